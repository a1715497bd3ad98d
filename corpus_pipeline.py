"""From raw documents to shards: the stages of the corpus pipeline, in order.

Each stage takes the session, its predecessor's documents and the folder of the given tables, applies one operator
to all of them and returns documents again; the last one adds each row's shard and its slot there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movara.functions.sharing import shared_folder
from movara.llm.common import with_record
from movara.llm.decontaminate import decontaminate
from movara.llm.mixing import mix_uploads
from movara.llm.near_texts import one_per_text
from movara.llm.quality_votes import score_uploads
from movara.llm.queries import quality_model, test_questions
from movara.llm.shards import shard_uploads


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours accept.

    An empty or missing text is scored like any other; repeated rows get one score each, the same; extra columns are carried along.
    """
    scored = score_uploads(with_record(docs), quality_model(spark, docs, sf_dir), carry=("record",))
    return scored.where("score >= 0.5").select("record.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, rows without one last.

    Candidates are the SimHash groups of ``simhash.near_copies`` and, beyond its radius, MinHash buckets; a five-word Jaccard of at least 0.8 settles each link.
    Empty and missing texts are one group; of rows with one id and text the one of the smallest hash stays.
    """
    return one_per_text(with_record(docs)).select("record.*")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote no test question or answer; those without words stay, repeated rows share their fate."""
    found = decontaminate(with_record(docs), test_questions(spark, sf_dir), carry=("record",))
    return found.where("n_hit = 0").select("record.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Rows without source are a source of their own; empty and missing texts have no words and are never taken twice.
    """
    taken = mix_uploads(with_record(docs), carry=("record",))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return taken.select("record", copies).select("record.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``; columns of these names are replaced. Repeated rows keep their rows and slots of their own."""
    kept = [F.col(f"record.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return shard_uploads(with_record(docs), carry=("record",)).select(*kept, "shard", "slot")


STAGES = [
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The votes, fingerprints and knapsack have no SQL form; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
