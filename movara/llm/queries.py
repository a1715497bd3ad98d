"""One registered query an operator: the given tables to its records, its results to the published columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from movara.functions.sharing import shared_folder, written
from movara.llm.collocations import collocations
from movara.llm.common import table, uploads
from movara.llm.decontaminate import decontaminate
from movara.llm.licences import scan_licences
from movara.llm.mixing import mix_uploads
from movara.llm.personal_data import KINDS as PERSONAL
from movara.llm.personal_data import scan_personal_data
from movara.llm.prefix_trie import end_digests, prefix_trie, turn_keys
from movara.llm.quality_votes import fit_votes, score_uploads
from movara.llm.registry import query
from movara.llm.secrets import kind_count, scan_secrets, spelled
from movara.llm.shards import shard_uploads
from movara.llm.simhash import near_copies
from movara.llm.url_filter import DIFFERENT, REJECTED, SMOOTHING, VARIABLE, judge_urls
from movara.llm.vector_search import top_inner_products
from movara.llm.web_archive import convert_arcs, read_warc, write_arc


def digest(column) -> F.Column:
    return F.sha2(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"), 256)


def test_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("content")
    )


OP2_SQL = r"""
WITH i AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
p AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS words
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
),
o AS (
  SELECT c.k, c.s, c.n, p.id
  FROM (
    SELECT k, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
    FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p))
  ) c JOIN p ON c.n = p.n AND c.words = p.words
),
h AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS place FROM o) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, id FROM o) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(uploads(table(spark, sf_dir, "documents")), test_questions(spark, sf_dir))
    return found.select(
        F.col("dataset_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("question_ids").cast("long").alias("n_items"),
        digest(F.array_join("question_ids", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(uploads(table(spark, sf_dir, "documents"))).select(
        F.col("dataset_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.c) = len(d.c)
  WHERE q.vec_id % 20 = 0
),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op10_exact_top_k", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector")
    )
    found = top_inner_products(vectors, vectors.where("vector_id % 20 = 0"), k=20, scale=64)
    return found.select("query_id", "rank", F.col("vector_id").alias("vec_id"), "score")


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = uploads(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("content"), F.lit("")).cast("binary"))
    return shard_uploads(documents.withColumn("text_crc32", crc), carry=("dataset_id", "text_crc32")).select(
        F.col("dataset_id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_uploads(uploads(table(spark, sf_dir, "documents"))).select(
        F.col("dataset_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


#: Levels of the path tree's twin, a statement each; it raises an error if a path is deeper.
TWIN_LEVELS = 12

#: The rules of the url query.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def url_sql(rules: list[tuple[str, str]]) -> str:
    """The same rules and path tree as statements, one step a level."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rule, says = "NULL", "NULL"
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, prefix = text.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{prefix}')"
        rule, says = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    stem, ending = (f"regexp_extract(x, '(?s)^(.+?)(\\.[A-Za-z]{{1,5}})?$', {n})" for n in (1, 2))
    classed = f"""CASE WHEN regexp_matches({stem}, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN concat('{{date}}', {ending})
      WHEN regexp_matches({stem}, '^[0-9]+$') THEN concat('{{number}}', {ending})
      WHEN regexp_matches({stem}, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches({stem}, '[0-9]') THEN concat('{{hex}}', {ending})
      WHEN regexp_matches({stem}, '^[^.]{{16,}}$') AND regexp_matches({stem}, '[0-9]') THEN concat('{{slug}}', {ending})
      ELSE x END"""
    steps = [
        f"""u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
w AS (SELECT *, {rule} AS rule, {says} AS says, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM v),
r AS (SELECT page_id, host, path, rule, says,
             CASE WHEN len(parts) > {TWIN_LEVELS} THEN error('a path is deeper than the twin') ELSE list_transform(parts, lambda x: {classed}) END AS segments
      FROM w),
p0 AS (SELECT host, segments, count(says) AS labelled, count(*) FILTER (says = 'block') AS blocked, '' AS template
       FROM r GROUP BY host, segments)"""
    ]
    for level in range(1, TWIN_LEVELS + 1):
        a, b = f"p{level - 1}", f"p{level}"
        own, rest = "b.blocked / b.labelled", "(n.blocked - b.blocked) / (n.labelled - b.labelled)"
        spread = "sqrt((n.blocked / n.labelled) * (1 - n.blocked / n.labelled) * (1.0 / b.labelled + 1.0 / (n.labelled - b.labelled)))"
        both = "(b.labelled > 0 AND n.labelled > b.labelled)"
        steps.append(
            f"""b{level} AS (SELECT host, template, segments[{level}] AS segment, sum(labelled) AS labelled, sum(blocked) AS blocked
      FROM {a} WHERE len(segments) >= {level} GROUP BY ALL),
n{level} AS (SELECT host, template, count(*) AS fanout, sum(labelled) AS labelled, sum(blocked) AS blocked FROM b{level} GROUP BY ALL),
{b} AS (SELECT p.host, p.segments, p.labelled, p.blocked,
             CASE WHEN len(p.segments) < {level} THEN p.template
                  WHEN n.fanout > 1 AND (n.fanout >= {VARIABLE} OR {both})
                       AND NOT ({both} AND coalesce(abs({own} - {rest}) > {DIFFERENT}::DOUBLE * {spread}, false))
                  THEN concat(p.template, '/*') ELSE concat(p.template, '/', b.segment) END AS template
      FROM {a} p LEFT JOIN b{level} b ON p.host = b.host AND p.template = b.template AND p.segments[{level}] = b.segment
                 LEFT JOIN n{level} n ON p.host = n.host AND p.template = n.template)"""
        )
    last, k = f"p{TWIN_LEVELS}", f"{SMOOTHING}::DOUBLE"
    steps.append(
        f"""g AS (SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0.0) AS rate FROM {last}),
h AS (SELECT host, (sum(blocked) + {k} * any_value(rate)) / (sum(labelled) + {k}) AS rate FROM {last}, g GROUP BY host),
t AS (SELECT x.host, template, (sum(blocked) + {k} * any_value(rate)) / (sum(labelled) + {k}) AS purity
      FROM {last} x JOIN h USING (host) GROUP BY x.host, template)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.says, CASE WHEN purity >= {REJECTED}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, p.template AS template, purity
FROM r JOIN {last} p ON r.host = p.host AND r.segments = p.segments JOIN t ON t.host = p.host AND t.template = p.template"""
    )
    return "WITH " + ",\n".join(steps[:-1]) + ",\n" + steps[-1]


@query("op1_url_filters", url_sql(URL_RULES))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(uploads(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("dataset_id").alias("doc_id"),
        *[kind_count(F.col("certain"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        digest(spelled(F.col("certain"))).alias("base_sha256"),
        spelled(F.array_sort(F.concat("certain", "linked"))).alias("spans"),
    )


def held_out(doc_id) -> F.Column:
    """Rows that no quality model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str):
    reviews = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("dataset_id"), F.col("quality").alias("accepted")
    )
    return fit_votes(uploads(documents), reviews.where(~held_out(F.col("dataset_id"))))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_uploads(uploads(documents), quality_model(spark, documents, sf_dir))
    return scored.select(
        F.col("dataset_id").alias("doc_id"),
        held_out(F.col("dataset_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_licences")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(uploads(table(spark, sf_dir, "documents")))
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c)["label"])), ",")
    return found.select(
        F.col("dataset_id").alias("doc_id"),
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.col("phrases")["start"]).alias("first_word"),
        F.array_max(F.col("phrases")["start"]).alias("last_word"),
        said("phrases").alias("base_labels"),
        said("licences").alias("labels"),
        "score",
    )


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_personal_data(uploads(table(spark, sf_dir, "documents")))
    names = F.array(*[F.lit(k) for k in (*PERSONAL, *[f"likely_{k}" for k in PERSONAL])])
    # the model's kinds are listed after the certain ones
    likely = F.transform("likely", lambda s: s.withField("kind", s["kind"] + len(PERSONAL)))
    spell = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("certain", lambda s: s["kind"] == PERSONAL.index(kind))).cast("long")
    added = lambda kind: F.size(F.filter("likely", lambda s: s["kind"] == PERSONAL.index(kind))).cast("long")
    return found.select(
        F.col("dataset_id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in PERSONAL],
        digest(spell(F.col("certain"))).alias("base_sha256"),
        spell(F.array_sort(F.concat("certain", likely))).alias("spans"),
        *[added(k).alias(f"n_likely_{k}") for k in PERSONAL],
    )


#: The first turns of every hundredth conversation, shared out by a checksum of the borrower's id.
_CRC32 = """xor(list_reduce(flatten(list_transform(range(1, len(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295)"""
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
),
o AS (SELECT conv_id, key, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM t),
c AS (SELECT conv_id, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, pos, key, chars FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
  UNION ALL
  SELECT c.conv_id, 1, pos, key, chars FROM c JOIN o USING (conv_id) WHERE pos > h
),
k AS (SELECT conv_id, coalesce(list(key ORDER BY own, pos) FILTER (WHERE key IS NOT NULL), []) AS keys,
             coalesce(list(chars ORDER BY own, pos) FILTER (WHERE key IS NOT NULL), []) AS sizes FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
v AS (SELECT conv_id, d, len(keys) AS n, array_to_string(keys[1:d], '') AS node, array_to_string(keys[1:d - 1], '') AS parent,
             CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS chars
      FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM k)),
g AS (SELECT node, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, count(*) AS n,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = v.n), '')) AS ends FROM v GROUP BY node),
e AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.parent = g.node AND x.depth = g.depth + 1) AS kids FROM g),
s AS (SELECT a.node, count(*) FILTER (WHERE b.kids = 0) AS leaves, sum((b.n - 1) * b.chars) AS saved
      FROM e a JOIN e b ON starts_with(b.node, a.node) GROUP BY a.node)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, CASE WHEN e.depth > 0 THEN p.conv_id END AS parent_conv_id, e.n AS n_convs, e.kids AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN s USING (node) LEFT JOIN g p ON p.node = e.parent AND p.depth = e.depth - 1
"""


def rebuilt_turns(keys: DataFrame) -> DataFrame:
    """Turns (``conversation_id``, ``turn``, ``key``, ``chars``, ``row``) with the start of each conversation borrowed.

    A conversation takes the first turns of every hundredth one, as many as its id's checksum says, in the place of its own.
    Own turns that give way stay as rows without key, so that the conversation is known.
    """
    first = F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn", "key", "row"))
    starts = keys.withColumn("place", first).where("place <= 5").select("conversation_id", "place", "key", "chars", "row")
    borrowed = (F.crc32(F.col("conversation_id").cast("string").cast("binary")) % 6).cast("int")
    known = keys.select("conversation_id").distinct().withColumn("borrowed", borrowed)
    base = (F.col("conversation_id") - F.col("conversation_id") % 100).alias("base")
    lent = starts.where("conversation_id % 100 = 0").withColumnRenamed("conversation_id", "base")
    heads = known.select("conversation_id", "borrowed", base).join(lent, "base").where("place <= borrowed")
    dropped = starts.join(known, "conversation_id").where("place <= borrowed").select("row", F.lit(True).alias("dropped"))
    own = keys.join(dropped, "row", "left").select(
        "conversation_id", F.lit(1).alias("part"), "turn", F.when(F.col("dropped").isNull(), F.col("key")).alias("key"), "chars", "row"
    )
    return own.unionByName(
        heads.select("conversation_id", F.lit(0).alias("part"), F.col("place").cast("long").alias("turn"), "key", "chars", "row")
    )


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conversation_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content")
    )
    keys = turn_keys(turns, "conversation_id", "turn").withColumn("row", F.monotonically_increasing_id())
    trie = prefix_trie(rebuilt_turns(written(keys, "turn-keys")), ["part", "turn", "key", "row"])
    return end_digests(trie).select(
        F.col("conversation_id").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent_id").alias("parent_conv_id"),
        F.col("n_conversations").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved_chars").alias("saved_tokens"),
        "ends_sha256",
    )


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k AS words, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k)) GROUP BY ALL
),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND a >= 30),
s AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.words = k AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.words = c.words - k AND r.phrase = array_to_string(ws[k + 1 :], ' ')
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, phrase, max(a) AS cover
  FROM (SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM c))) GROUP BY ALL
),
x AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN o USING (lang, phrase) WHERE cover IS NULL OR CAST(100 AS HUGEINT) * cover < CAST(80 AS HUGEINT) * a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM x JOIN t USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("content"))
    return collocations(texts, by="lang", least=30, most=2000, covered=80)


OP11_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
),
b AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT)) AS v FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to
FROM b
"""


@query("op11_web_archive", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("capture_id"), "url", F.lit(None).cast("timestamp").alias("captured_at"), F.col("html").alias("payload")
    )
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(captures, arc)
    convert_arcs(spark, arc, warc)
    return read_warc(spark, warc).where("record_type IN ('response', 'revisit')").select(
        F.col("capture_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_capture").alias("refers_to")
    )
