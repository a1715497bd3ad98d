"""URL filters: rules first, then a tree of path templates learnt per host, in DataFrame operations only.

The paths of a host form a tree of segments. Number-like segments become classes, and level by level a branch becomes
a wildcard where its share of blocked pages does not differ from its siblings' by more than chance. A template is rejected
when its purity, the blocked share of its labelled pages smoothed towards its host's and the whole table's,
reaches the limit. Pages that a rule decides are the labelled ones.

The operator is general: the library's own records have no addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movara.functions.joins import attached
from movara.llm.common import saved

#: A position with so many branches is variable even where they have no labels.
VARIABLE = 4
#: Standard errors by which a branch's blocked share must differ to be kept.
DIFFERENT = 2.58
#: Labelled pages that the smoothing counts as.
SMOOTHING = 4.0
REJECTED = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Kinds of variable segments, the first that fits.
CLASSES = (
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z", "{date}"),
    (r"^[0-9]+\z", "{number}"),
    (r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}\z", "{hex}"),
    (r"(?s)^(?=.*[0-9])[^.]{16,}\z", "{slug}"),
)
#: A segment's name and its file ending.
NAMED = r"(?s)^(.+?)(\.[A-Za-z]{1,5})?\z"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a missing address or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    domain, _, prefix = rule.partition("/")
    return ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{prefix}")


def winning_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one. ``rules``: (verdict, ``host/path``), a written list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        fits = rule_fits(text, host, path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Non-empty segments with their classes; a file ending stays."""

    def classed(segment: Column) -> Column:
        stem, ending = (F.regexp_extract(segment, NAMED, n) for n in (1, 2))
        name = segment
        for pattern, kind in reversed(CLASSES):
            name = F.when(stem.rlike(pattern), F.concat(F.lit(kind), ending)).otherwise(name)
        return name

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), classed)


def _rate(blocked: Column, labelled: Column, towards: Column) -> Column:
    return (blocked + SMOOTHING * towards) / (labelled + SMOOTHING)


def _wildcards(paths: DataFrame, level: int) -> DataFrame:
    """Extend every open template by its segment of this level, or by ``*`` where branches are alike.

    A path with no other below its template has nothing left to be compared with and takes all its segments.
    """
    here = paths.where("open").withColumn("segment", F.element_at("segments", level))
    branches = here.groupBy("host", "template", "segment").agg(
        F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count("*").alias("paths")
    )
    nodes = branches.groupBy("host", "template").agg(
        F.count("*").alias("fanout"), F.sum("paths").alias("all_paths"),
        F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"),
    )
    others = F.col("all_labelled") - F.col("labelled")
    own = F.try_divide("blocked", "labelled")
    rest = F.try_divide(F.col("all_blocked") - F.col("blocked"), others)
    pooled = F.try_divide("all_blocked", "all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "labelled") + F.try_divide(F.lit(1.0), others)))
    differs = F.coalesce(F.abs(own - rest) > DIFFERENT * error, F.lit(False))
    comparable = (F.col("labelled") > 0) & (others > 0)
    alike = ((F.col("fanout") >= VARIABLE) | comparable) & (F.col("fanout") > 1) & ~differs
    named = branches.join(nodes, ["host", "template"]).select(
        "host", "template", "segment", F.when(alike, F.lit("*")).otherwise(F.col("segment")).alias("name"), (F.col("all_paths") == 1).alias("alone")
    )
    rest = F.array_join(F.slice("segments", level, F.size("segments")), "/")
    longer = attached(here, named, ["host", "template", "segment"], F.col("path_key")).withColumns(
        {
            "template": F.concat("template", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("name"))),
            "open": ~F.col("alone") & (F.size("segments") > level),
        }
    )
    return longer.select(paths.columns).unionByName(paths.where("NOT open"))


def path_templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path_key, segments, label 1 blocked / 0 allowed / null) to one row a (host, path_key).

    Each has its ``template`` and the template's smoothed ``purity``. Work after the first aggregate is on
    distinct classed paths, a round a level as far down as paths still share a template.
    """
    paths = saved(
        pages.groupBy("host", "path_key", "segments")
        .agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
        .withColumns({"template": F.lit(""), "open": F.size("segments") > 0})
    )
    level = 0
    while not paths.where("open").isEmpty():
        level += 1
        paths = saved(_wildcards(paths, level))
    sums = F.sum("labelled").alias("n"), F.sum("blocked").alias("b")
    whole = paths.agg(*sums).first()
    overall = F.lit((whole["b"] or 0) / whole["n"] if whole["n"] else 0.0)
    hosts = paths.groupBy("host").agg(*sums).select("host", _rate(F.col("b"), F.col("n"), overall).alias("host_rate"))
    templates = (
        paths.groupBy("host", "template")
        .agg(*sums)
        .join(hosts, "host")
        .select("host", "template", _rate(F.col("b"), F.col("n"), F.col("host_rate")).alias("purity"))
    )
    return attached(paths, templates, ["host", "template"], F.col("path_key")).select("host", "path_key", "template", "purity")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], rejected: float = REJECTED) -> DataFrame:
    """A verdict for every page: its rule's, else its template's.

    ``pages``: ``page_id``, ``url``. Returns ``page_id``, ``host``, ``path``, ``rule`` (the winning one, else null), ``verdict``
    (``allow`` or ``block``), ``template`` and ``purity`` (the blocked share that it is judged by).

    A missing address, or one without ``://``, has an empty host and path and is judged like any other; repeated rows
    keep their rows and count each as evidence; without any labelled page everything is allowed. Of
    equally long rules the last in alphabetical order wins.
    """
    host, path = split_url(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = winning_rule(rules, F.col("host"), F.col("path"))
    parts = read.select("*", rule.alias("rule"), says.alias("says"), segments(F.col("path")).alias("segments")).withColumn(
        "path_key", F.array_join("segments", "/")
    )
    label = F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0)
    templates = path_templates(parts.select("host", "path_key", "segments", label.alias("label")))
    verdict = F.coalesce("says", F.when(F.col("purity") >= rejected, "block").otherwise("allow"))
    return attached(parts, templates, ["host", "path_key"], F.col("page_id")).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )
