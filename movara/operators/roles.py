"""Column roles: types, periods, metrics, domains, dimensions, time axis.

A profiling pass turns a table into a catalog frame (one row per column with its
statistics over all rows); the role rules then run on catalog rows, so catalogs of many
tables can be classified in one job. An explicit analysis spec always wins over inference.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movara.functions.columns import exact_sum, first_match, nan_to_null, round_to
from movara.functions.dates import UNIX_SECONDS, parse_date, parse_period, parse_unix, year_month_date, year_number
from movara.functions.names import (
    ADJUSTMENT_TERMS,
    IDENTIFIER_TERMS,
    NOISE_TERMS,
    contains_any_col,
    name_flags,
    whole_word_col,
)
from movara.functions.text import normalize, normalize_name
from movara.functions.sharing import shared
from movara.operators.stats import per_column
from movara.operators.vocabulary import (
    DATE_NAME_TERMS,
    MONTH_TERMS,
    NEGATIVE_ALLOWED_TERMS,
    PERIOD_TERMS,
    PURCHASE_WORDS,
    SALES_WORDS,
    SHORT_IDENTIFIER_TERMS,
    YEAR_TERMS,
)

# Period shapes of text columns.
MONTH_SHAPES = (
    r"^\d{4}[/-]\d{1,2}$",
    r"^\d{1,2}[/-]\d{4}$",
    r"(?i)^(jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez)[a-z]*[\s_/-]?\d{2,4}$",
)
QUARTER_SHAPES = (
    r"(?i)^\d{4}[-_/ ]?(t|q|tri|trim)\d$",
    r"(?i)^(t|q|tri|trim)\d[-_/ ]?\d{2,4}$",
    r"(?i)^\d[\s_/-]?[tq]\d{2,4}$",
)
FULL_DATE_SHAPES = (
    r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$",
    r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}[ T]\d{1,2}:\d{2}",
)


SHAPE_COLUMNS = (
    "month_ratio", "period_ratio", "quarter_ratio", "full_date_ratio", "text_unix_ratio", "text_parsed_ratio",
    "parsed_rows", "first_year", "last_year",
)

# Every accepted date, period and number holds a digit; other cells only count as misses.
ANY_DIGIT = "[0-9]"


def is_unix(number: Column) -> Column:
    low, high = UNIX_SECONDS
    size = F.abs(number)
    inside = size.between(low, high) | size.between(low * 1000.0, high * 1000.0)
    return F.coalesce(inside, F.lit(False))


def keys_of(frame: DataFrame) -> list[str]:
    """``table`` where the catalog holds several tables; every rule then works table by table."""
    return ["table"] if "table" in frame.columns else []


def long_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """The filled text cells of a table as (column, text)."""
    cells = df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns])
    return cells.unpivot([], columns, "column", "text").where(F.col("text").isNotNull())


def text_shapes(long: DataFrame) -> DataFrame:
    """Shares of date, period and unix shapes per text column, over all cells of ``long_texts``, of one table or of many.

    Cells are counted by text, so a repeated value is parsed once and hot values collapse before the shuffle; cells that
    cannot be dates collapse to one row.
    """
    keys = keys_of(long)
    possible = F.when(F.col("text").rlike(ANY_DIGIT), F.col("text"))
    counted = long.groupBy(*keys, "column", possible.alias("text")).agg(F.count("*").alias("copies"))
    text = F.col("text")
    flags = {f"m{i}": text.rlike(p) for i, p in enumerate(MONTH_SHAPES)}
    flags |= {f"q{i}": text.rlike(p) for i, p in enumerate(QUARTER_SHAPES)}
    flags["full"] = text.rlike("|".join(f"(?:{p})" for p in FULL_DATE_SHAPES))
    flags["unix"] = is_unix(text.try_cast("double"))
    parsed = (
        counted.withColumn("other", F.coalesce(parse_period(text), parse_unix(text)))
        .withColumn("month_first", F.coalesce("other", parse_date(text)))
        .withColumn("day_first", F.coalesce("other", parse_date(text, day_first=True)))
        .withColumn("year", F.year(F.coalesce("day_first", "month_first")))
    )
    hits = lambda test: F.sum(F.when(test, F.col("copies")).otherwise(0))
    summed = parsed.groupBy(*keys, "column").agg(
        F.sum("copies").alias("cells"),
        *[hits(test).alias(name) for name, test in flags.items()],
        F.greatest(hits(F.col("month_first").isNotNull()), hits(F.col("day_first").isNotNull())).alias("parsed_rows"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    share = lambda *names: F.greatest(*[F.col(n) for n in names], F.lit(0)) / F.col("cells")
    return summed.select(
        *keys,
        "column",
        share("m0", "m1", "m2").alias("month_ratio"),
        share("m0", "m1", "q0", "q1").alias("period_ratio"),
        share("q0", "q1", "q2").alias("quarter_ratio"),
        share("full").alias("full_date_ratio"),
        share("unix").alias("text_unix_ratio"),
        share("parsed_rows").alias("text_parsed_ratio"),
        "parsed_rows",
        "first_year",
        "last_year",
    )


def column_classes(df: DataFrame) -> dict[str, str]:
    """Each column as numeric, datetime, text or, where it holds nested or binary values, other."""
    temporal, scalar = (T.DateType, T.TimestampType, T.TimestampNTZType), (T.StringType, T.BooleanType, T.NullType)
    kind = lambda t: "numeric" if isinstance(t, T.NumericType) else "datetime" if isinstance(t, temporal) else "text" if isinstance(t, scalar) else "other"
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def column_sums(df: DataFrame) -> DataFrame:
    """Position, physical class and value sums of every column, in one pass."""
    classes = column_classes(df)
    position = {c: i for i, c in enumerate(df.columns)}

    def measures(c: str) -> dict[str, Column]:
        own = {"position": F.lit(position[c]), "class": F.lit(classes[c]), "rows": F.count("*"), "present": F.count(F.col(c))}
        if classes[c] != "numeric":
            return own | {name: F.lit(0.0) for name in ("negative_ratio", "abs_sum", "positive_sum", "number_unix_ratio")}
        number = F.col(c).cast("double")
        total = lambda v: F.coalesce(exact_sum(v), F.lit(0.0))
        return own | {
            "negative_ratio": F.coalesce(F.try_divide(F.count_if(number < 0), F.count(number)), F.lit(0.0)),
            "abs_sum": total(F.abs(number)),
            "positive_sum": total(F.greatest(number, F.lit(0.0))),
            "number_unix_ratio": F.coalesce(F.avg(F.when(number.isNotNull(), is_unix(number).cast("double"))), F.lit(0.0)),
        }

    return per_column(df, df.columns, measures)


def column_catalog(df: DataFrame) -> DataFrame:
    """Position, physical class, value sums and shape shares of every column."""
    texts = [c for c, kind in column_classes(df).items() if kind == "text"]
    return with_shapes(column_sums(df), text_shapes(long_texts(df.select(*[F.col(c).cast("string").alias(c) for c in texts]), texts)) if texts else None)


def tables_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """``column_catalog`` of many tables of different columns as one frame with a ``table`` key, for one job.

    The text cells of all tables are one long frame, counted and parsed together; the rules that read the result work table by table.
    """
    sums, texts = [], []
    for name, df in tables.items():
        sums.append(column_sums(df).withColumn("table", F.lit(name)))
        own = [c for c, kind in column_classes(df).items() if kind == "text"]
        if own:
            texts.append(long_texts(df.select(*[F.col(c).cast("string").alias(c) for c in own]), own).withColumn("table", F.lit(name)))
    shapes = text_shapes(reduce(DataFrame.unionByName, texts)) if texts else None
    return with_shapes(reduce(DataFrame.unionByName, sums), shapes)


def with_shapes(stats: DataFrame, shapes: DataFrame | None) -> DataFrame:
    joined = stats.join(shapes, [*keys_of(stats), "column"], "left") if shapes is not None else stats.select(
        "*", *[F.lit(None).cast("double").alias(c) for c in SHAPE_COLUMNS]
    )
    ratios = [c for c in joined.columns if c.endswith("_ratio")]
    filled = joined.fillna(0.0, subset=ratios)
    is_text = F.col("class") == "text"
    return filled.select(
        "*",
        F.when(is_text, F.col("text_unix_ratio")).otherwise(F.col("number_unix_ratio")).alias("unix_ratio"),
        F.when(is_text, F.col("text_parsed_ratio")).otherwise(F.col("number_unix_ratio")).alias("parsed_ratio"),
    ).drop("text_unix_ratio", "text_parsed_ratio", "number_unix_ratio")


def with_types(catalog: DataFrame) -> DataFrame:
    """Logical type of each column: numeric, categorical or datetime."""
    hint = contains_any_col("column", DATE_NAME_TERMS)
    numeric, text = F.col("class") == "numeric", F.col("class") == "text"
    kind = first_match(
        (numeric & hint & (F.col("parsed_ratio") >= 0.8), "datetime"),
        (numeric, "numeric"),
        (F.col("class") == "other", "categorical"),
        (~text, "datetime"),
        (F.col("present") == 0, "categorical"),
        (F.col("period_ratio") >= 0.65, "categorical"),
        ((F.col("full_date_ratio") < 0.65) & ~hint, "categorical"),
        (F.col("parsed_ratio") >= 0.8, "datetime"),
        default="categorical",
    )
    return catalog.withColumn("type", kind)


def period_suggestions(typed: DataFrame) -> DataFrame:
    """Columns that hold months, quarters or unix times but are not typed as dates."""
    name = normalize("column")
    hint = F.when(name.rlike("|".join(PERIOD_TERMS)), 0.65).otherwise(0.0)
    stamp = name.contains("timestamp")
    month, quarter, unix = F.col("month_ratio"), F.col("quarter_ratio"), F.col("unix_ratio")
    kind = first_match(
        ((month >= 0.65) | (name.contains("mes") & (month >= 0.35)), "month_period"),
        ((quarter >= 0.65) | (name.contains("trim") & (quarter >= 0.35)), "quarter_period"),
        ((unix >= 0.8) | (stamp & (unix >= 0.35)), "unix_timestamp"),
    )
    confidence = first_match(
        (F.col("kind") == "month_period", F.greatest(month, hint)),
        (F.col("kind") == "quarter_period", F.greatest(quarter, hint)),
        default=F.greatest(unix, F.when(stamp, 0.65).otherwise(0.0)),
    )
    rows = typed.where((F.col("type") != "datetime") & (F.col("present") > 0)).withColumn("kind", kind)
    return rows.where(F.col("kind").isNotNull()).select(
        *keys_of(typed), "column", "position", "kind", round_to(confidence, 2).alias("confidence")
    )


def date_candidates(typed: DataFrame) -> DataFrame:
    """Typed dates with full confidence, then the suggested periods."""
    dates = typed.where(F.col("type") == "datetime").select(
        *keys_of(typed), "column", "position", F.lit("datetime").alias("kind"), F.lit(1.0).alias("confidence")
    )
    return dates.unionByName(period_suggestions(typed))


def profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """Typed catalog of many tables, computed once for all its readers (one row a column of a table)."""
    return shared(with_types(tables_catalog(tables)))


def profile(df: DataFrame) -> DataFrame:
    """Typed catalog of a table, computed in one pass for all its readers (one row per column)."""
    return shared(with_types(column_catalog(df)))


def name_catalog(df: DataFrame) -> DataFrame:
    """Column names with their present cells: all that tests of names need, without parsing a cell."""
    return per_column(nan_to_null(df), df.columns, lambda c: {"present": F.count(F.col(c))})


def flagged_names(catalog: DataFrame) -> DataFrame:
    return catalog.select(*keys_of(catalog), "column", "present", *[c.alias(n) for n, c in name_flags("column").items()])


def vocabulary_matches(catalog: DataFrame, vocabularies: dict[str, Iterable[str]]) -> DataFrame:
    """Terms contained in each column name: (column, vocabulary, rank, term).

    The fixed vocabulary is unfolded per catalog row and filtered, so no join is needed.
    """
    entries = [
        F.struct(F.lit(v).alias("vocabulary"), F.lit(i).alias("rank"), F.lit(t).alias("term"))
        for v, terms in vocabularies.items()
        for i, t in enumerate(terms)
    ]
    named = catalog.withColumn("_name", normalize("column"))
    hits = named.select("*", F.inline(F.filter(F.array(*entries), lambda e: F.contains(F.col("_name"), e["term"]))))
    return hits.drop("_name")


def metric_scores(
    typed: DataFrame,
    domain: str,
    domain_terms: Iterable[str],
    value_terms: Iterable[str],
    domain_base: int = 120,
    value_base: int = 80,
    zero_sum_penalty: bool = True,
) -> DataFrame:
    """How well each numeric column serves as the main metric; the best has rank 1."""
    numeric = typed.where(F.col("type") == "numeric")
    hits = vocabulary_matches(numeric, {"domain": domain_terms, "value": value_terms})
    worth = first_match(
        (F.col("vocabulary") == "domain", F.greatest(F.lit(18), F.lit(domain_base) - F.col("rank") * 5)),
        default=F.greatest(F.lit(10), F.lit(value_base) - F.col("rank") * 3),
    )
    keys = keys_of(typed)
    points = hits.groupBy(*keys, "column").agg(F.sum(worth).alias("points"))
    rows = numeric.join(points, [*keys, "column"], "left")
    tolerant = contains_any_col("column", NEGATIVE_ALLOWED_TERMS)
    negative = F.col("negative_ratio")
    crossed = F.lit(0)
    if domain == "vendas":
        crossed = F.when(contains_any_col("column", PURCHASE_WORDS), 70).otherwise(0)
    elif domain == "compras":
        crossed = F.when(contains_any_col("column", SALES_WORDS), 50).otherwise(0)
    score = (
        F.coalesce("points", F.lit(0)).cast("double")
        - F.when(contains_any_col("column", ADJUSTMENT_TERMS), 220).otherwise(0)
        - crossed
        - F.when(tolerant, 0.0).otherwise(negative * 160)
        - F.when(~tolerant & (negative >= 0.35), 120).otherwise(0)
    )
    if zero_sum_penalty:
        score = score - F.when(F.col("abs_sum") == 0, 40).otherwise(0)
    unusable = (
        whole_word_col("column", IDENTIFIER_TERMS) | whole_word_col("column", NOISE_TERMS) | (F.col("present") == 0)
    )
    scored = rows.withColumn("score", round_to(F.when(unusable, -1000.0).otherwise(score)))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("column"))
    return scored.select(*keys, "column", "score", F.row_number().over(best).cast("bigint").alias("rank"))


def role_scores(typed: DataFrame, groups: dict[str, Iterable[str]]) -> DataFrame:
    """Score of every numeric column for each named role, positive scores only."""
    numeric = typed.where(F.col("type") == "numeric")
    hits = vocabulary_matches(numeric, groups)
    totals = hits.groupBy(*keys_of(typed), "vocabulary", "column", "present").agg(F.sum(100 - F.col("rank") * 4).alias("points"))
    score = (
        F.col("points")
        - F.when(whole_word_col("column", SHORT_IDENTIFIER_TERMS), 500).otherwise(0)
        - F.when(F.col("present") == 0, 200).otherwise(0)
    )
    return totals.select(*keys_of(typed), F.col("vocabulary").alias("role"), "column", score.cast("bigint").alias("score")).where(
        F.col("score") > 0
    )


def metric_map(typed: DataFrame, primary: Iterable[str], supports: dict[str, Iterable[str]]) -> DataFrame:
    """Primary metric and, among the other columns, one column per support role.

    Ties go to the later name; without a named primary metric the largest magnitude stands in.
    """
    keys = keys_of(typed)
    scored = role_scores(typed, {"primary_metric": primary, **supports})
    best = F.max_by(F.struct("column", "score"), F.struct("score", "column"))
    named = scored.where(F.col("role") == "primary_metric").groupBy(*keys).agg(best.alias("p"))
    usable = typed.where(F.col("type") == "numeric").withColumn("_id", whole_word_col("column", SHORT_IDENTIFIER_TERMS))
    largest = usable.groupBy(*keys).agg(
        F.max_by("column", F.struct(~F.col("_id"), F.col("abs_sum"), -F.col("position"))).alias("largest")
    )
    both = largest.join(named, keys, "left") if keys else largest.crossJoin(named)  # one row each
    chosen = both.select(
        *keys, F.lit("primary_metric").alias("role"), F.coalesce(F.col("p.column"), "largest").alias("column"), F.col("p.score").alias("score")
    )
    supporting = scored.where(F.col("role") != "primary_metric")
    taken = chosen.select(*keys, F.col("column").alias("_primary"))
    others = supporting.join(taken, keys) if keys else supporting.crossJoin(taken)
    found = others.where(F.col("column") != F.col("_primary")).groupBy(*keys, "role").agg(best.alias("b"))
    return chosen.unionByName(found.select(*keys, "role", "b.column", "b.score"))


def domain_scores(catalog: DataFrame, terms: dict[str, Iterable[str]], metrics: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """Distinct terms hit per domain, metric terms counting double; the first best domain wins."""
    order = first_match(*[(F.col("domain") == d, i) for i, d in enumerate(terms)])
    keys = keys_of(catalog)
    hits = vocabulary_matches(catalog, terms).select(*keys, F.col("vocabulary").alias("domain"), "term", F.lit(1).alias("w"))
    if metrics:
        extra = vocabulary_matches(catalog, metrics)
        hits = hits.unionByName(extra.select(*keys, F.col("vocabulary").alias("domain"), "term", F.lit(2).alias("w")))
    scores = hits.distinct().groupBy(*keys, "domain").agg(F.sum("w").alias("score"))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), order)
    return scores.withColumn("rank", F.row_number().over(best).cast("bigint"))


def chosen_domain(scores: DataFrame, minimum: int, base: float, step: float, cap: float) -> DataFrame:
    """The winning domain and its confidence, or the generic one."""
    best = scores.agg(F.min_by(F.struct("domain", "score"), "rank").alias("b"))
    enough = F.coalesce(F.col("b.score") >= minimum, F.lit(False))
    confidence = F.least(F.lit(cap), F.lit(base) + F.col("b.score") * step)
    return best.select(
        F.when(enough, F.col("b.domain")).otherwise("generico").alias("domain"),
        F.when(enough, round_to(confidence, 2)).otherwise(0.35).alias("confidence"),
    )


def pick_dimensions(typed: DataFrame, groups: dict[str, Iterable[str]], leftovers: bool = True) -> DataFrame:
    """First categorical column of each group's first matching term; then the unused columns."""
    keys = keys_of(typed)
    categorical = typed.where(F.col("type") == "categorical")
    hits = vocabulary_matches(categorical, groups)
    order = first_match(*[(F.col("vocabulary") == g, i) for i, g in enumerate(groups)])
    first = hits.groupBy(*keys, "vocabulary").agg(F.min_by(F.struct("column", "position"), F.struct("rank", "position")).alias("c"))
    named = first.select(*keys, "c.column", "c.position", F.col("vocabulary").alias("label"), order.alias("o"))
    once = named.groupBy(*keys, "column", "position").agg(F.min_by("label", "o").alias("label"), F.min("o").alias("o"))
    if leftovers:
        rest = categorical.join(once.select(*keys, "column"), [*keys, "column"], "left_anti")
        once = once.unionByName(
            rest.select(*keys, "column", "position", F.lit("grupo").alias("label"), (F.col("position") + 1000).alias("o"))
        )
    ranked = Window.partitionBy(*keys).orderBy("o")
    return once.select(*keys, "column", "label", F.row_number().over(ranked).cast("bigint").alias("rank"))


def fallback_metrics(typed: DataFrame) -> DataFrame:
    """Metric choices when no name scores: by positive sum (dashboard) and by magnitude (analysis)."""
    numeric = typed.where(F.col("type") == "numeric")
    identifier = whole_word_col("column", IDENTIFIER_TERMS)
    noise = whole_word_col("column", NOISE_TERMS) | contains_any_col("column", ADJUSTMENT_TERMS)
    shown = F.struct((~identifier & ~noise).alias("a"), (~identifier).alias("b"), F.col("positive_sum"), -F.col("position"))
    short = ~whole_word_col("column", SHORT_IDENTIFIER_TERMS)
    return numeric.groupBy(*keys_of(typed)).agg(
        F.max_by("column", shown).alias("dashboard_metric"),
        F.max_by("column", F.struct(short.alias("a"), F.col("abs_sum"), -F.col("position"))).alias("analysis_metric"),
    )


def year_column(df: DataFrame, exclude: str) -> str | None:
    """The column that most often holds a year; one row per column is read by the driver."""
    others = [c for c in df.columns if c != exclude]
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in others])
    rows = df.agg(F.count("*")).scalar()
    long = cells.unpivot([], others, "column", "text").where(F.col("text").rlike(r"\d"))
    # a repeated text is parsed once
    counted = long.groupBy("column", "text").agg(F.count("*").alias("copies"))
    hits = F.sum(F.when(year_number("text").isNotNull(), F.col("copies")).otherwise(0))
    shares = counted.groupBy("column").agg((hits / rows).alias("share")).where("share >= 0.6")
    bonus = contains_any_col("column", YEAR_TERMS).cast("int")
    best = shares.orderBy(F.desc("share"), bonus.desc(), F.desc("column")).limit(1).collect()
    return best[0]["column"] if best else None


def time_axis(df: DataFrame, typed: DataFrame) -> DataFrame:
    """The period axis: a year and month pair, else a date column, else a suggested period.

    Candidates come from names and types; each must parse in at least 60 % of all rows, and
    a month name without a year is refused. Output: one row, ``columns`` null when none fits.
    """
    names = df.columns
    matching = lambda terms, pool: next((c for t in terms for c in pool if t in normalize_name(c)), None)
    year = matching(YEAR_TERMS, names)
    month = matching(MONTH_TERMS, [c for c in names if c != year])
    if month and not year:
        year = year_column(df, month)
    months = contains_any_col("column", MONTH_TERMS)
    month_only = months & (F.col("first_year") == 2000) & (F.col("last_year") == 2000)
    listed = (
        date_candidates(typed)
        .join(typed.drop("position"), "column")
        .where(~F.coalesce(month_only, F.lit(False)))
        .select(
            F.when(F.col("kind") == "datetime", 1).otherwise(2).alias("tier"),
            "position",
            F.col("column").alias("columns"),
            F.try_divide(F.coalesce("parsed_rows", F.col("present")), F.col("rows")).alias("ratio"),
        )
    )
    if year and month:
        # a repeated pair is parsed once
        counted = df.groupBy(F.col(year).alias("year"), F.col(month).alias("month")).agg(F.count("*").alias("copies"))
        hits = F.sum(F.when(year_month_date("year", "month").isNotNull(), F.col("copies")).otherwise(0))
        pair = counted.agg(
            F.lit(0).alias("tier"),
            F.lit(0).alias("position"),
            F.lit(f"{year} + {month}").alias("columns"),
            F.try_divide(hits.cast("double"), F.sum("copies")).alias("ratio"),
        )
        listed = pair.unionByName(listed)
    best = listed.where(F.col("ratio") >= 0.6).agg(
        F.min_by(F.struct("columns", "ratio"), F.struct("tier", "position")).alias("best")
    )
    return best.select(F.col("best.columns").alias("columns"), round_to("best.ratio").alias("ratio"))
