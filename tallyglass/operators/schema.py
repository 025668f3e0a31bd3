"""Schema inference, patterns, contracts and their enforcement over whole columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyglass.functions.expressions import (
    atomic_columns, count_if, dbl, distinct_counts, logical_type, long_values, numeric_columns, one, per_column, ratio, text_columns, union_all)
from tallyglass.sources.readers import seeded_sample

# Patterns in the order in which the first match wins, each with its share > 0.8 rule.
PATTERNS = [
    ("email", [r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"]),
    ("url", [r"^https?://"]),
    ("phone", [r"^[\d\s\-\(\)\+\.]+$"]),
    ("date", [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$"]),
    ("credit_card", [r"^\b(?:\d[ -]*?){13,16}\b"]),
    ("postal_code", [r"^\d{5}(?:-\d{4})?$"]),
    ("ip_address", [r"^(?:\d{1,3}\.){3}\d{1,3}$"]),
    ("uuid", [r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"]),
]
# Names that mark an id column.
NUMBER_ID_NAMES = ["id", "id_", "_id", "key", "pk", "primary_key"]
STRING_ID_NAMES = NUMBER_ID_NAMES + ["uuid"]
DATE_FORMATS = ["MM/dd/yyyy", "dd-MM-yyyy"]
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
MATCH_SHARE, PARSE_SHARE, ID_RATIO, UNIQUE_RATIO = 0.8, 0.8, 0.9, 0.95


def parse_time(c: Column) -> Column:
    """Timestamp from ISO text (any offset) or the two common numeric formats, else null.

    ISO text must start with a four-digit year and month and day: a bare number
    such as "2020" stays a number.
    """
    iso = F.when(c.rlike(ISO_DATE), F.try_to_timestamp(c))
    return F.coalesce(iso, *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def infer_types(df: DataFrame, review_below: float = 0.8, cols: Sequence[str] | None = None) -> DataFrame:
    """column, inferred_type, confidence, needs_review, nullable, distinct_count.

    A string column is datetime (or numeric) when every value parses.
    """
    types = {f.name: f.dataType for f in df.schema}
    native = {"number": "numeric", "boolean": "boolean", "datetime": "datetime"}
    cols, stats = list(cols or atomic_columns(df)), {}
    for c in cols:
        text = isinstance(types[c], T.StringType)
        stats[c] = {"filled": F.count(c), "nullable": count_if(F.col(c).isNull()) > 0, "times": F.count(parse_time(F.col(c))) if text else F.max(F.lit(-1).cast("long")),
                    "numbers": F.count(F.expr(f"try_cast(`{c}` as double)")) if text else F.max(F.lit(-1).cast("long")),
                    "native": F.max(F.lit(None if text else native[logical_type(types[c])]).cast("string"))}
    filled, kind = F.col("filled"), F.col("inferred_type")
    inferred = (F.when(filled == 0, "unknown").when(F.col("native").isNotNull(), F.col("native")).when(F.col("times") == filled, "datetime")
                .when(F.col("numbers") == filled, "numeric").when(ratio(F.col("distinct_count"), filled) < 0.1, "categorical").otherwise("string"))
    confidence = (F.when(kind == "unknown", 0.0).when(F.col("native").isNotNull(), 1.0).when(kind.isin("datetime", "categorical"), 0.9)
                  .when(kind == "numeric", 0.8).otherwise(0.7))
    out = per_column(df, stats).join(F.broadcast(distinct_counts(df, cols)), "column", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    return out.withColumn("inferred_type", inferred).withColumn("confidence", confidence).select(
        "column", "inferred_type", "confidence", (F.col("confidence") < review_below).alias("needs_review"), "nullable", "distinct_count")


def number_texts(df: DataFrame, cols: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Per column i the significant digits without leading zeros of a number's shortest decimal text, `k{i}`, and the exponent of the last of them, `e{i}`; null for nulls, NaN and infinity. `w{i}`: the columns of `carry`.

    Each step is a projection of its own, so that a number is turned into text once, and plain
    text functions take the place of patterns.
    """
    number, others = range(len(cols)), [f"w{i}" for i in range(len(carry))]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(dbl(c)) & (F.abs(dbl(c)) < float("inf"))
    text = df.select(*[F.col(c).alias(w) for c, w in zip(carry, others)], *[F.when(finite(c), F.upper(F.abs(F.col(c)).cast("string"))).alias(f"t{i}") for i, c in enumerate(cols)])
    parts = text.select(*others, *[x for i in number for x in (
        F.substring_index(f"t{i}", "E", 1).alias(f"m{i}"),
        F.when(F.contains(f"t{i}", F.lit("E")), F.substring_index(f"t{i}", "E", -1).try_cast("int")).otherwise(0).alias(f"p{i}"))])
    digits = parts.select(*others, *[x for i in number for x in (
        F.ltrim(F.replace(f"m{i}", F.lit("."), F.lit("")), F.lit("0")).alias(f"d{i}"),
        (F.col(f"p{i}") - F.when(F.contains(f"m{i}", F.lit(".")), F.length(F.substring_index(f"m{i}", ".", -1))).otherwise(0)).alias(f"p{i}"))])
    kept = digits.select(*others, *[x for i in number for x in (f"d{i}", f"p{i}", F.rtrim(F.col(f"d{i}"), F.lit("0")).alias(f"k{i}"))])
    return kept.select(*others, *[x for i in number for x in (
        F.col(f"k{i}"), F.when(F.col(f"k{i}") == "", 0).otherwise(F.col(f"p{i}") + F.length(f"d{i}") - F.length(f"k{i}")).alias(f"e{i}"))])


def precision_scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, precision, scale: largest digit and decimal counts over all rows, of numbers of any size; a zero before the point counts as a digit."""
    types = {f.name: f.dataType for f in df.schema}
    cols = list(cols or numeric_columns(df))
    whole = [c for c in cols if isinstance(types[c], T.IntegralType)]
    others = [c for c in cols if c not in whole]
    stats = {}
    for c in cols:
        if c in whole:
            ends = [x(f"w{whole.index(c)}").cast("decimal(38,0)") for x in (F.min, F.max)]
            digits, decimals = F.greatest(*[F.length(F.abs(x).cast("string")) for x in ends]), F.max(F.lit(0))
        else:
            kept, last = f"k{others.index(c)}", F.col(f"e{others.index(c)}")
            size = F.greatest(F.length(kept) + F.greatest(last, F.lit(0)), -last + F.when(F.length(kept) + last <= 0, 1).otherwise(0), F.lit(1))
            given = F.col(kept).isNotNull()
            digits, decimals = F.max(F.when(given, size)), F.max(F.when(given, F.greatest(-last, F.lit(0))))
        stats[c] = {"precision": digits.cast("long"), "scale": decimals.cast("long")}
    return per_column(number_texts(df, others, whole), stats)


def _id_rule(share: Column, hint: Column, threshold: float) -> Column:
    return F.coalesce((share >= threshold) & (hint | (share >= UNIQUE_RATIO)), F.lit(False))


def _id_hint(df: DataFrame, c: str) -> Column:
    """Sequential 1..n or an id name."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.NumericType):
        return ((F.min(c) == 1) & (F.max(c) == F.count(F.lit(1)))) | F.lit(c.lower() in NUMBER_ID_NAMES)
    return F.max(F.lit(isinstance(kind, T.StringType) and c.lower() in STRING_ID_NAMES))


def _counted(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """The per-column statistics with n_rows and distinct_count added."""
    wide = per_column(df, {c: {**stats[c], "n_rows": F.count(F.lit(1))} for c in cols})
    return wide.join(F.broadcast(distinct_counts(df, cols)), "column")       # one row per column


def id_columns(df: DataFrame, threshold: float = ID_RATIO, cols: Sequence[str] | None = None) -> DataFrame:
    """column, uniqueness_ratio, is_id: nearly unique and sequential 1..n, id-named, or at least 95 % unique."""
    cols = list(cols or atomic_columns(df))
    share = ratio(F.col("distinct_count"), F.col("n_rows"))
    return _counted(df, cols, {c: {"hint": _id_hint(df, c)} for c in cols}).select(
        "column", share.alias("uniqueness_ratio"), _id_rule(share, F.col("hint"), threshold).alias("is_id"))


def id_columns_by_name(df: DataFrame, threshold: float = ID_RATIO) -> DataFrame:
    """The looser rule: an id word anywhere in the name, or at least 95 % unique."""
    marked = F.lit(False)
    for word in STRING_ID_NAMES:
        marked = marked | F.lower("column").contains(word)
    share = F.col("uniqueness_ratio")
    return id_columns(df, threshold).select("column", "uniqueness_ratio", ((share >= threshold) & (marked | (share >= UNIQUE_RATIO))).alias("is_id"))


def datetime_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, parse_share, unique_ratio, is_datetime: over half unique and over 80 % parse, on all rows."""
    cols = list(cols or text_columns(df))
    parsed = _counted(df, cols, {c: {"parse_share": ratio(F.count(parse_time(F.col(c))), F.count(c), 0.0)} for c in cols})
    return parsed.select("column", "parse_share", ratio(F.col("distinct_count"), F.col("n_rows"), 0.0).alias("unique_ratio")).withColumn(
        "is_datetime", (F.col("unique_ratio") > 0.5) & (F.col("parse_share") > PARSE_SHARE))


def _pattern_shares(c: str) -> list[tuple[str, Column]]:
    n = F.count(F.lit(1))
    return [(name, F.greatest(*shares) if len(shares) > 1 else shares[0]) for name, shares in
            ((name, [ratio(F.sum(one(F.col(c).rlike(p))), n, 0.0) for p in alternatives]) for name, alternatives in PATTERNS)]


def detect_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, pattern: the first pattern more than 80 % of the rows match, else null."""
    stats = {}
    for c in cols or text_columns(df):
        found = F.lit(None).cast("string")
        for name, share in reversed(_pattern_shares(c)):
            found = F.when(share > MATCH_SHARE, name).otherwise(found)
        stats[c] = {"pattern": found}
    return per_column(df, stats)


def max_lengths(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, {c: {"max_length": F.max(F.length(c)).cast("long")} for c in cols or text_columns(df)})


def sample_values(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """column, samples: range text for numeric ids, top values up to 10 distinct ones, else seeded rows."""
    cols = list(cols or [c for c in atomic_columns(df)])
    share = ratio(F.col("distinct_count"), F.col("n_rows"))
    info = {r["column"]: r for r in _counted(df, cols, {c: {"hint": _id_hint(df, c)} for c in cols}).select(
        "column", F.col("distinct_count").alias("d"), _id_rule(share, F.col("hint"), ID_RATIO).alias("is_id")).collect()}      # one row per column
    numbers, frames = numeric_columns(df), []
    few = [c for c in cols if info[c]["d"] <= 10 and not (info[c]["is_id"] and c in numbers)]
    for c in cols:
        if info[c]["is_id"] and c in numbers:
            text = F.concat(F.lit("Range: "), F.min(c).cast("string"), F.lit(" to "), F.max(c).cast("string"))
            frames.append(df.agg(F.array(text).alias("samples")).select(F.lit(c).alias("column"), "samples"))
        elif c not in few:
            rows = seeded_sample(df.where(F.col(c).isNotNull()).select(*dict.fromkeys([*keys, c])), k, keys, seed)
            frames.append(rows.agg(F.sort_array(F.collect_list(F.col(c).cast("string"))).alias("samples")).select(F.lit(c).alias("column"), "samples"))
    if few:
        counts = long_values(df, few, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))     # at most 10 rows per column
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))))
        frames.append(counts.groupBy("column").agg(F.transform(F.slice(ordered, 1, k), lambda s: s["v"]).alias("samples")))
    return union_all(frames)


def column_quality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, missing_pct, duplicate_pct = (n - distinct) / n, uniqueness_ratio, is_id."""
    cols = list(cols or atomic_columns(df))
    n, d = F.col("n_rows"), F.col("distinct_count")
    share = ratio(d, n)
    return _counted(df, cols, {c: {"hint": _id_hint(df, c), "missing": F.sum(one(F.col(c).isNull()))} for c in cols}).select(
        "column", F.round(ratio(F.col("missing") * 100.0, n), 2).alias("missing_pct"), F.round(ratio((n - d) * 100.0, n), 2).alias("duplicate_pct"),
        F.round(share, 3).alias("uniqueness_ratio"), _id_rule(share, F.col("hint"), ID_RATIO).alias("is_id"))


def infer_contract(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, nullability, range, precision, scale, length, pattern, uniqueness, missing and duplicate share."""
    cols = list(cols or atomic_columns(df))
    types, numbers, texts = {f.name: f.dataType for f in df.schema}, numeric_columns(df), text_columns(df)
    nothing = lambda kind: F.max(F.lit(None).cast(kind))
    stats = {c: {"nullable": count_if(F.col(c).isNull()) > 0, "n_rows": F.count(F.lit(1)),
                 "min_value": F.min(dbl(c)) if c in numbers else nothing("double"),
                 "max_value": F.max(dbl(c)) if c in numbers else nothing("double"),
                 "max_length": F.max(F.length(c)).cast("long") if c in texts else nothing("long")} for c in cols}
    out = per_column(df, stats).join(F.broadcast(column_quality(df, cols)), "column")
    chosen_numbers, chosen_texts = [c for c in cols if c in numbers], [c for c in cols if c in texts]
    empty = df.sparkSession.createDataFrame
    digits = precision_scale(df, chosen_numbers) if chosen_numbers else empty([], "column string, precision long, scale long")
    patterns = detect_patterns(df, chosen_texts) if chosen_texts else empty([], "column string, pattern string")
    dates = datetime_strings(df, chosen_texts).select("column", "is_datetime") if chosen_texts else empty([], "column string, is_datetime boolean")
    for piece in (digits, patterns, dates):
        out = out.join(F.broadcast(piece), "column", "left")       # one row per column
    kinds = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(logical_type(types[c])))])
    is_date = F.coalesce("is_datetime", F.lit(False))
    return out.select(
        "column", F.when(is_date, "datetime").otherwise(kinds[F.col("column")]).alias("type"), "nullable", "min_value", "max_value",
        "precision", "scale", "max_length", F.coalesce("pattern", F.when(is_date, "datetime")).alias("pattern"), F.col("is_id").alias("unique"),
        "missing_pct", "duplicate_pct", "uniqueness_ratio", "n_rows")


def contract_documents(contract: DataFrame) -> DataFrame:
    """column, document: the contract rows as JSON with absent constraints left out."""
    constraints = [c for c in contract.columns if c not in ("column", "type", "nullable", "n_rows")]
    return contract.select("column", F.to_json(F.struct("column", "type", "nullable", F.struct(*constraints).alias("constraints"))).alias("document"))


def contract_summary(contract: DataFrame) -> DataFrame:
    """One row per dataset: id, highly unique, incomplete and patterned columns, and the quality score."""
    names = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("column")))), ",")
    return contract.agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"), names(F.col("unique")).alias("id_columns"),
        names(F.col("uniqueness_ratio") > 0.8).alias("high_cardinality_columns"), names(F.col("nullable")).alias("columns_with_missing"),
        names(F.col("pattern").isNotNull()).alias("pattern_columns"), F.round(100 - F.avg("missing_pct"), 2).alias("quality_score"))


def column_rules(contract: DataFrame) -> DataFrame:
    """column, rule, measured, threshold: the rules that a column of the contract meets."""
    rule = lambda test, name, measured, limit: F.when(test, F.struct(
        name.alias("rule"), measured.cast("double").alias("measured"), F.lit(limit).cast("double").alias("threshold")))
    met = F.array(
        rule(F.col("unique"), F.lit("unique"), F.col("uniqueness_ratio"), UNIQUE_RATIO),
        rule(F.col("missing_pct") > 20, F.lit("missing_pct"), F.col("missing_pct"), 20),
        rule(F.col("duplicate_pct") > 10, F.lit("duplicate_pct"), F.col("duplicate_pct"), 10),
        rule(F.col("pattern").isNotNull(), F.concat(F.lit("pattern_"), F.col("pattern")), F.lit(None), MATCH_SHARE))
    return contract.select("column", F.explode(F.filter(met, lambda x: x.isNotNull())).alias("_m")).select("column", "_m.rule", "_m.measured", "_m.threshold")


def schema_table(df: DataFrame) -> DataFrame:
    """(column, data_type) rows of a schema."""
    return df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column string, data_type string")


def schema_differences(expected: Sequence[str], df: DataFrame) -> DataFrame:
    """column, issue ('missing' or 'extra'); no rows means the schema passes."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in expected], "column string")
    found = schema_table(df).select("column")
    return wanted.exceptAll(found).withColumn("issue", F.lit("missing")).unionByName(
        found.exceptAll(wanted).withColumn("issue", F.lit("extra")))


def schema_check(expected: Sequence[str], df: DataFrame) -> DataFrame:
    """status (pass or fail) with the sorted missing and extra columns."""
    names = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("issue") == kind, F.col("column")))), ",")
    return schema_differences(expected, df).agg(
        F.when(F.count(F.lit(1)) == 0, "pass").otherwise("fail").alias("status"), names("missing").alias("missing_columns"), names("extra").alias("extra_columns"))


def type_differences(baseline: DataFrame, df: DataFrame) -> DataFrame:
    """column, baseline_type, current_type, issue (missing, extra, type_mismatch, ok)."""
    a = schema_table(baseline).withColumnRenamed("data_type", "baseline_type")
    b = schema_table(df).withColumnRenamed("data_type", "current_type")
    issue = (F.when(F.col("current_type").isNull(), "missing").when(F.col("baseline_type").isNull(), "extra")
             .when(F.col("baseline_type") != F.col("current_type"), "type_mismatch").otherwise("ok"))
    return a.join(b, "column", "full").withColumn("issue", issue)


def enforce_contract(df: DataFrame, rules: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """column, rule, violations, limit, exceeded for rules unique, enum, max_missing, min, max, pattern.

    All rules are aggregates of one scan.  A rule on an absent column is one violation of rule 'present'.
    """
    aggregates, rows = [], []

    def add(column: str, rule: str, expr: Column, limit: float) -> None:
        i = len(rows)
        aggregates.append(expr.cast("double").alias(f"v{i}"))
        rows.append(F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"),
                             F.lit(float(limit)).alias("limit"), (F.col(f"v{i}") > float(limit)).alias("exceeded")))

    for c, spec in rules.items():
        if c not in df.columns:
            add(c, "present", F.max(F.lit(1)), 0)
            continue
        if spec.get("unique"):
            add(c, "unique", F.count(c) - F.count_distinct(F.col(c)), 0)
        if "enum" in spec:
            add(c, "enum", count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(spec["enum"]))), 0)
        if "max_missing" in spec:
            add(c, "max_missing", ratio(F.sum(one(F.col(c).isNull())), F.count(F.lit(1)), 0.0), spec["max_missing"])
        if "min" in spec:
            add(c, "min", count_if(F.col(c) < F.lit(spec["min"])), 0)
        if "max" in spec:
            add(c, "max", count_if(F.col(c) > F.lit(spec["max"])), 0)
        if "pattern" in spec:
            add(c, "pattern", count_if(~F.col(c).rlike(spec["pattern"])), 0)
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def contract_violations(df: DataFrame, rules: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Rows that break a row-level rule (enum, min, max, pattern, or a null where none is allowed)."""
    broken = F.lit(False)
    for c, spec in rules.items():
        if c not in df.columns:
            continue
        tests = []
        if "enum" in spec:
            tests.append(F.col(c).isNotNull() & ~F.col(c).isin(list(spec["enum"])))
        if spec.get("max_missing") == 0:
            tests.append(F.col(c).isNull())
        if "min" in spec:
            tests.append(F.col(c) < F.lit(spec["min"]))
        if "max" in spec:
            tests.append(F.col(c) > F.lit(spec["max"]))
        if "pattern" in spec:
            tests.append(~F.col(c).rlike(spec["pattern"]))
        for t in tests:
            broken = broken | F.coalesce(t, F.lit(False))
    return df.where(broken)
