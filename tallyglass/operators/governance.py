"""Personal data, links and text cleaning over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.expressions import count_if

# Personal-data patterns in the order of detection and masking.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "mac_address": r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b",
}
# The link pattern.
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
URL_HOST = r"^https?://([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}|localhost|\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?(?:[/?#].*)?$"
# Text removed by cleaning, case-insensitive and across lines.
DANGEROUS_PATTERNS = [
    r"<system>.*?</system>", r"IGNORE\s+ALL\s+INSTRUCTIONS", r"IGNORE\s+PREVIOUS\s+INSTRUCTIONS",
    r"DISREGARD\s+ALL\s+PREVIOUS\s+INSTRUCTIONS", r"<script.*?>.*?</script>", r"javascript:", r"data:text/html",
    r"eval\s*\(", r"exec\s*\(", r"__import__", r"subprocess\.", r"os\.", r"sys\.",
]
TAG_PATTERN = r"<[^>]*>"
# Words that mark a key sentence.
KEY_PATTERNS = [
    r"(?i)\b(what|how|why|when|where|which|who)\b",
    r"(?i)\b(analyze|create|generate|load|process|run|execute)\b",
    r"(?i)\b(data|dataset|model|workflow|task)\b",
]


def pii_matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PII_PATTERNS[kind]), F.lit(0))


def detect_pii(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pii_type, value, start (0-based), stop: one row per match.

    The gaps between the matches give the positions; no match leaves the row early.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    # Literal patterns, each compiled once; most texts hold no match of most kinds: test first, then extract and split only where it pays.
    found = F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(k).alias("pii_type"), pii_matches(F.col(text), k).alias("values"), F.split(F.col(text), p, -1).alias("gaps")))
                      for k, p in PII_PATTERNS.items()])
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s")).select(key, "s.pii_type", "s.values", "s.gaps")
    rows = rows.withColumn("_g", F.transform("gaps", F.length)).withColumn("_m", F.transform("values", F.length))
    rows = rows.select(key, "pii_type", "_g", "_m", F.posexplode("values").alias("_i", "value"))
    start = total(F.slice("_g", 1, F.col("_i") + 1)) + total(F.slice("_m", 1, F.col("_i")))
    return rows.select(key, "pii_type", "value", start.alias("start"), (start + F.length("value")).alias("stop"))


def mask_pii(text: Column) -> Column:
    """Text with every match replaced by [TYPE], type after type."""
    return reduce(lambda t, kind: F.regexp_replace(t, F.lit(PII_PATTERNS[kind]), F.lit(f"[{kind.upper()}]")), PII_PATTERNS, text)


def pii_counts(df: DataFrame, text: str) -> dict[str, Column]:
    return {kind: F.regexp_count(F.col(text), F.lit(PII_PATTERNS[kind])) for kind in PII_PATTERNS}


def compliance(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pii_count, gdpr_compliant, advice."""
    counts = [F.coalesce(c, F.lit(0)) for c in pii_counts(df, text).values()]
    n = sum(counts[1:], counts[0])
    return df.select(key, n.cast("long").alias("pii_count")).select(
        key, "pii_count", (F.col("pii_count") == 0).alias("gdpr_compliant"), F.when(F.col("pii_count") > 0, "anonymise or encrypt").alias("advice"))


def pii_summary(df: DataFrame, text: str) -> DataFrame:
    """total matches, sorted types present, rows with matches: one scan of the whole column."""
    counts = pii_counts(df, text)
    wide = df.select(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()])
    names = F.array_sort(F.array(*[F.when(F.sum(k) > 0, F.lit(k)) for k in counts]))
    every = sum([F.col(k) for k in counts], F.lit(0))
    return wide.agg(F.coalesce(F.sum(every), F.lit(0)).cast("long").alias("pii_count"),
                    F.array_join(F.filter(names, lambda x: x.isNotNull()), ",").alias("pii_types"), count_if(every > 0).alias("rows_with_pii"))


def extract_urls(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, url: links with a plausible host."""
    urls = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(URL_PATTERN), F.lit(0))).alias("url"))
    return urls.where(F.col("url").rlike(URL_HOST))


def clean_text(text: Column, max_length: int | None = None) -> Column:
    """Dangerous parts and tags removed, blanks collapsed; whole texts unless a length is asked for."""
    out = F.regexp_replace(text, "(?is)" + "|".join(DANGEROUS_PATTERNS), "")
    out = F.regexp_replace(out, TAG_PATTERN, "")
    if max_length:
        out = F.substring(out, 1, max_length)
    return F.coalesce(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^ | $", ""), F.lit(""))


def key_sentences(text: Column, most: int = 2) -> Column:
    """The `most` sentences with most key words, earlier first on ties; short texts as they are.  Stays inside the row."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    score = lambda s: sum([F.regexp_count(s, F.lit(p)) for p in KEY_PATTERNS], F.lit(0))
    ranked = lambda ss: F.sort_array(F.transform(ss, lambda s, i: F.struct((-score(s)).alias("k"), i.alias("i"), s.alias("s"))))
    best = lambda ss: F.transform(F.slice(ranked(ss), 1, most), lambda r: r["s"])
    chosen = lambda ss: F.when(F.size(ss) <= most, text).otherwise(F.concat(F.array_join(best(ss), ". "), F.lit(".")))
    return F.transform(F.array(sentences), chosen)[0]           # one split for the test and the ranking
