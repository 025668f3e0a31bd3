"""Quality rules per document and verdicts per host, in DataFrame operations only.

Each document fails or passes single rules. Failures are summed per host (here the
column `source`), each rule's rate over hosts gets a beta prior fitted to the hosts
themselves (moments, weighted by documents), a host's rate is shrunk to
(failures + a) / (documents + a + b), and a host whose shrunk rate passes a rule's limit
is rejected with all its documents: 0.9 of a single rule, or one half of documents that
fail any of them. Hosts with few documents stay near the corpus.

The text is read once; the host sums are folded before the shuffle, so a host with a
third of all documents is a few rows per task. The verdict join carries ids and counts
only, and the adaptive join splits a large host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.llm.common import keep_table, only

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: rule -> share of a host's documents that may fail it, after shrinking
HOST_LIMITS = {"base": 0.9, "symbols": 0.9, "word_length": 0.9, "lines": 0.9, "any": 0.5}


def repeated_words(hashes: str) -> Column:
    """Number of words inside windows that occur twice or more; `hashes`: array column of one hash per window, in order."""
    h = F.col(hashes)
    marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_covered(marked))


def _covered(marked: Column) -> Column:
    """Positions of equal neighbours in the sorted (hash, position) array, then the words that these windows cover."""
    empty = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("bigint").alias("n"))
    after = F.concat(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))))
    pairs = F.filter(F.zip_with(marked, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    at = F.sort_array(F.array_distinct(F.flatten(pairs)))
    return F.aggregate(at, empty, lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n")), lambda s: s["n"])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    d = only(docs, doc_id=id_col, text=text_col, host=host_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select("doc_id", "host", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                 F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
                 F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("marks"))
    window = F.transform(F.sequence(F.lit(1), F.greatest(F.size("marks") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("marks", i, WINDOW)))
    d = d.withColumn("windows", F.when(F.size("marks") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated_words("windows").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def failures() -> dict[str, Column]:
    """Rule -> whether a document fails it; `any`: whether it fails one of them."""
    rules = {"base": base_failed(), "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
             "word_length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words")),
             "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")}
    return rules | {"any": rules["base"] | rules["symbols"] | rules["word_length"] | rules["lines"]}


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, and per rule the failures `f_<rule>` and the shrunk rate `r_<rule>`.

    The prior's mean is the corpus rate p. With I hosts, N documents, S = sum n (k/n - p)^2
    and w = N - sum n^2 / N, the share of variance between hosts is
    (S / (p (1 - p)) - (I - 1)) / (w - (I - 1)), held within 1e-6 and 1 - 1e-6; the prior's
    weight a + b is its inverse less one. With one host or p of 0 or 1 the weight is
    that of the least share.
    """
    rules = list(failures())
    hosts = keep_table(measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.when(c, 1).otherwise(0)).alias(f"f_{r}") for r, c in failures().items()]), "hosts")
    totals = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("squares"),
                       *[F.sum(f"f_{r}").alias(f"f_{r}") for r in rules], *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}") for r in rules]).first()
    if not totals["n"]:
        return hosts.select("*", *[F.lit(None).cast("double").alias(f"r_{r}") for r in rules])
    n, spread = float(totals["n"]), totals["n"] - totals["squares"] / totals["n"] - (totals["hosts"] - 1)
    shrunk = []
    for r in rules:
        p = totals[f"f_{r}"] / n
        between = ((totals[f"q_{r}"] - n * p * p) / (p * (1 - p)) - (totals["hosts"] - 1)) / spread if 0 < p < 1 and spread > 0 else 0.0
        weight = 1 / min(max(between, 1e-6), 1 - 1e-6) - 1
        shrunk.append(((F.col(f"f_{r}") + p * weight) / (F.col("n") + weight)).alias(f"r_{r}"))
    return hosts.select("*", *shrunk)


def apply_rules(docs: DataFrame, limits: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures of every document, base_failed, host_failed (its host is rejected), kept (neither).

    Null and empty texts have no words and fail the base rule. Null hosts are one host.
    Rows with equal ids are separate documents. Repeated words are found by 64-bit hashes
    of word windows. Empty table: no rows.
    """
    limits = HOST_LIMITS if limits is None else limits
    measured = keep_table(measures(docs, id_col, text_col, host_col), "measures")
    rates = host_rates(measured)
    over = F.lit(False)
    for rule, limit in limits.items():
        over = over | F.coalesce(F.col(f"r_{rule}") > limit, F.lit(False))
    rejected = rates.where(over).select(F.col("host").alias("bad_host"), F.lit(True).alias("host_failed"))
    out = measured.join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                      "host_failed", (~base_failed() & ~F.col("host_failed")).alias("kept"))
