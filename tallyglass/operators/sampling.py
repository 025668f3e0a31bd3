"""Class imbalance, resampling, splits and folds; every draw is a hash, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.expressions import ratio
from tallyglass.functions.ranking import hash_order, hash_rank, order_rank, running_totals
from tallyglass.operators.neighbors import nearest
from tallyglass.session import cut_lineage

#: Imbalance ratios above which a severity begins.
SEVERITIES = {"mild": 3, "moderate": 10, "severe": 20, "extreme": 100}


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """n_rows, n_classes, minority, majority, imbalance_ratio, minority_pct, g_mean, severity."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("minority"), F.max("n").alias("majority"))
    r = F.col("imbalance_ratio")
    return row.withColumn("imbalance_ratio", ratio(F.col("majority"), F.col("minority"))).withColumns({
        "minority_pct": ratio(F.col("minority") * 100.0, F.col("n_rows")),
        "g_mean": F.sqrt(ratio(F.col("minority"), F.col("n_rows")) * ratio(F.col("majority"), F.col("n_rows"))),
        "severity": F.coalesce(*[F.when(r > t, n) for n, t in reversed(SEVERITIES.items())], F.lit("balanced"))})


def imbalance_rules(df: DataFrame, label: str) -> DataFrame:
    """rule, measured, threshold: one row per severity whose limit the imbalance ratio passes."""
    limits = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(float(t)).alias("threshold")) for n, t in SEVERITIES.items()])
    met = imbalance(df, label).select(F.col("imbalance_ratio").alias("measured"), F.explode(limits).alias("_m"))
    return met.where(F.col("measured") > F.col("_m.threshold")).select("_m.rule", "measured", "_m.threshold")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = n / (classes * class count)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k")).withColumn("_p", F.lit(1))
    return counts.withColumn("_p", F.lit(1)).join(F.broadcast(whole), "_p").select(label, "n", ratio(F.col("_t"), F.col("_k") * F.col("n")).alias("weight"))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(F.col(label).alias("_l"), F.col("weight").alias(name))
    return df.join(weights, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def undersample(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, in hash order."""
    ranked = hash_rank(df, keys, seed, by=[label])
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_least")).withColumn("_p", F.lit(1))
    return ranked.withColumn("_p", F.lit(1)).join(F.broadcast(least), "_p").where(F.col("hash_rank") <= F.col("_least")).drop(
        "hash_rank", "group_size", "_least", "_p")


# ---- synthetic minority rows ----

def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) from a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(16 ** 12)


def _between(seeds: DataFrame, pool: DataFrame, key: str, vec: str, label: str, copies: Column, k: int, seed: int) -> DataFrame:
    """(key, vec, label, synthetic): `copies` points per seed row on segments to its nearest pool rows."""
    near = nearest(seeds, pool, key, vec, k, exclude_self=True)
    lists = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))      # k per row
    drawn = seeds.withColumn("_copies", copies).where(F.col("_copies") > 0).join(lists, key)
    drawn = drawn.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))))
    pick = F.floor(_uniform(F.col(key), F.col("_i"), F.lit(f"n{seed}")) * F.size("_near")).cast("int")
    drawn = drawn.withColumn("_other", F.element_at("_near", pick + 1)["neighbour"]).withColumn("_u", _uniform(F.col(key), F.col("_i"), F.lit(f"u{seed}")))
    ends = pool.select(F.col(key).alias("_other"), F.col(vec).alias("_end"))
    point = F.zip_with(F.col(vec), F.col("_end"), lambda a, b: a + F.col("_u") * (b - a))
    return drawn.join(ends, "_other").select(
        F.concat_ws("#", F.col(key).cast("string"), F.col("_i").cast("string")).alias(key), point.alias(vec), label, F.lit(True).alias("synthetic"))


def _with_original(df: DataFrame, made: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    kept = df.select(F.col(key).cast("string").alias(key), vec, label, F.lit(False).alias("synthetic"))
    return kept.unionByName(made)


def _sizes(df: DataFrame, label: str) -> dict:
    """Class sizes on the driver: classes are few."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def _vectors(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    return df.select(key, F.col(vec).cast("array<double>").alias(vec), label)


def _even_copies(seeds: DataFrame, keys: Sequence[str], wanted: int, seed: int) -> tuple[DataFrame, Column]:
    """Spread `wanted` copies evenly over the seeds, the remainder by hash rank."""
    ranked = hash_rank(seeds, keys, seed)
    copies = F.floor(F.lit(wanted) / F.col("group_size")) + F.when(F.col("hash_rank") <= F.lit(wanted) % F.col("group_size"), 1).otherwise(0)
    return ranked, copies


def smote(df: DataFrame, key: str, vec: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Minority classes filled up to the majority size with points between a row and one of its k nearest class mates."""
    data = _vectors(df, key, vec, label)
    sizes = _sizes(data, label)
    out = _with_original(data, data.limit(0).select(F.col(key).cast("string").alias(key), vec, label, F.lit(True).alias("synthetic")), key, vec, label)
    for value, n in sorted(sizes.items(), key=str):
        wanted = max(sizes.values()) - n
        if wanted:
            mates = data.where(F.col(label) == F.lit(value))
            ranked, copies = _even_copies(mates, [key], wanted, seed)
            out = out.unionByName(_between(ranked, mates, key, vec, label, copies, k, seed))
    return out


def foreign_share(df: DataFrame, key: str, vec: str, label: str, value: object, k: int) -> DataFrame:
    """Rows of one class with the share of other classes among their k nearest rows."""
    data = _vectors(df, key, vec, label)
    mine = data.where(F.col(label) == F.lit(value))
    near = nearest(mine, data, key, vec, k, exclude_self=True)
    labels = data.select(F.col(key).alias("neighbour"), F.col(label).alias("_nl"))
    votes = near.join(labels, "neighbour").groupBy(key).agg(F.avg(F.when(F.col("_nl") != F.lit(value), 1.0).otherwise(0.0)).alias("foreign"))
    return cut_lineage(mine.join(votes, key))       # several later steps read it: search once


def borderline_smote(df: DataFrame, key: str, vec: str, label: str, k: int = 5, m: int = 10, seed: int = 42) -> DataFrame:
    """SMOTE seeded only by minority rows with at least half, but not all, foreign neighbours."""
    data = _vectors(df, key, vec, label)
    sizes = _sizes(data, label)
    made = None
    for value, n in sorted(sizes.items(), key=str):
        wanted = max(sizes.values()) - n
        if wanted:
            danger = foreign_share(data, key, vec, label, value, m).where((F.col("foreign") >= 0.5) & (F.col("foreign") < 1.0)).drop("foreign")
            ranked, copies = _even_copies(danger, [key], wanted, seed)
            piece = _between(ranked, data.where(F.col(label) == F.lit(value)), key, vec, label, copies, k, seed)
            made = piece if made is None else made.unionByName(piece)
    return _with_original(data, made, key, vec, label) if made is not None else data.select(
        F.col(key).cast("string").alias(key), vec, label, F.lit(False).alias("synthetic"))


def adasyn(df: DataFrame, key: str, vec: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows in proportion to the foreign share around each minority row, rounded along a running total."""
    data = _vectors(df, key, vec, label)
    sizes = _sizes(data, label)
    made = None
    for value, n in sorted(sizes.items(), key=str):
        wanted = max(sizes.values()) - n
        if not wanted:
            continue
        hard = hash_rank(foreign_share(data, key, vec, label, value, k), [key], seed)
        run = running_totals(hard, "hash_rank", ["foreign"])
        upto = lambda x: F.round(F.try_divide(x * F.lit(float(wanted)), F.col("total_foreign")))
        run = run.withColumn("_allot", F.coalesce(upto(F.col("before_foreign") + F.col("foreign")) - upto(F.col("before_foreign")), F.lit(0.0)))
        piece = _between(run, data.where(F.col(label) == F.lit(value)), key, vec, label, F.col("_allot"), k, seed)
        made = piece if made is None else made.unionByName(piece)
    return _with_original(data, made, key, vec, label) if made is not None else data.select(
        F.col(key).cast("string").alias(key), vec, label, F.lit(False).alias("synthetic"))


def tomek_links(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """key_a, key_b, label_a, label_b: mutual nearest rows of different classes (key_a < key_b)."""
    data = _vectors(df, key, vec, label)
    first = cut_lineage(nearest(data, data, key, vec, 1, exclude_self=True).select(F.col(key).alias("a"), F.col("neighbour").alias("b")))
    mutual = first.where("a < b").join(first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    labels = data.select(key, label)
    out = mutual.join(labels.select(F.col(key).alias("a"), F.col(label).alias("label_a")), "a").join(
        labels.select(F.col(key).alias("b"), F.col(label).alias("label_b")), "b")
    return out.where("label_a != label_b").select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), "label_a", "label_b")


def remove_tomek(df: DataFrame, key: str, vec: str, label: str, both: bool = False) -> DataFrame:
    """Without the majority member (or both members) of each link; the smallest class keeps its rows."""
    sizes = _sizes(df, label)
    least = min(sizes, key=lambda v: (sizes[v], str(v)))
    links = tomek_links(df, key, vec, label)
    ends = links.select(F.col("key_a").alias(key), F.col("label_a").alias("_l")).unionAll(links.select(F.col("key_b").alias(key), F.col("label_b").alias("_l")))
    gone = ends if both else ends.where(F.col("_l") != F.lit(least))
    return df.join(gone.select(key).distinct(), key, "left_anti")


def edited_neighbours(df: DataFrame, key: str, vec: str, label: str, k: int = 3, agree: str = "all") -> DataFrame:
    """Rows whose k nearest rows all (or, with 'mode', mostly) share their class."""
    data = _vectors(df, key, vec, label)
    near = nearest(data, data, key, vec, k, exclude_self=True)
    labelled = near.join(data.select(F.col(key).alias("neighbour"), F.col(label).alias("_nl")), "neighbour").join(data.select(key, label), key)
    same = F.avg(F.when(F.col("_nl") == F.col(label), 1.0).otherwise(0.0))
    keep = labelled.groupBy(key).agg(same.alias("_same")).where(F.col("_same") >= (1.0 if agree == "all" else 0.5)).select(key)
    return df.join(keep, key, "left_semi")


def smote_enn(df: DataFrame, key: str, vec: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    return edited_neighbours(cut_lineage(smote(df, key, vec, label, k, seed)), key, vec, label)


def smote_tomek(df: DataFrame, key: str, vec: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    return remove_tomek(cut_lineage(smote(df, key, vec, label, k, seed)), key, vec, label, both=True)


# ---- splits and folds ----

def _part(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train").alias("part")


def random_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: exactly ceil(n * test_size) rows are 'test'."""
    ranked = hash_rank(df, keys, seed)
    return ranked.withColumn("part", _part(F.col("hash_rank") <= F.ceil(F.col("group_size") * test_size))).drop("hash_rank", "group_size")


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: the test share holds inside every class (rounded)."""
    ranked = hash_rank(df, keys, seed, by=[label])
    return ranked.withColumn("part", _part(F.col("hash_rank") <= F.round(F.col("group_size") * test_size))).drop("hash_rank", "group_size")


def time_split(df: DataFrame, order: str, keys: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: the first floor(n * (1 - test_size)) rows in time are 'train'."""
    ranked = order_rank(df, order, keys, seed)
    return ranked.withColumn("part", _part(F.col("order_rank") > F.floor(F.col("table_size") * (1 - test_size)))).drop("order_rank", "table_size")


def group_split(df: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part by the hash of the group key: no group is on both sides, no shuffle is needed."""
    draw = F.conv(F.substring(hash_order([group], seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return df.withColumn("part", _part(draw < test_size))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0..folds-1, dealt round in hash order within each class."""
    return hash_rank(df, keys, seed, by=[label]).withColumn("fold", ((F.col("hash_rank") - 1) % folds).cast("int")).drop("hash_rank", "group_size")


def expanding_folds(df: DataFrame, order: str, keys: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """(row, fold, part) rows: fold i tests on the i-th of `folds` equal blocks at the end and trains on everything earlier."""
    ranked = order_rank(df, order, keys, seed)
    n, block = F.col("table_size"), F.floor(F.col("table_size") / (folds + 1))
    options = []
    for i in range(folds):
        start = n - (folds - i) * block
        part = F.when(F.col("order_rank") <= start, "train").when(F.col("order_rank") <= start + block, "test")
        options.append(F.struct(F.lit(i).alias("fold"), part.alias("part")))
    out = ranked.select(*df.columns, F.inline(F.filter(F.array(*options), lambda s: s["part"].isNotNull())))
    return out
