"""Quality scores on the held-out fold and against a plain discriminant."""

import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyglass.llm import discriminant
from tallyglass.llm.common import read

LEARN, LARGER = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def plain_scores(train, rows, toward_pooled, toward_diagonal):
    """Scores by loops and an explicit inverse: train is [(values, label)], rows are values."""
    train = [([v / discriminant.UNIT for v in x], c) for x, c in train]
    p = len(rows[0])
    means, own, sizes = {}, {}, {}
    for c in (0, 1):
        of = [x for x, label in train if label == c]
        sizes[c] = len(of)
        means[c] = [sum(x[i] for x in of) / len(of) for i in range(p)]
        own[c] = [[sum((x[i] - means[c][i]) * (x[j] - means[c][j]) for x in of) / len(of) for j in range(p)] for i in range(p)]
    total, out = sum(sizes.values()), []
    pooled = [[sum(sizes[c] * own[c][i][j] for c in (0, 1)) / total for j in range(p)] for i in range(p)]
    shrunk = {c: np.array([[(1 - toward_diagonal) * ((1 - toward_pooled) * own[c][i][j] + toward_pooled * pooled[i][j]) + (i == j) * (toward_diagonal * pooled[i][i] + 1e-6) for j in range(p)] for i in range(p)]) for c in (0, 1)}
    for x in rows:
        g = []
        for c in (0, 1):
            d = np.array([v / discriminant.UNIT for v in x]) - np.array(means[c])
            g.append(math.log(sizes[c] / total) - 0.5 * np.linalg.slogdet(shrunk[c])[1] - 0.5 * float(d @ np.linalg.inv(shrunk[c]) @ d))
        out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, g[1] - g[0])))))
    return out


def test_held_out_accuracy(spark):
    labels = read(spark, LEARN, "labels")
    held = discriminant.quality(read(spark, LEARN, "documents"), labels).where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 500
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.98                # always saying good: 0.852
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) >= 0.98 and np.mean([r["predicted"] for r in held if r["quality"] == 0]) <= 0.05


def test_scores_against_a_plain_discriminant(spark):
    docs, labels = read(spark, LARGER, "documents"), {r["doc_id"]: r["quality"] for r in read(spark, LARGER, "labels").collect()}
    rows = [(r["doc_id"], discriminant.statistics(r["text"])) for r in docs.collect()]
    train = [(x, labels[i]) for i, x in rows if i in labels and zlib.crc32(str(i).encode()) % 5]
    want = dict(zip([i for i, _ in rows], plain_scores(train, [x for _, x in rows], discriminant.TOWARD_POOLED, discriminant.TOWARD_DIAGONAL)))
    for made in (discriminant.quality(docs, read(spark, LARGER, "labels")), discriminant.quality(docs.repartition(13), read(spark, LARGER, "labels").repartition(5))):
        got = {r["doc_id"]: r["score"] for r in made.collect()}
        assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_statistics_by_hand():
    unit, names = discriminant.UNIT, discriminant.NAMES
    assert discriminant.statistics(None) == discriminant.statistics("") and len(discriminant.statistics("")) == len(names)
    got = dict(zip(names, discriminant.statistics("Ab ab ab! |\nQ9.")))
    odds = lambda a, b: round(math.log((a + 0.5) / (b - a + 1)) * unit)
    assert got["words"] == round(math.log(6) * unit) and got["letters"] == odds(7, 15) and got["capitals"] == odds(2, 15) and got["symbols"] == odds(1, 15)
    assert got["digits"] == odds(1, 15) and got["bare"] == odds(1, 5) and got["commonest"] == odds(1, 5) and got["distinct"] == odds(5, 5) and got["shouts"] == odds(1, 15)
    assert got["lines"] == odds(2, 2) and got["capitalised"] == odds(2, 5) and got["stutter"] == odds(0, 5)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = read(spark, LARGER, "documents"), read(spark, LARGER, "labels")
    turned = labels.withColumn("quality", F.when(discriminant.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    values = discriminant.document_statistics(docs).cache()
    a, b = discriminant.fit(values, labels), discriminant.fit(values, turned)
    assert a.counts == b.counts and all(np.array_equal(x, y) for x, y in zip(a.factors, b.factors))


def test_rows_nulls_and_poor_labels(spark, docs, messy, nothing):
    labels = read(spark, LARGER, "labels").withColumns({n: F.lit("clash") for n in ("text", "score", "values", "label", "at")})
    clash = docs.withColumns({n: F.lit("clash") for n in ("values", "quality", "held_out", "label")})
    made = discriminant.quality(clash, labels).collect()
    assert len(made) == len(messy) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in made)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in made)
    texts, by_text = {i: t for i, t, *_ in messy}, defaultdict(set)
    for r in made:
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]] or ""].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert discriminant.quality(nothing, labels).count() == 0
    assert {r["score"] for r in discriminant.quality(docs, labels.limit(0)).collect()} == {0.5}
    ones = labels.withColumn("quality", F.lit(1))
    assert len({r["score"] for r in discriminant.quality(docs, ones).collect()}) == 1
    same = spark.createDataFrame([(i, "same words here", i % 2) for i in range(40)], "doc_id long, text string, quality int")       # no spread at all
    assert all(0 < r["score"] < 1 for r in discriminant.quality(same.drop("quality"), same.select("doc_id", "quality")).collect())
