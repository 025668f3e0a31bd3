"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text gives sixteen statistics (sizes, shares of kinds of characters, repeats), turned
into logarithms and log-odds so that they are nearer to normal. Every class has its mean
and a covariance that is shrunk twice: `toward_pooled` of it is the covariance pooled over
the classes, then `toward_diagonal` of that the pooled variances alone. A score is the
logistic of the difference of the two log-densities, each from the Mahalanobis distance by
a triangular solve; the Cholesky factors are made once and stay with the worker.

The fit reads all labelled rows outside the held-out fold. Statistics are rounded to
1/1024, so the sums of values and of products are whole numbers: any dealing of the rows
over tasks gives the same model. Tasks send one row of sums per class.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import keep_table, map_rows, only
from tallyglass.llm.toxicity import fold

TOWARD_POOLED, TOWARD_DIAGONAL, LIMIT = 0.1, 0.05, 0.3
UNIT = 1024          # values are kept in whole steps of 1/UNIT
NAMES = ("words", "word_length", "letters", "capitals", "symbols", "marks", "digits", "bare", "commonest", "distinct", "lines", "stutter", "pairs", "sentence", "capitalised", "shouts")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER, DIGIT, MARK, ENDS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"[.,;:!?]+"), re.compile(r"[.!?]+")
SYMBOL = re.compile(r"[#*$%&|<>{}\[\]=~^\\@_/+]+")


def _chars(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def statistics(text: str | None) -> list[int]:
    """The statistics of one whole text in steps of 1/UNIT; a null text counts as empty.

    Log-odds of a share a of b: log((a + 1/2) / (b - a + 1)), defined for empty texts too.
    """
    text = text or ""
    words = WORD.findall(text)
    n, chars, counts = len(words), len(text), Counter(words)
    pairs = Counter(pairwise(words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counted = [(_chars(LETTER, text), chars), (sum(map(str.isupper, text)), chars),
               (_chars(SYMBOL, text), chars), (_chars(MARK, text), chars), (_chars(DIGIT, text), chars),
               (sum(c for w, c in counts.items() if not any(map(str.isalnum, w))), n), (max(counts.values(), default=0), n), (len(counts), n),
               (len(set(lines)), len(lines)), (sum(c for (a, b), c in pairs.items() if a == b), n), (sum(c for c in pairs.values() if c > 1), n)]
    more = [(sum(c for w, c in counts.items() if w[0].isupper()), n), (text.count("!"), chars)]
    odds = [np.log((a + 0.5) / (b - a + 1.0)) for a, b in counted + more]
    values = [np.log1p(n), np.log1p(sum(map(len, words)) / max(n, 1)), *odds[:11], np.log1p(n / max(len(ENDS.findall(text)), 1)), *odds[11:]]
    return [round(float(v) * UNIT) for v in values]


class Model:
    """Means, log-priors and Cholesky factors of both classes; with one class only, its share; without rows, one half."""

    def __init__(self, counts: list[int], means: list[np.ndarray], factors: list[np.ndarray]):
        self.counts, self.means, self.factors = counts, means, factors
        if all(counts):
            self.constants = [np.log(c / sum(counts)) - np.log(np.diag(f)).sum() for c, f in zip(counts, factors)]

    def densities(self, values: np.ndarray) -> np.ndarray:
        """Log of prior times density of each class, up to a constant; one column per class."""
        return np.stack([k - 0.5 * (np.linalg.solve(f, (values - m).T) ** 2).sum(0) for k, m, f in zip(self.constants, self.means, self.factors)], 1)

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of statistics."""
        if not all(self.counts):
            return np.full(len(values), (self.counts[1] + 0.5) / (sum(self.counts) + 1))
        d = self.densities(np.asarray(values, np.float64).reshape(-1, len(self.means[0])) / UNIT)
        return 1 / (1 + np.exp(-np.clip(d[:, 1] - d[:, 0], -500, 500)))


def model_of(sums: dict[int, tuple[int, list[int], list[int]]], toward_pooled: float = TOWARD_POOLED, toward_diagonal: float = TOWARD_DIAGONAL) -> Model:
    """Model from (rows, sums of values, sums of products) of the classes 0 and 1."""
    p = len(NAMES)
    counts = [sums[c][0] for c in (0, 1)]
    if not all(counts):
        return Model(counts, [], [])
    means = [np.array(sums[c][1], np.float64) / counts[c] for c in (0, 1)]
    own = [np.array(sums[c][2], np.float64).reshape(p, p) / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (own[0] * counts[0] + own[1] * counts[1]) / sum(counts)
    factors = []
    for c in (0, 1):
        shrunk = (1 - toward_pooled) * own[c] + toward_pooled * pooled
        shrunk = (1 - toward_diagonal) * shrunk + toward_diagonal * np.diag(np.diag(pooled))
        factors.append(np.linalg.cholesky(shrunk / UNIT ** 2 + 1e-6 * np.eye(p)))
    return Model(counts, [m / UNIT for m in means], factors)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, values) of every row, from its whole text."""
    d = only(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return map_rows(d, lambda doc_id, text: {"doc_id": doc_id, "values": [statistics(t) for t in text]}, f"doc_id {kind}, values array<int>")


def _sums(rows: DataFrame) -> DataFrame:
    """(label, sums) of each task's rows, one row per class: how many, then the sums of values, then of products."""
    import pyarrow as pa

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = np.asarray(batch.column("label").to_pylist(), np.int64)
            values = np.asarray(batch.column("values").to_pylist(), np.int64).reshape(len(labels), len(NAMES))
            for c in np.unique(labels).tolist():
                x = values[labels == c]
                held[c] = held.get(c, 0) + np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        if held:
            yield pa.RecordBatch.from_pydict({"label": list(held), "sums": [h.tolist() for h in held.values()]}, schema=pa.schema([("label", pa.int32()), ("sums", pa.list_(pa.int64()))]))
    return rows.select("label", "values").mapInArrow(run, "label int, sums array<long>")


def fit(values: DataFrame, labels: DataFrame, toward_pooled: float = TOWARD_POOLED, toward_diagonal: float = TOWARD_DIAGONAL, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Model of all labelled rows of (doc_id, values) outside the held-out fold.

    Rows without id or label, or with a label other than 0 and 1, teach nothing; of several
    labels of an id the largest counts, and each row of a repeated id counts.
    """
    known = only(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    taught = values.where("doc_id IS NOT NULL").join(known.where(fold("doc_id") != 0), "doc_id")
    parts = _sums(taught).select("label", F.posexplode("sums").alias("at", "part"))
    sums = {c: [0] * (1 + len(NAMES) + len(NAMES) ** 2) for c in (0, 1)}
    for r in parts.groupBy("label", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():     # 273 numbers per class
        sums[r["label"]][r["at"]] = int(r["total"])
    return model_of({c: (s[0], s[1:1 + len(NAMES)], s[1 + len(NAMES):]) for c, s in sums.items()}, toward_pooled, toward_diagonal)


def score(values: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of rows of (doc_id, values)."""
    sent = values.sparkSession.sparkContext.broadcast(model)             # two means and two factors
    kind = values.schema["doc_id"].dataType.simpleString()
    return map_rows(values.select("doc_id", "values"), lambda doc_id, values: {"doc_id": doc_id, "score": sent.value.score(np.array(values, np.float64))}, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document; null texts are empty, rows without an id are scored and never held out."""
    values = keep_table(document_statistics(docs, id_col, text_col), "statistics")
    scored = score(values, fit(values, labels, id_col=id_col))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
