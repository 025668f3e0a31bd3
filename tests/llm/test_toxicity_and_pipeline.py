"""Toxicity on the held-out fold, and every pipeline stage against a plain version."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from tallyglass.llm import quality_rules, toxicity
from tallyglass.llm.common import keep_table, only, read
from test_near_copies import brute_components
from test_texts import check_packing, ordered, rows_of

LARGER, LEARN = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(read(spark, LEARN, "documents"), read(spark, LEARN, "labels"), per_class=800)


def test_held_out_accuracy(spark, model):
    scored = toxicity.score(read(spark, LEARN, "documents"), model)
    held = scored.join(read(spark, LEARN, "labels"), "doc_id").where(toxicity.fold("doc_id") == 0).collect()
    assert len(held) > 500
    # Only 350 toxic documents teach here, and some labelled toxic hold no toxic word at all: the accuracy reached is 0.948, always saying clean would be 0.882.
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) >= 0.93
    toxic, clean = [r["score"] for r in held if r["toxic"] == 1], [r["score"] for r in held if r["toxic"] == 0]
    assert np.mean([[a > b for b in clean] for a in toxic]) >= 0.93


def test_misspellings_share_ngrams(model):
    plain, odd, clean = model.score(["thou idiot of ander", "thou idiott of ander", "thou ander of thine"])
    assert plain > 0.5 and odd > clean


def test_rows_and_fold(spark, docs, messy, nothing):
    labels = read(spark, LARGER, "labels").withColumns({"text": F.lit("clash"), "score": F.lit(1)})
    made = toxicity.toxicity(docs, labels).collect()
    assert len(made) == len(messy) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in made)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in made)
    by_text = defaultdict(set)
    texts = {i: t for i, t, *_ in messy}
    for r in made:
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]] or ""].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = read(spark, LARGER, "documents"), read(spark, LARGER, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(docs, labels, 50).grams, toxicity.fit(docs, turned, 50).grams)


def test_subwords_by_hand():
    bucket, owner = toxicity.subwords(["ab", "abcdef"])
    assert np.bincount(owner).tolist() == [3, 6 + 5 + 4 + 3]          # <ab>: 2 of three, 1 of four; <abcdef>: 6, 5, 4, 3
    again, _ = toxicity.subwords(["zz", "ab"])
    assert sorted(again[_ == 1]) == sorted(bucket[owner == 0])


# pipeline

def test_names_and_columns(spark, docs, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "line dedup", "SimHash near-dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, LARGER).columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, nothing, LARGER).count() == 0
    assert corpus_pipeline.packing_stage(spark, nothing, LARGER).count() == 0


def stays(rows):
    """Ids that near-copy removal leaves, rows without an id and repeated ids included."""
    numbered = list(enumerate(t for _, t in rows))
    groups = defaultdict(list)
    for n, c in brute_components(numbered).items():
        groups[c].append(rows[n][0])
    gone = {i for own in groups.values() for i in own if i is not None and i != min(x for x in own if x is not None)}
    return {i for i, _ in rows} - gone


def test_stages_one_by_one(spark, docs):
    fitted = {}
    for given in (only(docs, *corpus_pipeline.COLUMNS), read(spark, LARGER, "documents")):
        fitted[id(given)] = toxicity.fit(given, read(spark, LARGER, "labels"))
        rows = rows_of(given)
        scored = fitted[id(given)].score([t for _, t in rows])
        after = keep_table(corpus_pipeline.toxicity_stage(spark, given, LARGER), "t")
        assert ordered(rows_of(after)) == ordered(r for r, s in zip(rows, scored) if s < 0.5)
        rows = rows_of(after)

        kept = keep_table(corpus_pipeline.quality_stage(spark, after, LARGER), "q")
        bad = {r["host"] for r in quality_rules.apply_rules(after).where("host_failed").collect()}
        hosts = {(r["doc_id"], r["text"]): r["source"] for r in after.collect()}
        failed = {i for i, t in rows if (m := brute.measures(t))[0] < 20 or 100 * m[4] > 30 * m[0] or hosts[(i, t)] in bad}
        assert ordered(rows_of(kept)) == ordered(r for r in rows if r[0] not in failed)
        rows = rows_of(kept)

        lines = keep_table(corpus_pipeline.line_stage(spark, kept, LARGER), "l")
        assert ordered(rows_of(lines)) == ordered(r[:2] for r in brute.dedup_lines(rows))
        assert lines.where("n_chars <> length(text)").isEmpty()
        rows = rows_of(lines)

        one = keep_table(corpus_pipeline.near_dedup_stage(spark, lines, LARGER), "n")
        left = rows_of(one)
        assert {i for i, _ in left} == stays(rows) and len(left) >= len({i for i, _ in left})

        check_packing(corpus_pipeline.packing_stage(spark, one, LARGER).collect(), left)


def test_run(spark, folder):
    made = corpus_pipeline.run(spark, folder).collect()
    assert len(made) > 50 and {"doc_id", "sequence_id", "offset"} <= set(made[0].asDict())
