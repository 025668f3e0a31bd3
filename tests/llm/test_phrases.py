"""Phrase collocations against plain counting, and the automata by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tallyglass.llm import phrases


def plain(rows, least=10, top=2000, inside=50, width=3):
    """Tuples of the operator's columns from (lang, text) rows, by counting every phrase."""
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(brute.LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for n in range(1, width + 1):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, sizes[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "ένα", "été", "rain", "x", "a\x00b", "token", "="] + [f"w{i}" for i in range(30)]
    return [("en" if r.random() < 0.7 else r.choice(["fr", None, ""]), "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "?!"]) for _ in range(r.randint(0, 60)))) for _ in range(n)]


def made_of(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "range_entries": 300}, {"shard_bytes": 40, "range_entries": 5000}])
def test_against_plain_counting(spark, options):
    rows = texts(3, 400) + [("en", "hot pair " * 3000), ("en", "one long piece without stops " * 500), ("de", "same words here. " * 12), ("de", "same words there. " * 9)]
    assert made_of(spark.createDataFrame(rows, "lang string, text string").repartition(5), **options) == plain(rows)


def test_limits_and_other_widths(spark):
    rows = texts(4, 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert made_of(df, least=4, top=7, inside=90, shard_bytes=2000, range_entries=500) == plain(rows, 4, 7, 90)
    assert made_of(df, width=4, least=5) == plain(rows, 5, width=4)
    assert made_of(df, width=2, least=5) == plain(rows, 5, width=2)


def test_nulls_clashes_and_nothing(spark, docs, messy, nothing):
    clash = docs.withColumns({n: F.lit("clash") for n in ("part", "blob", "phrase", "cuts", "n", "a", "marks")})
    want = plain([(lang, t) for _, t, lang, *_ in messy])
    assert made_of(clash) == want and want
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, ""), ("en", " ,. ")], "lang string, text string")).count() == 0


def test_automaton_keeps_what_was_added():
    r = random.Random(8)
    tokens = [r.choice([b"a", b"b", b"c", b"dd", b"."]) for _ in range(4000)]
    n, found = phrases.count(tokens, 0)
    assert n == sum(t != b"." for t in tokens)
    made = phrases.Automaton.of(found)
    again = phrases.Automaton.unpack(made.pack()).unfold()
    for length in (1, 2, 3):
        assert dict(zip(again.phrases(length), again.levels[length - 1][2].tolist())) == Counter(
            tuple(tokens[i:i + length]) for i in range(len(tokens) - length + 1) if b"." not in tokens[i:i + length])
    states = [len(begins) - 1 for begins, _ in made.depths]
    assert states[0] == 1 and all(np.all(arcs["weight"] > 0) for _, arcs in made.depths)


def test_equal_states_are_shared():
    _, found = phrases.count(b"a x y . b x y . a x z . b x z .".split(), 0)
    made = phrases.Automaton.of(found)
    begins, arcs = made.depths[1]
    first = made.depths[0][1]
    assert len({int(a["target"]) for a in first if made.words[a["label"]] in (b"a", b"b")}) == 1          # both go on alike, with equal counts
    assert len(begins) - 1 == len({tuple(map(tuple, arcs[lo:hi].tolist())) for lo, hi in zip(begins, begins[1:])})


def test_cut_and_unite_lose_nothing():
    r = random.Random(9)
    words = [f"w{i:02}".encode() for i in range(25)] + [b"."]
    found = [phrases.count([r.choice(words) for _ in range(900)], 0)[1] for _ in range(3)]
    want = Counter()
    for f in found:
        for length in (1, 2, 3):
            want.update(dict(zip(f.phrases(length), f.levels[length - 1][2].tolist())))
    cuts = [(b"w03", b"w01"), (b"w03", b"w20"), (b"w10", b""), (b"w10", b"w105"), (b"w12x", b"a"), (b"zz", b"")]
    parts = defaultdict(list)
    for f in found:
        for number, part in f.cut(cuts):
            parts[number].append(part)
    got = Counter()
    for number, held in parts.items():
        one = phrases.unite(held)
        for length in (1, 2, 3):
            for p, n in zip(one.phrases(length), one.levels[length - 1][2].tolist()):
                assert n == 0 or sum(c <= (p[0], p[1] if length > 1 else b"") for c in cuts) == number
                got[p] += n
    assert +got == want
    asked = phrases.of_phrases([(b"w01",), (b"w02", b"w03"), (b"nowhere", b"w01"), (b"w02", b"w03", b"w04")])
    whole = phrases.Automaton.of(phrases.unite(phrases.Automaton.of(f).unfold() for f in found))
    for length, weights in enumerate(whole.weights(asked), 1):
        assert [want[p] for p in asked.phrases(length)] == weights.tolist()


def test_ranges_of_many_alike_shards_are_even(spark, monkeypatch):
    """No range holds much more than it should, however many shards name their marks."""
    monkeypatch.setattr(phrases, "MARK", 128)
    r = np.random.RandomState(5)
    rows = [("en", " ".join(f"w{i}" for i in r.zipf(1.2, 1500) % 900)) for _ in range(100)]
    counted = phrases.shards(spark.createDataFrame(rows, "lang string, text string").repartition(4), size=6000)
    held = counted.collect()
    spark.createDataFrame(held, counted.schema).createOrReplaceTempView("alike_shards")
    cuts = phrases.cuts_of(spark.table("alike_shards"), 6000)
    sizes = Counter()
    for row in held:
        for number, part in phrases.Automaton.unpack(row["blob"]).unfold().cut([c[1:] for c in cuts]):
            sizes[number] += part.entries()
    assert len(held) > 60 and len(sizes) > 20 and max(sizes.values()) < 2 * 6000
