"""Text operators on messy rows and whole small tables, against plain versions and the tokenizer libraries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tallyglass.llm import line_dedup, packing, quality_rules, simhash, spans, token_counts
from tallyglass.llm.common import only, read
from tallyglass.llm.vocab import Generations, tokenizer, word_ids


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_only_takes_exact_names(docs):
    assert only(docs, "text", id="doc_id").columns == ["text", "id"]
    with pytest.raises(ValueError):
        only(docs, "absent")


# quality rules

def test_measures(docs, messy):
    made = quality_rules.measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines").collect()
    assert ordered(tuple(r) for r in made) == ordered((i, *brute.measures(t)) for i, t, *_ in messy)


def test_repeated_windows_overlap(spark):
    texts = ["a b c d e f g h " * 2, "a " * 30, "a b c d e f g h x a b c d e f g h y b c d e f g h x a", "a b c d e f g"]
    made = quality_rules.measures(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in made} == {i: brute.measures(t)[4] for i, t in enumerate(texts)}


def test_bad_host_is_rejected_and_small_host_is_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(f"host{h}", good) for h in range(12) for _ in range(200)] + [("bad", "too short")] * 400 + [("bad", good)] + [("tiny", "too short"), ("tiny", good)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    made = quality_rules.apply_rules(docs).groupBy("host").agg(F.max("host_failed").alias("failed"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    state = {r["host"]: (r["failed"], r["kept"]) for r in made}
    assert state["bad"] == (True, 0) and state["tiny"] == (False, 1) and all(state[f"host{h}"] == (False, 200) for h in range(12))
    rates = {r["host"]: r["r_base"] for r in quality_rules.host_rates(quality_rules.measures(docs)).collect()}
    assert rates["tiny"] < 0.5 < 0.9 < rates["bad"]


def test_mostly_failing_host_goes_and_a_mixed_one_stays(spark):
    """Host `junk` fails two rules by half each, `mixed` by a fifth each; no single rule's rate is near its limit."""
    good = [f"plain words number {i} of some good document that says this and that about weather and rivers and stones and trees" for i in range(400)]
    symbols, lines = [t + " $$$ ### %%%" for t in good], ["one line\n" * 3 + t for t in good]
    rows = [(f"h{i % 20}", t) for i, t in enumerate(good)] + [("junk", t) for t in symbols[:100] + lines[100:200] + good[:10]] + [("mixed", t) for t in symbols[:40] + lines[:40] + good[:120]]
    made = quality_rules.apply_rules(spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string"))
    assert {r["host"] for r in made.where("host_failed").collect()} == {"junk"} and made.where("base_failed").isEmpty()


def test_quality_of_nothing(nothing, docs, messy):
    assert quality_rules.apply_rules(nothing).count() == 0
    assert quality_rules.apply_rules(docs).count() == len(messy)


# SentencePiece

def test_spans_and_round_trip(docs, messy):
    from sentencepiece import SentencePieceProcessor
    from tallyglass.llm.vocab import file_of

    library = SentencePieceProcessor(model_file=file_of("piece_bpe_32k.model"))
    made = spans.encode(docs).collect()
    assert len(made) == len(messy)
    texts = {i: t or "" for i, t, *_ in messy if i is not None}
    for r in made:
        if r["doc_id"] is None:
            continue
        text = texts[r["doc_id"]]
        data = text.encode()
        assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(r["ids"])
        pieces = library.encode(text, return_type="proto").pieces
        if not any(library.is_byte(i) for i in r["ids"]):
            assert list(zip(r["begins"], r["ends"])) == [(p.begin, p.end) for p in pieces]
        if r["ids"]:
            assert r["begins"][0] == 0 and r["ends"][-1] == len(data) and all(a <= b for a, b in zip(r["begins"], r["ends"]))
            assert all(b == a for a, b in zip(r["begins"][1:], r["ends"]))
    digests = {r["doc_id"]: r for r in spans.encode_digests(docs).collect()}
    assert digests[6]["covered"] == len(texts[6].encode()) and digests[2]["n_tokens"] == 0


@pytest.mark.parametrize("flags", [dict(add_dummy_prefix=True, remove_extra_whitespaces=True), dict(add_dummy_prefix=False, remove_extra_whitespaces=False)])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_character_map(rule, flags):
    """The general normaliser against the library's, with a map that rewrites characters."""
    from sentencepiece import SentencePieceNormalizer
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, **flags)
    model = proto.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = spans.Normalizer(model.normalizer_spec)
    for text in ["ＡＢＣ　½ ﬁ", "  two  blanks ", "Straße ÀÉ é", "plain", "", "①②③ ㌔ ｶﾞ", "tab\tand\nline", "   "]:
        made, origin = own.align(text)
        assert made.decode() == library.normalize(text), text
        assert len(origin) == len(made) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())
    assert own.map.longest("plain".encode(), 0) is None


# SimHash

def test_masks_cover_every_small_difference():
    masks = [m % (1 << 64) for m in simhash.covering_masks(4)]
    r = np.random.RandomState(0)
    assert len(masks) == 31
    for _ in range(3000):
        bits = r.choice(64, r.randint(1, 5), replace=False)
        difference = sum(1 << int(b) for b in bits)
        assert any(difference & m == 0 for m in masks)


def test_near_duplicates(docs, messy):
    made = simhash.near_duplicates(docs).collect()
    assert ordered((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in made) == ordered(brute.near_duplicates([(i, t) for i, t, *_ in messy]))


@pytest.mark.parametrize("block", [2, 4, 512])
def test_links_at_any_block_size(spark, block):
    """Chains and dense balls of fingerprints; small blocks force the further levels."""
    from tallyglass.llm.graph import connected_components

    r = np.random.RandomState(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        at = int(r.randint(0, 1 << 62)) * 2
        for _ in range(25):
            prints.add(at)
            for b in r.choice(64, r.randint(1, 6), replace=False):
                at ^= 1 << int(b)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, block)
    root = {n["node"] % (1 << 64): n["root"] for n in connected_components(links).collect()}
    want = brute.components(prints)
    groups = defaultdict(set)
    for p in prints:
        groups[root.get(p, f"alone {p}")].add(p)
    expected = defaultdict(set)
    for p, q in want.items():
        expected[q].add(p)
    assert ordered(map(sorted, groups.values())) == ordered(map(sorted, expected.values()))


@pytest.mark.parametrize("block", [2, 512])
def test_links_over_the_sign_bit(spark, block):
    """A fingerprint, its 30 neighbours, and far ends that only a link across bit 63 joins; near complements must not link."""
    from tallyglass.llm.graph import connected_components

    r, prints = np.random.RandomState(5), set()
    for _ in range(5):
        at = int(r.randint(0, 1 << 62)) * 4 + int(r.randint(0, 4))
        prints |= {at} | {at ^ 1 << b for b in range(30)} | {at ^ 1 << 63 ^ 1 << 40, at ^ 1 << 63 ^ 1 << 41 ^ 1 << 42 ^ 1 << 43, at ^ (1 << 64) - 1, at ^ (1 << 64) - 1 ^ 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = {n["node"] % (1 << 64): n["root"] for n in connected_components(simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, block)).collect()}
    want, groups = brute.components(prints), defaultdict(set)
    for p in prints:
        groups[root.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(q for q in prints if want[q] == c) for c in set(want.values()))


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_query_on_whole_table(spark, folder):
    from tallyglass.llm.queries import op5

    rows = rows_of(read(spark, folder, "documents"))
    assert ordered(tuple(r) for r in op5(spark, folder).collect()) == ordered((i, f"{p:016x}", c) for i, p, c in brute.near_duplicates(rows))


# line dedup

def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 62, 5000).astype(np.uint64))
    made = line_dedup.PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert len(line_dedup.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


@pytest.mark.parametrize("shard_keys", [1, 200_000])
def test_lines(docs, messy, shard_keys):
    made = line_dedup.dedup_lines(docs, shard_keys=shard_keys, carry=("lang", "n_words")).collect()
    assert ordered((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in made) == ordered(brute.dedup_lines([(i, t) for i, t, *_ in messy]))
    assert {r["n_words"] for r in made} == {"clash"}


def test_lines_of_nothing(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0


# token counts

def test_token_counts(docs, messy):
    library = tokenizer("byte_bpe_50k.json")
    made = token_counts.token_counts(docs, sample_docs=4, table_size=50).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in messy]
    assert ordered(tuple(r) for r in made) == ordered(want)


def test_token_counts_of_nothing_and_table(spark, folder, nothing):
    assert token_counts.token_counts(nothing).count() == 0
    library = tokenizer("byte_bpe_50k.json")
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows_of(read(spark, folder, "documents"))]
    assert ordered((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(read(spark, folder, "documents")).collect()) == ordered(want)


def test_every_character_is_counted_as_by_the_library():
    """Each character alone, and between letters, digits and signs; those of unlike kinds are few and go to the library."""
    library = tokenizer("byte_bpe_50k.json")
    counter = token_counts.Counts("byte_bpe_50k.json", token_counts.FrequentLengths([], []))
    known = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xF900 and c < 0xF0000]
    odd = [c for at in range(0, len(known), 256) for c in counter.differ(known[at:at + 256])]
    assert len(odd) < 20_000
    for start in [*range(0, 0x3400, 16), *range(0x10000, 0x20000, 509), *map(ord, odd[:300])]:
        text = "".join(f" a{c}b{c}1{c}2!{c}? {c}{c}\n" for c in map(chr, range(start, start + 16)) if not "\ud800" <= c < "\ue000")
        assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)], hex(start)


def test_latin_texts_are_cut_as_others(messy):
    counter = token_counts.Counts("byte_bpe_50k.json", token_counts.FrequentLengths([], []))
    library = tokenizer("byte_bpe_50k.json")
    words = tokenizer("word_bpe_49k.json")
    r = np.random.RandomState(3)
    letters = list("aZéßŽŒ×÷İıŉſ09'’ \t\n\r\x0b!?-_…") + ["'s", " 'll", "  ", "ﬁ", "e\u0301"]
    texts = ["".join(r.choice(letters, r.randint(0, 40))) for _ in range(3000)]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [i.tolist() for i in word_ids(texts, "word_bpe_49k.json")] == [words.encode(t, add_special_tokens=False).ids for t in texts]


def test_caches_forget_and_find_again():
    made = []
    cache = Generations(lambda t: made.append(t) or len(t), most=20)
    for i in range(60):
        assert {t: n for t, n in cache.of({"often", f"w{i}", "x" * 100}).items() if t in ("often", f"w{i}", "x" * 100)} == {"often": 5, f"w{i}": len(f"w{i}"), "x" * 100: 100}
    assert made.count("often") == 1 and len(cache.new) + len(cache.old) <= 24


def test_frequent_pretokens_come_from_all_files(spark):
    rows = [(f"first only {i}",) for i in range(300)] + [(f"second kind {i}",) for i in range(300)]
    made, _ = token_counts.frequent_lengths(spark.createDataFrame(rows, "text string").repartitionByRange(20, "text"), "byte_bpe_50k.json", 100, 60)
    assert {" only", " kind"} <= set(made)


def test_frequent_pretokens_are_counted_over_all_documents(spark, monkeypatch):
    r, kept, library = np.random.RandomState(7), [], tokenizer("byte_bpe_50k.json")
    rows = [(" ".join(f"w{i}x" for i in r.zipf(1.3, 12) % 3000) + " É ƛ"[:2 * (k % 3)] + "q" * (k % 70),) for k in range(2500)] + [(None,), ("",)]
    whole = token_counts.frequent_lengths
    monkeypatch.setattr(token_counts, "frequent_lengths", lambda *a: kept.append(whole(*a)) or kept[0])
    monkeypatch.setattr(token_counts, "HELD", 50)
    assert token_counts.token_counts(spark.createDataFrame(rows, "text string").withColumn("doc_id", F.lit(1)).repartition(6), table_size=200).count() == len(rows)
    seen = Counter(t for text, in rows for t in token_counts.regex.findall(token_counts.PATTERN, text or "") if len(t) <= 64)
    want = sorted(seen, key=lambda t: (-seen[t], t.encode()))[:200]
    assert kept == [(want, [len(library.encode(t, add_special_tokens=False).ids) for t in want])]


def test_frequent_table_is_exact():
    table = token_counts.FrequentLengths(["a", " b", "c"], [1, 2, 3])
    assert [table.get(t) for t in ("a", " b", "c", "d")] == [1, 2, 3, 0]


# packing

def check_packing(made, texts, length=4096, end_id=2):
    library = tokenizer("word_bpe_49k.json")
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [end_id]) for i, t in texts]
    expected = ordered((i, s, len(x[s:s + length]), zlib.crc32(np.array(x[s:s + length], "<u4").tobytes()), len(x)) for i, x in ids for s in range(0, len(x), length))
    assert ordered((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in made) == expected
    sequences = defaultdict(list)
    for r in made:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    return 1 - sum(r["length"] for r in made) / (length * max(1, len(sequences)))


def test_packing(docs, messy, nothing):
    check_packing(packing.pack(docs).collect(), [(i, t) for i, t, *_ in messy])
    check_packing(packing.pack(docs, length=64).collect(), [(i, t) for i, t, *_ in messy], 64)
    assert packing.pack(nothing).count() == 0


def test_packing_of_a_table_has_little_padding(spark, folder):
    docs = read(spark, folder, "documents")
    assert check_packing(packing.pack(docs).collect(), rows_of(docs)) < 0.05


@pytest.mark.parametrize("histogram", [{10: 1_000_000}, {4096: 3, 1: 1}, {4000: 5, 96: 2, 50: 7, 3: 100}, {i: i % 7 + 1 for i in range(1, 4097)}, {}])
def test_plan_places_every_piece_once(histogram):
    plan = packing.plan_packs(histogram, 4096)
    used = defaultdict(int)
    for pattern, packs in plan:
        assert packs > 0 and sum(size * times for size, times in pattern) <= 4096
        for size, times in pattern:
            used[size] += packs * times
    assert dict(used) == histogram
    slots = packing.slots_of(plan)
    for size, count in histogram.items():
        if count < 1000:
            sequence, offset = packing.place(np.full(count, size), np.arange(count), slots)
            assert len(set(zip(sequence.tolist(), offset.tolist()))) == count
