"""Phrase collocations through weighted acyclic automata.

Every task counts the phrases of its texts in shards of about a million words, sorts them
and adds them in order to an automaton: arcs are words, an arc's weight is the count of the
phrase that ends with it. A state is closed when its last phrase is in, and looked up in a
register of closed states, so phrases with the same continuations and counts share one.
Shards are cut by ranges of prefixes (language, first word, second word); per range the
automata are united, weights of equal phrases summed, and what is rarer than `least` is
dropped, for parts of a candidate are never rarer than the candidate. A candidate's parts
are looked up by composing an automaton of the parts asked for with the range's counts.

Scale. A task holds one shard or one range. Ranges are cut at words of a bounded sample of
the shards' own phrases, which begins at another place in every shard, so that alike shards
do not all name the same words; a hot first word is cut by its second; the cuts, at most
`MOST_RANGES` pairs of at most `CUT_BYTES` bytes each, are all that is broadcast. They
decide about balance only, never about counts. Long texts are cut at blanks, with the words
before the cut as context.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.llm.common import give_back, keep_table, only, slices

WIDTH, LEAST, TOP, INSIDE = 3, 10, 2000, 50
SHARD_BYTES, RANGE_ENTRIES, MARK = 4_000_000, 700_000, 1 << 13
MOST_RANGES, MOST_MARKS, CUT_BYTES = 1 << 16, 1 << 19, 32
STATES = 1 << 15
STOPS = b".,;:!?\n\x0b\x0c\r"
#: Stops become one kind, tabs become blanks.
TO_STOPS = bytes.maketrans(STOPS + b"\t", b"." * len(STOPS) + b" ")
ARC = np.dtype([("label", "<i4"), ("target", "<i4"), ("weight", "<i8")])


def folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and the place of every given key among them."""
    if not len(keys):
        return keys, counts, np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    run = keys[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    return run[at], np.add.reduceat(counts[order], at), place


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start to before its end, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.empty(0, np.int64)


class Sorted:
    """Phrases in order with their counts: `words` in byte order, and per length (last word, place of the phrase without it, count)."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    def entries(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def phrases(self, length: int) -> list[tuple[bytes, ...]]:
        """All phrases of a length as tuples of words."""
        columns, at = [], np.arange(len(self.levels[length - 1][0]))
        for label, parent, _ in reversed(self.levels[:length]):
            columns.append([self.words[i] for i in label[at]])
            at = parent[at]
        return list(zip(*reversed(columns)))

    def marks(self, step: int, start: int) -> list[tuple[bytes, bytes]]:
        """(first, second word) of every `step`-th entry from `start` on."""
        if len(self.levels) < 2 or not len(self.levels[1][0]):
            return []
        label, parent, _ = self.levels[1]
        longer = np.bincount(self.levels[2][1], minlength=len(label)) if len(self.levels) > 2 else 0
        at = np.searchsorted(np.cumsum(1 + longer), np.arange(start, int(len(label) + np.sum(longer)), step))
        return [(self.words[parent[i]][:CUT_BYTES], self.words[label[i]][:CUT_BYTES]) for i in at[at < len(label)]]

    def cut(self, cuts: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, Sorted]]:
        """(number, part) of the non-empty parts between successive cuts. A phrase goes with its first two words, a single word before all its phrases; a first word whose count is elsewhere has count 0."""
        words, v = self.words, len(self.words)
        firsts, seconds = [0], [0]
        keys = self.levels[1][1] * v + self.levels[1][0]
        for one, two in cuts:
            i = bisect_left(words, one)
            same = i < v and words[i] == one
            firsts.append(i + (same and two > b""))
            seconds.append(int(np.searchsorted(keys, i * v + (bisect_left(words, two) if same else 0))))
        firsts.append(v)
        seconds.append(len(keys))
        for number in range(len(cuts) + 1):
            one, two = slice(*firsts[number:number + 2]), slice(*seconds[number:number + 2])
            if one.start >= one.stop and two.start >= two.stop:
                continue
            parents = self.levels[1][1][two]
            lo, hi = (min(one.start, parents[0]), max(one.stop, parents[-1] + 1)) if len(parents) and one.start < one.stop else (parents[0], parents[-1] + 1) if len(parents) else (one.start, one.stop)
            numbers = np.arange(lo, hi)
            levels = [(numbers, np.zeros(len(numbers), np.int64), np.where((numbers >= one.start) & (numbers < one.stop), self.levels[0][2][lo:hi], 0))]
            base, span = lo, two
            for label, parent, count in self.levels[1:]:
                levels.append((label[span], parent[span] - base, count[span]))
                base, following = span.start, self.levels[len(levels)][1] if len(levels) < len(self.levels) else None
                if following is not None:
                    span = slice(*np.searchsorted(following, (span.start, span.stop)).tolist())
            used = np.unique(np.concatenate([level[0] for level in levels]))
            yield number, Sorted([words[i] for i in used], [(np.searchsorted(used, label), parent, count) for label, parent, count in levels])


class Automaton:
    """States by depth; those of the last depth have no arcs. `depths[d]` is (where each state's arcs begin, arcs)."""

    def __init__(self, words: list[bytes], depths: list[tuple[np.ndarray, np.ndarray]]):
        self.words, self.depths = words, depths

    @classmethod
    def of(cls, given: Sorted) -> Automaton:
        """Add sorted phrases prefix by prefix; a prefix whose phrases are all in is closed and shared through the register."""
        depths, targets = [], np.zeros(len(given.levels[-1][0]), np.int64)
        for depth in range(len(given.levels) - 1, -1, -1):
            label, parent, count = given.levels[depth]
            arcs = np.empty(len(label), ARC)
            arcs["label"], arcs["target"], arcs["weight"] = label, targets, count
            above = len(given.levels[depth - 1][0]) if depth else 1
            ends = np.searchsorted(parent, np.arange(above + 1))
            data, size, register, states = arcs.tobytes(), ARC.itemsize, {b"": 0}, np.empty(above, np.int64)
            for at in range(0, above, STATES):
                marks = (ends[at:at + STATES + 1] * size).tolist()
                states[at:at + STATES] = [register.setdefault(data[lo:hi], len(register)) for lo, hi in zip(marks, marks[1:])]
            held = b"".join(register)
            sizes = np.fromiter((len(k) // size for k in register), np.int64, len(register))
            depths.append((np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(held, ARC)))
            targets = states
        depths.reverse()
        begins, arcs = depths[0]
        depths[0] = (np.array([0, len(arcs)]), arcs)               # one root
        return cls(given.words, depths)

    def unfold(self) -> Sorted:
        """All phrases, in order."""
        levels, states, parents = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
        for begins, arcs in self.depths:
            lo, hi = begins[states], begins[states + 1]
            at = spread(lo, hi)
            parents = np.repeat(np.arange(len(states)), hi - lo)
            levels.append((arcs["label"][at].astype(np.int64), parents, arcs["weight"][at]))
            states = arcs["target"][at].astype(np.int64)
        return Sorted(self.words, levels)

    def weights(self, asked: Sorted) -> list[np.ndarray]:
        """Compose with an automaton of phrases: per length, the weight of each phrase asked for, 0 where it is not held."""
        numbers = {w: i for i, w in enumerate(self.words)}
        known = np.array([numbers.get(w, -1) for w in asked.words], np.int64)
        out, states, v = [], np.zeros(1, np.int64), len(self.words) + 1
        for (begins, arcs), (label, parent, _) in zip(self.depths, asked.levels):
            held = np.repeat(np.arange(len(begins) - 1), np.diff(begins)) * v + arcs["label"]
            key = np.where((states[parent] >= 0) & (known[label] >= 0), states[parent] * v + known[label], -1)
            at = np.minimum(np.searchsorted(held, key), max(len(held) - 1, 0))
            hit = (held[at] == key) if len(held) else np.zeros(len(key), bool)
            out.append(np.where(hit, arcs["weight"][at] if len(held) else 0, 0))
            states = np.where(hit, arcs["target"][at] if len(held) else -1, -1)
        return out

    def pack(self) -> bytes:
        import zstandard

        lexicon = b" ".join(self.words)
        parts = [np.array([len(self.depths), len(self.words), len(lexicon)] + [n for begins, arcs in self.depths for n in (len(begins), len(arcs))], "<i8").tobytes(), lexicon]
        for begins, arcs in self.depths:
            parts += [np.diff(begins).astype("<i4").tobytes(), *[arcs[n].tobytes() for n in ARC.names]]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def unpack(cls, blob: bytes) -> Automaton:
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(blob)
        n, n_words, size = np.frombuffer(data, "<i8", 3).tolist()
        shape = np.frombuffer(data, "<i8", 2 * n, 24).tolist()
        at = 24 + 16 * n
        words = data[at:at + size].split(b" ") if n_words else []
        at += size
        depths = []
        for n_begins, n_arcs in zip(shape[::2], shape[1::2]):
            sizes = np.frombuffer(data, "<i4", n_begins - 1, at)
            at += 4 * (n_begins - 1)
            arcs = np.empty(n_arcs, ARC)
            for name in ARC.names:
                arcs[name] = np.frombuffer(data, ARC[name], n_arcs, at)
                at += ARC[name].itemsize * n_arcs
            depths.append((np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), arcs))
        return cls(words, depths)


def count(tokens: list[bytes], context: int, width: int = WIDTH) -> tuple[int, Sorted]:
    """(words, phrases of up to `width` words) of tokens, of which the first `context` only begin phrases; `.` parts."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    x = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    stop = number.pop(b".", -1)
    words = sorted(number)
    rank = np.full(len(number) + (stop >= 0), -1, np.int64)
    rank[[number[w] for w in words]] = np.arange(len(words))
    x = rank[x] if len(x) else x
    v, counted = max(len(words), 1), np.arange(len(x)) >= context
    single = np.bincount(x[counted & (x >= 0)], minlength=len(words)).astype(np.int64)
    levels = [(np.arange(len(words)), np.zeros(len(words), np.int64), single)]
    place = x                                                      # of the phrase that ends here, -1 for none
    for _ in range(1, width):
        ends = np.flatnonzero((place[:-1] >= 0) & (x[1:] >= 0)) + 1
        keys, sums, where = folded(place[ends - 1] * v + x[ends], counted[ends].astype(np.int64))
        levels.append((keys % v, keys // v, sums))
        place = np.full(len(x), -1, np.int64)
        place[ends] = where
    return int(single.sum()), Sorted(words, levels)


def unite(parts: Iterable[Sorted], least: int = 1) -> Sorted:
    """Sum the weights of equal phrases; those below `least` go, but for single words with phrases left. The parts are used up."""
    parts = list(parts)
    words = sorted(set().union(*[p.words for p in parts]))
    v, number = max(len(words), 1), {w: i for i, w in enumerate(words)}
    new = [np.array([number[w] for w in p.words], np.int64) for p in parts]
    levels, above = [], [np.zeros(1, np.int64) for _ in parts]
    for depth in range(len(parts[0].levels)):
        keys, counts = [], []
        for p, known, up in zip(parts, new, above):
            label, parent, c = p.levels[depth]
            p.levels[depth] = None                                 # read once
            place = up[parent]
            keys.append(np.where(place >= 0, place * v + known[label], -1))
            counts.append(c)
        owners = np.cumsum([0] + [len(k) for k in keys])
        key, c = np.concatenate(keys), np.concatenate(counts)
        stay = np.flatnonzero(key >= 0)
        distinct, sums, where = folded(key[stay], c[stay])
        keep = (sums >= least) if depth else np.ones(len(sums), bool)
        renumbered = np.where(keep, np.cumsum(keep) - 1, -1)
        place = np.full(len(key), -1, np.int64)
        place[stay] = renumbered[where] if len(where) else where
        above = [place[lo:hi] for lo, hi in zip(owners, owners[1:])]
        levels.append((distinct[keep] % v, distinct[keep] // v, sums[keep]))
    label, parent, c = levels[0]
    need = c >= least
    need[levels[1][1]] = True
    levels[0] = (label[need], parent[need], c[need])
    levels[1] = (levels[1][0], (np.cumsum(need) - 1)[levels[1][1]], levels[1][2])
    used = np.unique(np.concatenate([level[0] for level in levels])).astype(np.int64)
    return Sorted([words[i] for i in used], [(np.searchsorted(used, label), parent, c) for label, parent, c in levels])


def of_phrases(phrases: list[tuple[bytes, ...]], width: int = WIDTH) -> Sorted:
    """Sorted phrases of distinct word tuples, with the beginnings that they need; all counts 1."""
    words = sorted({w for p in phrases for w in p})
    number = {w: i for i, w in enumerate(words)}
    levels, place = [], {(): 0}
    for length in range(1, width + 1):
        beginnings = sorted({p[:length] for p in phrases if len(p) >= length})
        levels.append((np.array([number[p[-1]] for p in beginnings], np.int64), np.array([place[p[:-1]] for p in beginnings], np.int64), np.ones(len(beginnings), np.int64)))
        place = {p: i for i, p in enumerate(beginnings)}
    return Sorted(words, levels)


def _slices(data: bytes, size: int, width: int) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, how many of them are context) of data in pieces of about `size` bytes, cut at blanks."""
    at, context = 0, []
    while at < len(data):
        end = len(data) if len(data) - at <= size else data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        tokens = context + data[at:end].split()
        before, context, at = len(context), tokens[-(width - 1):] if width > 1 else [], end
        yield tokens, before


def shards(docs: DataFrame, width: int = WIDTH, size: int = SHARD_BYTES) -> DataFrame:
    """(lang, n words, entries, marks, blob) of every shard of (lang, text)."""
    mark = pa.struct([("one", pa.binary()), ("two", pa.binary())])
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("entries", pa.int64()), ("marks", pa.list_(mark)), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)

        def made(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for tokens, context in _slices(b" . ".join(held.pop(lang)), size, width):
                n, found = count(tokens, context, width)
                tokens.clear()                                     # the automaton needs no texts
                if found.words:
                    blob = Automaton.of(found).pack()
                    marks = [{"one": a, "two": b} for a, b in found.marks(MARK, zlib.crc32(blob) % MARK)]
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "n": [n], "entries": [found.entries()], "marks": [marks], "blob": [blob]}, schema=schema)
                del found
                give_back()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass").lower().translate(TO_STOPS).replace(b".", b" . ")
                held[lang].append(data)
                sizes[lang] += len(data) + 3
                if sizes[lang] >= size:
                    yield from made(lang)
            while sum(sizes.values()) > 2 * size:                  # many languages: the fullest goes
                yield from made(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield from made(lang)
    return docs.select("lang", "text").mapInArrow(run, "lang string, n long, entries long, marks array<struct<one:binary,two:binary>>, blob binary")


def cuts_of(counted: DataFrame, range_entries: int = RANGE_ENTRIES) -> list[tuple[str, bytes, bytes]]:
    """(lang, first, second word) where ranges begin, in order, from a sample of at most about MOST_MARKS marks."""
    marks = counted.select("lang", F.explode("marks").alias("m")).select("lang", "m.one", "m.two")
    total = counted.agg(F.sum("entries").alias("n"), F.sum(F.size("marks")).alias("m")).first()
    ranges = min(MOST_RANGES, -(-(total["n"] or 0) // range_entries))
    if ranges <= 1:
        return []
    if total["m"] > MOST_MARKS:
        marks = marks.where(F.pmod(F.xxhash64("lang", "one", "two"), F.lit(total["m"])) < MOST_MARKS)
    rows = sorted((r["lang"].encode("utf-8", "surrogatepass"), bytes(r["one"]), bytes(r["two"])) for r in marks.collect())
    return sorted({rows[i * len(rows) // ranges] for i in range(1, ranges)}) if rows else []


def ranged(counted: DataFrame, cuts) -> DataFrame:
    """(part, lang, blob): every shard cut into its prefix ranges."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("blob", pa.binary())])
    sent = counted.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in range(batch.num_rows)):
                key = lang.encode("utf-8", "surrogatepass")
                lo, hi = bisect_left(sent.value, (key,)), bisect_left(sent.value, (key + b"\x00",))
                made = [(lo + i, Automaton.of(s).pack()) for i, s in Automaton.unpack(blob).unfold().cut([c[1:] for c in sent.value[lo:hi]])]
                yield pa.RecordBatch.from_pydict({"part": [m[0] for m in made], "lang": [lang] * len(made), "blob": [m[1] for m in made]}, schema=schema)
                del made
                give_back()
    return counted.select("lang", "blob").mapInArrow(run, "part int, lang string, blob binary")


def united(slices: DataFrame, cuts, least: int = LEAST) -> DataFrame:
    """Per range: one row with the united automaton (`blob`), and one per candidate with its count and its cuts into two parts (words and the range that counts them)."""
    end = pa.struct([("k", pa.int32()), ("left", pa.string()), ("left_part", pa.int32()), ("right", pa.string()), ("right_part", pa.int32())])
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("cuts", pa.list_(end)), ("blob", pa.binary())])
    sent = slices.sparkSession.sparkContext.broadcast(cuts)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        part, lang = key[0].as_py(), key[1].as_py()
        found = unite([Automaton.unpack(b).unfold() for b in group.column("blob").to_pylist()], least)
        code = lang.encode("utf-8", "surrogatepass")
        rows = [{"part": part, "lang": lang, "blob": Automaton.of(found).pack()}]

        def where(words: tuple[bytes, ...]) -> int:
            return bisect_right(sent.value, (code, words[0], words[1] if len(words) > 1 else b""))
        for length in range(2, len(found.levels) + 1):
            for words, a in zip(found.phrases(length), found.levels[length - 1][2].tolist()):
                parts = [(k, words[:k], words[k:]) for k in range(1, length)]
                rows.append({"part": part, "lang": lang, "phrase": b" ".join(words).decode("utf-8", "surrogatepass"), "a": a, "cuts": [
                    {"k": k, "left": b" ".join(x).decode("utf-8", "surrogatepass"), "left_part": where(x), "right": b" ".join(y).decode("utf-8", "surrogatepass"), "right_part": where(y)} for k, x, y in parts]})
        del found
        give_back()
        return pa.Table.from_pylist(rows, schema=schema)
    return slices.groupBy("part", "lang").applyInArrow(run, "part int, lang string, phrase string, a long, cuts array<struct<k:int,left:string,left_part:int,right:string,right_part:int>>, blob binary")


def looked_up(asked: DataFrame, automata: DataFrame, width: int = WIDTH) -> DataFrame:
    """(lang, words, f) of the distinct (part, lang, words) asked for, range by range."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.string()), ("f", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        wanted = sorted(tuple(w.encode("utf-8", "surrogatepass").split(b" ")) for w in left.column("words").to_pylist())
        query, lang = of_phrases(wanted, width), left.column("lang")[0].as_py()
        weights = Automaton.unpack(right.column("blob")[0].as_py()).weights(query)
        rows, only_these = [], set(wanted)
        for length, w in enumerate(weights, 1):
            rows += [{"lang": lang, "words": b" ".join(p).decode("utf-8", "surrogatepass"), "f": f} for p, f in zip(query.phrases(length), w.tolist()) if p in only_these]
        return pa.Table.from_pylist(rows, schema=schema)
    return asked.groupBy("part", "lang").cogroup(automata.groupBy("part", "lang")).applyInArrow(run, "lang string, words string, f long")


def collocations(docs: DataFrame, width: int = WIDTH, least: int = LEAST, top: int = TOP, inside: int = INSIDE, lang_col: str = "lang", text_col: str = "text",
                 shard_bytes: int = SHARD_BYTES, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `width` words.

    Null texts are empty, a null language is `und`. A phrase needs `least` occurrences and
    goes if a longer candidate around it has at least `inside` per cent of them. Ties go to
    the greater count, then to the phrase that is first in byte order. Languages without
    candidates, and empty tables, give no rows.
    """
    rows = only(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = keep_table(shards(rows, width, shard_bytes), "shards")
    cuts = cuts_of(counted, range_entries)
    few = counted.repartition(-(-counted.count() // 4) or 1)          # a task's batch holds few shards, however many share a file
    held = keep_table(united(ranged(few, cuts), cuts, least), "ranges")
    found = held.where("blob IS NULL").select("lang", "phrase", "a", "cuts")
    cut = found.select("lang", "phrase", "a", F.explode("cuts").alias("cut")).select("lang", "phrase", "a", "cut.*")
    asked = cut.select(F.col("left_part").alias("part"), "lang", F.col("left").alias("words")).unionAll(cut.select("right_part", "lang", "right")).distinct()
    parts = keep_table(looked_up(asked, held.where("blob IS NOT NULL").select("part", "lang", "blob"), width), "parts")
    cut = cut.join(parts.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = {c: f"CAST({c} AS DECIMAL(19,0))" for c in "alr"}
    cut = cut.withColumn("score", F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * {exact['a']} * {exact['a']}) DIV (CAST({exact['l']} AS DECIMAL(38,0)) * {exact['r']})"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    words = F.split("phrase", " ")
    longer = found.where(F.size(words) > 2).select("lang", "a", words.alias("w")).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    longer = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(f"around IS NULL OR 100 * around < {inside} * a")
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
