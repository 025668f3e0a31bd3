"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens by the byte-level pattern; tokens never cross one. Tier one
is a compact hash table of frequent pre-tokens and their token counts, made once and
broadcast: at most `table_size` entries, so its size has a stated bound. Tier two is the
worker's own cache; what it lacks is encoded by the library. The lookup shuffles nothing.
The table is made from all documents: tasks fold their pre-tokens to counts of at most
`HELD` at a time, and only these are summed by pre-token. Neither tier holds pre-tokens of
over LONGEST_HELD characters. Any table gives the same counts of tokens.

Characters that the library's pattern takes for another kind (letter, number, blank, other)
than the one here, as the two know different Unicode versions, are found by the worker
when it first meets a character; a text with one is counted by the library itself.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from tallyglass.llm.common import give_back, map_rows, only, slices
from tallyglass.llm.vocab import LATIN_TEXT, LONGEST_HELD, Generations, as_letters, chunks, tokenizer

#: The byte-level pre-token pattern, and its white space.
SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+"


#: The same pattern for texts that vocab.LATIN_TEXT matches.
LATIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ž]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ž]+|\s+(?!\S)|\s+")

HELD = 200_000          # distinct pre-tokens that a task counts before it hands them on
LISTS = 64              # most tasks that sum counts, as one task merges their lists of the most frequent


class FrequentLengths:
    """Open-addressing table: 64-bit hash of a pre-token -> its token count; two flat arrays, at most half full."""

    def __init__(self, tokens: list[str], lengths: list[int]):
        self.bits = max(4, (2 * len(tokens)).bit_length())
        self.keys, self.lengths = array("Q", bytes(8 << self.bits)), array("I", bytes(4 << self.bits))
        for token, n in zip(tokens, lengths):
            h = xxh3_64_intdigest(token) or 1
            at = h >> (64 - self.bits)
            while self.keys[at] and self.keys[at] != h:
                at = (at + 1) % len(self.keys)
            # two pre-tokens of one hash and different counts: left to tier two
            self.lengths[at] = 0 if self.keys[at] == h and self.lengths[at] != n else n
            self.keys[at] = h

    def get(self, token: str) -> int:
        """Token count of a pre-token, 0 where the table has none."""
        h = xxh3_64_intdigest(token) or 1
        at = h >> (64 - self.bits)
        while self.keys[at]:
            if self.keys[at] == h:
                return self.lengths[at]
            at = (at + 1) % len(self.keys)
        return 0


class Counts:
    """Worker side: both tiers behind one dictionary of what this worker has met."""

    def __init__(self, name: str, table: FrequentLengths):
        library = tokenizer(name)
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.cut_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern, self.table = regex.compile(PATTERN), table
        self.library, self.merge = library, library.model.tokenize
        self.plain, self.odd = set(), set()          # characters met
        self.cache = Generations(self._length)

    def _length(self, token: str) -> int:
        return self.table.get(token) or len(self.merge(as_letters(token)))

    def differ(self, chars: list[str]) -> list[str]:
        """Those characters that the library takes for another kind."""
        texts = [s + s.join(chars) + s for s in "a1!"]
        if all(self.pattern.findall(t) == [t[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(t)] for t in texts):
            return []
        return chars if len(chars) == 1 else self.differ(chars[:len(chars) // 2]) + self.differ(chars[len(chars) // 2:])

    def _is_odd(self, text: str) -> bool:
        met = set(text)
        new = met - self.plain - self.odd
        if new:
            self.odd.update(self.differ(sorted(new)))
            self.plain |= new - self.odd
        return not self.odd.isdisjoint(met)

    def cut(self, text: str) -> tuple[list[str], int] | None:
        """(pre-tokens, special tokens) of a text; None where the library has to cut it. A special token's string is one token, as the library has it."""
        latin = LATIN_TEXT.fullmatch(text) is not None
        find = LATIN_PATTERN.findall if latin else self.pattern.findall
        if not latin and not text.isascii() and self._is_odd(text):
            return None
        if not any(s in text for s in self.special):
            return find(text), 0
        parts = self.cut_special.split(text)
        return [t for p in parts for t in find(p)], len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        """Token count of each text."""
        cut = [self.cut(t) for t in texts]
        known = self.cache.of(set().union(*[c[0] for c in cut if c]))
        return [sum(map(known.__getitem__, c[0])) + c[1] if c else len(self.library.encode(t, add_special_tokens=False).ids) for c, t in zip(cut, texts)]


_COUNTERS: dict[str, Counts] = {}


def _counter(name: str, key: str, sent) -> Counts:
    """This worker's counter of one broadcast table; a newer table replaces it."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counts(name, FrequentLengths(*sent.value))
    return _COUNTERS[key]


def frequent_lengths(docs: DataFrame, name: str, table_size: int, sample_docs: int | None = None, text_col: str = "text") -> tuple[list[str], list[int]]:
    """The `table_size` most frequent pre-tokens of all documents, ties by their bytes, with their token counts.

    With `sample_docs`, of about so many documents of all files: a document is taken by
    the hash of its text, so that copies of one text come together or not at all.
    """
    d = only(docs, text=text_col)
    if sample_docs is not None and (total := d.count()) > sample_docs:
        d = d.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(sample_docs / total * (1 << 40)))
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts, seen = Counts(name, FrequentLengths([], [])), Counter()
        made = lambda: pa.RecordBatch.from_pydict({"token": list(seen), "n": list(seen.values())}, schema=schema)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                cut = counts.cut(text or "")
                seen.update(t for t in (cut[0] if cut else counts.pattern.findall(text)) if len(t) <= LONGEST_HELD)
                if len(seen) > HELD:
                    yield made()
                    seen.clear()
        yield made()
        seen.clear()
        give_back()
    summed = d.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).coalesce(LISTS)
    tokens = [r["token"] for r in summed.orderBy(F.desc("n"), "token").limit(table_size).toLocalIterator()]
    counts = Counts(name, FrequentLengths([], []))
    return tokens, [counts._length(t) for t in tokens]


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512, table_size: int = 32_768, sample_docs: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per document, repeated and null ids too; null texts are empty.

    The counts are those of the library on the whole text without added special tokens;
    a special token's string inside a text is one token, as the library has it.
    """
    d = only(docs, doc_id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, name, table_size, sample_docs, text_col))
    kind, key = d.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def per_batch(doc_id, text):
        counter = _counter(name, key, sent)
        texts = [t or "" for t in text]
        totals = [n for _, some in chunks(texts) for n in counter.counts(some)]
        return {"doc_id": doc_id, "n_bytes": [len((t or "").encode()) for t in text], "n_tokens": totals, "over_limit": [n > limit for n in totals]}
    return map_rows(d, per_batch, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
