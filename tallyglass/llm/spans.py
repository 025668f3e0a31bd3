"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest prefixes of the model's compiled character map; each
normalised byte records the original byte it came from. The library gives the pieces;
their lengths run through the normalised bytes, and the alignment projects every piece
to a span of original bytes. Ids and decoded text are the library's own.

Where the map is empty, as in the plain models, normalisation only writes blanks as the
word mark, and if no piece has a mark behind another character, words are encoded one
by one through a worker's cache: merges cannot cross their edges.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tallyglass.llm.common import map_rows, only
from tallyglass.llm.vocab import Cache, file_of

MARK = "▁"
MARK_BYTES = MARK.encode()

class CharacterMap:
    """The compiled map: a double-array trie of prefixes and a pool of their replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.pool = compiled[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes covered, replacement) of the longest known prefix of data[at:]."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.pool[start:self.pool.index(b"\0", start)]


class Normalizer:
    """Normalisation with alignment; the flags are those of the model file."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and not self.squeeze and self.escape

    def align(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, original byte offset of each, and at the end the length of the original)."""
        data = text.encode()
        return self._align_plain(data) if self.plain else self._align(data)

    def _align_plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        times = np.where(raw == 32, len(MARK_BYTES), 1)
        origin = np.repeat(np.arange(len(raw)), times)
        lead = len(MARK_BYTES) if self.prefix and data else 0
        return (MARK_BYTES if lead else b"") + data.replace(b" ", MARK_BYTES), np.concatenate([np.zeros(lead, np.int64), origin, [len(data)]])

    def _align(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = MARK_BYTES if self.escape else b" "
        out, origin = bytearray(), []
        parts, at = [], 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = size, data[at:at + size]
            parts.append((at, found[1]))
            at += found[0]
        end = len(data)
        if self.squeeze:
            while parts and parts[0][1] in (b" ", b""):
                parts.pop(0)
        if self.prefix and parts:
            out += space
            origin += [parts[0][0]] * len(space)
        was_space = self.squeeze
        for start, chunk in parts:
            if self.squeeze and was_space:
                chunk = chunk.lstrip(b" ")
            if chunk:
                for byte in chunk:
                    new = space if byte == 32 else bytes([byte])
                    out += new
                    origin += [start] * len(new)
                was_space = chunk.endswith(b" ")
        if self.squeeze:
            while out.endswith(space) and len(out) > (len(space) if self.prefix else 0):
                end = origin[len(out) - len(space)]
                del out[-len(space):]
                del origin[-len(space):]
        return bytes(out), np.array([*origin, end], np.int64)


class Pieces:
    """A model with what spans need: the normalised length of each piece."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(file_of(name), "rb") as f:
            model.ParseFromString(f.read())
        self.library = SentencePieceProcessor(model_file=file_of(name))
        self.normalizer = Normalizer(model.normalizer_spec)
        kind = model.SentencePiece
        self.sizes = np.array([1 if p.type == kind.BYTE else 0 if p.type in (kind.CONTROL, kind.UNKNOWN) else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = self.library.unk_id()
        joins = any(MARK in p.piece.lstrip(MARK) for p in model.pieces) or any(p.type == kind.USER_DEFINED for p in model.pieces)
        self.by_word = self.normalizer.plain and self.normalizer.prefix and not joins
        self.by_word &= self.library.piece_to_id(MARK) != self.unknown
        self.cache = Cache(self._word)

    def _word(self, word: str) -> bytes:
        """Ids of a word with the word mark in front, which the library's prefix writes; no word: the mark alone."""
        return np.array(self.library.encode(word) if word else [self.library.piece_to_id(MARK)], np.int32).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if not self.by_word or MARK in text or "\0" in text:
            return np.array(self.library.encode(text), np.int32)
        words = text.split(" ")
        if "" in words:
            words = _with_blanks(words)
        return np.frombuffer(b"".join(self.cache.all_of(words)), np.int32)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of every piece in the original text."""
        if (ids == self.unknown).any():          # an unknown piece has no length of its own
            pieces = self.library.encode(text, return_type="proto").pieces
            return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)
        normalised, origin = self.normalizer.align(text)
        ends = np.cumsum(self.sizes[ids])
        if len(ids) and ends[-1] != len(normalised):
            raise ValueError("pieces and normalised text differ in length")
        return origin[ends - self.sizes[ids]], origin[ends]


def _with_blanks(words: list[str]) -> list[str]:
    """Units of a text split at single blanks: an empty part is a blank that goes to the next word; the last ones stand alone."""
    units, blanks = [], 0
    for w in words:
        if w:
            units.append(" " * blanks + w)
            blanks = 0
        else:
            blanks += 1
    if blanks:
        units.append(" " * (blanks - 1))
    return units


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


def _rows(text: list[str | None], name: str):
    """Per text: ids, begins and ends of the pieces, decoded text."""
    p = pieces(name)
    for t in text:
        ids = p.ids(t or "")
        begins, ends = p.spans(t or "", ids)
        yield ids, begins, ends, p.library.decode(ids.tolist()) if len(ids) else ""


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): piece ids and the spans of original bytes they stand for, one row per document.

    Null and empty texts have no ids and decode to the empty text. Long texts are encoded
    whole. Rows with equal or null ids are separate documents.
    """
    d = only(docs, doc_id=id_col, text=text_col)

    def per_batch(doc_id, text):
        ids, begins, ends, decoded = zip(*_rows(text, name))
        return {"doc_id": doc_id, "ids": ids, "begins": begins, "ends": ends, "decoded": decoded}
    return map_rows(d, per_batch, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string")


def encode_digests(docs: DataFrame, name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_text, decoded, covered): the same encoding with the ids as decimal text and, instead of the spans, the number of original bytes they cover."""
    d = only(docs, doc_id=id_col, text=text_col)

    def per_batch(doc_id, text):
        out = {"doc_id": doc_id, "n_tokens": [], "ids_text": [], "decoded": [], "covered": []}
        for ids, begins, ends, decoded in _rows(text, name):
            out["n_tokens"].append(len(ids))
            out["ids_text"].append(",".join(map(str, ids.tolist())))
            out["decoded"].append(decoded)
            out["covered"].append(int(ends[-1] - begins[0]) if len(ids) else 0)
        return out
    return map_rows(d, per_batch, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_text string, decoded string, covered bigint")
