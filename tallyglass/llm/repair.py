"""Repair of damaged conversations by a generalised LR parser over the roles.

Grammar of the roles of a whole conversation (s system, u user, a assistant):

    C -> empty | T | s T        T -> u a | T u a

A row is shifted as it is (Keep), under another role (Rerole) or not at all (Delete); a
missing turn may be shifted without a row (Insert). All ways go on side by side in a
graph-structured stack: a node is a top state with the way that led there, and of the nodes
with equal tops only that with the least (cost, audit) stays, for equal tops allow the same
rest. The audit is the string of the actions' initials.

Audits are never compared letter by letter. Of two different ways over the same rows
neither is the beginning of the other (a further Insert costs something), so a node keeps
its rank among its step's nodes, and the next step's nodes are ranked by (rank of the node
before, new actions).

Scale. Rows are dealt by ranges of (conversation, turn, role, beginning of the text) and
sorted, so a conversation of any length is spread over many tasks. Conversations that lie
within one task and one segment (`SEGMENT_ROWS`, `SEGMENT_CHARS`) are finished there. All
others, among them the first and the last of every task, which a range's border may have
cut, take a second way: repeats are found by an aggregate over (conversation, role, text),
tasks turn their segments into counts and into the least way from every top state to every
other, and the segments are put together in order. Only the hash of a conversation's whole
text is a sequence by nature: the sorted rows of these conversations are streamed through
it without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.llm.common import keep_table, only

INSERT, REROLE, DELETE, TRUNCATED = 5, 1, 2, 5
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 8_000_000
ROLES = {"u": "user", "a": "assistant"}
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, SOUND = "bdt-"

# LR states by what the stack holds: nothing; s; T; u on nothing or s; s T; u on T or s T.
START, SYSTEM, TURNS, USER, SYSTEM_TURNS, NEXT_USER = range(6)
SHIFTS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, TURNS: {"u": NEXT_USER}, SYSTEM_TURNS: {"u": NEXT_USER}, USER: {}, NEXT_USER: {}}
GOTO_TURNS = {START: TURNS, SYSTEM: SYSTEM_TURNS}
ACCEPTING = (START, TURNS, SYSTEM_TURNS)
#: A stack for every top a segment may begin with; tops of equal rests (T and s T, both u) share one.
FIRST_STACKS = ((START,), (START, SYSTEM), (START, TURNS), (START, USER))
ALIKE = {START: 0, SYSTEM: 1, TURNS: 2, SYSTEM_TURNS: 2, USER: 3, NEXT_USER: 3}
DAMAGES = 20


@lru_cache(maxsize=None)
def shift(stack: tuple[int, ...], role: str) -> tuple[int, ...] | None:
    """The stack after a role initial is shifted and complete turns are reduced; None where the grammar has no way on."""
    top = stack[-1]
    if role == "a" and top in (USER, NEXT_USER):
        base = stack[:-1] if top == USER else stack[:-2]          # T -> u a takes u off, T -> T u a takes T and u off
        return base + (GOTO_TURNS[base[-1]],)
    return stack + (SHIFTS[top][role],) if role in SHIFTS[top] else None


@lru_cache(maxsize=None)
def inserted(stack: tuple[int, ...]) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """The stack with none, one or two inserted turns: (actions, stack). Three come to what one does."""
    found = [("", stack)]
    for n in (1, 2):
        found += [("I" * n, after) for r in ROLES if (after := shift(found[-1][1], r))]
    return tuple(found)


@lru_cache(maxsize=None)
def moves(stack: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, str, tuple[int, ...]], ...]:
    """Ways over one row: (cost, actions, stack after it)."""
    found = []
    for actions, at in inserted(stack):
        cost = INSERT * len(actions)
        found.append((cost + DELETE, actions + "D", at))
        if fault in (CUT, SOUND):
            more = TRUNCATED if fault == CUT else 0
            found += [(cost + more, actions + "K", after) for after in [shift(at, initial)] if after]
            found += [(cost + REROLE + more, actions + "R", after) for r in ROLES if (after := shift(at, r))]
    return tuple(found)


def ways(symbols: str, first: tuple[int, ...] = (START,)) -> dict[tuple[int, ...], tuple[int, str]]:
    """Least (cost, audit) from a stack over rows to each stack they can end in, one per top.

    A row is two letters of `symbols`: its role's initial (`o` for others) and its fault.
    """
    nodes = {first: (0, 0)}                                       # stack -> (cost, rank of its audit)
    links: list[dict] = []
    for i in range(0, len(symbols), 2):
        best: dict[int, tuple] = {}
        for stack, (cost, rank) in nodes.items():
            for more, actions, after in moves(stack, symbols[i], symbols[i + 1]):
                key = (cost + more, rank, actions, stack, after)
                if after[-1] not in best or key < best[after[-1]]:
                    best[after[-1]] = key
        order = sorted(best.values(), key=lambda k: k[1:3])
        nodes = {k[4]: (k[0], r) for r, k in enumerate(order)}
        links.append({k[4]: (k[3], k[2]) for k in order})
    out = {}
    for stack, (cost, _) in nodes.items():
        audit, at = [], stack
        for step in reversed(links):
            at, actions = step[at]
            audit.append(actions)
        out[stack] = (cost, "".join(reversed(audit)))
    return out


def finish(found: dict[tuple[int, ...], tuple[int, str]]) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation: turns may still be inserted at its end."""
    return min((cost + INSERT * len(actions), audit + actions) for stack, (cost, audit) in found.items() for actions, at in inserted(stack) if at[-1] in ACCEPTING)


@lru_cache(maxsize=1 << 16)
def _known(symbols: str) -> tuple[int, str]:
    return finish(ways(symbols))


def repair(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a conversation; short ones come from the worker's cache."""
    return _known(symbols) if len(symbols) <= 64 else finish(ways(symbols))


def fault_of(text: str, repeated: bool) -> str:
    seen = text.rstrip(BLANKS)
    return BLANK if not seen else DUPLICATE if repeated else CUT if seen[-1] not in ".!?" else SOUND


def initial_of(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "o"


class Replay:
    """Hash of the repaired lines, fed row by row in the order of the audit."""

    def __init__(self, audit: str):
        self.actions, self.hash, self.turn, self.empty = iter(audit), hashlib.sha256(), "u", True

    def _line(self, role: str, text: str) -> None:
        self.hash.update((b"" if self.empty else b"\n") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def _next(self) -> str:
        turn, self.turn = self.turn, "a" if self.turn == "u" else "u"
        return ROLES[turn]

    def row(self, role: str, text: str) -> None:
        while (action := next(self.actions)) == "I":
            self._line(self._next(), "")
        if action == "R":
            self._line(self._next(), text)
        elif action == "K":
            if initial_of(role) != "s":
                self._next()
            self._line(role, text)

    def digest(self) -> str:
        for _ in self.actions:
            self._line(self._next(), "")
        return self.hash.hexdigest()


class Segment:
    """Counts and symbols of successive rows of one conversation, in order."""

    def __init__(self):
        self.symbols: list[str] = []
        self.turns: tuple | None = None            # least, greatest, distinct
        self.ends: tuple[str, str] | None = None   # first and last role initial as written
        self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        self.symbols.append(initial_of(role) + fault_of(text, repeated))
        if turn is not None:
            least, last, n = self.turns or (turn, None, 0)
            self.turns = (least, turn, n + (turn != last))
        if self.ends:
            self.illegal += self.ends[1] + role[:1] not in LEGAL
        self.ends = (self.ends[0] if self.ends else role[:1], role[:1])

    def counts(self) -> dict:
        faults = [s[1] for s in self.symbols]
        least, last, n = self.turns or (0, -1, 0)
        return {"gaps": last - least + 1 - n, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": self.illegal}


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): by crc32 of `conv_id:turn` modulo 20, 0 drops a row (it stays with an empty text, marked), 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the user's. A null role, text, or null in the hashed pair is one space."""
    d = only(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)

    def part(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % DAMAGES
    d = d.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = d.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("dropped"),
                    F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return made.drop("copy")


def _sorted_ranges(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges and sorted. Equal rows stay together, for they agree in all columns of the range."""
    dealt = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32))
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _frame(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _whole(rows: DataFrame, segment_rows: int, segment_chars: int) -> DataFrame:
    """One row per conversation of sorted ranges: its result, or `cut` where this task may not hold all of it or it is too long."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, cut boolean, {RESULT}"
    arrow = _arrow(schema)

    def result(conv, held: list[tuple]) -> dict:
        part, seen = Segment(), set()
        for turn, role, text in held:
            part.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        cost, audit = repair("".join(part.symbols))
        replay = Replay(audit)
        for _, role, text in held:
            replay.row(role, text)
        return {"conv_id": conv, "cut": False, **part.counts(), "cost": cost, "audit": audit, "repaired_sha256": replay.digest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, current, started, first = [], [], 0, None, False, True

        for conv, turn, role, text, dropped in _rows_of(batches):
            if not started or conv != current:
                if started:
                    out.append({"conv_id": current, "cut": True} if first or held is None else result(current, held))
                    first = False
                started, current, held, size = True, conv, [], 0
                if len(out) >= 1000:
                    yield _frame(out, arrow)
                    out = []
            if held is not None and not dropped and not first:
                held.append((turn, role, text))
                size += len(text)
                if len(held) > segment_rows or size > segment_chars:
                    held = None
        if started:
            out.append({"conv_id": current, "cut": True})        # the next range may go on with it
        if out:
            yield _frame(out, arrow)
    return rows.select("conv_id", "turn", "role", "text", "dropped").mapInArrow(run, schema)


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Segments of sorted ranges of (conv_id, turn, role, text, dropped, later), where `later` marks rows whose role and text stand at an earlier turn."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = "least long, last long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
    schema = f"conv_id {kind}, at long, {counts}, ways array<struct<start:int, end:int, cost:long, audit:string>>"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current, part, before = TaskContext.get().partitionId() << 33, None, None, None

        def made() -> pa.RecordBatch:
            text = "".join(part.symbols)
            found = [{"start": o, "end": ALIKE[s[-1]], "cost": c, "audit": a} for o, stack in enumerate(FIRST_STACKS) for s, (c, a) in ways(text, stack).items()]
            return _frame([{"conv_id": current, "at": at, **part.counts(), "least": (part.turns or [None])[0], "last": part.turns and part.turns[1], "turns": (part.turns or (0, 0, 0))[2],
                            "head": part.ends and part.ends[0], "tail": part.ends and part.ends[1], "ways": found}], arrow)
        for conv, turn, role, text, dropped, later in _rows_of(batches):
            if part is None or conv != current or len(part.symbols) >= segment_rows:
                if part is not None:
                    yield made()
                    at += 1
                current, part = conv, Segment()
            if not dropped:
                row = (conv, turn, role, text)
                part.add(turn, role, text, later or row == before)
                before = row
        if part is not None:
            yield made()
    return rows.select("conv_id", "turn", "role", "text", "dropped", "later").mapInArrow(run, schema)


def _put_together(segments: DataFrame) -> DataFrame:
    """One row per conversation from its segments, in order."""
    import pandas as pd

    schema = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        best, tail, illegal, turns, least, last = {0: (0, "")}, None, 0, 0, None, None
        for r in part.itertuples():
            if r.head is not None:
                illegal += tail is not None and tail + r.head not in LEGAL
                tail = r.tail
            if r.turns:
                turns += r.turns - (last == r.last_first)
                least, last = r.last_first if least is None else least, r.last
            if len(r.ways):
                after: dict[int, tuple[int, str]] = {}
                for w in r.ways:
                    if w["start"] in best:
                        cost, audit = best[w["start"]]
                        way = (cost + w["cost"], audit + w["audit"])
                        after[w["end"]] = min(way, after.get(w["end"], way))
                best = after
        cost, audit = finish({FIRST_STACKS[t]: w for t, w in best.items()})
        sums = {c: int(part[c].sum()) for c in ("blank", "duplicate", "truncated")}
        return pd.DataFrame([{"conv_id": part["conv_id"].iloc[0], "gaps": int(last - least + 1 - turns) if turns else 0, **sums, "illegal": int(part["illegal"].sum()) + illegal, "cost": cost, "audit": audit}])
    return segments.withColumnRenamed("least", "last_first").groupBy("conv_id").applyInPandas(run, schema)


def _hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`found` with the hash of the repaired text: each conversation's row goes before its sorted rows, which stream through."""
    kind = found.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {RESULT}"
    arrow, names = _arrow(schema), COLUMNS[:-1]
    lead = found.select("conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), *names)
    rest = rows.where("NOT dropped").select("conv_id", F.lit(1).alias("step"), "turn", "role", "text", *[F.lit(None).cast(found.schema[n].dataType).alias(n) for n in names])
    dealt = lead.unionAll(rest).repartition("conv_id").sortWithinPartitions("conv_id", "step", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, replay = None, None
        for conv, step, _, role, text, *values in _rows_of(batches):
            if step == 0:
                if current:
                    yield _frame([{**current, "repaired_sha256": replay.digest()}], arrow)
                current = {"conv_id": conv, **dict(zip(names, values))}
                replay = Replay(current["audit"])
            else:
                replay.row(role, text)
        if current:
            yield _frame([{**current, "repaired_sha256": replay.digest()}], arrow)
    return dealt.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, dropped): its counts, the cost and audit of the cheapest repair, and the hash of the repaired lines `role:text`.

    Rows follow their turn (nulls first), then role and text. A row whose role begins with
    none of s, u and a, or is empty, cannot be kept as it is. Rows without a conversation's
    id are one conversation. `dropped` rows count for nothing, but a conversation of such
    rows only is returned, with zeros, an empty audit and the hash of nothing. No rows, no result.
    """
    whole = keep_table(_whole(_sorted_ranges(rows), segment_rows, segment_chars), "repaired")
    cut = keep_table(whole.where("cut").select(F.col("conv_id").alias("cut_id")).distinct(), "cut-conversations")       # a table of its own: its size is known when the join is planned
    again = rows.join(cut, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left_semi").withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    again = keep_table(again, "cut-rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = again.where("NOT dropped").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(order).alias("first"))
    marked = again.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left").select(
        "conv_id", "turn", "role", "text", "dropped", F.coalesce(order > F.col("first"), F.lit(False)).alias("later"))
    found = keep_table(_put_together(keep_table(_segments(_sorted_ranges(marked), segment_rows), "segments")), "joined")
    return whole.where("NOT cut").select("conv_id", *COLUMNS).unionAll(_hashed(again, found).select("conv_id", *COLUMNS))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Damage by rule, then repair: one row per conversation of the table."""
    return repair_conversations(damage(conversations))
