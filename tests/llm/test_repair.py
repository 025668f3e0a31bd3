"""Conversation repair against exhaustive search, and the cut conversations against the whole ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import repair

GRAMMAR = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(BLANKS)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def ways_of(initial, fault):
    """(cost, action, initial given) of one row."""
    found = [(2, "D", "")]
    if fault in "t-":
        more = 5 if fault == "t" else 0
        found += [(more, "K", initial), (1 + more, "R", "u"), (1 + more, "R", "a")]
    return found


def exhaustive(rows):
    """(cost, audit, initials) by trying every action of every row and up to two inserts at every place."""
    between = [""] + list("ua") + ["".join(p) for p in itertools.product("ua", repeat=2)]
    best = None
    for chosen in itertools.product(*[ways_of(r[1][:1] if r[1][:1] in list("sua") else "o", f) for r, f in zip(rows, faults(rows))]):
        base = sum(c for c, *_ in chosen)
        for gaps in itertools.product(between, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            given = "".join(g + c[2] for g, c in zip(gaps, [*chosen, (0, "", "")]))
            if GRAMMAR.fullmatch(given):
                audit = "".join("I" * len(g) + c[1] for g, c in zip(gaps, [*chosen, (0, "", "")]))
                best = min(best, (cost, audit, given)) if best else (cost, audit, given)
    return best


def stepwise(rows):
    """(cost, audit, initials) row by row, keeping whole strings: least (cost, audit) per last initial of what is given so far."""
    def grown(held):
        more = dict(held)
        for _ in range(2):
            for (cost, audit, given) in list(more.values()):
                for r in "ua":
                    put(more, (cost + 5, audit + "I", given + r))
        return more

    def put(held, way):
        given = way[2]
        if re.fullmatch("s?(ua)*u?", given):
            state = "" if not given else "s" if given == "s" else given[-1]
            held[state] = min(way, held.get(state, way))
    held = {"": (0, "", "")}
    for r, f in zip(rows, faults(rows)):
        after = {}
        for cost, audit, given in grown(held).values():
            for more, action, g in ways_of(r[1][:1] or "o", f):
                put(after, (cost + more, audit + action, given + g))
        held = after
    return min(w for w in grown(held).values() if GRAMMAR.fullmatch(w[2]))


def expected(rows, solve=stepwise):
    """conv_id -> result, of undamaged (conv_id, turn, role, text) rows."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held[c] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for c, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, marks = [t for t, *_ in own if t is not None], faults(own)
        cost, audit, given = solve(own)
        at, names, lines = iter(own), iter(given), []
        for action in audit:
            _, role, text = next(at) if action != "I" else (None, None, "")
            if action != "D":
                name = {"u": "user", "a": "assistant"}.get(next(names))
                lines.append(f"{role if action == 'K' else name}:{text}")
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(k) for k in "bdt"],
                  sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(seed, sizes):
    r, rows = random.Random(seed), []
    for c, n in enumerate(sizes):
        for turn in range(n):
            rows.append((c, r.choice([turn, turn, turn, turn + 1, None]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         r.choice(["One.", "Two!", "Three", "four?", " ", None, f"Own {turn}.", f"Own {turn}", "Été.\n"])))
    return rows


def results(df, **options):
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(repair.damage(df), **options).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_plain_version_against_exhaustive_search():
    r = random.Random(2)
    for _ in range(60):
        rows = [(i, r.choice(["system", "user", "assistant", "x"]), r.choice(["A.", "B", "", f"{i}."])) for i in range(r.randint(0, 3))]
        assert stepwise(rows) == exhaustive(rows)
    for _ in range(300):
        rows = [(i, r.choice(["system", "user", "assistant", "x"]), r.choice(["A.", "B", "", f"{i}.", f"{i}"])) for i in range(r.randint(0, 12))]
        symbols = "".join(repair.initial_of(role) + f for (_, role, _), f in zip(rows, faults(rows)))
        assert repair.repair(symbols) == stepwise(rows)[:2]


@pytest.mark.parametrize("rows", [1, 3, 4096])
def test_against_plain_version(spark, rows):
    """Short conversations, and one of 2,000 rows that spans segments and tasks."""
    given = talk(5, [0, 1, 2, 3, 5, 8, 13, 2000, 4, 4, 4, 40, 1, 1, 1])
    assert results(spark.createDataFrame(given, SCHEMA).repartition(4), segment_rows=rows) == expected(given)


def test_segment_chars(spark):
    given = talk(6, [30, 30, 3, 3])
    assert results(spark.createDataFrame(given, SCHEMA).repartition(2), segment_chars=50) == expected(given)


def test_ties_repeats_nulls_and_clashes(spark):
    given = [(None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm."), (7, None, "user", "A."), (7, None, "assistant", "B."), (7, 1, "user", "A."),
             *[(8, 0, "user", "Same.")] * 50, (8, 0, "assistant", "Same."), (9, 2, "user", "x" * 100_000 + "."), (9, 3, "assistant", "Fine.")]
    extra = {n: F.lit("clash") for n in ("cut", "cost", "audit", "dropped", "at", "step", "said", "code", "copy", "ways")}
    df = spark.createDataFrame(given, SCHEMA).withColumns(extra).repartition(3)
    for options in ({}, {"segment_rows": 2}):
        assert results(df, **options) == expected(given)
    assert results(spark.createDataFrame([], SCHEMA)) == {}


def test_nothing_left_after_damage(spark):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    made = results(spark.createDataFrame([(c, 0, "user", "Hello.") for c in gone], SCHEMA))
    assert set(made) == set(gone) and set(made.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
