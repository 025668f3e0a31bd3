import random

import pytest

LONG = " ".join(random.Random(5).choice(["alpha", "Beta", "gamma,", "delta.\n", "épsilon", "ζeta", "#", "etaetaeta"]) + str(random.Random(i).randint(0, 400)) for i in range(30_000))
NOTE = "This notice stands at the foot of every page of the site."


def _mixed(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["river", "stone", "cloud", "amber", "quiet", "ladder", "copper", "winter", "salmon", "basil"]) + r.choice(["", "s", "ed", ",", "."]) for _ in range(n))


#: Nulls in every column, empty and blank texts, one very long text, ties and repeated rows.
MESSY = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\n ", "en", "a", 5), (4, "three short words", "en", "b", 17), (5, "three short words", "en", "b", 17),
    (6, LONG, "en", "a", len(LONG)), (6, LONG, "en", "a", len(LONG)), (None, _mixed(1, 40), "en", None, None), (None, None, None, None, None),
    (8, _mixed(1, 40) + "\n" + NOTE, "de", "b", 1), (9, NOTE + "\n" + _mixed(2, 60), None, "b", 1), (10, NOTE.upper() + "\n" + _mixed(3, 60) + "\n  " + NOTE + "\t", "en", "b", 1),
    (11, NOTE, "en", "c", 1), (12, "x\n" + NOTE + "\ny", "en", "c", 1), (12, "x\n" + NOTE + "\ny", "en", "c", 1), (-3, NOTE + "\n", "en", "c", 1),
    (13, "É" * 39 + "\n" + "é" * 40, "fr", "c", 1), *[(20 + i, "é" * 40, "fr", "c", 1) for i in range(5)],
    *[(30 + i, _mixed(7, 120) + f" tail{i}", "en", "d", 1) for i in range(4)], (40, "word " * 60, "en", "d", 1), (41, "<|endoftext|> a<|endoftext|>b \x1c c d e", "en", "d", 1),
    (42, "日本語のテキスト。🙂🙂 ΑΣ İi ﬁ ½ é", "ja", "e", 1), (43, "▁ ▁▁ leading  and trailing  ", "en", "e", 1), (44, "a\x00b\x01c", "en", "e", 1),
]


@pytest.fixture(scope="session")
def messy():
    return MESSY


@pytest.fixture(scope="session")
def docs(spark):
    """The messy rows with extra columns whose names clash with what the operators use."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(MESSY, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    extra = {n: F.lit("clash") for n in ("fp", "key", "c0", "x0", "n_words", "host", "score", "length", "n_tokens", "component_id", "kept", "words", "root", "task", "keeper")}
    rows = rows.withColumns(extra)
    return rows.toDF(*rows.columns).select("*", F.lit(7).alias("TEXT"), F.lit(8).alias("lang2"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
