"""Files hashed split by split against hashlib, with splits of a few bytes."""

import gzip
import hashlib
import random

import pytest

from tallyglass.functions.carried_hash import CarriedSha256, can_carry
from tallyglass.sources import tables as B


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Files beyond 300 bytes count as large and come in splits of 97 bytes; contents beyond 1,000 bytes are refused whole, as Spark refuses 2 GB."""
    settings = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.sources.binaryFile.maxLength": "1000"}
    before = {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(B, "LARGE_FILE", 300, raising=False)
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(folder, files):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)


def check(spark, folder, files):
    got = {r["sha256"]: r for r in B.snapshot_files(spark, str(folder)).collect()}
    wanted = {}
    for name, content in files.items():
        wanted.setdefault(hashlib.sha256(content).hexdigest(), []).append(name)
    assert got.keys() == wanted.keys()
    for digest, names in wanted.items():
        r, first = got[digest], folder / min(names)
        assert (r["copies"], r["size"], r["name"]) == (len(names), len(files[names[0]]), f"file:{first}")
        assert r["snapshot_id"] == f"{digest[:12]}-{min(int((folder / n).stat().st_mtime) for n in names)}" and not r["has_pii"]


def test_state_goes_on_anywhere():
    assert can_carry()
    text = random.Random(1).randbytes(1000)
    for cut in (0, 1, 55, 56, 63, 64, 65, 500, 1000):
        first = CarriedSha256()
        first.update(text[:cut])
        second = CarriedSha256(first.state())
        second.update(text[cut:])
        assert second.hexdigest() == second.hexdigest() == hashlib.sha256(text).hexdigest()


def test_files_beyond_the_limit_of_one_content(spark, tmp_path, small_splits):
    rnd = random.Random(2)
    some = lambda n: bytes(rnd.choice(b"\n\r\x00\xff\xefab") for _ in range(n))
    files = {f"few {k}.bin": some(1001 + k) for k in range(9)}
    files |= {f"all{k}.bin": rnd.randbytes(1500 + k) for k in range(4)}
    files |= {"lines.txt": b"0123456789\n" * 200, "open.txt": b"0123456789\n" * 200 + b"end", "feeds": b"\n" * 1400, "feeds and more": b"\n" * 1400 + b"x",
              "mark.csv": b"\xef\xbb\xbf" + b"a,b\n" * 300, "mark open.csv": b"\xef\xbb\xbf" + b"a,b\n" * 300 + b"z", "marks": b"\xef\xbb\xbf" * 400, "mark feed": b"\xef\xbb\xbf\n" + some(1100),
              "one line": b"q" * 1300, "one closed line": b"q" * 1300 + b"\n", "ü%20 #+[1]{a,b}.bin": some(1200), "tiny": b"\xef\xbb\xbfx\n", "at edge": some(300)}
    files |= {"copy of lines": files["lines.txt"]}
    written(tmp_path, files)
    check(spark, tmp_path, files)


def test_files_the_text_reader_would_change_are_hashed_whole(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(B, "LONGEST_LINE", 200, raising=False)
    rnd = random.Random(3)
    files = {"packed.gz": gzip.compress(rnd.randbytes(700)), "named only.gz": b"no gzip\n" * 60, "long stretch": b"a\n" * 200 + b"b" * 250 + b"\nc" * 100, "plain": b"a line\n" * 100}
    written(tmp_path, files)
    check(spark, tmp_path, files)


def test_folders_named_by_a_column(spark, tmp_path, small_splits):
    files = {"value=1/a": b"one\n" * 300, "value=2/b": b"two\n" * 300 + b"x"}
    written(tmp_path, files)
    check(spark, tmp_path, files)


def test_without_a_carried_state_files_are_hashed_whole(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(B, "can_carry", lambda: False)
    files = {"a": b"one\n" * 200, "b": b"two\n" * 240}
    written(tmp_path, files)
    check(spark, tmp_path, files)
