"""WARC bundles, exact search and page text."""

import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tallyglass.llm import html_blocks, topk, warc
from tallyglass.llm.common import read, store

BIG = "<p>" + "payload ä " * 20_000 + "</p>"
SAME = "<p>" + "s" * 120 + "</p>"
PAGES = [(1, "http://a/1", None), (2, None, ""), (3, "http://a/3\r\nX: y", "short"), (4, "http://a/4", "short"), (9, "u", SAME), (5, "u5", SAME), (7, "u7", SAME), (7, "u7", SAME),
         (5, "u5", SAME), (None, "u0", SAME), (None, None, "x" * 200), (11, "b", BIG), (10, "b", BIG), (-4, "é", "ü" * 50)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    return rows.withColumns({n: F.lit("clash") for n in ("payload", "digest", "size", "refers_to", "bundle", "first")}).select("*", F.lit(1).alias("HTML"))


def expected_records():
    out = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "").encode() == data and p is not None), default=None)
        revisit = len(data) >= 100 and page_id is not None and first != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(pages):
    made = warc.archive(pages, frame_bytes=1000).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in made], key=str) == expected_records()
    assert {bytes(r["payload"]).decode() for r in made if r["page_id"] == 10} == {BIG}
    assert {r["url"] for r in made if r["page_id"] == 3} == {"http://a/3%0D%0AX:%20y"}


def test_one_record_by_its_offset_and_whole_bundles(spark, pages):
    from zstandard import ZstdDecompressor

    index = warc.write_archives(warc.plan_records(pages), frame_bytes=500, bundle_bytes=2000)
    one = warc.read_records(index.where("page_id = 9")).collect()
    assert [(r["page_id"], r["refers_to"]) for r in one] == [(9, 5)]
    found = 0
    for row in index.select("bundle").distinct().collect():
        files, path = store(row["bundle"])
        with files.open_input_stream(path, compression=None) as f:
            data = f.read()
        plain = ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        found += plain.count(b"WARC/1.1\r\n")
        with files.open_input_file(path) as f:
            assert b"".join(warc.BundleReader(f).frame(i) for i in range(len(warc.BundleReader(f).frames))) == plain
    assert found == len(PAGES)


def test_damaged_payload_is_noticed():
    record = warc.format_record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), 7, None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse_record(record)


def test_archive_of_nothing(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# exact search

def test_search_with_ties_nulls_and_lengths(spark):
    r = random.Random(4)
    rows = [(i, [r.randint(-3, 3) / 1024 for _ in range(r.choice([6, 6, 6, 4]))]) for i in range(300)]
    rows += [(400 + i, [0.001] * 6) for i in range(30)] + [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (505, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumns({n: F.lit("clash") for n in ("terms", "x", "score", "rank", "query_id")})
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = sorted(brute.top_k(good, [g for g in good if g[0] % 100 == 0], 10))
    for block, wave in ((8192, 4096), (7, 3)):
        made = topk.search(vectors, every=100, k=10, block=block, wave=wave).collect()
        assert sorted((m["query_id"], m["rank"], m["vec_id"], m["score"]) for m in made) == want


def test_search_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(few, every=100).collect()] == [(0, 1, 3, 1024 * 2048)]
    assert topk.search(few.limit(0)).count() == 0


# page text

def paragraph(i):
    return f"Paragraph {i} of the article says something in a whole sentence, and then a little more."


PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li>About <b>us</b></li></ul></nav>
<div id="cookie-notice">We use cookies. <p>Accept?</p></div><div class="top ads"><div>Buy</div> now &amp; here</div>
<main><h1>Head &lt;line&gt;</h1><p>{paragraph(1)}<br>Next&nbsp;line.</p><p>Ti.<p>{paragraph(2)}</p>
<aside><p>{paragraph(90)}</p></aside><!-- <p>hidden</p> --><form action="/s"><input name=q>Search <button>Go</button></form>
<blockquote>Said <i>he</i>.</blockquote><table><tr><td>a</td><td>b</td></tr></table><p>{paragraph(3)}</p>
<div class="comments"><div class="comment"><p>{paragraph(91)}</p></div></div></main>
<div class='sidebar'><p>{paragraph(92)}</p></div><footer>&copy; 2020<p>{paragraph(93)}</p></footer></body></html>"""


def test_main_text():
    assert html_blocks.main_text(PAGE).split("\n\n") == ["Head <line>", paragraph(1) + " Next line.", "Ti.", paragraph(2), "Said he.", "a", "b", paragraph(3)]


def test_surge_and_dive_without_article_element():
    gap = "<nav>x</nav>" * 4
    page = f"<body><p>Menu</p>{gap}<h1>Heading of it</h1><p>{paragraph(1)}</p><p>Short.</p><p>{paragraph(2)}</p>{gap}<p>Legal</p></body>"
    assert html_blocks.main_text(page).split("\n\n") == ["Heading of it", paragraph(1), "Short.", paragraph(2)]


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   \n ", ""), ("<p>", ""), ("plain words", "plain words"), ("<article>That it.</article>", "That it."), ("a<b", "a"), ("<p title='>'>x</p>", "x"),
    ("<p>unclosed <b>bold", "unclosed bold"), ("<nav>never closed <article><p>kept</p></article>", "kept"), ("<script>open", ""), ("<p>1 < 2 &amp;amp; &#x41;&#66; &nosuch;</p>", "1 < 2 &amp; AB &nosuch;"),
    ("<div style='display: none'>gone</div><p>stays</p>", "stays"), ("<p class=\"adverb\">stays</p>", "stays"), ("<div class=\"ad\"><div>x</div></div>y", "y"), ("<!-- a", ""), ("<p>a</p><p>a</p>", "a\n\na")])
def test_odd_pages(html, text):
    assert html_blocks.main_text(html) == text


def test_long_page_is_whole():
    text = [paragraph(i) for i in range(20_000)]
    assert html_blocks.main_text("<body><article>" + "".join(f"<p>{t}</p>" for t in text) + "</article></body>") == "\n\n".join(text)


def test_extract_table(spark, pages, folder):
    made = html_blocks.extract(pages).collect()
    assert len(made) == len(PAGES) and all(r["n_chars"] == len(r["text"]) and r["text"] is not None for r in made)
    assert html_blocks.extract(pages.limit(0)).count() == 0
    import re
    from html import unescape
    given = {r["page_id"]: r["html"] for r in read(spark, folder, "pages").collect()}
    for r in html_blocks.extract(read(spark, folder, "pages")).collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", given[r["page_id"]], re.S)[1])
        want = [" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(w for w in want if w)
