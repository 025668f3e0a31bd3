"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one per text block in page order; blocks inside menus,
headers, footers, sidebars, notices, adverts, forms, comments and scripts become empty
lines; white space between tags makes none. The text length of a line and its neighbours in a sliding window gives the
distribution; the main text starts where a window surges over the threshold and ends
where the distribution dives to an empty window. Everything between is kept, short
lines too. Where article and main elements hold most of the text, their lines are kept
as well that no run holds.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from tallyglass.llm.common import map_rows, only

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "iframe", "object", "button", "select", "dialog", "menu", "canvas", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "meta", "link", "input"}
ROLES = re.compile(r"\brole\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu|menubar)\b", re.I)
NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BOILERPLATE = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisements?|advertising|adsbox|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|"
    r"cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|comment-?list|disqus|replies|reply|pagination|pager)(?:$|[_-])", re.I)
#: A class of one of these forms tells about the layout or state of an element, not what it is.
STATE = re.compile(r"^(?:has|have|no|not|non|with|without|is|show|hide)[_-]|[_-](?:has|no|with|without)[_-]|[_-](?:open|opened|closed|enabled|disabled|active|visible|fixed|sticky|layout)$", re.I)
#: What readers say; an article inside is a comment too.
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|comment-?list|disqus|replies|reply|respond|discussion)(?:$|[_-])", re.I)
#: An article of such a class is no article of the page.
OTHER_ARTICLE = re.compile(r"(?:^|[_-])(?:teaser|related|recommended|promo|sponsored|ads?|adverts?|advertisements?)(?:$|[_-])", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|display\s*:\s*none|\baria-hidden\s*=\s*[\"']?true", re.I)
CONTAINERS = {"div", "section", "ul", "ol", "table", "p", "span", "dl", "figure", "li", "td", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}


def _boilerplate(name: str, attributes: str) -> str:
    """Why an element is no content: its kind, that it is hidden, its role, that it holds comments, its class or id; empty for content."""
    if name in DROPPED:
        return "kind"
    if name not in CONTAINERS or not attributes or attributes.isspace():
        return ""
    if HIDDEN.search(re.sub(r"\b(?:class|id|href|title)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", attributes)):
        return "hidden"
    if ROLES.search(attributes):
        return "role"
    tokens = [x for found in NAMED.findall(attributes) for x in "".join(found).split() if not STATE.search(x)]
    if any(map(COMMENTS.search, tokens)):
        return "comments"
    return "class" if any(map(OTHER_ARTICLE.search if name == "article" else BOILERPLATE.search, tokens)) else ""


def blocks(html: str) -> tuple[list[str], list[bool]]:
    """(lines, inside): text of each block in page order, empty for what is no content; whether it stands in an article or main element."""
    lines, inside, held = [], [], []
    depth, at, n = 0, 0, len(html)

    def end() -> None:
        line = " ".join(unescape("".join(held)).split())
        if line:
            lines.append(line)
            inside.append(depth > 0)
        held.clear()
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        why = "" if m["close"] or name in VOID or (m["attributes"] or "").endswith("/") else _boilerplate(name, m["attributes"])
        after, holds = _skip(html, at, name, why) if why else (at, False)
        if why and not (holds and why == "class"):
            end()
            at = after
            lines.append("")
            inside.append(depth > 0)
        elif name in ("br", "wbr", "img"):
            held.append(" " if name != "wbr" else "")
        elif name not in INLINE:
            end()
            if name in ("article", "main"):
                depth = max(0, depth + (-1 if m["close"] else 1))
    end()
    return lines, inside


def _skip(html: str, at: int, name: str, why: str) -> tuple[int, bool]:
    """(where the element that was opened before `at` ends, whether an article or main element stopped it): its closing tag, or before an article of the page, unless it is hidden or holds comments, or a main element."""
    if name in RAW:
        m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
        return m.end() if m else len(html), False
    depth, within = 1, 0          # within: articles that were opened inside
    for m in TOKEN.finditer(html, at):
        found = (m["name"] or "").lower()
        if found == "article" and name != "article" and m["close"] and within:
            within -= 1
            continue
        if found == "article" and name != "article" and not m["close"] and why not in ("hidden", "comments") and not _boilerplate(found, m["attributes"]):
            return m.start(), True
        if found == "article" and name != "article" and not m["close"]:
            within += 1
        if found == name:
            depth += -1 if m["close"] else 0 if (m["attributes"] or "").endswith("/") or name == "p" else 1
            if depth == 0:
                return m.end(), False
            if name == "p" and not m["close"]:
                return m.start(), False
        elif found in ("main", "body") or found == "article" and m["close"] and within == 0 and why != "hidden":
            return m.start(), found == "main" and not m["close"]
    return len(html), False


def between(lines: list[str], window: int = 3, threshold: int = 86) -> np.ndarray:
    """Whether each line stands between surge and dive points of the window sums.

    A surge: the sum over a line and the next `window - 1` reaches the threshold, or half
    the largest sum where that is less, so that pages with little text have one too. The
    kept run reaches back and on over lines until a window is empty.
    """
    lengths = np.array([len(x) for x in lines], np.int64)
    keep = np.zeros(len(lengths), bool)
    if not lengths.any():
        return keep
    padded = np.concatenate([lengths, np.zeros(window - 1, np.int64)])
    sums = np.convolve(padded, np.ones(window, np.int64), "valid")
    surge = sums >= min(threshold, max(1, int(sums.max()) // 2))
    at = 0
    while at < len(sums):
        if sums[at] == 0:
            at += 1
            continue
        dive = at
        while dive < len(sums) and sums[dive] > 0:
            dive += 1
        if surge[at:dive].any():
            keep[at:dive] = True
        at = dive
    return keep


def main_text(html: str | None, window: int = 3, threshold: int = 86) -> str:
    """Blocks of the main text joined by an empty line; empty for null, empty and text-free pages.

    The distribution is that of all lines of the page, whatever elements they stand in.
    """
    lines, inside = blocks(html or "")
    keep = between(lines, window, threshold)
    held = sum(len(x) for x, i in zip(lines, inside) if i)
    if 2 * held > sum(map(len, lines)):
        keep |= np.array(inside)
    return "\n\n".join(x for x, k in zip(lines, keep) if k and x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, threshold: int = 86) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page, repeated and null ids too."""
    p = only(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def per_batch(page_id, url, html):
        texts = [main_text(h, window, threshold) for h in html]
        return {"page_id": page_id, "url": url, "text": texts, "n_chars": [len(t) for t in texts]}
    return map_rows(p, per_batch, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
