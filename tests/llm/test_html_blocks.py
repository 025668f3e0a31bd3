"""Main text of pages as they are written: indented, in wrappers, with teasers and layout names."""

from html.parser import HTMLParser

from tallyglass.llm import html_blocks
from tallyglass.llm.common import read


def paragraph(i):
    return f"Paragraph {i} of the article says something in a whole sentence, and then a little more."


def lines_of(html):
    return html_blocks.main_text(html).split("\n\n")


def test_white_space_between_tags_is_no_gap():
    parts = ['<div class="intro">\n      <p>Short lead.</p>\n    </div>', f'<div class="body">\n <p>{paragraph(1)}</p>\n <p>{paragraph(2)}</p>\n </div>',
             f"<section>\n <h2>Part</h2>\n <p>{paragraph(3)}</p>\n</section>", "<aside>\n<p>Aside</p>\n</aside>", "<section>\n\n<p>Short end.</p>\n</section>"]
    want = ["Short lead.", paragraph(1), paragraph(2), "Part", paragraph(3), "Short end."]
    for open_, close in (("<article>", "</article>"), ("<div>", "</div>")):
        assert lines_of(f"<body>\n {open_}\n " + "\n ".join(parts) + f"\n{close}\n</body>") == want


def test_short_runs_inside_an_article_stay():
    gap = "<nav>x</nav>" * 4
    assert lines_of(f"<p>Menu</p>{gap}<article><p>Lead.</p>{gap}<p>{paragraph(1)}</p><p>{paragraph(2)}</p>{gap}<p>End.</p></article>") == ["Lead.", paragraph(1), paragraph(2), "End."]


def test_teasers_do_not_displace_the_main_text():
    body = "".join(f"<p>{paragraph(i)}</p>" for i in range(8))
    made = lines_of(f"<body><div><section>{body}</section></div><nav>x</nav><nav>x</nav><nav>x</nav><article><h3>Teaser</h3><p>Read it.</p></article></body>")
    assert made == [paragraph(i) for i in range(8)]


def test_layout_names_remove_nothing():
    text = f"<p>{paragraph(1)}</p><p>{paragraph(2)}</p>"
    for names in ("content has-sidebar", "no-sidebar", "with-header", "comments-open", "sidebar"):
        assert lines_of(f'<div class="{names}"><p>Lead.</p><article>{text}</article></div>')[-2:] == [paragraph(1), paragraph(2)]
        assert lines_of(f'<article class="post {names}">{text}</article>') == [paragraph(1), paragraph(2)]
    for names in ("has-sidebar", "no-sidebar", "with-header", "comments-open"):
        assert lines_of(f'<div class="{names}">{text}</div>') == [paragraph(1), paragraph(2)]
    assert lines_of(f'<aside><p>x</p><article>{text}</article></aside><div class="site-footer"><p>{paragraph(3)}</p></div>') == [paragraph(1), paragraph(2)]
    assert lines_of(f'<article>{text}</article><div hidden><article><p>{paragraph(3)}</p></article></div>') == [paragraph(1), paragraph(2)]


def test_compound_names_of_boilerplate():
    text = f"<p>{paragraph(1)}</p><p>{paragraph(2)}</p>"
    body = [paragraph(1), paragraph(2)]
    assert lines_of(f"<div class='page-header'>MENU HOME</div><div>{text}</div><div class='page-footer'>Copyright</div>") == body
    assert lines_of(f"<div class='sidebar-content'>SIDE LINKS</div><div>{text}</div><div id='body-sidebar'>MORE</div>") == body
    assert lines_of(f"<div class='sticky-header'>TOP</div><div class='header-fixed'>{text}</div>") == body


def test_reader_comments_are_no_articles():
    text, said = f"<p>{paragraph(1)}</p><p>{paragraph(2)}</p>", "<p>I think so too, and I say it in a rather long comment below the text.</p>"
    body = [paragraph(1), paragraph(2)]
    for opened, closed in (("<div id='comments'>", "</div>"), ("<section class='comments'>", "</section>"), ("<div class='comment-list'>", "</div>")):
        for kind in ("<article class='comment'>", "<article>", "<article id='comment-7' class='reply'>"):
            made = f"{opened}<h3>2 comments</h3>{kind}{said}</article>{kind}{said}</article>{closed}"
            assert lines_of(f"<article>{text}</article>{made}") == body
            assert lines_of(f"<article>{text}{made}</article>") == body
            assert lines_of(f"<div>{text}</div>{made}<p>End.</p>")[:2] == body
    assert lines_of(f"<article>{text}</article><article class='comment'>{said}</article><article class='teaser'>{said}</article>") == body


def test_main_text_beside_an_article_is_found_by_the_distribution():
    inside, gap = "".join(f"<p>{paragraph(i)}</p>" for i in range(1, 5)), "<nav>x</nav>" * 4
    body = [paragraph(i) for i in range(1, 5)]
    assert lines_of(f"<article>{inside}</article>{gap}<div><p>{paragraph(5)}</p><p>{paragraph(6)}</p></div>") == [*body, paragraph(5), paragraph(6)]
    assert lines_of(f"<div><h1>Title</h1><p>{paragraph(0)}</p></div><article>{inside}{gap}<p>End.</p></article>{gap}<p>Imprint</p>") == ["Title", paragraph(0), *body, "End."]


class Tree(HTMLParser):
    """Plain version: elements are kept as (name, attributes, children); text is a string."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", "", [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, " ".join(f'{k}="{v}"' if v is not None else k for k, v in attrs), [])
        self.open[-1][2].append(node)
        if tag not in html_blocks.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_text(html):
    tree, lines, held = Tree(), [], []
    tree.feed(html or "")
    tree.close()

    def end(inside):
        if line := " ".join("".join(held).split()):
            lines.append((line, inside))
        held.clear()

    def walk(node, inside):
        for child in node[2]:
            if isinstance(child, str):
                held.append(child)
            elif html_blocks._boilerplate(child[0], child[1]):
                end(inside)
                lines.append(("", inside))
            elif child[0] in html_blocks.INLINE:
                held.append(" " if child[0] in ("br", "img") else "")
                walk(child, inside)
            else:
                end(inside)
                walk(child, inside or child[0] in ("article", "main"))
                end(inside or child[0] in ("article", "main"))
    walk(tree.root, False)
    end(False)
    sizes = [len(x) for x, _ in lines]
    if 2 * sum(len(x) for x, i in lines if i) > sum(sizes):
        return "\n\n".join(x for x, i in lines if i and x)
    sums = [sum(sizes[i:i + 3]) for i in range(len(sizes))]
    kept, at = [], 0
    while at < len(sums):
        dive = at
        while dive < len(sums) and sums[dive] > 0:
            dive += 1
        if any(x >= min(86, max(1, max(sums) // 2)) for x in sums[at:dive]):
            kept += [x for x, _ in lines[at:dive] if x]
        at = dive + 1
    return "\n\n".join(kept)


def test_pages_against_a_parsed_tree(spark):
    pages = read(spark, "/root/testdata/sf0.1", "pages").select("page_id", "html").collect()
    made = {r["page_id"]: r["text"] for r in html_blocks.extract(read(spark, "/root/testdata/sf0.1", "pages")).collect()}
    assert len(made) == len(pages) and {r["page_id"]: plain_text(r["html"]) for r in pages} == made
