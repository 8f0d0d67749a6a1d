import re

import pytest

from nearfield.llm.html_text import extract_main_text, main_text, page_texts

import html as html_lib

ARTICLE = "<article><h1>Title &amp; more</h1><p>First  long\n paragraph of the text, with words.</p><p>Second &eacute; one<br>goes on here.</article>"


def test_article_without_the_rest_of_the_page():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><header><h2>Site</h2></header>"
        "<nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        f"{ARTICLE}<aside>See also this</aside><section id='comments'><p>Nice article, I liked reading it a lot!</p></section>"
        "<form><label>Mail</label><input></form><script>var t='</p>';</script><!-- x --><footer>&copy; us</footer></body></html>"
    )
    assert main_text(page) == "Title & more\nFirst long paragraph of the text, with words.\nSecond é one goes on here."


def test_without_article_element():
    texts = [f"Paragraph {i} has quite a lot of plain words in it, so that it is dense." for i in range(6)]
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(20))
    page = f"<body><ul>{links}</ul><div id=x><div>{''.join(f'<p>{t}</p>' for t in texts)}</div></div><div class=ad>Buy!</div>"
    assert main_text(page) == "\n".join(texts)


def test_edge_pages(spark):
    deep = "<div>" * 3000 + "<p>deep text</p>"
    cases = {None: "", "": "", "   ": "", "<p></p>": "", "plain text &lt; tags": "plain text < tags", deep: "deep text",
             "<article><h1>Only a title</h1></article>": "Only a title", "<b>x</i></p></div> y": "x y"}
    long = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    cases[long] = "\n".join(["word word"] * 30_000)
    for page, text in cases.items():
        assert main_text(page) == text
    rows = [(i, None if i == 0 else "u", h, "clash", 1) for i, h in enumerate(cases)] + [(None, "u", "x", "c", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars bigint")
    found = {r.page_id: r for r in page_texts(pages).collect()}
    assert [found[i].text for i in range(len(cases))] == list(cases.values())
    assert all(r.n_chars == len(r.text) for r in found.values()) and None in found
    kept = extract_main_text(pages)
    assert sorted(kept.columns) == sorted(pages.columns) and kept.count() == len(rows)
    assert page_texts(pages.limit(0)).count() == 0


def test_pages_of_the_tables(small):
    """Articles there are one element of headings and paragraphs, cut out here by pattern."""
    db, _ = small
    for (page,) in db.execute("SELECT html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [html_lib.unescape(re.sub(r"<[^>]*>", " ", b)) for b in re.split(r"</?(?:h1|p)>", article)]
        assert main_text(page) == "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


PROSE = [f"Paragraph {i} of the text says at some length what it has to say, and then it ends." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(8)) + "</ul>"


def page(body, head="<head><title>T</title></head>"):
    return f"<html>{head}<body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, extra",
    [
        # A list of linked sources inside an article belongs to it.
        (page(f"<nav>{MENU}</nav><article>{BODY}<ul><li><a href='/a'>Source one</a></li><li><a href='/b'>Source two</a></li></ul></article>"), ["Source one", "Source two"]),
        # A form around the whole page, as some servers make.
        (page(f"<form action='/'>{MENU}<h1>Title</h1>{BODY}<input name='x'></form>"), ["Title"]),
        # A head that is never closed, and no body.
        (f"<html><head><title>T</title><meta charset='utf-8'><h1>Title</h1>{BODY}", ["Title"]),
        # One word of a class is not enough to lose the text.
        (page(f"<div class='nav'>{MENU}</div><div class='post-share-wrapper content'>{BODY}</div>"), []),
        (page(f"<div class='nav'>{MENU}</div><div class='news-alert'><div>{BODY}</div></div><div class='footer'>Imprint</div>"), []),
        # Neither article nor main: what is marked goes where enough is left.
        (page(f"<div id='menu'>{MENU}</div><div class='text'>{BODY}</div><div class='comments'><p>First! Great read.</p></div>"), []),
        (page(f"{MENU}<div><div>{BODY}</div></div><div class='sidebar'><p>Most read this week, and more of it.</p></div>"), []),
    ],
)
def test_pages_without_article_and_odd_wrappers(html, extra):
    lines = main_text(html).split("\n")
    assert [x for x in lines if x in PROSE] == PROSE
    assert set(lines) - set(PROSE) == set(extra)
