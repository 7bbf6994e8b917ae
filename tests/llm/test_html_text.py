import duckdb
import pytest

from taintloom.llm import html_text
from taintloom.llm.html_text import blocks, extract, extract_pages
from taintloom.llm.queries import ORACLES, QUERIES

LONG = "This is a sentence of the story, with some words; it goes on. " * 4


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


FURNITURE = "<nav><ul><li><a href=/a>Home, and more</a></li></ul></nav>", '<div class="ad">Buy this. Buy that, now.</div>', "<footer>&copy; me</footer>", f"<aside>{LONG}</aside>", f'<div id="cookie-notice">{LONG}</div>', f"<form>{LONG}<input></form>", f'<section class="comments"><article>{LONG}</article></section>'


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<main>{}</main>', '<div id="content">{}</div>', "{}", '<div><div class="post"><div>{}</div></div></div>'])
def test_article_without_furniture(wrap):
    inner = f"<h1>A &amp; B</h1><p>{LONG}<p>Ti.<ul><li>one<li>two <b>bold</b></ul><p>x&lt;y\n\t z<br>w&nbsp;v</p><table><tr><td>c1<td>c2</table><p>{LONG}"
    got = extract(page(FURNITURE[0] + FURNITURE[1] + wrap.format(inner) + "".join(FURNITURE[2:])))
    assert got.split("\n\n") == ["A & B", LONG.strip(), "Ti.", "one", "two bold", "x<y z w v", "c1", "c2", LONG.strip()]


def test_names_that_only_look_like_furniture():
    for tag in ('<div class="content has-sidebar">{}</div>', '<div class="no-comments post">{}</div>', '<div class="sidebar-layout"><main>{}</main></div>', '<div class="address">{}</div>', '<div class="shadow">{}</div>'):
        assert extract(page(FURNITURE[0] + tag.format(f"<p>{LONG}</p>"))) == LONG.strip(), tag


NAMES = ("overflow-hidden", "layout sidebar-right", "content-sidebar-wrap", "elementor-widget elementor-widget-theme-post-content", "post type-post category-social-media", "post tag-cookies")


@pytest.mark.parametrize("name", NAMES)
def test_names_with_furniture_in_a_part(name):
    for html in (f'<article class="{name}"><p>{LONG}</p></article>', f'<div class="{name}"><article><p>{LONG}</p></article></div>', f'<div class="{name}"><p>{LONG}</p></div>'):
        assert extract(page(FURNITURE[0] + html)) == LONG.strip()


def test_names_do_not_hide_articles_code_and_formulas():
    for html in ('<article class="widget">{}</article>', '<div class="popup"><article>{}</article></div>', '<div class="hidden"><div itemprop="articleBody" class="share">{}</div></div>', '<div class="comments"><article>{}</article></div>', '<div class="widget">{}</div>', '<div class="comments"><main>{}</main></div>'):
        assert extract(page(FURNITURE[0] + html.format(f"<p>{LONG}</p>"))) == LONG.strip(), html
    for name in ("site-footer", "cookie-banner", "related-posts", "comments-area", "ad-slot", "social-share", "widget-area", "main-nav"):
        assert extract(page(f'<article><p>{LONG}</p><div class="x {name}">{LONG}</div></article>')) == LONG.strip(), name
    code = '<pre>x = 1 <span class="hljs-comment"># one</span> <i class="comment">two</i></pre>'
    formula = "<p>Let <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> hold.</p>"
    assert extract(page(f"<article><p>{LONG}</p>{code}{formula}</article>")).split("\n\n") == [LONG.strip(), "x = 1 # one two", "Let a=2 hold."]


def test_headline_lead_and_all_parts():
    want = ["Title", "A lead, with a comma.", LONG.strip(), LONG.strip()]
    body = f"<p>{LONG}</p><p>{LONG}</p>"
    lead = "<h1>Title</h1><p class=lead>A lead, with a comma.</p>"
    for html in (
        f"<div class=post>{lead}<div class=body>{body}</div></div>",
        f"<div class=post><h1>Title</h1><div><p>A lead, with a comma.</p><div>{body}</div></div></div>",
        f"<article>{lead}<p>{LONG}</p></article><article><p>{LONG}</p></article>",
        f"<div>{lead}<article><p>{LONG}</p></article><article><p>{LONG}</p></article></div>",
    ):
        assert extract(page(FURNITURE[0] + html)).split("\n\n") == want, html
    long = f"<p>{LONG * 5}</p>" * 4
    assert extract(page(f"<div class=post>{lead}<div class=body>{long}</div></div>")).split("\n\n")[:2] == want[:2]
    assert extract(page(f"<h1>Title</h1><div class=body>{long}</div>")).startswith("Title\n\nThis")
    thirds = "".join(f"<article><p>{n} {LONG}</p></article>" for n in "abc")
    assert [t[0] for t in extract(page(thirds)).split("\n\n")] == ["a", "b", "c"]


def test_broken_markup():
    for html in [None, "", "<", "<p", "<p class='", "a < b", "<!-- never closed <p>x", "<script>never", "</p></p></div>", "<a <b", "&", "&#xZZ; &bogus;", "<p>" * 5000 + "deep", "<div>" * 2000 + "x", "<x " + "'" * 3001]:
        extract(html)
    assert extract("just text, no tags.") == "just text, no tags."
    assert [b.text for b in blocks("a < b <p>c")] == ["a < b", "c"]


def test_pages(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view pages as from '{d}/pages.parquet'")
    q = QUERIES["op3_html"](spark, d)
    got = sorted(tuple(r) for r in q.collect())
    assert got == sorted(duckdb.sql(f"select {', '.join(q.columns)} from ({ORACLES['op3_html']})").fetchall())


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 7), (2, page(f"<p>{LONG}"), 7), (2, page(f"<p>{LONG}"), 7)], "page_id long, html string, n_chars int")
    got = {(r.page_id, r.text, r.n_chars) for r in extract_pages(df).collect()}
    assert got == {(1, "", 0), (2, LONG.strip(), len(LONG.strip()))}
    assert extract_pages(df.limit(0)).collect() == []


def test_ratios_decide(monkeypatch):
    """Furniture without a telling tag or name goes by the ratios of its paths alone."""
    body = "".join(f"<p>{n} {LONG}</p>" for n in "abcd")
    want = [f"{n} {LONG.strip()}" for n in "abcd"]
    links = "<ul>" + "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(9)) + "</ul>"
    pages = [
        page(f"<div><div>{links}</div><div>{body}</div><div><span>Prev</span> <span>Next</span></div></div>"),
        page(f"<table><tr><td>{links}</td><td>{body}</td></tr></table>"),
        page(f"<div>{links}</div><div><article>{body}</article></div><div><p>About us</p></div>"),
        page(f"<center>Welcome</center><div id=b>{body}</div><font>top of page</font>"),
    ]
    for html in pages:
        assert extract(html).split("\n\n") == want, html
    monkeypatch.setattr(html_text, "path_ratios", lambda every, said: [1.0] * len(every))
    for html in pages:
        assert extract(html).split("\n\n") != want


def test_pages_wrapped_in_a_form():
    body = "".join(f"<p>{n} {LONG}</p>" for n in "abcd")
    want = [f"{n} {LONG.strip()}" for n in "abcd"]
    for inner in (f"<article>{body}</article>", f"<div class=content>{body}</div>", f"<main><div>{body}</div></main>"):
        got = extract(page(f'<form id="aspnetForm"><input type=hidden><nav><a href=/>Home, here</a></nav>{inner}<select><option>x</select></form>'))
        assert got.split("\n\n") == want, inner
    search = f"<form><p>Search, if you like.</p><input></form><article>{body}</article>"
    assert extract(page(search)).split("\n\n") == want


@pytest.mark.parametrize("part,close", [("<div>", "</div>"), ("<div><p>a, b.", ""), ('<div class="widget"><b><i>a', "</q>"), ("<ul><li>", ""), ("<header>b", ""), ("<form><annotation>", "")])
def test_time_grows_with_the_page_not_its_depth(part, close):
    import time

    n, took = 100_000, []
    for k in (n // 4, n):
        began = time.perf_counter()
        extract(part * k + "x." + close * k)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 and took[1] < 4 * 2.5 * took[0] + 0.5
