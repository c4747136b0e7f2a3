"""Main text of pages: light parts, unclosed elements, excluded wrappers, and a brute-force version of the line windows."""

import random

from tidewright.llm import html


def test_html_keeps_light_parts():
    p = "A sentence that says, at some length, what there is to say about it. " * 8
    page = f"<main><h1>T</h1><p>lead</p><article>{p}</article></main>"
    assert html.main_text(page) == f"T lead {p.strip()}"
    assert html.main_text(f"<article>short</article><div>between</div><article>{p}</article>") == f"short {p.strip()}"
    cut = "".join(f"<li>{x}</li>" for x in ("Yes.", "No.", "So?", "Well.", "Oh."))
    end = "And a last section that is lighter than half of all that came before it."
    assert html.main_text(f"<div>{p}</div><ul>{cut}</ul><ul><li><a href=x>Home</a></li></ul><div>{end}</div>") == f"{p.strip()} Yes. No. So? Well. Oh. {end}"
    assert html.main_text("<p>One.</p><p>Two.</p><ul>" + "<li><a href=x>link</a></li>" * 4 + "</ul><p>Three.</p>") == "One. Two. Three."


def test_html_unclosed_and_wrapped():
    p = "A sentence that says, at some length, what there is to say about it."
    text = html.main_text
    assert text(f"<html><head><title>t</title><meta charset=x><body><p>{p}</p></body>") == p
    assert text(f"<head><style>x</style><title>t<p>{p}") == p
    for tag in ("button", "select", "svg", "math", "canvas", "object", "iframe", "textarea", "noscript", "template"):
        assert text(f"<div>{p}</div><{tag} a=b>x<div>{p}</div><{tag}>y</{tag}><p>{p}</p>") == f"{p} {p} {p}", tag
        assert text(f"<p>{p} <{tag}>x<p>y</p></{tag}></p><p>{p}</p>") == f"{p} {p}", tag
    assert text(f"<p>{p} <svg width='1'/>and <math/>more</p>") == f"{p} and more"
    assert text(f"<p>{p} <svg><svg/><svg>x</svg>y</svg>and</p>") == f"{p} and"
    for outer in ("div class='page has-sidebar'", "div class=with-comments", "div class='social'", "form", "section id=related"):
        assert text(f"<{outer}><h1>Site</h1><article><p>{p}</p></article></{outer.split()[0]}>").endswith(p), outer
        assert text(f"<{outer}><main><p>{p}</p><nav>m</nav></main></{outer.split()[0]}>").endswith(p), outer
    assert text(f"<div class=has-sidebar><p>{p}</p></div>") == p
    assert text(f"<article>{p}</article><div class=comments><article class=comment>{p}</article></div>") == p
    for outer in ("nav", "aside", "footer", "div hidden", "div role=dialog", "div class=social><nav"):
        assert text(f"<article>{p}</article><{outer}><article>{p}</article></{outer.split()[0]}>") == p, outer


def test_stretches_against_brute_force():
    g = random.Random(8)
    for _ in range(3000):
        w = [g.choice([0, 0, 0, 1, 5, 19, 20, 21, 59, 60, 200]) for _ in range(g.randrange(0, 25))]
        sums = [sum(w[max(0, i - 1) : i + 2]) for i in range(len(w))]
        least = html.SURGE if max(sums, default=0) >= html.SURGE else 1
        want = []
        for i in range(len(w)):
            # Text: from here one comes to a surge, to the left or the right, without a dive on the way.
            right = next((j for j in range(i, len(w)) if sums[j] >= least or not sums[j]), None)
            left = next((j for j in range(i, -1, -1) if sums[j] >= least or not sums[j]), None)
            if w[i] and any(j is not None and sums[j] for j in (left, right)):
                want.append(i)
        assert [i for a, b in html.stretches(w) for i in range(a, b) if w[i]] == want


def test_windows_decide_with_without_and_against_marks():
    p = ["One sentence of a paragraph that is long enough to be seen as text.", "A second one, which is of about the same length as the first one is."]
    short = ["a", "b", "c", "d", "e"]
    body = "".join(f"<p>{x}</p>" for x in ["Two short", "paragraphs.", *p, *short, "And a closing one."])
    want = " ".join(["Two short", "paragraphs.", *p, *short, "And a closing one."])
    links = "<div><a href=1>Home</a></div>" * 4
    small = "<div>Site</div>"
    for page in (f"{small}{links}<div>{body}</div>{links}<div>Imprint</div>", f"<div>Site</div><article>{body}</article><div>Imprint</div>"):
        assert html.main_text(page) == want
    # A mark around a teaser is wrong: the text is elsewhere.
    assert html.main_text(f"<article><h2>Teaser</h2></article>{links}<div>{body * 3}</div>") == " ".join([want] * 3)
    # A marked line among too little text doesn't surge by itself.
    assert html.main_text(f"<article>{body}</article>{small * 4}<article>Hi</article>") == want
    assert html.main_text("<p>x</p>") == "x" and html.main_text(links) == ""
    assert html.main_text(f"<article><p><a href=1>{p[0]}</a></p><p>{p[1]}</p></article>") == " ".join(p)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "<p>" + "long text " * 100_000), (None, "u", None), (1, None, "")], "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = html.extract(docs).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 999_999] and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert html.extract(docs.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    """The marked article of each page of the table, read by the library's own parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.text = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.text.append("\n" if tag in ("p", "h1", "h2", "h3", "li", "br", "div") else "")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.text.append("\n" if tag in ("p", "h1", "h2", "h3", "li", "div") else "")

        def handle_data(self, data):
            if self.inside:
                self.text.append(data)

    docs = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null")
    pages = {r.page_id: r.html for r in docs.collect()}
    same = 0
    for r in html.extract(docs).collect():
        a = Article()
        a.feed(pages[r.page_id])
        same += " ".join("".join(a.text).split()) == r.text
    print(same, len(pages))
    assert same >= 0.9 * len(pages)


def test_stray_tags_take_linear_time():
    import time

    for page in ("<div>" * 40_000 + "</p>" * 40_000, "<div>" * 40_000 + "</section>" * 40_000, "</b></x>" * 40_000 + "<div>" * 40_000 + "<section></div>" * 40_000):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 3
    assert html.main_text("<div><section><p>a</div></section></p><div>b</div></div></main>") == "a b"


def test_class_names_exclude_as_a_whole():
    p = "A sentence that says, at some length, what there is to say about it."
    for name in ("social-history", "commentary", "shared-memory", "related_work", "login-theory", "advertisers"):
        assert html.main_text(f"<main><p>{p}</p><div class={name}><p>{p}</p></div></main>") == f"{p} {p}", name
    for name in ("social-links", "comments", "related-articles", "ad-slot-3", "page-footer", "cookie-notice", "x newsletter-box"):
        assert html.main_text(f"<main><p>{p}</p><div class='{name}'><p>{p}</p></div></main>") == p, name


def test_linked_paragraphs_of_a_text_stay():
    p = "A sentence that says, at some length, what there is to say about it."
    for page in (f"<p>{p}</p><p>See <a href=1>all that was said of it before</a>.</p><h2><a href=2>Part two</a></h2><p>{p}</p>",):
        assert html.main_text(f"<div>{page}</div>") == f"{p} See all that was said of it before. Part two {p}"
        assert html.main_text(f"<article>{page}</article>") == f"{p} See all that was said of it before. Part two {p}"


def test_windows_choose_lines_outside_marks():
    """A text outside the marks that is denser than the marked one is text too; one that isn't stays out."""
    p = "A sentence that says, at some length, what there is to say about it. "
    marked, gap = f"<article><p>{p}</p></article>", "<div><a href=1>Home</a></div>" * 4
    assert html.main_text(f"<div><p>{p * 3}</p></div>{gap}{marked}") == " ".join((p * 4).split())
    assert html.main_text(f"<div><p>{p}</p></div>{gap}{marked}") == p.strip()


def test_pages_without_marks_by_windows(spark):
    """With all marks, classes and element names taken off, the windows find what the marks held, within 2% of the whole."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").collect()]
    off = whole = close = 0
    for page in pages:
        bare = re.sub(r' (class|id|role)="?[\w-]+"?', "", re.sub(r"<(/?)(article|nav|footer|aside|header|main)\b", r"<\1div", page))
        want, got = html.main_text(page), html.main_text(bare)
        off, whole = off + abs(len(got) - len(want)), whole + len(want)
        close += abs(len(got) - len(want)) <= 0.02 * len(want)
    assert off <= 0.002 * whole and close >= 0.98 * len(pages)
