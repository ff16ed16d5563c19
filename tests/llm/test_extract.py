import html
import re
import time

from pyspark.sql import functions as F

from vozlake.llm import extract as ex

PROSE = "It is one of the things that they have been told about in the town, and all of it was true for them and for us."
LONG = " ".join([PROSE] * 3)


def test_article_with_everything_around_it():
    page = f"""<!DOCTYPE html><html><head><title>T {LONG}</title><style>p{{}}</style><script>var a="</p><p>{LONG}";</script></head><body class="has-sidebar">
    <header><h1>The site of all</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News of the day</a></ul></nav>
    <div class="cookie-notice">{LONG}</div><form><p>{LONG}</p></form>
    <article><header><h1>On   things &amp; towns</h1></header><p>{LONG}<p>Short one.<br>Goes on.</p><p>a &lt; b &#233;&nbsp;c < d</p>
    <ul><li>first of all</li><li>last</li></ul><!-- <p>{LONG}</p> --><div class="share">Share this on the net</div><aside>{LONG}</aside>
    <section id="comments"><p>{LONG}</p></section></article>
    <div hidden><p>{LONG}</p></div><div style="display: none">{LONG}</div><div class="sidebar"><p>{LONG}</p></div><footer>&copy; 2020 the site</footer></body></html>"""
    assert ex.main_text(page) == "\n".join(["On things & towns", LONG, "Short one. Goes on.", "a < b é c < d", "first of all", "last"])


def test_pages_without_an_article_element():
    links = "".join(f'<a href="/{k}">link number {k} of the list</a> ' for k in range(9))
    page = f"<body><div>{links}</div><div>Short notice</div><h2>A heading</h2><div>{LONG}</div><div>So it goes.</div><div>{LONG}</div><div>{links}</div><div>Imprint</div></body>"
    assert ex.main_text(page) == "\n".join(["A heading", LONG, "So it goes.", LONG])
    assert ex.main_text(f"<div>{links}</div><div>too short</div>") == ""
    assert ex.main_text(f"{LONG}<br><br>{LONG}<br>x") == f"{LONG}\n{LONG} x"


def test_broken_markup():
    assert ex.main_text(None) == ex.main_text("") == ex.main_text("<") == ex.main_text("<p") == ex.main_text("<!-- x") == ""
    assert ex.main_text(f"<article><p>{LONG}<script>never ends <p>{LONG}") == LONG
    assert ex.main_text(f'<article><p title="a > b" class=x>{LONG}</div></p></nav><p>{LONG}') == f"{LONG}\n{LONG}"
    assert ex.main_text(f'<p class="unclosed>{LONG}</p>') in ("", LONG)
    assert ex.main_text(f"<nav><ul><li>x<article><p>{LONG}</p></article>") == LONG


def test_short_blocks_with_links():
    short = '<h2>Results <a href="#r">#</a></h2><p>See <a href="/r">the report</a> for more.</p><ul><li>An <a href="/x">inline link</a> in it</li></ul><p><a href="/s">Source</a></p><p>© the town</p>'
    kept = ["Results #", "See the report for more.", "An inline link in it", "Source", "© the town"]
    page = '<body><div><a href="/">Home</a></div>{}<div>© 2020 the site</div></body>'
    assert ex.main_text(page.format(f"<article><p>{LONG}</p>{short}<p>{LONG}</p></article>")) == "\n".join([LONG, *kept, LONG])
    assert ex.main_text(page.format(f'<div>{LONG}</div><div>It is said in <a href="/r">one</a> of them.</div><div>{LONG}</div>')) == f"{LONG}\nIt is said in one of them.\n{LONG}"


def test_linked_lists_and_formulas_stay_in_the_article():
    linked = [f"A link to part number {k} of the report that was made for the town and its people" for k in range(3)]
    listed = "".join(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(linked))
    given = "Let <math><mi>n</mi></math> be a number of the kind that we want to have in the set."
    page = f'<body><nav>{listed}</nav><article><p>{LONG}</p><p>{given}</p><ul>{listed}</ul><object><p>It is a picture of the town.</p></object><nav>{listed}</nav><p>See the end.</p></article><div>{listed}</div></body>'
    assert ex.main_text(page) == "\n".join([LONG, "Let n be a number of the kind that we want to have in the set.", *linked, "It is a picture of the town.", "See the end."])


def test_stray_end_tags_take_linear_time():
    for head, tail in (("<div>", "</section>"), ("<section><article>" + "<div>" * 10, "</section>"), ("<body><article><div>", "</main>"), ("<main><article>", "</main>")):
        start = time.process_time()
        text = ex.main_text(head * 50_000 + tail * 100_000 + f"<p>{LONG}</p>")
        assert time.process_time() - start < 20 and text in (LONG, "")
    start = time.process_time()
    ex.main_text("<section><article>" + "<div>" * 100_000 + "</section>" * 100_000)
    assert time.process_time() - start < 2
    assert ex.main_text(f"<nav><div><article><div><p>{LONG}</p></section></nav></body></html><p>{LONG}</p>").startswith(LONG)


def test_long_attributes():
    for value in (f"<nav class='menu'><p>{LONG}</p> > ", f"<b>{LONG}"):
        value = value * (100_000 // len(value) + 1)
        aside = f'<aside data-x="{value}"><p>{LONG}</p></aside>'
        assert ex.main_text(f'{aside}<article data-y="{value}"><div data-x="{value}" id=a><p>{LONG}</p></div></article>') == LONG
        assert ex.main_text(f'<div data-x="{value}" CLASS = "sidebar"><p>{LONG}</p></div><p>{LONG}</p>') == LONG


def test_unclosed_quotes_take_linear_time():
    for piece in ('<a href="', "<a href='x\"", '<a "', "<a '<a \""):
        start = time.process_time()
        ex.main_text(piece * 40_000)
        assert time.process_time() - start < 10


def test_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<article><p>{LONG}</p></article>"), (3, "u", f"<article><p>{LONG}</p></article>"), (None, "u", "<article>" + f"<p>{LONG}</p>" * 2000 + "</article>"), (5, "u", "<b " * 50_000), (6, "u", '<a href="' * 20_000), (7, "u", "<p>x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("N_chars", F.lit(1)).withColumn("a.b", F.lit(1))
    got = {(r.page_id, r.text): r.n_chars for r in ex.digest(df).collect()}
    assert got[(1, "")] == got[(2, "")] == 0 and got[(3, LONG)] == len(LONG)
    assert got[(None, "\n".join([LONG] * 2000))] == 2000 * len(LONG) + 1999
    assert ex.digest(df).count() == 8 and ex.digest(df.limit(0)).count() == 0


def test_whole_table_equals_its_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in ex.digest(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article.replace("<br>", " ")))
        assert got[r.page_id] == "\n".join(x for x in parts if x)
