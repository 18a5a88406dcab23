import html
import re

import duckdb

from llm.conftest import SF
from runlens.llm import html_extract as H

PAGES = "page_id long, url string, html string"
SITE = """<html><head><title>T</title><style>p{{}}</style></head><body><div id=top class='site-header'>Logo</div>
<ul class=menu><li><a href=x>Home</a><li><a>About</a></ul><div class="wrap post-{n}"><h2>Title &amp; more {n}</h2>
<p>First paragraph number {n} with some &lt;text&gt; that is long enough.<p>Second   paragraph<br>after a break, which is quite long too.
<div class="share-buttons">Share me</div><form><input><p>Mail</form><!-- <p>no</p> --></div>
<div id="comments"><p>Nice article, I liked it very much, thanks a lot indeed.</p></div><aside>Side</aside>
<script>if(a<b){{"</p>"}}</script><div class="cookie-notice">We use cookies on this site, accept them all.</div><footer>&copy; 2020</footer>"""


def article(page):
    """Main text of the test tables' pages, whose article element holds it."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_table_pages(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in H.report(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for i, url, page in pages:
        text = article(page)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))


def test_consensus_helps_a_short_page(spark):
    rows = [(n, f"http://a.example/{n}", SITE.format(n=n)) for n in range(6)]
    short = ('<body><div class="wrap post-9"><h2>Short</h2><p>Tiny.</div><div class="box"><p>'
             + "A long block of something else that is not in the place where this host keeps its articles. " * 3 + "</div>")
    df = spark.createDataFrame(rows + [(9, "http://a.example/9", short)], PAGES).selectExpr("*", "1 AS host", "2 AS paths", "3 AS text")
    got = {r.page_id: r.text for r in H.report(df).collect()}
    assert got[3] == ("Title & more 3\nFirst paragraph number 3 with some <text> that is long enough.\n"
                      "Second paragraph after a break, which is quite long too.")
    assert got[9] == "Short\nTiny."


def test_every_layout_of_a_host_counts(spark):
    prose = "This is the main text of a page, and it is long enough to be read as prose by anybody. "
    block = "A long block of something else that is not in the place where this host keeps its articles. " * 4
    rows = [(10 * k + n, f"http://b.example/{k}/{n}", f'<body><div class="lay{chr(97 + k)}"><p>{prose}{k} {n}</p></div>')
            for k in range(9) for n in range(12 - k)]
    short = [(1000 + k, f"http://b.example/s{k}", f'<body><div class="lay{chr(97 + k)}"><p>Tiny.</div><div class="box"><p>{block}</div>')
             for k in range(9)]
    got = {r.page_id: r.text for r in H.report(spark.createDataFrame(rows + short[8:], PAGES)).collect()}
    assert got[1008] == "Tiny."
    got = {r.page_id: r.text for r in H.report(spark.createDataFrame(rows + short[6:7], PAGES)).collect()}
    assert got[1006] == "Tiny." and got[83] == f"{prose}8 3"


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text &amp; more"), (4, "http://h/", "<"), (5, "http://h/", '<a href="x'),
            (6, "http://h/", "<!-- open"), (7, "http://h/", "<p>" * 2000 + "x"), (8, "http://h/", "</p></div>"), (None, "http://h/", "<b>a<i>b"),
            (9, "http://h/", "<p>same</p>"), (9, "http://h/", "<p>same</p>"), (10, "HTTP://U@H:80/", "<div hidden>no</div><p>yes")]
    got = [tuple(r) for r in H.report(spark.createDataFrame(rows, PAGES)).collect()]
    by = {r[0]: r[2] for r in got}
    assert len(got) == len(rows)
    assert by == {1: "", 2: "", 3: "just text & more", 4: "<", 5: '<a href="x', 6: "", 7: "x", 8: "", None: "ab", 9: "same", 10: "yes"}
    assert H.report(spark.createDataFrame([], PAGES)).collect() == []
