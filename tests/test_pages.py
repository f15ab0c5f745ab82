import html as html_module
import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.operators import ingest as G
from newsloom.sources import files, sinks
from newsloom.sources.files import view_count

LISTING = """
<section><article class="head"><div><a href="/n/0"><div></div></a></div>
 <a href="/n/0"><h2 class="article-title"> Primera &amp; más </h2></a></article>
<article><a href="/n/1"><div class="article-image" style="background-image: url('http://i/1.png'); x"></div></a>
 <div><div><div class="article-date-hour">martes 18 junio, 2024 | 16:47</div></div><a href="/n/1">
 <h2 class="article-title">Segunda</h2></a></div></article>
<article><div class="article-date-hour">sin fecha</div><a href="/n/2"><h2 class="x article-title">Tercera</h2></a></article>
<article><a href="/n/3"><h2 class="article-title"> </h2></a></article>
<article><a href="/n/4">no title</a></article></section>
"""


def test_listing(spark):
    pages = spark.createDataFrame([("u", LISTING)], "url string, html string")
    cards = G.listing_cards(pages, G.SITE_RULES["biobiochile"])
    rows = G.normalise_listing(cards).orderBy("pos").collect()
    assert [(r.title, r.link, r.image) for r in rows] == [
        ("Primera & más", "/n/0", ""), ("Segunda", "/n/1", "http://i/1.png"), ("Tercera", "/n/2", ""),
    ]
    assert [r.publish_date for r in rows] == [None, datetime(2024, 6, 18, 16, 47), None]
    assert [r.bad_date for r in rows] == [False, False, True]
    manifest = sinks.image_manifest(G.normalise_listing(cards)).collect()
    assert [m.s3_link for m in manifest] == ["http://i/1.png"]


def test_css_url(spark):
    styles = ['url("x")', "url('x')", "url(x)", "x", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(styles)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(H.css_url(F.col("v"))).collect()]
    assert got == ["x", "x", "x", "x", "", None]


def test_view_counts(spark):
    payloads = ['[{"NotaId": 1, "Visitas": 7}]', '[{"Visitas": 0}]', '[{"NotaId": 1}]', "[]", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(view_count(F.col("v"))).collect()]
    assert got == [7, None, None, None, None]


def test_routes(spark):
    links = ["/especial/aqui-tierra/x", "/especial/y", "/noticias/z"]
    df = spark.createDataFrame([(v,) for v in links], "v string")
    got = [r[0] for r in df.select(G.template_route(F.col("v"))).collect()]
    assert got == ["aqui-tierra", "especial", "normal"]


NORMAL = """<html><head><script>var p="<p>no</p>";</script></head><body><h2>outside</h2>
<div class="post big" id="post-77"><div class="post-excerpt">Lead &amp; more</div>
 <div class="banners-contenido-nota-77"><p>One <b>bold</b></p><div><p>nested</p></div>
 <h2>Sub</h2><p>Two<br>lines<p>Three</div><section><blockquote>Quote <p>inner</p></blockquote></section>
</div><h2>after</h2></body></html>"""
NO_HEADER = """<div class="nota"><div class="banners-contenido-nota"><p>A</p></div></div>"""


def test_templates(spark):
    rows = [
        ("n", "/noticias/1", NORMAL),
        ("s", "/especial/1", NO_HEADER),
        ("t", "/especial/aqui-tierra/1", NO_HEADER),
        ("m", "/noticias/2", "<div>nothing</div>"),
        ("x", "/noticias/3", None),
    ]
    pages = spark.createDataFrame(rows, "article_hash string, article_link string, html string")
    got = {r.article_hash: r for r in G.template_bodies(pages).collect()}
    assert set(got) == {"n", "s"}
    assert got["n"].article_body == "Lead & more One bold Sub Twolines Three Quote inner"
    assert got["s"].article_body == " A"
    assert got["n"].raw_content.startswith('<div class="post-excerpt">')
    assert got["n"].raw_content.rstrip().endswith("</section>")


def test_assemble_body(spark):
    parts = spark.createDataFrame([("a", i, f"p{i}") for i in (11, 2, 0)], "k string, pos int, text string")
    assert G.assemble_body(parts, "k").first().article_body == "p0 p2 p11"


def test_search_hits(spark, tmp_path):
    payload = (
        '{"news_results": [{"title": "a", "link": "http://x.cl/biobio", "date": "hace 3 horas"},'
        '{"title": "b", "link": "http://x.org", "date": "hace 1 horas"},'
        '{"title": "c", "link": "http://x.com", "date": "hace 2 días"}]}'
    )
    (tmp_path / "hits.json").write_text(payload)
    rows = G.search_hits(files.read_search_json(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.title, r.mark, r.is_biobio) for r in rows] == [("a", "##", True), ("b", "!!", False)]


def test_stored_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text(NORMAL)
    row = files.read_stored_pages(spark, str(tmp_path)).first()
    assert row.html == NORMAL and row.url.endswith("p.html")


def test_target_pages(spark):
    targets = spark.createDataFrame([("http://x/page/",)], "url string")
    got = [r.page_url for r in G.target_pages(targets).orderBy("page").collect()]
    assert got == [f"http://x/page/{i}" for i in range(1, 8)]


# -- the tag walker against a plain one ---------------------------------------

PIECE = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)([^>]*)>|[^<]+|<", re.S)


def slow_walk(page):
    """(tag, attributes, parent's number, start, inner, end, text) of each element; every text is added to all open elements."""
    out, stack = [], []

    def close(at):
        out[stack.pop()][5] = at

    def close_to(tag, at):
        if any(out[i][0] == tag for i in stack):
            while out[stack[-1]][0] != tag:
                close(at)
            close(at)

    for m in PIECE.finditer(page):
        tag = (m.group(3) or "").lower()
        if not tag:
            if m.group(1) is None and not (m.group(0).startswith("<!--") and len(m.group(0)) > 1):
                for i in stack:
                    out[i][6] += html_module.unescape(m.group(0))
        elif m.group(2):
            close_to(tag, m.start())
        else:
            if tag in H.CLOSES_P:
                close_to("p", m.start())
            attrs = {k.lower(): v.strip("\"'") for k, v in re.findall(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", m.group(4))}
            out.append([tag, attrs, stack[-1] if stack else None, m.start(), m.end(), None, ""])
            if tag in H.VOID or m.group(4).endswith("/"):
                out[-1][5] = m.end()
            else:
                stack.append(len(out) - 1)
    while stack:
        close(len(page))
    return out


BITS = st.sampled_from(
    ["<p>", "</p>", "<div class='a b'>", "</div>", "<br/>", "<b>", "</b>", "<x y=1 z = 'q' >", "text &amp; ", "<", ">", "<!--", "-->", "<!-- c -->",
     "<script>", "</script>", "<style x>", "</style >", "<h1>", "</h1>", " a=b ", "&lt", "<SCRIPT>", "</x>", "<img src=a>", "\n", "<p a='b' c>"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(BITS, max_size=40).map("".join))
def test_walk_against_a_plain_walker(page):
    got = [[n.tag, n.attrs, n.parent and n.parent.number, n.start, n.inner, n.end, n.text] for n in H.walk(page)]
    want = slow_walk(page)
    assert got == [[*w[:6], " ".join(w[6].split())] for w in want]
    nodes = H.walk(page)
    for n in nodes:
        above, at = set(), n.parent
        while at is not None:
            above.add(at.number)
            at = at.parent
        assert {m.number for m in nodes if n.inside(m)} == above


def test_walk_is_linear():
    import time

    def seconds(page):
        start = time.process_time()
        G.read_template(page, "normal")
        return time.process_time() - start

    head = '<div class="post" id="post-1"><h1 class="post-excerpt">x</h1><div class="banners-contenido-nota-1">'
    pages = {
        "deep": lambda n: head + "<div>" * n + "t" + "</div>" * n,
        "unclosed": lambda n: head + "<section>word " * n,
        "strays": lambda n: head + "<div>" * n + "</b>" * n,
        "comments": lambda n: head + "<!-- <script " * n,
        "no end": lambda n: head + "<a b" * n,
        "attributes": lambda n: head + "<div " + "a" * 20 * n + ">",
    }
    for name, page in pages.items():
        seconds(page(1000))
        few, many = min(seconds(page(10_000)) for _ in range(3)), min(seconds(page(80_000)) for _ in range(2))
        assert many < 24 * few + 0.2, (name, few, many)
