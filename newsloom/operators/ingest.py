"""From stored pages to complete article rows."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions.arrays import pos_exploded
from newsloom.functions.dates import spanish_date
from newsloom.functions.keys import link_md5
from newsloom.functions.text import strip
from newsloom.operators.incremental import first_per_key
from newsloom.schema import BODY_ROW


@dataclass(frozen=True)
class SiteRule:
    """Patterns that find the cards of a listing page and their fields."""

    card: str
    title: str
    link: str
    date: str | None = None
    image: str | None = None


# Listing rules per site.
SITE_RULES = {
    "biobiochile": SiteRule(
        card=r"(?s)<article\b.*?</article>",
        title=r'(?s)<h2[^>]*class="[^"]*\barticle-title\b[^"]*"[^>]*>(.*?)</h2>',
        link=r'(?s)<a[^>]*\bhref="([^"]*)"',
        date=r'(?s)<div[^>]*class="[^"]*\barticle-date-hour\b[^"]*"[^>]*>(.*?)</div>',
        image=r"""(?s)<div[^>]*class="[^"]*\barticle-image\b[^"]*"[^>]*background-image:\s*([^;]*?\))""",
    ),
    "latercera": SiteRule(
        card=r"(?s)<article\b.*?</article>",
        title=r"(?s)<h3[^>]*>\s*<a[^>]*>(.*?)</a>",
        link=r'(?s)<h3[^>]*>\s*<a[^>]*\bhref="([^"]*)"',
        date=r'(?s)<div[^>]*class="[^"]*\btime\b[^"]*"[^>]*>(.*?)</div>',
        image=r'(?s)<img[^>]*\bsrc="([^"]*)"',
    ),
    "24horas": SiteRule(
        card=r'(?s)<article[^>]*class="col xs-12 xsm-12[^"]*"[^>]*>.*?</article>',
        title=r"(?s)<h[23][^>]*>(.*?)</h[23]>",
        link=r'(?s)<a[^>]*\bhref="([^"]*)"',
        image=r'(?s)<img[^>]*\bsrc="([^"]*)"',
    ),
    "nav": SiteRule(
        card=r"(?s)<li>.*?</li>",
        title=r"(?s)<a[^>]*>(.*?)</a>",
        link=r'(?s)<a[^>]*\bhref="([^"]*)"',
    ),
}

# Fixed values: (route, mark in the address), first match wins; else `normal`.
ROUTES = (("aqui-tierra", "aqui-tierra"), ("especial", "/especial/"))

# Class names per route; `{id}` is the number of the post.
TEMPLATES = {
    "aqui-tierra": (("nota-y-mas-leidos",), "extracto-nota", "banners-contenido-nota"),
    "especial": (("nota-y-mas-leidos", "nota"), "extracto-nota", "banners-contenido-nota"),
    "normal": (("post",), "post-excerpt", "banners-contenido-nota-{id}"),
}


def target_pages(targets: DataFrame, pages: int = 7, url: str = "url") -> DataFrame:
    """Numbered listing pages 1..pages of every target."""
    return targets.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages)))).withColumn(
        "page_url", F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"), F.col("page").cast("string"))
    )


def listing_cards(pages: DataFrame, rule: SiteRule, html: str = "html") -> DataFrame:
    """One row per article card with its raw text fields, in page order.

    Missing fields are '' and cards without a title are dropped.
    """

    def field(pattern: str | None) -> Column:
        return F.lit("") if pattern is None else F.regexp_extract("raw_content", pattern, 1)

    keep = [c for c in pages.columns if c != html]
    cards = F.regexp_extract_all(F.col(html), F.lit(rule.card), F.lit(0))
    return (
        pos_exploded(pages, keep, cards, "pos", "raw_content")
        .withColumn("title", strip(H.inner_text(field(rule.title))))
        .filter("title <> ''")
        .withColumn("link", H.unescape(field(rule.link)))
        .withColumn("date", strip(H.inner_text(field(rule.date))))
        .withColumn("image", field(rule.image))
    )


def normalise_listing(cards: DataFrame) -> DataFrame:
    """Parsed image address and date, and the key of the link.

    An unparsable date is NULL and flagged; rows without a link have no key and
    are dropped.
    """
    return (
        cards.filter("link <> ''")
        .withColumn("image", H.css_url(F.col("image")))
        .withColumn("publish_date", spanish_date(F.col("date")))
        .withColumn("bad_date", (F.col("date") != "") & F.col("publish_date").isNull())
        .withColumn("hash_id", link_md5(F.col("link")))
    )


def with_target(listing: DataFrame, targets: DataFrame, on: str = "url") -> DataFrame:
    """Category and entity of the target a page belongs to."""
    return listing.join(targets.select(on, "category", "entity"), on)


def template_route(link: Column) -> Column:
    routed = None
    for name, mark in ROUTES:
        hit = F.contains(link, F.lit(mark))
        routed = F.when(hit, name) if routed is None else routed.when(hit, name)
    return routed.otherwise("normal")


def read_template(page: str, route: str) -> tuple[str, str] | None:
    """Body text and inner HTML of one page; None when its root is missing.

    The body is the header text followed by ' ' and each part: paragraphs that
    are direct children of the body container, and every h2 and blockquote of
    the post, in document order.
    """
    roots, header, container = TEMPLATES[route]
    nodes = H.walk(page)
    first: dict[str, H.Node] = {}
    for node in nodes:
        for name in node.classes:
            first.setdefault(name, node)
    root = next((first[name] for name in roots if name in first), None)
    if root is None:
        return None
    if "{id}" in container:
        number = root.attrs.get("id", "").split("-")
        if len(number) < 2:
            return None
        container = container.format(id=number[1])
    within = nodes[root.number + 1 : root.last + 1]
    body = next((n.text for n in within if n.has_class(header)), "")
    for node in within:
        direct = node.tag == "p" and node.parent is not None and node.parent.has_class(container)
        if direct or node.tag in ("h2", "blockquote"):
            body += " " + node.text
    return body, page[root.inner : root.end]


def template_bodies(pages: DataFrame) -> DataFrame:
    """Bodies of (article_hash, article_link, html) rows by their page template.

    The direct-child rule needs the nesting of a page, which patterns cannot
    follow; Arrow batches go through a small tag walker. Pages without the root
    of their template give no row.
    """

    names = BODY_ROW.names

    def extract(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("article_hash", "html", "route")))
            read = [(key, read_template(page, route)) for key, page, route in rows]
            kept = [(key, *found) for key, found in read if found is not None]
            columns = [pa.array([row[i] for row in kept], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    routed = pages.filter("html is not null").select(
        "article_hash", "html", template_route(F.col("article_link")).alias("route")
    )
    return routed.mapInArrow(extract, BODY_ROW)


def page_parts(pages: DataFrame, html: str = "html", root: str = "article") -> DataFrame:
    """Flat pages, JVM only: title, paragraph texts and cleaned content."""
    keep = [c for c in pages.columns if c != html]
    return (
        pages.select(*keep, H.drop_noise(F.col(html)).alias("_page"))
        .select(*keep, H.first_element(F.col("_page"), root).alias("raw_content"))
        .select(
            *keep,
            strip(H.inner_text(H.first_element(F.col("raw_content"), "h1"))).alias("title"),
            H.paragraphs(F.col("raw_content")).alias("parts"),
            "raw_content",
        )
    )


def assemble_body(parts: DataFrame, key: str, pos: str = "pos", text: str = "text") -> DataFrame:
    """Join part rows into one body per key, in order, with a space."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(text).alias("text"))))
    return parts.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("article_body")
    )


def left_merge(
    listing: DataFrame,
    bodies: DataFrame,
    key: str = "article_hash",
    order: list[str] | None = None,
    multiply: bool = False,
) -> DataFrame:
    """Listing rows with the body of their link; a failed body leaves NULLs.

    Of the bodies of one link the first in `order` is taken, any one without
    an order. With `multiply` a listing row comes once per body, as in any
    equi-join.
    """
    one = bodies if multiply else first_per_key(bodies, key, order or [key])
    return listing.join(one, key, "left")


def complete_articles(
    listing: DataFrame, bodies: DataFrame, views: DataFrame, note: str = "note_id"
) -> DataFrame:
    """Listing rows with body, views and a date filled from the page.

    `bodies` has (hash_id, article_body, page_date, note), `views` (note, view_count).
    A listing row gets the one body of its link, so both sides are reduced to a
    row per key first: copies of a page never multiply.
    """
    one_body = first_per_key(bodies, "hash_id", [note])
    one_count = views.groupBy(note).agg(F.max("view_count").alias("view_count"))
    return (
        listing.join(one_body, "hash_id")
        .join(one_count, note, "left")
        .withColumn("publish_date", F.coalesce("publish_date", "page_date"))
        .drop("page_date")
    )


def search_hits(hits: DataFrame) -> DataFrame:
    """Hits some hours old, marked by their address."""
    known = F.contains(F.col("link"), F.lit(".cl")) | F.contains(F.col("link"), F.lit(".com"))
    return hits.filter(F.contains(F.col("date"), F.lit("horas"))).select(
        *[c for c in hits.columns if c != "date"],
        F.when(known, "##").otherwise("!!").alias("mark"),
        F.contains(F.col("link"), F.lit("biobio")).alias("is_biobio"),
    )
