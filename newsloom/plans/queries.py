"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schema as S
from newsloom.functions import dates as D
from newsloom.functions import html as H
from newsloom.functions import keys as K
from newsloom.functions import scoring as N
from newsloom.functions import text as X
from newsloom.functions.arrays import pos_exploded
from newsloom.functions import sql as SQL
from newsloom.functions.rouge import rouge_score
from newsloom.operators import evaluation as E
from newsloom.operators import incremental as I
from newsloom.operators import ingest as G
from newsloom.operators import profile as P
from newsloom.operators import quality as Q
from newsloom.operators import ranking as R
from newsloom.operators import summarise as M
from newsloom.operators import words as W
from newsloom.plans import batch as B
from newsloom.plans import rounds as L
from newsloom.session import dealt, scratch_path, written
from newsloom.sources import files, pages, sinks
from newsloom.sources.tables import (
    arrivals,
    articles,
    chunk_pairs,
    dictionary,
    document_link,
    read_table,
    scored_articles,
)
from newsloom.streaming import dedupe

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _r(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[_r(c).alias(c) if c in names else c for c in df.columns])


# -- sources and sinks ----------------------------------------------------


def _export(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_articles(spark, sf)
    return rows.select(
        *[
            F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in S.LISTING_EXPORT.fields
        ]
    )


@query
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_export(spark, sf), path)
    return files.read_articles_csv(spark, path)


@query
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(_export(spark, sf), path)
    return files.read_records_json(spark, path)


@query
def experiment_export(spark, sf):
    path = scratch_path(spark, "experiment")
    rows = L.experiment(_rounds(spark, sf, "article_hash"), stem=False)
    sinks.write_json(rows.select(*S.EXPERIMENT.names), path)
    total = lambda m, f: _r(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x[m][f]))
    return files.read_experiment_json(spark, path).select(
        "article_hash",
        K.experiment_key(F.col("article_hash"), F.col("n_chunks")).alias("key"),
        "round",
        F.md5(F.array_join("chunks", "|")).alias("chunks_md5"),
        F.md5(F.array_join("summaries", "|")).alias("summaries_md5"),
        total("rouge1", "precision").alias("precision_1"),
        total("rouge1", "recall").alias("recall_1"),
        total("rougeL", "fmeasure").alias("fmeasure_l"),
    )


@query
def append_new_articles(spark, sf):
    """A table of old rows, then one append of the rows newer than its maximum."""
    path = scratch_path(spark, "append")
    rows = articles(spark, sf).select(
        "article_hash", "category", "source_entity", "publish_date", F.length("article_body").alias("n")
    )
    old = D.before(I.latest(rows, "publish_date"), 6)
    sinks.append_rows(rows.filter(F.col("publish_date") <= old), path)
    stored = spark.read.parquet(path)
    start = D.before(I.latest(rows, "publish_date"), 24)
    last = F.coalesce(I.latest(stored, "publish_date"), start)
    new = I.newer_than(rows, last, "publish_date")
    sinks.append_rows(new, path)
    return spark.read.parquet(path)


@query
def insert_if_absent(spark, sf):
    """Three runs into one table kept by key: new keys only, the first of equal keys wins.

    The last run, of an hour, meets the buckets of its few keys only.
    """
    path = scratch_path(spark, "insert")
    rows = arrivals(spark, sf).select("event_id", "ts", "entity", "category", "link", "article_hash")
    half, hour = D.before(I.latest(rows), 24 * 15), D.before(I.latest(rows), 1)
    for batch in (rows.filter(F.col("ts") < half), rows, rows.filter(F.col("ts") >= hour)):
        sinks.insert_if_absent(batch, path, "article_hash", ["entity", "event_id"], buckets=16)
    return spark.read.parquet(path).drop(sinks.BUCKET)


@query
def latest_articles_48h(spark, sf):
    rows = articles(spark, sf).select("article_hash", "category", "source_entity", "publish_date")
    return I.within_hours(rows, I.latest(rows, "publish_date")).drop("publish_date")


@query
def image_manifest(spark, sf):
    return sinks.image_manifest(_listing(spark, sf))


@query
def json_view_count(spark, sf):
    return _views(spark, sf)


@query
def ad_hoc_sql(spark, sf):
    return files.run_sql(
        spark,
        "SELECT category, source_entity, max(publish_date) AS last_date, count(*) AS n "
        "FROM {article} GROUP BY category, source_entity",
        article=articles(spark, sf),
    )


@query
def sql_functions(spark, sf):
    """Chunks, link keys and scores from SQL text alone.

    The roles are chosen below the join: Spark calls a Python table function before the
    filters behind it. Rows are dealt, for the costly work on each.
    """
    SQL.register(spark)
    return spark.sql(
        """
        SELECT doc_id, link_md5(concat_ws('/', source, doc_id), 16) AS link_key, link_sha256(concat_ws('/', source, doc_id)) AS link_sha,
               pos, length(chunk) AS n_chars, size(rouge_tokens(chunk)) AS n_tokens, CAST(NULL AS STRING) AS metric,
               CAST(NULL AS INT) AS hits, CAST(NULL AS DOUBLE) AS recall
        FROM {documents}, LATERAL chunk_rows(text)
        UNION ALL
        SELECT u.conv_id, link_md5(u.text), link_sha256(a.text), CAST(u.turn AS INT), length(a.text), r.n_sum, r.metric, r.hits, round(r.recall, 6)
        FROM (SELECT * FROM {conversations} WHERE role = 'user') u
             JOIN (SELECT * FROM {conversations} WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1,
             LATERAL rouge_rows(u.text, a.text) r
        """,
        documents=dealt(read_table(spark, sf, "documents").select("doc_id", "source", "text")),
        conversations=dealt(read_table(spark, sf, "conversations")),
    )


@query
def stored_pages(spark, sf):
    """The pages written as files of a folder, and read back from it at once and as a stream of two deliveries."""
    folder, table, log = (scratch_path(spark, f"stored-{x}") for x in ("pages", "stream", "log"))
    rows = read_table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), "html", "page_id")
    for odd in (0, 1):
        pages.write_pages(rows.filter(F.abs(F.col("page_id") % 2) == odd), folder)
        dedupe.append_stream(pages.stream_pages(spark, folder), table, log).awaitTermination()
    streamed = spark.read.parquet(table).withColumn("way", F.lit("stream"))
    both = pages.read_pages(spark, folder).withColumn("way", F.lit("batch")).unionByName(streamed)
    number = F.regexp_extract("name", r"^(-?\d+)\.html$", 1).cast("long")
    return both.select(number.alias("page_id"), "way", "size", F.md5("html").alias("html_md5"))


@query
def search_hits(spark, sf):
    anchor = r'<a href="([^"]*)">([^<]*)</a>'
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    links = F.regexp_extract_all("html", F.lit(anchor), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit(anchor), F.lit(2))
    # Some hits are hours old and some days, by their address.
    unit = lambda link: F.when(F.substring(F.md5(link), 1, 1) < "8", " horas").otherwise(" días")
    age = lambda x, i: F.concat(F.lit("hace "), i + 1, unit(x["link"]))
    hits = F.transform(
        F.arrays_zip(links.alias("link"), titles.alias("title")),
        lambda x, i: F.struct(
            x["title"].alias("title"), F.concat(host, x["link"]).alias("link"), age(x, i).alias("date")
        ),
    )
    payloads = read_table(spark, sf, "pages").select(
        "page_id", F.to_json(F.struct(hits.alias("news_results"))).alias("payload")
    )
    return G.search_hits(files.search_results(payloads))


# -- listing and bodies ---------------------------------------------------


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """Navigation links of the pages as listing cards, the head card without a date."""
    pages = read_table(spark, sf, "pages")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr(
        "page_id * INTERVAL '1' HOUR + pos * INTERVAL '1' MINUTE"
    )
    cards = G.listing_cards(pages, G.SITE_RULES["nav"])
    cards = cards.withColumn("date", F.when(F.col("pos") > 0, D.spanish_text(at)).otherwise(""))
    cards = cards.withColumn("image", F.concat(F.lit('url("'), "link", F.lit('.png")')))
    targets = pages.select(
        "url",
        F.regexp_extract("url", r"^https?://[^/]+/([^/]+)/", 1).alias("category"),
        F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("entity"),
    ).distinct()
    return G.with_target(G.normalise_listing(cards), targets)


@query
def listing_articles(spark, sf):
    return _listing(spark, sf).select(
        "page_id", "pos", "title", "link", "image", "publish_date", "bad_date", "hash_id",
        "category", "entity", F.md5("raw_content").alias("raw_md5"),
    )


#: A link of a page's navigation as a card of each site; $1 is the address, $2 the title, DATE the date.
_SITE_CARDS = {
    "biobiochile": (
        """<article><a href="$1"><div class="article-image" style="background-image: url('$1.png'); x"></div></a>"""
        """<div class="article-date-hour">DATE</div><a href="$1"><h2 class="x article-title">$2</h2></a></article>"""
    ),
    "latercera": """<article><h3 class="t"><a href="$1">$2</a></h3><div class="time">DATE</div><img src="$1.png"></article>""",
    "24horas": """<article class="col xs-12 xsm-12 x"><a href="$1"><img src="$1.png"><h2>$2</h2></a></article>""",
}


@query
def site_listings(spark, sf):
    """The pages rewritten in the markup of each site, and read by its rule."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("page_id * INTERVAL '1' HOUR")
    item = F.lit(r'(?s)<li><a href="([^"]*)">(.*?)</a></li>')
    lists = []
    for site, card in _SITE_CARDS.items():
        html = F.regexp_replace("html", item, F.replace(F.lit(card), F.lit("DATE"), D.spanish_text(at)))
        pages = read_table(spark, sf, "pages").select("page_id", html.alias("html"))
        cards = G.normalise_listing(G.listing_cards(pages, G.SITE_RULES[site]))
        lists.append(cards.select(F.lit(site).alias("site"), "page_id", "pos", "title", "link", "image", "publish_date", "bad_date", "hash_id"))
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query
def page_extract(spark, sf):
    parts = G.page_parts(read_table(spark, sf, "pages"))
    return parts.select(
        "page_id",
        "title",
        F.array_join("parts", " ").alias("article_body"),
        F.md5("raw_content").alias("raw_md5"),
    )


@query
def assemble_body(spark, sf):
    parts = G.page_parts(read_table(spark, sf, "pages"))
    return G.assemble_body(pos_exploded(parts, ["page_id"], F.col("parts"), "pos", "text"), "page_id")


@query
def template_route(spark, sf):
    link = F.replace(F.replace(F.col("url"), F.lit("/en/"), F.lit("/especial/")), F.lit("/fr/"),
                     F.lit("/especial/aqui-tierra/"))
    return read_table(spark, sf, "pages").select("page_id", G.template_route(link).alias("route"))


@query
def template_bodies(spark, sf):
    """The pages in the three article templates, read by the tag walker."""
    url = F.col("url")
    number = F.col("page_id").cast("string")
    pick = lambda a, b, c: (
        F.when(F.contains(url, F.lit("://www.")), a).when(F.contains(url, F.lit("://m.")), b).otherwise(c)
    )
    root = pick(F.lit("nota-y-mas-leidos"), F.lit("nota"), F.lit("post"))
    box = pick(*[F.lit("banners-contenido-nota")] * 2, F.concat(F.lit("banners-contenido-nota-"), number))
    head = pick(F.lit("extracto-nota"), F.lit("extracto-nota"), F.lit("post-excerpt"))
    open_tag = F.concat(
        F.lit('<div class="x '), root, F.lit('" id="post-'), number, F.lit('"><div class="'), box, F.lit('">')
    )
    html = F.replace(F.col("html"), F.lit("<article>"), open_tag)
    html = F.replace(html, F.lit("</article>"), F.lit("</div></div>"))
    html = F.replace(html, F.lit("<h1>"), F.concat(F.lit('<h1 class="'), head, F.lit('">')))
    link = F.concat(pick(F.lit("/aqui-tierra/"), F.lit("/especial/"), F.lit("/noticias/")), F.col("url"))
    pages = read_table(spark, sf, "pages").select(
        F.md5("url").alias("article_hash"), link.alias("article_link"), html.alias("html")
    )
    return G.template_bodies(pages).select("article_hash", "article_body")


@query
def target_pages(spark, sf):
    targets = read_table(spark, sf, "documents").select(
        F.col("source").alias("entity"),
        F.col("lang").alias("category"),
        F.concat_ws("/", F.lit("https:/"), "source", F.lit("lista"), "lang", F.lit("")).alias("url"),
    )
    return G.target_pages(targets.distinct()).select("entity", "category", "page", "page_url")


def _with_body(rows: DataFrame) -> DataFrame:
    """The articles whose body is taken as read: all but every seventh id."""
    return rows.filter("doc_id % 7 <> 0")


@query
def left_merge_bodies(spark, sf):
    rows = articles(spark, sf)
    bodies = _with_body(rows).select("article_hash", F.length("article_body").alias("body_chars"))
    listing = rows.select("doc_id", "article_hash", "article_title", "category")
    return G.left_merge(listing, bodies)


def _views(spark: SparkSession, sf: str) -> DataFrame:
    """Counter payloads made of the event properties, read back."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    payload = F.to_json(
        F.array(F.struct(F.col("event_id").alias("NotaId"), F.col("event_type").alias("Titulo"), k.alias("Visitas")))
    )
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("note_id"), files.view_count(payload).alias("view_count")
    )


@query
def complete_articles(spark, sf):
    pages = G.page_parts(read_table(spark, sf, "pages"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("page_id * INTERVAL '1' HOUR")
    page_date = D.spanish_date(D.spanish_text(at))
    day_later = D.spanish_text(at + F.expr("INTERVAL '1' DAY"))
    listed = F.when(F.contains(F.col("url"), F.lit("#")), "").otherwise(day_later)
    listing = read_table(spark, sf, "pages").select(
        K.link_md5(F.col("url")).alias("hash_id"), "url", D.spanish_date(listed).alias("publish_date")
    )
    bodies = pages.select(
        K.link_md5(F.col("url")).alias("hash_id"),
        F.array_join("parts", " ").alias("article_body"),
        page_date.alias("page_date"),
        F.col("page_id").alias("note_id"),
    )
    return G.complete_articles(listing, bodies, _views(spark, sf)).select(
        "hash_id", "url", "publish_date", F.md5("article_body").alias("body_md5"), "view_count"
    )


@query
def union_lists(spark, sf):
    """The articles as one list for each language there is, and one for those without."""
    return I.numbered_lists(articles(spark, sf).select("article_hash", "category", "doc_id"), "category")


# -- incremental ----------------------------------------------------------


def _stored(rows: DataFrame) -> DataFrame:
    """Arrivals stored so far: each category is a few hours further behind."""
    lag = F.expr("(6 + 12 * category) * INTERVAL '1' HOUR")
    return rows.filter(F.col("ts") < I.latest(rows) - lag)


@query
def last_date_per_target(spark, sf):
    rows = arrivals(spark, sf).select("entity", "category", "ts")
    targets = rows.select("entity", "category").distinct()
    return I.cut_dates(targets, _stored(rows), I.latest(rows), date="ts")


@query
def take_while_newer(spark, sf):
    rows = arrivals(spark, sf).select("entity", "category", "event_id", "ts")
    targets = rows.select("entity", "category").distinct()
    cuts = I.cut_dates(targets, _stored(rows), I.latest(rows), date="ts", floor="prev_midnight")
    newest_first = rows.withColumn("pos", -F.col("event_id"))
    return I.take_while_newer(
        newest_first, cuts.select("entity", "category", "cut_date"), ["entity", "category"], "pos"
    ).drop("pos")


@query
def incremental_since(spark, sf):
    rows = arrivals(spark, sf).select("event_id", "article_hash", "ts")
    stored = rows.filter(F.col("ts") <= D.before(I.latest(rows), 10))
    return I.since_last_run(rows, stored, I.latest(rows))


@query
def unseen_articles(spark, sf):
    rows = arrivals(spark, sf).select("event_id", "article_hash", "ts")
    as_of = I.latest(rows)
    seen = I.within_hours(rows.filter(F.col("ts") < D.before(as_of, 24)), as_of, 48, "ts")
    new = rows.filter(F.col("ts") >= D.before(as_of, 24))
    return I.unseen(new, seen)


@query
def batch_low_date(spark, sf):
    rows = arrivals(spark, sf)
    k = F.get_json_object("props", "$.k").cast("bigint")
    dated = rows.select("entity", "category", "event_id", F.when(k >= 25, F.col("ts")).alias("ts"))
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return I.lowest_dates(dated, ["entity", "category"], "event_id", as_of)


@query
def recapture_candidates(spark, sf):
    rows = articles(spark, sf)
    captured = rows.select(
        "article_hash",
        F.when(F.col("doc_id") % 7 != 0, F.col("article_body")).alias("article_body"),
        F.col("publish_date").alias("capture_date"),
    )
    as_of = I.latest(rows, "publish_date") + F.expr("INTERVAL '60' HOUR")
    return I.recapture_due(captured, as_of).select("article_hash", "capture_date")


@query
def stream_dedupe(spark, sf):
    """Everything that has arrived, through micro-batches that skip stored keys."""
    stream = _event_stream(spark, sf)
    table = scratch_path(spark, "stream")
    rows = _stream_keys(stream)
    job = dedupe.load_new(rows, table, scratch_path(spark, "stream-log"), ["ts", "event_id"])
    job.awaitTermination()
    return spark.read.parquet(table)


@query
def stream_watermark_dedupe(spark, sf):
    """One micro-batch through the 48-hour key state."""
    stream = _event_stream(spark, sf)
    table = scratch_path(spark, "watermark")
    rows = dedupe.drop_seen(_stream_keys(stream), "ts")
    job = dedupe.append_stream(
        rows.select("article_hash", "entity", "category"), table, scratch_path(spark, "watermark-log")
    )
    job.awaitTermination()
    return spark.read.parquet(table)


@query
def stream_return_after_window(spark, sf):
    """The arrivals in five deliveries, a restart of the job for each; keys come back after 48 hours.

    A delivery is all files that came since the last one. The fourth run finds
    nothing new, and adds nothing.
    """
    rows = _stream_keys(read_table(spark, sf, "events"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    low, high = (micros(rows.agg(f("ts")).scalar()) for f in (F.min, F.max))
    share = (micros(F.col("ts")) - low) / F.greatest(F.lit(1), high - low)
    inbox, table, log = (scratch_path(spark, f"return-{x}") for x in ("in", "out", "log"))
    rows.withColumn("slice", F.least(F.lit(4), F.floor(share * 5))).write.partitionBy("slice").parquet(inbox)
    schema, jobs = rows.schema, dedupe.with_state_store(spark)
    for n in (0, 1, 2, 2, 3, 4):
        # Only the folders delivered so far are read.
        stream = dedupe.read_arrivals(jobs, f"{inbox}/slice=[0-{n}]", schema)
        passed = dedupe.after_absence(stream, "ts", ["event_id"])
        dedupe.append_stream(passed, table, log).awaitTermination()
    return spark.read.schema(schema).parquet(table)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, because a plain streaming path has to be a folder.
    path = f"{sf.rstrip('/')}/events.parque[t]"
    return dedupe.read_arrivals(spark, path, read_table(spark, sf, "events").schema)


def _stream_keys(stream: DataFrame) -> DataFrame:
    link = F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type"))
    return stream.select(
        "event_id",
        "ts",
        F.col("event_type").alias("entity"),
        (F.col("user_id") % 5).alias("category"),
        K.link_md5(link).alias("article_hash"),
    )


def _page_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as listing rows, twice: the second list repeats the first under other titles."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("page_id * INTERVAL '1' HOUR")
    return read_table(spark, sf, "pages").select(
        F.col("page_id").alias("pos"),
        H.unescape(H.first_element(F.col("html"), "h1")).alias("title"),
        F.col("url").alias("link"),
        F.when(~F.contains(F.col("url"), F.lit("#")), at).alias("publish_date"),
        K.link_md5(F.col("url")).alias("hash_id"),
        F.regexp_extract("url", r"^https?://[^/]+/([^/]+)/", 1).alias("category"),
        F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("entity"),
    )


@query
def load_by_key(spark, sf):
    """Two overlapping lists into a table that holds all but the last days."""
    listing = _page_listing(spark, sf)
    last = D.before(I.latest(listing, "publish_date"), 24 * 5)
    stored = listing.filter(F.col("publish_date") < last).select(F.col("hash_id").alias("article_hash"))
    again = listing.withColumn("title", F.lower("title"))
    first = listing.filter("category = 'en'")
    pages = G.page_parts(read_table(spark, sf, "pages"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("page_id * INTERVAL '1' HOUR")
    bodies = pages.select(
        K.link_md5(F.col("url")).alias("hash_id"),
        F.array_join("parts", " ").alias("article_body"),
        at.alias("page_date"),
        F.col("page_id").alias("note_id"),
    )
    rows = B.load_by_key([first, again], stored, bodies, _views(spark, sf))
    path = scratch_path(spark, "load-by-key")
    sinks.append_rows(rows, path)
    return spark.read.parquet(path).drop("raw_content", "negative_score", "importance_score")


@query
def load_by_date(spark, sf):
    """Listings newest first, down to the stored rows, with the bodies that could be read."""
    rows = articles(spark, sf)
    as_of = I.latest(rows, "publish_date")
    listing = rows.withColumn("pos", -F.col("doc_id")).drop("article_body", "doc_id")
    stored = rows.filter(F.col("publish_date") <= D.before(as_of, 2)).select(
        "source_entity", "category", "publish_date"
    )
    bodies = _with_body(rows).select("article_hash", "article_body")
    path = scratch_path(spark, "load-by-date")
    sinks.append_rows(B.load_by_date(listing, stored, bodies, as_of), path)
    return spark.read.parquet(path).select(
        "article_hash", "article_title", "category", "publish_date", "source_entity", "article_link",
        F.md5("article_body").alias("body_md5"),
    )


# -- profiles -------------------------------------------------------------


@query
def drop_null_body(spark, sf):
    rows = articles(spark, sf)
    known = F.col("doc_id") % 7 != 0
    body = F.when(known, F.col("article_body")).alias("article_body")
    return P.drop_null_body(rows.select("doc_id", body)).select(
        "doc_id", F.length("article_body").alias("n")
    )


@query
def outlier_filter(spark, sf):
    return P.usual_length(articles(spark, sf)).select("doc_id", F.length("article_body").alias("n"))


@query
def length_bands(spark, sf):
    return P.length_bands(articles(spark, sf).select("article_link", "article_body")).select(
        "article_link", "low", "high", F.md5("article_body").alias("body_md5")
    )


@query
def length_profile(spark, sf):
    return P.length_profile(articles(spark, sf), {"title": "article_title", "body": "article_body"})


@query
def length_describe(spark, sf):
    rows = P.describe(articles(spark, sf), F.length("article_body"))
    return _rounded(rows, ["mean", "std"])


@query
def outlier_counts(spark, sf):
    return P.outlier_counts(articles(spark, sf))


@query
def date_span(spark, sf):
    return P.date_span(articles(spark, sf))


@query
def column_profile(spark, sf):
    return P.column_profile(scored_articles(spark, sf))


@query
def frame_shape(spark, sf):
    return P.frame_shape(articles(spark, sf))


@query
def length_curve(spark, sf):
    return P.sorted_curve(articles(spark, sf), F.length("article_body"))


@query
def part_length_curve(spark, sf):
    """Sorted mean part lengths, in hundredths."""
    mean = F.round(X.mean_part_length(F.col("article_body")) * 100).cast("bigint")
    return P.sorted_curve(articles(spark, sf).select("article_body"), mean)


@query
def avg_sentence_len(spark, sf):
    rows = articles(spark, sf).select("doc_id", "article_body")
    return rows.select("doc_id", _r(X.mean_part_length(F.col("article_body"))).alias("mean_len"))


@query
def sample_n(spark, sf):
    return P.sample_rows(articles(spark, sf).select("doc_id", "category"), "doc_id", 100, seed=7)


@query
def sample_tenth(spark, sf):
    """A tenth of the table, however large that is."""
    rows = articles(spark, sf).select("doc_id", "category")
    return P.sample_rows(rows, "doc_id", rows.count() // 10, seed=11)


@query
def head_rows(spark, sf):
    return P.head(articles(spark, sf).select("doc_id", "article_title", "publish_date"), ["doc_id"])


@query
def driver_rows(spark, sf):
    """The first rows, taken to the driver as records and made a frame again; odd ones lack their title."""
    first = P.head(articles(spark, sf).select("doc_id", "article_title", "publish_date"), ["doc_id"])
    records = [r.asDict() for r in first.collect()]
    for record in records:
        if record["doc_id"] % 2:
            del record["article_title"]
    return files.rows_with_schema(spark, records, first.schema)


# -- chunks ---------------------------------------------------------------


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles(spark, sf).select("doc_id", "article_body")
    return rows.select("doc_id", "article_body", X.sentences(F.col("article_body")).alias("parts"))


@query
def sentences(spark, sf):
    rows = articles(spark, sf).select("doc_id", "article_body")
    return pos_exploded(rows, ["doc_id"], X.sentences(F.col("article_body")), "pos", "part")


@query
def chunk_greedy(spark, sf):
    chunks = X.close_chunks(X.greedy_chunks(F.col("parts")))
    return pos_exploded(_parts(spark, sf), ["doc_id"], chunks, "pos", "chunk")


@query
def chunk_fixed(spark, sf):
    rows = articles(spark, sf).select("doc_id", "article_body")
    body = F.col("article_body")
    chunks = X.fixed_chunks(X.sentences(body), X.group_size(body))
    return pos_exploded(rows, ["doc_id"], chunks, "pos", "chunk")


@query
def pair_merge(spark, sf):
    pairs = X.pair_chunks(X.greedy_chunks(F.col("parts")))
    return pos_exploded(_parts(spark, sf), ["doc_id"], pairs, "pos", "chunk")


@query
def chunk_stats(spark, sf):
    return P.chunk_stats(articles(spark, sf).select("doc_id", "article_body"))


# -- summaries and rounds -------------------------------------------------


def _rounds(spark: SparkSession, sf: str, key: str = "doc_id") -> DataFrame:
    return L.rechunk_rounds(articles(spark, sf), [key])


def _means(spark: SparkSession, sf: str, metrics: tuple[str, ...] = ("rouge1", "rougeL")) -> DataFrame:
    scored = L.score_rounds(L.one_row_per_round(_rounds(spark, sf)), stem=False, metrics=metrics)
    return E.score_means(scored.select("doc_id", "round", "n_chunks", "scores"), metrics=metrics)


@query
def rechunk_rounds(spark, sf):
    return L.one_row_per_round(_rounds(spark, sf)).select(
        "doc_id",
        "round",
        "n_chunks",
        F.length(F.array_join("chunks", "")).alias("n_chars"),
        F.md5(F.array_join("summaries", "|")).alias("summaries_md5"),
    )


@query
def summarize_extractive(spark, sf):
    both_ways = X.let(
        X.greedy_chunks(F.col("parts")),
        lambda chunks: F.arrays_zip(
            M.summarise_chunks(chunks, "central").alias("central"), M.summarise_chunks(chunks, "lead").alias("lead")
        ),
    )
    both = pos_exploded(_parts(spark, sf), ["doc_id"], both_ways, "pos", "s")
    return both.select("doc_id", "pos", "s.central", "s.lead")


def _first_characters(n: int):
    """A stand-in model: the first characters of each text."""
    return lambda: lambda texts: [t[:n] for t in texts]


@query
def summarize_model(spark, sf):
    """Summaries of all chunks by a model that is loaded in the tasks."""
    rows = _parts(spark, sf).select("doc_id", X.greedy_chunks(F.col("parts")).alias("chunks"))
    # The chunks stay a column of their own: Spark takes no Python function over a lambda.
    # And the summaries become a table, so that no later step calls the model again.
    summaries = rows.withColumn("summaries", M.model_summaries(F.col("chunks"), _first_characters(60)))
    return pos_exploded(written(summaries, "model-summaries"), ["doc_id"], F.col("summaries"), "pos", "summary")


@query
def rechunk_model(spark, sf):
    """The loop of chunks and summaries with a model, a job for each round."""
    rows = L.rechunk_with_model(articles(spark, sf), ["doc_id"], _first_characters(200))
    joined = lambda c: F.md5(F.array_join(c, "|")).alias(f"{c}_md5")
    return rows.select("doc_id", "round", "n_chunks", joined("chunks"), joined("summaries"), "finished")


@query
def summary_constraints(spark, sf):
    last = F.try_element_at("rounds", F.lit(-1))["summaries"]
    rows = L.rechunk_rounds(articles(spark, sf), ["doc_id", "article_title"])
    # A table, so that neither the filter nor the counts compute the rounds again.
    rows = written(rows.select("doc_id", "article_title", F.array_join(last, "\n").alias("points")), "last-summaries")
    text = F.concat("article_title", F.lit("\n"), "points").alias("summary")
    # An article without sentences has no rounds, and no summary to check.
    return M.summary_checks(rows.select("doc_id", text).filter("summary is not null")).drop("summary")


@query
def bullets(spark, sf):
    """Of all turns and of all documents; a document is no turn."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), "text")
    return pos_exploded(turns.unionByName(docs), ["conv_id", "turn"], X.bullets(F.col("text")), "pos", "bullet")


@query
def rouge1(spark, sf):
    rows = E.rouge1(chunk_pairs(spark, sf), ["conv_id", "turn"], "reference", "summary")
    return _rounded(rows, ["precision", "recall", "fmeasure"])


@query
def rougeL(spark, sf):
    score = rouge_score(F.col("reference"), F.col("summary"), stem=False)
    rows = chunk_pairs(spark, sf).select("conv_id", "turn", score["rougeL"].alias("m"))
    return rows.select(
        "conv_id", "turn", *[F.round(F.col("m")[f], 5).alias(f) for f in S.METRIC.names]
    )


@query
def rouge_stemmed(spark, sf):
    """The chunk-wise report with stemming, as the scores are usually read."""
    scored = L.score_rounds(L.one_row_per_round(_rounds(spark, sf)))
    return E.score_report(scored, ["doc_id", "round"])


@query
def rouge_means(spark, sf):
    return _rounded(_means(spark, sf), [name for name, _, _ in E.MEANS])


@query
def rouge_by_chunks(spark, sf):
    return _rounded(E.means_by_chunks(_means(spark, sf)), [name for name, _, _ in E.MEANS])


@query
def rouge_frame(spark, sf):
    """The scores of each article and number of chunks."""
    # A table, because the sort looks at its rows once for the ranges and once for the rows.
    means = written(_means(spark, sf), "rouge-means")
    return _rounded(E.metric_frame(means), [name for name, _, _ in E.MEANS])


@query
def metrics_csv(spark, sf):
    """The scores by number of chunks, written as the metrics file and read back."""
    path = scratch_path(spark, "metrics")
    rows = E.means_by_chunks(_means(spark, sf))
    sinks.write_metrics_csv(rows, path)
    return _rounded(files.read_metrics_csv(spark, path), [name for name, _, _ in E.MEANS])


@query
def rouge_gap(spark, sf):
    rows = E.score_gap(_means(spark, sf))
    return rows.select("doc_id", "round", "n_chunks", _r("gap").alias("gap"))


@query
def rouge_round_delta(spark, sf):
    rows = _rounded(L.round_changes(_means(spark, sf, ("rouge1",)), ["doc_id"]), ["value", "change"])
    return rows.withColumn("change", F.col("change") + 0.0)  # no negative zero


# -- words ----------------------------------------------------------------


@query
def rare_words(spark, sf):
    return W.rare_words(articles(spark, sf), ["doc_id"], "article_body", dictionary(spark, sf))


def _pair_repairs(spark: SparkSession, sf: str, function) -> DataFrame:
    return function(
        chunk_pairs(spark, sf), ["conv_id", "turn"], "reference", "summary", dictionary(spark, sf)
    )


@query
def nearest_word(spark, sf):
    rows = _pair_repairs(spark, sf, W.word_repairs)
    return pos_exploded(rows, ["conv_id", "turn"], F.col("repairs"), "pos", "r").select(
        "conv_id", "turn", "pos", "r.word", "r.nearest"
    )


@query
def repair_summaries(spark, sf):
    return _pair_repairs(spark, sf, W.repair_summaries).select("conv_id", "turn", "repaired")


@query
def special_cases(spark, sf):
    body = F.replace(F.col("article_body"), F.lit(" the "), F.lit(" Bío "))
    body = F.replace(body, F.lit(" of "), F.lit(" Radio Bío "))
    return articles(spark, sf).select(
        "doc_id", F.length(X.place_names(body)).alias("n"), F.md5(X.place_names(body)).alias("text_md5")
    )


@query
def remove_stopwords(spark, sf):
    rows = articles(spark, sf).select("doc_id", "article_body")
    kept = X.drop_stop_words(F.col("article_body"), W.spanish_stop_words())
    return rows.select("doc_id", kept.alias("kept")).select(
        "doc_id", F.length("kept").alias("n"), F.md5("kept").alias("kept_md5")
    )


@query
def sentiment_softmax(spark, sf):
    odd = F.length("word") % 2
    lexicon = dictionary(spark, sf).select(
        "word", (odd / 8.0).alias("negative"), ((1 - odd) / 8.0).alias("positive")
    )
    logits = W.lexicon_logits(articles(spark, sf), ["doc_id"], "article_body", lexicon)
    return _rounded(W.sentiment(logits), ["negative", "positive"])


# -- quality and ranking --------------------------------------------------


@query
def key_violations(spark, sf):
    return Q.key_violations(arrivals(spark, sf), "article_hash")


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "labels").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("image_hash"))


@query
def fk_orphans(spark, sf):
    return Q.orphans(_images(spark, sf), _with_body(articles(spark, sf)), "doc_id")


@query
def fk_valid(spark, sf):
    return Q.with_parent(_images(spark, sf), _with_body(articles(spark, sf)), "doc_id")


@query
def negativity_filter(spark, sf):
    return R.below_negativity(scored_articles(spark, sf)).select("article_hash", "negative_score")


@query
def importance_topk(spark, sf):
    rows = scored_articles(spark, sf).select("doc_id", "category", "importance_score")
    return R.top_by_importance(rows, 10, "doc_id")


@query
def digest(spark, sf):
    langs = F.array(*[F.lit(x) for x in ("en", "es", "fr", "de")])
    readers = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("reader"),
        F.element_at(langs, (F.col("c_nationkey") % 4 + 1).cast("int")).alias("category"),
    )
    rows = scored_articles(spark, sf).select(
        "article_hash", "category", "publish_date", "negative_score", "importance_score"
    )
    return R.digest(rows, readers, I.latest(rows, "publish_date")).select(
        "reader", "category", "rank", "article_hash"
    )


# -- scalar functions -----------------------------------------------------


@query
def scalar_hash(spark, sf):
    link = document_link(F.col("source"), F.col("doc_id"))
    return read_table(spark, sf, "documents").select(
        "doc_id",
        K.link_sha256(link).alias("sha"),
        K.link_md5(link).alias("md5"),
        K.link_md5(link, 16).alias("md5_16"),
    )


@query
def scalar_text(spark, sf):
    text = F.col("text")
    return read_table(spark, sf, "documents").select(
        "doc_id",
        F.size(F.split("text", "\\.")).alias("n_stops"),
        F.element_at(F.split("text", " "), -1).alias("last_word"),
        F.replace(F.concat_ws(" | ", "lang", "source"), F.lit(" | "), F.lit(" ")).alias("joined"),
        F.length(X.strip(text)).alias("n_stripped"),
        F.md5(X.letters_only(text)).alias("letters_md5"),
        H.css_url(F.concat(F.lit("url('"), "source", F.lit("')"))).alias("image"),
        F.md5(F.lower(text)).alias("lower_md5"),
        F.length(text).alias("n"),
        F.contains(text, F.lit(" de ")).alias("has_de"),
        F.md5(F.substring(text, 513, 512)).alias("slice_md5"),
        F.md5(X.summary_prompt(F.col("source"), text)).alias("prompt_md5"),
        F.levenshtein("lang", "source").alias("distance"),
        K.object_key(F.col("lang")).alias("object_key"),
    )


@query
def scalar_math(spark, sf):
    n = F.col("n_chars")
    p = N.softmax_pair(n / 1000.0, F.col("doc_id") % 7)
    return read_table(spark, sf, "documents").select(
        "doc_id",
        F.ceil(n / 390 - 0.5).alias("groups"),
        F.floor(n / 390).alias("whole"),
        F.round(n / 390.0, 2).alias("wanted"),
        _r(p["negative"], 5).alias("negative"),
        _r(p["positive"], 5).alias("positive"),
        N.falsy_to_null(n % 5).alias("nonzero"),
    )


@query
def scalar_date(spark, sf):
    ts = F.col("ts")
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    as_of = I.latest(read_table(spark, sf, "events"))
    return read_table(spark, sf, "events").select(
        "event_id",
        D.spanish_date(D.spanish_text(ts)).alias("spanish"),
        D.free_date(F.concat(text, F.lit("-03:00"))).alias("zoneless"),
        D.free_date(F.date_format(ts, "dd/MM/yyyy HH:mm")).alias("slashes"),
        D.iso_or_null(ts).alias("iso"),
        _r(D.days_between(as_of, ts)).alias("days"),
        D.lookback_floor(ts).alias("floor_rolling"),
        D.lookback_floor(ts, "prev_midnight").alias("floor_midnight"),
        D.before(ts, 3).alias("three_hours"),
        D.strictly_after(as_of, ts).alias("is_older"),
    )


def _date_texts(ts: Column, n: Column) -> Column:
    """A moment in the forms that pages show, by the number of the row."""
    text = lambda form: F.date_format(ts, form)
    month = F.element_at(F.array(*[F.lit(m) for m in D.SPANISH_MONTHS]), F.month(ts))
    k = (n % 30 + 2).cast("string")
    forms = [
        F.concat(F.lit("hace "), k, F.lit(" horas")),
        F.lit("hace un día"),
        F.lit("Ayer"),
        F.lit("anteayer a las 07:05"),
        F.concat(k, F.lit(" minutes ago")),
        F.concat(F.lit("Hace "), k, F.lit(" meses")),
        F.concat(text("d"), F.lit(" de "), month, F.lit(" de "), text("yyyy")),
        F.concat(text("MMMM"), F.lit(" "), text("d"), F.lit(", "), text("yyyy")),
        F.concat(text("dd"), F.lit(" "), F.substring(month, 1, 3), F.lit(". "), text("yyyy HH:mm")),
        F.lit("yesterday at 18:30"),
        F.lit("sin fecha"),
        F.lit("hoy"),
        F.concat(F.lit("hace "), k, F.lit(" semanas")),
        F.concat(text("MMM"), F.lit(" "), text("d"), F.lit(", "), text("yyyy, HH:mm")),
        D.spanish_text(ts),
        text("yyyy-MM-dd HH:mm:ss"),
    ]
    return F.element_at(F.array(*forms), (n % len(forms) + 1).cast("int"))


@query
def free_dates(spark, sf):
    """Named, relative and numeric dates, read against the moment of their capture."""
    rows = read_table(spark, sf, "events").select("event_id", "ts", _date_texts(F.col("ts"), F.col("event_id")).alias("text"))
    return rows.select("event_id", "text", D.free_date(F.col("text"), F.col("ts")).alias("moment"))


@query
def scalar_nested(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    upto = F.sequence(F.lit(0), k % 6)
    pairs = F.map_from_entries(F.array(F.struct(F.col("event_type"), k)))
    return read_table(spark, sf, "events").select(
        "event_id",
        k.alias("k"),
        F.array_join(upto.cast("array<string>"), "-").alias("range"),
        F.size(F.concat(upto, F.array(k))).alias("appended"),
        F.element_at(upto, -1).alias("last"),
        F.size(F.filter(upto, lambda x: x % 2 == 0)).alias("even"),
        F.aggregate(F.transform(upto, lambda x: x * x), F.lit(0), lambda a, x: a + x).alias("squares"),
        F.element_at(pairs, F.col("event_type")).alias("lookup"),
    )


__all__ = ["QUERIES"]
