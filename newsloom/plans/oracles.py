"""The same results as plain SQL for DuckDB, over the whole tables."""

from __future__ import annotations

from functools import cache

from newsloom.functions import text as X
from newsloom.functions.html import ENTITIES, NOISE
from newsloom.operators.words import spanish_stop_words


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chars(text: str) -> str:
    """A text with control characters, as a SQL expression."""
    return " || ".join(
        _q(run) if run.isprintable() else f"chr({ord(run)})" for run in text
    )


WS = "(" + _chars(X.WHITESPACE) + ")"
NOT_LETTERS = r"'[^a-zA-ZáéíóúÁÉÍÓÚñÑ\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"

ARTICLES = """articles AS (
  SELECT doc_id, sha256(source || '/' || doc_id) AS article_hash,
         string_split(text, chr(10))[1] AS article_title, lang AS category,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS publish_date,
         text AS article_body, source AS source_entity, source || '/' || doc_id AS article_link
  FROM documents)"""

SCORED = ARTICLES + """, scored AS (
  SELECT a.*, CAST(l.toxic AS DOUBLE) AS negative_score, CAST(l.quality AS DOUBLE) AS importance_score
  FROM articles a LEFT JOIN labels l USING (doc_id))"""

ARRIVALS = """arrivals AS (
  SELECT event_id, ts, event_type AS entity, user_id % 5 AS category,
         user_id || '/' || event_type AS link, md5(user_id || '/' || event_type) AS article_hash,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events), top AS (SELECT max(ts) AS as_of FROM events),
  stored AS (SELECT * FROM arrivals, top WHERE ts < as_of - to_hours(6 + 12 * category))"""

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS reference, a.text AS summary
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sentences(x: str) -> str:
    return f"list_filter(string_split({x}, '.'), lambda p: length(p) > 0)"


def letters(x: str) -> str:
    return f"regexp_replace({x}, {NOT_LETTERS}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '\\s+'), lambda w: length(w) > 0)"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 0)"


def unescape(x: str) -> str:
    for entity, character in ENTITIES:
        x = f"regexp_replace({x}, {_q(entity + ';?')}, {_q(character)}, 'g')"
    return x


def inner_text(x: str) -> str:
    return unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def greedy(parts: str, size: int = X.CHUNK_CHARS) -> str:
    """Fold over the stripped parts; the result is a struct, see `closed`."""
    return f"""list_reduce(list_transform({parts}, lambda p: {strip('p')}),
      lambda a, t: CASE WHEN length(a.acc) + length(t) >= {size}
        THEN {{'res': list_append(a.res, a.acc), 'acc': t, 'n': 1}}
        ELSE {{'res': a.res, 'acc': CASE WHEN a.n = 0 THEN t ELSE a.acc || '. ' || t END, 'n': 1}} END,
      {{'res': []::VARCHAR[], 'acc': '', 'n': 0}})"""


def closed(state: str) -> str:
    return f"CASE WHEN {state}.n > 0 THEN list_append({state}.res, {state}.acc) ELSE {state}.res END"


def candidates(chunk: str) -> str:
    return f"list_filter(list_transform(string_split({chunk}, '.'), lambda s: {strip('s')}), lambda s: length(s) > 0)"


def lead(chunk: str) -> str:
    return f"coalesce({candidates(chunk)}[1], '')"


def central(chunk: str) -> str:
    """Struct-free: the first sentence with the highest mean word count."""
    options = candidates(chunk)
    bag = tokens(f"array_to_string({options}, ' ')")
    mean = f"""coalesce(list_sum(list_transform({tokens('s')},
        lambda w: len(list_filter(b.bag, lambda z: z = w))))::DOUBLE / nullif(len({tokens('s')}), 0), 0)"""
    several = f"""coalesce(list_transform([{{'bag': {bag}, 'opts': {options}}}], lambda b:
      list_transform([list_transform(b.opts, lambda s: {mean})], lambda m:
        b.opts[list_position(m, list_max(m))])[1])[1], '')"""
    # The only sentence of a chunk needs no counts, however long it is.
    return f"CASE WHEN len({options}) > 1 THEN {several} ELSE coalesce({options}[1], '') END"


def rounds_sql(key: str = "doc_id") -> str:
    """`rounds`: every round of every article with the central summary."""
    summ = f"list_transform(chunks, lambda c: {central('c')})"
    return f"""{ARTICLES},
  base AS (SELECT {key}, {greedy(sentences('article_body'))} AS g FROM articles),
  first_round AS (SELECT {key}, 1 AS round, {closed('g')} AS chunks FROM base),
  rounds AS (
    SELECT {key}, round, chunks, summaries, {closed('g')} AS nxt
    FROM (SELECT *, {greedy('summaries')} AS g
          FROM (SELECT *, {summ} AS summaries FROM first_round WHERE len(chunks) > 0))
    UNION ALL
    SELECT {key}, round, chunks, summaries, {closed('g')} AS nxt
    FROM (SELECT *, {greedy('summaries')} AS g
          FROM (SELECT *, {summ} AS summaries
                FROM (SELECT {key}, round + 1 AS round, nxt AS chunks FROM rounds
                      WHERE len(nxt) >= 5 AND nxt <> chunks))))"""


def lcs(ref: str, hyp: str) -> str:
    """Longest common subsequence length of two token lists, row by row."""
    return f"""list_reduce({ref}, lambda r, t: list_reduce(range(1, len({hyp}) + 1),
        lambda acc, j: list_append(acc, CASE WHEN {hyp}[j] = t THEN r[j] + 1
                                        ELSE greatest(acc[j], r[j + 1]) END), [0::BIGINT]),
      list_transform(range(0, len({hyp}) + 1), lambda z: 0::BIGINT))[len({hyp}) + 1]"""


def overlap(ref: str, hyp: str) -> str:
    return f"""coalesce(list_sum(list_transform(list_distinct({hyp}), lambda w:
      least(len(list_filter({ref}, lambda x: x = w)), len(list_filter({hyp}, lambda x: x = w))))), 0)"""


def prf(hits: str, ref: str, hyp: str) -> str:
    """Precision, recall, fmeasure columns p, r, f of a pair."""
    return f"""{hits} / greatest(len({hyp}), 1)::DOUBLE AS p, {hits} / greatest(len({ref}), 1)::DOUBLE AS r"""


def inside(ref: str, hyp: str) -> str:
    """Whether the tokens of `hyp` stand in a row in `ref`; then all of them are shared, in order."""
    padded = lambda x: f"(' ' || array_to_string({x}, ' ') || ' ')"
    return f"contains({padded(ref)}, {padded(hyp)})"


def scored_rounds(key: str = "doc_id", source: str = "rounds", stem: bool = False) -> str:
    """`pair_scores`: one row per chunk and summary with both metrics.

    Each pair of texts is scored once. With stems a pair has a score only where
    the summary stands in the chunk as it is, which stems do not change.
    """
    f = lambda p, r: f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
    whole = f"len(hyp) = 0 OR {inside('ref', 'hyp')}"
    other = ("NULL", "NULL") if stem else (overlap("ref", "hyp"), lcs("ref", "hyp"))
    return f""",
  flat AS (SELECT {key}, round, len(chunks) AS n_chunks, unnest(chunks) AS chunk,
                  unnest(summaries) AS summary, unnest(range(len(chunks))) AS pos FROM {source}),
  toks AS (SELECT *, {tokens('chunk')} AS ref, {tokens('summary')} AS hyp FROM (SELECT DISTINCT chunk, summary FROM flat)),
  hits AS (SELECT chunk, summary, len(ref) AS nr, len(hyp) AS nh,
                  CASE WHEN {whole} THEN len(hyp) ELSE {other[0]} END AS o1,
                  CASE WHEN {whole} THEN len(hyp) ELSE {other[1]} END AS ol FROM toks),
  pr AS (SELECT *, o1 / greatest(nh, 1)::DOUBLE AS p1, o1 / greatest(nr, 1)::DOUBLE AS r1,
                ol / greatest(nh, 1)::DOUBLE AS pl, ol / greatest(nr, 1)::DOUBLE AS rl FROM hits),
  pair_scores AS (SELECT {key}, round, n_chunks, pos, p1, r1, pl, rl, {f('p1', 'r1')} AS f1, {f('pl', 'rl')} AS fl
                  FROM flat JOIN pr USING (chunk, summary))"""


MEANS = """,
  means AS (SELECT doc_id, round, n_chunks, avg(f1) AS meanf1_rouge1, avg(fl) AS meanf1_rougeL,
                   avg(p1) AS meanprecision_rouge1, avg(pl) AS meanprecision_rougeL,
                   avg(r1) AS meanrecall_rouge1, avg(rl) AS meanrecall_rougeL
            FROM pair_scores GROUP BY ALL)"""

_MEAN_NAMES = (
    "meanf1_rouge1", "meanf1_rougeL", "meanprecision_rouge1", "meanprecision_rougeL",
    "meanrecall_rouge1", "meanrecall_rougeL",
)


def _means_query(select: str) -> str:
    return f"WITH RECURSIVE {rounds_sql()}{scored_rounds()}{MEANS} {select}"


def _pages() -> str:
    page = "html"
    for pattern in NOISE:
        page = f"regexp_replace({page}, {_q(pattern)}, '', 'g')"
    text = f"list_transform(string_split(raw_content, '<p>')[2:], lambda p: {strip(inner_text('p'))})"
    head = r"regexp_extract(raw_content, '(?s)<h1\b[^>]*>(.*?)</h1>', 1)"
    return rf"""cleaned AS (
    SELECT page_id, url, html, regexp_extract({page}, '(?s)<article\b[^>]*>(.*?)</article>', 1) AS raw_content
    FROM pages),
  page_parts AS (
    SELECT page_id, url, html, {strip(inner_text(head))} AS title,
           list_filter({text}, lambda p: length(p) > 0) AS parts, raw_content FROM cleaned)"""


def _cards() -> str:
    link = unescape("regexp_extract(c.raw, '(?s)<a[^>]*\\bhref=\"([^\"]*)\"', 1)")
    title = strip(inner_text(r"regexp_extract(c.raw, '(?s)<a[^>]*>(.*?)</a>', 1)"))
    return rf"""cards AS (
    SELECT page_id, url, unnest(items) AS raw, unnest(range(len(items))) AS pos
    FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<li>.*?</li>') AS items FROM pages)),
  listing AS (
    SELECT page_id, url, pos, raw, {title} AS title, {link} AS link FROM cards c
    WHERE {title} <> '' AND {link} <> '')"""


def _dictionary() -> str:
    return f"""dict AS (SELECT DISTINCT unnest({words(letters('lower(text)'))}) AS word FROM benchmark)"""


def _repairs() -> str:
    """`repaired_words`: each pair with its candidate list and its list of repairs."""
    fold = lambda x: f"translate({x}, 'áéíóúÁÉÍÓÚñÑ', '0123456789@#')"
    return f"""{PAIRS}, {_dictionary()}, dict_list AS (SELECT list(word) AS known FROM dict),
  cleaned AS (SELECT *, {letters('reference')} AS ref_letters, {letters('summary')} AS sum_letters FROM pairs),
  ref_parts AS (
    SELECT conv_id, turn, pos, part FROM (
      SELECT conv_id, turn, unnest(string_split(ref_letters, ' ')) AS part,
             unnest(range(len(string_split(ref_letters, ' ')))) AS pos FROM cleaned)
    WHERE length(part) > 0 AND lower(part) NOT IN (SELECT word FROM dict)),
  rare AS (SELECT conv_id, turn, list_filter(flatten(list({words('part')} ORDER BY pos)), lambda w: true) AS cands
           FROM ref_parts GROUP BY conv_id, turn),
  weird AS (
    SELECT conv_id, turn, pos, tok FROM (
      SELECT conv_id, turn, ref_letters, unnest(string_split(sum_letters, ' ')) AS tok,
             unnest(range(len(string_split(sum_letters, ' ')))) AS pos FROM cleaned)
    WHERE NOT contains(lower(ref_letters), lower(tok)) AND lower(tok) NOT IN (SELECT word FROM dict)),
  ranked AS (
    SELECT w.conv_id, w.turn, w.pos, w.tok,
           list_sort(list_transform(range(1, len(cands) + 1),
             lambda i: {{'d': levenshtein({fold('tok')}, {fold('cands[i]')}), 'i': i, 'w': cands[i]}}))[1].w AS nearest
    FROM weird w LEFT JOIN rare USING (conv_id, turn)),
  repairs AS (
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS pos,
           tok AS word, nearest FROM ranked)"""


def place_names(x: str) -> str:
    for trigger, find, new in X.PLACE_NAME_RULES:
        x = f"CASE WHEN contains({x}, {_q(trigger)}) THEN replace({x}, {_q(find)}, {_q(new)}) ELSE {x} END"
    return x


_HAS_BODY = "doc_id % 7 <> 0"
_EXPORT = f"""WITH {SCORED} SELECT article_hash, article_title, category, publish_date, article_body,
  NULL::VARCHAR AS raw_content, source_entity, article_link, NULL::VARCHAR AS generated_summary,
  negative_score, importance_score FROM scored"""
_VIEWS = """views AS (SELECT event_id AS note_id,
  nullif(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS view_count FROM events)"""


def _chunks(select_list: str, where: str = "true") -> str:
    """Rows (doc_id, pos, chunk) of a list expression."""
    return f"""SELECT doc_id, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS chunk
      FROM (SELECT doc_id, {select_list} AS c FROM src WHERE {where})"""


def _softmax(a: str, b: str) -> tuple[str, str]:
    ea, eb = f"exp({a} - greatest({a}, {b}))", f"exp({b} - greatest({a}, {b}))"
    return f"{ea} / ({ea} + {eb})", f"{eb} / ({ea} + {eb})"


@cache
def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["csv_roundtrip"] = sql["json_roundtrip"] = _EXPORT

    kept = """, kept AS (SELECT article_hash, max(round) AS round, len(chunks) AS n
                         FROM rounds GROUP BY article_hash, len(chunks)),
      final AS (SELECT r.* FROM rounds r JOIN kept k ON k.article_hash = r.article_hash
                AND k.round = r.round AND k.n = len(r.chunks))"""
    sql["experiment_export"] = f"""WITH RECURSIVE {rounds_sql('article_hash')}{kept}
      {scored_rounds('article_hash', 'final')},
      sums AS (SELECT article_hash, round, n_chunks, round(sum(p1), 6) AS precision_1,
                      round(sum(r1), 6) AS recall_1, round(sum(fl), 6) AS fmeasure_l
               FROM pair_scores GROUP BY ALL)
      SELECT article_hash, article_hash || '_n_chunks_' || n_chunks AS key, round::INTEGER AS round,
             md5(array_to_string(chunks, '|')) AS chunks_md5,
             md5(array_to_string(summaries, '|')) AS summaries_md5, precision_1, recall_1, fmeasure_l
      FROM sums JOIN final USING (article_hash, round)"""
    sql["append_new_articles"] = f"""WITH {ARTICLES} SELECT article_hash, category, source_entity,
      publish_date, length(article_body)::INTEGER AS n FROM articles"""
    sql["insert_if_absent"] = f"""WITH {ARRIVALS}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY article_hash
          ORDER BY (ts >= as_of - INTERVAL 360 HOURS), entity, event_id) AS rn FROM arrivals, top)
      SELECT event_id, ts, entity, category, link, article_hash FROM ranked WHERE rn = 1"""
    sql["latest_articles_48h"] = f"""WITH {ARTICLES} SELECT article_hash, category, source_entity FROM articles
      WHERE publish_date >= (SELECT max(publish_date) FROM articles) - INTERVAL 48 HOURS"""
    sql["image_manifest"] = f"""WITH {_cards()} SELECT md5(link) AS article_hash, md5(link || '.png') AS image_hash,
      link || '.png' AS s3_link, 's3_' || md5(link) || '.png' AS object_key FROM listing"""
    sql["json_view_count"] = f"WITH {_VIEWS} SELECT note_id, view_count FROM views"
    sql["ad_hoc_sql"] = f"""WITH {ARTICLES} SELECT category, source_entity, max(publish_date) AS last_date,
      count(*) AS n FROM articles GROUP BY category, source_entity"""
    sql["search_hits"] = r"""WITH raw AS (
        SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS links,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS titles FROM pages),
      hits AS (SELECT page_id, unnest(range(len(links)))::INTEGER AS pos, unnest(titles) AS title,
                      host || unnest(links) AS link FROM raw)
      SELECT page_id, pos, title, link,
             CASE WHEN contains(link, '.cl') OR contains(link, '.com') THEN '##' ELSE '!!' END AS mark,
             contains(link, 'biobio') AS is_biobio
      FROM (SELECT *, link[length(host) + 1:] AS address FROM hits JOIN (SELECT page_id, host FROM raw) USING (page_id))
      WHERE contains('hace ' || (pos + 1) || CASE WHEN md5(address) < '8' THEN ' horas' ELSE ' días' END, 'horas')"""

    sql["listing_articles"] = rf"""WITH {_cards()}
      SELECT page_id, pos::INTEGER AS pos, title, link, link || '.png' AS image,
             CASE WHEN pos > 0 THEN TIMESTAMP '2024-01-01' + to_hours(page_id) + to_minutes(pos) END AS publish_date,
             false AS bad_date, md5(link) AS hash_id,
             regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) AS category,
             regexp_extract(url, '^https?://([^/]+)/', 1) AS entity, md5(raw) AS raw_md5
      FROM listing"""
    sql["site_listings"] = f"""WITH {_cards()}, sites(site, dated) AS (
        VALUES ('biobiochile', true), ('latercera', true), ('24horas', false))
      SELECT site, page_id, pos::INTEGER AS pos, title, link,
             regexp_extract(raw, 'href="([^"]*)"', 1) || '.png' AS image,
             CASE WHEN dated THEN moment END AS publish_date, false AS bad_date, md5(link) AS hash_id
      FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(page_id) AS moment FROM listing), sites"""
    sql["page_extract"] = f"""WITH {_pages()} SELECT page_id, title, array_to_string(parts, ' ') AS article_body,
      md5(raw_content) AS raw_md5 FROM page_parts"""
    sql["assemble_body"] = f"""WITH {_pages()}, rows AS (
        SELECT page_id, unnest(parts) AS text, unnest(range(len(parts))) AS pos FROM page_parts)
      SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS article_body FROM rows GROUP BY page_id"""
    sql["template_route"] = """SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'aqui-tierra'
      WHEN contains(url, '/en/') THEN 'especial' ELSE 'normal' END AS route FROM pages"""
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    raw = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
    head = squeeze(inner_text(rf"regexp_extract({raw}, '(?s)<h1>(.*?)</h1>', 1)"))
    each = squeeze(inner_text("p"))
    sql["template_bodies"] = f"""SELECT md5(url) AS article_hash, {head} ||
        array_to_string(list_transform(string_split({raw}, '<p>')[2:], lambda p: ' ' || {each}), '')
        AS article_body FROM pages"""
    sql["target_pages"] = """SELECT DISTINCT source AS entity, lang AS category, page::INTEGER AS page,
      'https://' || source || '/lista/' || lang || '/' || page AS page_url
      FROM documents, range(1, 8) r(page)"""
    sql["left_merge_bodies"] = f"""WITH {ARTICLES} SELECT doc_id, article_hash, article_title, category,
      CASE WHEN {_HAS_BODY} THEN length(article_body)::INTEGER END AS body_chars FROM articles"""
    sql["complete_articles"] = f"""WITH {_pages()}, {_VIEWS},
      one AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM page_parts)
      SELECT md5(p.url) AS hash_id, p.url,
             CASE WHEN NOT contains(p.url, '#') THEN TIMESTAMP '2024-01-01' + to_hours(p.page_id) + INTERVAL 1 DAY
                  ELSE TIMESTAMP '2024-01-01' + to_hours(one.page_id) END AS publish_date,
             md5(array_to_string(one.parts, ' ')) AS body_md5, view_count
      FROM page_parts p JOIN one ON one.url = p.url AND one.rn = 1 LEFT JOIN views ON note_id = one.page_id"""
    sql["union_lists"] = f"""WITH {ARTICLES}
      SELECT article_hash, category, doc_id, (dense_rank() OVER (ORDER BY category NULLS LAST) - 1)::INTEGER AS list_no
      FROM articles"""

    cuts = lambda floor: f"""cuts AS (
        SELECT t.entity, t.category, last_date, greatest(coalesce(last_date, {floor}), {floor}) AS cut_date
        FROM (SELECT DISTINCT entity, category FROM arrivals) t CROSS JOIN top
        LEFT JOIN (SELECT entity, category, max(ts) AS last_date FROM stored GROUP BY 1, 2) s
          ON s.entity = t.entity AND s.category = t.category)"""
    sql["last_date_per_target"] = f"""WITH {ARRIVALS}, {cuts('(as_of - INTERVAL 24 HOURS)')} SELECT * FROM cuts"""
    floor = "(as_of - INTERVAL 24 HOURS - to_hours(hour(as_of)))"
    sql["take_while_newer"] = f"""WITH {ARRIVALS}, {cuts(floor)}, marked AS (
        SELECT a.*, max(CASE WHEN ts <= cut_date THEN 1 ELSE 0 END) OVER (
          PARTITION BY a.entity, a.category ORDER BY event_id DESC) AS stopped
        FROM arrivals a JOIN cuts c ON a.entity = c.entity AND a.category = c.category)
      SELECT entity, category, event_id, ts FROM marked WHERE stopped = 0"""
    sql["incremental_since"] = f"""WITH {ARRIVALS}
      SELECT event_id, article_hash, ts FROM arrivals, top
      WHERE ts > (SELECT max(ts) FROM arrivals, top WHERE ts <= as_of - INTERVAL 10 HOURS)
        AND ts > as_of - INTERVAL 24 HOURS"""
    sql["unseen_articles"] = f"""WITH {ARRIVALS}
      SELECT article_hash, event_id, ts FROM arrivals, top WHERE ts >= as_of - INTERVAL 24 HOURS
        AND article_hash NOT IN (SELECT article_hash FROM arrivals, top
          WHERE ts < as_of - INTERVAL 24 HOURS AND ts >= as_of - INTERVAL 48 HOURS)"""
    sql["batch_low_date"] = f"""WITH {ARRIVALS}, dated AS (
        SELECT entity, category, event_id, CASE WHEN k >= 25 THEN ts END AS d FROM arrivals),
      grouped AS (SELECT entity, category, min(d) AS low, arg_min(CASE WHEN d IS NULL THEN 0 ELSE 1 END, event_id) AS ok
                  FROM dated GROUP BY 1, 2)
      SELECT entity, category, CASE WHEN ok = 1 THEN low ELSE least(low, TIMESTAMP '2024-01-01') END AS low_date
      FROM grouped"""
    sql["recapture_candidates"] = f"""WITH {ARTICLES} SELECT article_hash, publish_date AS capture_date
      FROM articles WHERE NOT ({_HAS_BODY}) AND publish_date <=
        (SELECT max(publish_date) FROM articles) + INTERVAL 60 HOURS - INTERVAL 3 DAYS"""
    sql["stream_dedupe"] = f"""WITH {ARRIVALS}, ranked AS (SELECT *, row_number() OVER (
        PARTITION BY article_hash ORDER BY ts, event_id) AS rn FROM arrivals)
      SELECT event_id, ts, entity, category, article_hash FROM ranked WHERE rn = 1"""
    sql["stream_return_after_window"] = f"""WITH {ARRIVALS}, w AS (SELECT *, lag(ts) OVER (
        PARTITION BY article_hash ORDER BY ts, event_id) AS previous FROM arrivals)
      SELECT event_id, ts, entity, category, article_hash FROM w
      WHERE previous IS NULL OR ts >= previous + INTERVAL 48 HOURS"""
    sql["stream_watermark_dedupe"] = (
        f"WITH {ARRIVALS} SELECT DISTINCT article_hash, entity, category FROM arrivals"
    )

    raw_title = unescape(r"regexp_extract(html, '(?s)<h1\b[^>]*>(.*?)</h1>', 1)")
    sql["load_by_key"] = rf"""WITH {_pages()}, {_VIEWS},
      listed AS (SELECT url, page_id, {raw_title} AS t, row_number() OVER (
                   PARTITION BY url ORDER BY page_id) AS rn FROM page_parts),
      one AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM page_parts),
      new AS (
        SELECT one.page_id, md5(one.url) AS article_hash, one.url, array_to_string(parts, ' ') AS article_body,
               CASE WHEN regexp_extract(l.url, '^https?://[^/]+/([^/]+)/', 1) = 'en' THEN t ELSE lower(t) END AS article_title,
               one.page_id AS date_id
        FROM one JOIN listed l ON l.url = one.url AND l.rn = 1 AND one.rn = 1
        WHERE one.url NOT IN (SELECT url FROM pages WHERE NOT contains(url, '#') AND page_id <
          (SELECT max(page_id) FROM pages WHERE NOT contains(url, '#')) - 120)),
      folded AS (SELECT *, {greedy(sentences('article_body'))} AS g FROM new),
      chunked AS (SELECT *, {closed('g')} AS chunks FROM folded)
      SELECT article_hash, article_title, regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) AS category,
             TIMESTAMP '2024-01-01' + to_hours(date_id) AS publish_date, article_body,
             regexp_extract(url, '^https?://([^/]+)/', 1) AS source_entity,
             url AS article_link,
             array_to_string(list_transform(chunks, lambda c: {central('c')}), chr(10)) AS generated_summary,
             view_count
      FROM chunked LEFT JOIN views ON note_id = page_id"""
    sql["load_by_date"] = f"""WITH {ARTICLES}, top AS (SELECT max(publish_date) AS as_of FROM articles),
      stored AS (SELECT source_entity, category, max(publish_date) AS last_date FROM articles, top
                 WHERE publish_date <= as_of - INTERVAL 2 HOURS GROUP BY ALL),
      cut AS (SELECT a.*, greatest(coalesce(last_date, as_of - INTERVAL 24 HOURS), as_of - INTERVAL 24 HOURS) AS cut_date
              FROM articles a CROSS JOIN top LEFT JOIN stored s
                ON s.source_entity = a.source_entity AND s.category = a.category),
      marked AS (SELECT *, max(CASE WHEN publish_date <= cut_date THEN 1 ELSE 0 END) OVER (
                   PARTITION BY source_entity, category ORDER BY doc_id DESC) AS stopped FROM cut)
      SELECT article_hash, article_title, category, publish_date, source_entity, article_link,
             CASE WHEN {_HAS_BODY} THEN md5(article_body) END AS body_md5
      FROM marked WHERE stopped = 0"""

    sql["drop_null_body"] = "SELECT doc_id, length(text)::INTEGER AS n FROM documents WHERE doc_id % 7 <> 0"
    sql["outlier_filter"] = (
        "SELECT doc_id, length(text)::INTEGER AS n FROM documents WHERE length(text) BETWEEN 500 AND 5000"
    )
    sql["length_bands"] = """SELECT source || '/' || doc_id AS article_link, low::INTEGER AS low,
      high::INTEGER AS high, md5(text) AS body_md5
      FROM documents JOIN (VALUES (0, 250), (5000, 5100), (7000, 10000)) b(low, high)
        ON length(text) BETWEEN low AND high"""
    sql["length_profile"] = f"""WITH {ARTICLES} SELECT
      trunc(avg(length(article_title)))::BIGINT AS avg_title, min(length(article_title)) AS min_title,
      max(length(article_title)) AS max_title, trunc(avg(length(article_body)))::BIGINT AS avg_body,
      min(length(article_body)) AS min_body, max(length(article_body)) AS max_body FROM articles"""
    sql["length_describe"] = """SELECT count(*) AS count, round(avg(length(text)), 6) AS mean,
      round(stddev_samp(length(text)), 6) AS std, min(length(text))::DOUBLE AS min,
      quantile_cont(length(text)::DOUBLE, 0.25) AS p25, quantile_cont(length(text)::DOUBLE, 0.5) AS p50,
      quantile_cont(length(text)::DOUBLE, 0.75) AS p75, max(length(text))::DOUBLE AS max FROM documents"""
    sql["outlier_counts"] = """SELECT count(*) FILTER (length(text) < 500) AS below,
      count(*) FILTER (length(text) > 5000) AS above, count(*) AS rows FROM documents"""
    sql["date_span"] = f"""WITH {ARTICLES} SELECT min(publish_date) AS first_date, max(publish_date) AS last_date,
      date_diff('second', min(publish_date), max(publish_date)) AS span_seconds FROM articles"""
    columns = (
        ("doc_id", "bigint"), ("article_hash", "string"), ("article_title", "string"),
        ("category", "string"), ("publish_date", "timestamp_ntz"), ("article_body", "string"),
        ("source_entity", "string"), ("article_link", "string"), ("negative_score", "double"),
        ("importance_score", "double"),
    )
    sql["column_profile"] = f"WITH {SCORED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null FROM scored" for c, t in columns
    )
    sql["frame_shape"] = "SELECT count(*) AS rows, 8 AS columns FROM documents"
    sql["length_curve"] = """SELECT row_number() OVER (ORDER BY length(text)) - 1 AS rank,
      length(text)::INTEGER AS value FROM documents"""
    mean = "list_avg(list_transform(string_split(text, '.'), lambda p: length(p)))"
    sql["part_length_curve"] = f"""SELECT row_number() OVER (ORDER BY v) - 1 AS rank, v AS value
      FROM (SELECT round({mean} * 100)::BIGINT AS v FROM documents)"""
    sql["avg_sentence_len"] = f"SELECT doc_id, round({mean}, 6) AS mean_len FROM documents"
    sql["sample_n"] = """SELECT doc_id, lang AS category FROM documents
      ORDER BY md5(doc_id || '-7'), doc_id LIMIT 100"""
    sql["sample_tenth"] = """SELECT doc_id, category FROM (SELECT doc_id, lang AS category,
        row_number() OVER (ORDER BY md5(doc_id || '-11'), doc_id) AS place, count(*) OVER () AS n FROM documents)
      WHERE place <= n // 10"""
    sql["driver_rows"] = f"""WITH {ARTICLES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN article_title END AS article_title,
      publish_date FROM articles ORDER BY doc_id LIMIT 5"""
    sql["head_rows"] = f"""WITH {ARTICLES} SELECT doc_id, article_title, publish_date FROM articles
      ORDER BY doc_id LIMIT 5"""

    src = f"""WITH src AS (SELECT doc_id, text AS body, {sentences('text')} AS parts FROM documents)"""
    sql["sentences"] = f"{src} SELECT doc_id, pos, chunk AS part FROM ({_chunks('parts')})"
    folded = f"""{src}, folded AS (SELECT doc_id, {greedy('parts')} AS g FROM src),
      merged AS (SELECT doc_id, {closed('g')} AS chunks FROM folded)"""
    rows = lambda expr: f"""SELECT doc_id, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS chunk
      FROM (SELECT doc_id, {expr} AS c FROM merged)"""
    sql["chunk_greedy"] = f"{folded} " + rows(f"list_transform(chunks, lambda c: {strip('c || chr(46)')})")
    sql["chunk_fixed"] = f"""{src}, sized AS (
        SELECT doc_id, parts, length(body) // 390 AS n FROM src WHERE length(body) >= 390),
      grouped AS (SELECT *, greatest(ceil(len(parts) / n - 0.5), 0)::BIGINT AS g FROM sized)
      SELECT doc_id, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS chunk FROM (
        SELECT doc_id, list_transform(range(g), lambda i:
          array_to_string(parts[i * n + 1 : i * n + n], '. ')) AS c FROM grouped)"""
    sql["pair_merge"] = f"{folded} " + rows(
        "list_transform(range((len(chunks) + 1) // 2), lambda i: array_to_string(chunks[2 * i + 1 : 2 * i + 2], '. '))"
    )
    sql["chunk_stats"] = f"""{src}, folded AS (SELECT *, {greedy('parts')} AS g FROM src)
      SELECT doc_id, length(body)::INTEGER AS n_chars, len(parts)::INTEGER AS n_parts,
             length(body) // 390 AS whole_chunks, round(length(body) / 390.0, 2)::DOUBLE AS wanted_chunks,
             len({closed('g')})::INTEGER AS n_chunks FROM folded"""

    sql["rechunk_rounds"] = f"""WITH RECURSIVE {rounds_sql()}
      SELECT doc_id, round::INTEGER AS round, len(chunks)::INTEGER AS n_chunks,
             length(array_to_string(chunks, ''))::INTEGER AS n_chars,
             md5(array_to_string(summaries, '|')) AS summaries_md5 FROM rounds"""
    sql["summarize_extractive"] = f"""{folded}, rows AS ({rows('chunks')})
      SELECT doc_id, pos, {central('chunk')} AS central, {lead('chunk')} AS lead FROM rows"""
    sql["summary_constraints"] = f"""WITH RECURSIVE {rounds_sql()},
      last AS (SELECT doc_id, arg_max(summaries, round) AS s FROM rounds GROUP BY doc_id),
      texts AS (SELECT doc_id, string_split(text, chr(10))[1] || chr(10) || array_to_string(s, chr(10)) AS t
                FROM last JOIN documents USING (doc_id)),
      counted AS (SELECT doc_id,
        greatest(len(list_filter(string_split(t, chr(10)), lambda x: length({strip('x')}) > 0)) - 1, 0)::INTEGER AS n_bullets,
        len({words('t')})::INTEGER AS n_words FROM texts)
      SELECT *, n_bullets <= 5 AND n_words <= 100 AS is_valid FROM counted"""
    sql["bullets"] = """SELECT conv_id, turn, unnest(range(len(b)))::INTEGER AS pos, unnest(b) AS bullet
      FROM (SELECT conv_id, turn, string_split(text, '.') AS b FROM conversations
            UNION ALL SELECT doc_id, NULL, string_split(text, '.') FROM documents)"""
    sql["summarize_model"] = f"{folded} " + rows("list_transform(chunks, lambda c: substring(c, 1, 60))").replace("AS chunk", "AS summary")
    sql["rechunk_model"] = f"""WITH RECURSIVE {ARTICLES},
      base AS (SELECT doc_id, {greedy(sentences('article_body'))} AS g FROM articles),
      loop AS (
        SELECT *, {closed('g')} AS nxt FROM (
          SELECT *, {greedy('summaries')} AS g FROM (
            SELECT doc_id, 1 AS round, chunks, list_transform(chunks, lambda c: substring(c, 1, 200)) AS summaries
            FROM (SELECT doc_id, {closed('g')} AS chunks FROM base) WHERE len(chunks) > 0))
        UNION ALL
        SELECT *, {closed('g')} AS nxt FROM (
          SELECT *, {greedy('summaries')} AS g FROM (
            SELECT doc_id, round + 1 AS round, nxt AS chunks, list_transform(nxt, lambda c: substring(c, 1, 200)) AS summaries
            FROM loop WHERE len(nxt) >= 5 AND nxt <> chunks
              AND length(array_to_string(summaries, '')) < length(array_to_string(chunks, '')))))
      SELECT doc_id, round::INTEGER AS round, len(chunks)::INTEGER AS n_chunks, md5(array_to_string(chunks, '|')) AS chunks_md5,
             md5(array_to_string(summaries, '|')) AS summaries_md5,
             len(nxt) < 5 OR nxt = chunks OR length(array_to_string(summaries, '')) >= length(array_to_string(chunks, '')) AS finished
      FROM loop"""

    toks = f"{PAIRS}, toks AS (SELECT conv_id, turn, {tokens('reference')} AS ref, {tokens('summary')} AS hyp FROM pairs)"
    f1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
    sql["rouge1"] = f"""WITH {toks}, hits AS (SELECT *, {overlap('ref', 'hyp')} AS o FROM toks),
      pr AS (SELECT *, {prf('o', 'ref', 'hyp')} FROM hits)
      SELECT conv_id, turn, o::BIGINT AS overlap, round(p, 6) AS precision, round(r, 6) AS recall,
             round({f1}, 6) AS fmeasure FROM pr"""
    sql["rougeL"] = f"""WITH {toks}, hits AS (SELECT *, {lcs('ref', 'hyp')} AS o FROM toks),
      pr AS (SELECT *, {prf('o', 'ref', 'hyp')} FROM hits)
      SELECT conv_id, turn, round(p, 5) AS precision, round(r, 5) AS recall, round({f1}, 5) AS fmeasure FROM pr"""
    report = ", ".join(
        f"round({v}{n}, 5) AS rouge{m}_{f}"
        for m, n in (("1", "1"), ("L", "l"))
        for f, v in (("precision", "p"), ("recall", "r"), ("fmeasure", "f"))
    )
    sql["rouge_stemmed"] = f"""WITH RECURSIVE {rounds_sql()}{scored_rounds(stem=True)}
      SELECT doc_id, round::INTEGER AS round, (pos + 1)::INTEGER AS chunk, {report} FROM pair_scores"""
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in _MEAN_NAMES)
    sql["rouge_means"] = _means_query(
        f"SELECT doc_id, round::INTEGER AS round, n_chunks::INTEGER AS n_chunks, {rounded} FROM means"
    )
    by = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEAN_NAMES)
    sql["rouge_by_chunks"] = _means_query(
        f"SELECT n_chunks::INTEGER AS chunksize, {by} FROM means GROUP BY n_chunks ORDER BY 1"
    )
    sql["metrics_csv"] = sql["rouge_by_chunks"]
    sql["rouge_frame"] = _means_query(f"SELECT n_chunks::INTEGER AS chunksize, {rounded} FROM means")
    sql["rouge_gap"] = _means_query(
        """SELECT doc_id, round::INTEGER AS round, n_chunks::INTEGER AS n_chunks,
           round(meanf1_rouge1 - meanf1_rougeL, 6) AS gap FROM means"""
    )
    sql["rouge_round_delta"] = _means_query(
        """SELECT doc_id, round::INTEGER AS round, n_chunks::INTEGER AS n_chunks, round(meanf1_rouge1, 6) AS value,
           round(meanf1_rouge1 - lag(meanf1_rouge1) OVER (PARTITION BY doc_id ORDER BY round), 6) + 0.0::DOUBLE AS change FROM means"""
    )

    split = f"list_transform(string_split({letters('text')}, ' '), lambda p: p)"
    sql["rare_words"] = f"""WITH {_dictionary()}, parts AS (
        SELECT doc_id, list_filter({split}, lambda p: length(p) > 0) AS c FROM documents),
      rows AS (SELECT doc_id, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS word FROM parts)
      SELECT * FROM rows WHERE lower(word) NOT IN (SELECT word FROM dict)"""
    sql["nearest_word"] = f"""WITH {_repairs()}
      SELECT conv_id, turn, pos::INTEGER AS pos, word, nearest FROM repairs"""
    sql["repair_summaries"] = f"""WITH {_repairs()}, lists AS (
        SELECT conv_id, turn, list({{'w': word, 'n': coalesce(nearest, word)}} ORDER BY pos) AS l
        FROM repairs GROUP BY conv_id, turn),
      replaced AS (
        SELECT p.conv_id, p.turn, CASE WHEN l IS NULL THEN summary ELSE
          list_reduce(l, lambda t, x: replace(t, x.w, x.n), summary) END AS t
        FROM pairs p LEFT JOIN lists ON lists.conv_id = p.conv_id AND lists.turn = p.turn)
      SELECT conv_id, turn, {place_names('t')} AS repaired FROM replaced"""
    sql["special_cases"] = f"""WITH b AS (SELECT doc_id,
        replace(replace(text, ' the ', ' Bío '), ' of ', ' Radio Bío ') AS t FROM documents)
      SELECT doc_id, length({place_names('t')})::INTEGER AS n, md5({place_names('t')}) AS text_md5 FROM b"""
    stops = ", ".join(_q(w) for w in spanish_stop_words())
    sql["remove_stopwords"] = f"""WITH stop AS (SELECT [{stops}] AS s), k AS (
        SELECT doc_id, array_to_string(list_filter({words(letters('lower(text)'))},
          lambda w: NOT list_contains(s, w)), ' ') AS t FROM documents, stop)
      SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS kept_md5 FROM k"""
    neg, pos = _softmax("logit_neg", "logit_pos")
    sql["sentiment_softmax"] = f"""WITH {_dictionary()}, lex AS (
        SELECT word, (length(word) % 2) / 8.0::DOUBLE AS neg, (1 - length(word) % 2) / 8.0::DOUBLE AS pos FROM dict),
      w AS (SELECT doc_id, unnest({words(letters('lower(text)'))}) AS word FROM documents),
      s AS (SELECT doc_id, sum(neg) AS a, sum(pos) AS b FROM w JOIN lex USING (word) GROUP BY doc_id),
      l AS (SELECT doc_id, coalesce(a, 0)::DOUBLE AS logit_neg, coalesce(b, 0)::DOUBLE AS logit_pos
            FROM documents LEFT JOIN s USING (doc_id))
      SELECT *, round({neg}, 6) AS negative, round({pos}, 6) AS positive FROM l"""

    sql["key_violations"] = f"""WITH {ARRIVALS} SELECT article_hash, count(*) AS n FROM arrivals
      GROUP BY article_hash HAVING count(*) > 1"""
    for name, test in (("fk_orphans", "NOT"), ("fk_valid", "")):
        sql[name] = f"""SELECT doc_id, md5(doc_id::VARCHAR) AS image_hash FROM labels WHERE doc_id {test} IN
          (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)"""
    sql["negativity_filter"] = f"""WITH {SCORED} SELECT article_hash, negative_score FROM scored
      WHERE negative_score < 0.5"""
    sql["importance_topk"] = f"""WITH {SCORED}, r AS (SELECT doc_id, category, importance_score,
        row_number() OVER (PARTITION BY category ORDER BY importance_score DESC NULLS LAST, doc_id)::INTEGER AS rank
        FROM scored) SELECT * FROM r WHERE rank <= 10"""
    sql["digest"] = f"""WITH {SCORED}, recent AS (SELECT * FROM scored
        WHERE publish_date >= (SELECT max(publish_date) FROM scored) - INTERVAL 48 HOURS AND negative_score < 0.5),
      best AS (SELECT article_hash, category, row_number() OVER (PARTITION BY category
          ORDER BY importance_score DESC NULLS LAST, article_hash)::INTEGER AS rank FROM recent),
      readers AS (SELECT c_custkey AS reader, ['en', 'es', 'fr', 'de'][c_nationkey % 4 + 1] AS category FROM customer)
      SELECT reader, category, rank, article_hash FROM readers JOIN best USING (category) WHERE rank <= 5"""

    sql["stored_pages"] = """SELECT page_id, way, strlen(html)::BIGINT AS size, md5(html) AS html_md5
      FROM pages, (VALUES ('batch'), ('stream')) w(way)"""
    sql["sql_functions"] = f"""WITH docs AS (SELECT doc_id, source || '/' || doc_id AS link, {sentences('text')} AS parts FROM documents),
      folded AS (SELECT doc_id, link, {greedy('parts')} AS g FROM docs),
      merged AS (SELECT doc_id, link, {closed('g')} AS c FROM folded),
      rows AS (SELECT doc_id, link, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS chunk FROM merged),
      {toks.replace('SELECT conv_id, turn,', 'SELECT conv_id, turn, reference, summary,', 2)},
      hits AS (SELECT *, {overlap('ref', 'hyp')} AS o, {lcs('ref', 'hyp')} AS l FROM toks)
      SELECT doc_id, md5(link)[:16] AS link_key, sha256(link) AS link_sha, pos, length(chunk)::INTEGER AS n_chars,
             len({tokens('chunk')})::INTEGER AS n_tokens, NULL::VARCHAR AS metric, NULL::INTEGER AS hits, NULL::DOUBLE AS recall FROM rows
      UNION ALL
      SELECT conv_id, md5(reference), sha256(summary), turn::INTEGER, length(summary)::INTEGER, len(hyp)::INTEGER, metric, n::INTEGER,
             round(n / greatest(len(ref), 1)::DOUBLE, 6)
      FROM (SELECT *, unnest(['rouge1', 'rougeL']) AS metric, unnest([o, l]) AS n FROM hits)"""
    sql["scalar_hash"] = """SELECT doc_id, sha256(source || '/' || doc_id) AS sha, md5(source || '/' || doc_id) AS md5,
      substring(md5(source || '/' || doc_id), 1, 16) AS md5_16 FROM documents"""
    prompt = f"{_chars(X.PROMPT_RULES)} || 'Artículo: \"' || source || ' ' || text || '\"'"
    sql["scalar_text"] = f"""SELECT doc_id, len(string_split(text, '.'))::INTEGER AS n_stops,
      string_split(text, ' ')[-1] AS last_word, lang || ' ' || source AS joined,
      length({strip('text')})::INTEGER AS n_stripped, md5({letters('text')}) AS letters_md5, source AS image,
      md5(lower(text)) AS lower_md5, length(text)::INTEGER AS n, contains(text, ' de ') AS has_de,
      md5(substring(text, 513, 512)) AS slice_md5, md5({prompt}) AS prompt_md5,
      levenshtein(lang, source)::INTEGER AS distance, 's3_' || lang || '.png' AS object_key FROM documents"""
    a, b = _softmax("(n_chars / 1000.0)::DOUBLE", "(doc_id % 7)::DOUBLE")
    sql["scalar_math"] = f"""SELECT doc_id, ceil(n_chars / 390.0 - 0.5)::BIGINT AS groups, n_chars // 390 AS whole,
      round(n_chars / 390.0, 2)::DOUBLE AS wanted, round({a}, 5) AS negative, round({b}, 5) AS positive,
      nullif(n_chars % 5, 0) AS nonzero FROM documents"""
    sql["scalar_date"] = """WITH top AS (SELECT max(ts) AS as_of FROM events)
      SELECT event_id, date_trunc('minute', ts) AS spanish, date_trunc('second', ts) AS zoneless,
        date_trunc('minute', ts) AS slashes, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
        round((epoch_us(as_of) - epoch_us(ts)) / 86400e6, 6) AS days, ts - INTERVAL 24 HOURS AS floor_rolling,
        ts - INTERVAL 24 HOURS - to_hours(hour(ts)) AS floor_midnight, ts - INTERVAL 3 HOURS AS three_hours,
        as_of > ts AS is_older FROM events, top"""
    months = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"
    weekdays = "['lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado', 'domingo']"
    forms = (
        ("'hace ' || k || ' horas'", "ts - to_hours(k)"),
        ("'hace un día'", "ts - INTERVAL 1 DAY"),
        ("'Ayer'", "ts - INTERVAL 1 DAY"),
        ("'anteayer a las 07:05'", "date_trunc('day', ts) - INTERVAL 2 DAY + INTERVAL 425 MINUTE"),
        ("k || ' minutes ago'", "ts - to_minutes(k)"),
        ("'Hace ' || k || ' meses'", "ts - to_months(k::INTEGER)"),
        ("day(ts) || ' de ' || mes || ' de ' || year(ts)", "date_trunc('day', ts)"),
        ("strftime(ts, '%B') || ' ' || day(ts) || ', ' || year(ts)", "date_trunc('day', ts)"),
        ("strftime(ts, '%d') || ' ' || mes[:3] || '. ' || strftime(ts, '%Y %H:%M')", "date_trunc('minute', ts)"),
        ("'yesterday at 18:30'", "date_trunc('day', ts) - INTERVAL 330 MINUTE"),
        ("'sin fecha'", "NULL::TIMESTAMP"),
        ("'hoy'", "ts"),
        ("'hace ' || k || ' semanas'", "ts - to_days(7 * k::INTEGER)"),
        ("strftime(ts, '%b') || ' ' || day(ts) || ', ' || strftime(ts, '%Y, %H:%M')", "date_trunc('minute', ts)"),
        (f"{weekdays}[isodow(ts)] || strftime(ts, ' %d ') || mes || strftime(ts, ', %Y | %H:%M')", "date_trunc('minute', ts)"),
        ("strftime(ts, '%Y-%m-%d %H:%M:%S')", "date_trunc('second', ts)"),
    )
    case = lambda i: " ".join(f"WHEN {n} THEN {form[i]}" for n, form in enumerate(forms))
    sql["free_dates"] = f"""WITH e AS (SELECT event_id, ts, event_id % 30 + 2 AS k, {months}[month(ts)] AS mes FROM events)
      SELECT event_id, CASE event_id % {len(forms)} {case(0)} END AS text,
             CASE event_id % {len(forms)} {case(1)} END AS moment FROM e"""
    sql["scalar_nested"] = """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
      SELECT event_id, k, array_to_string(range(k % 6 + 1), '-') AS range, (k % 6 + 2)::INTEGER AS appended,
        (k % 6)::INTEGER AS last, len(list_filter(range(k % 6 + 1), lambda x: x % 2 = 0))::INTEGER AS even,
        list_sum(list_transform(range(k % 6 + 1), lambda x: x * x))::INTEGER AS squares, k AS lookup FROM e"""
    return sql

