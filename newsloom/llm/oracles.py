"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLES = {
    "op5_mix_sources": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
          FROM documents),
        s AS (
          SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::BIGINT AS most,
                 (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
          FROM d GROUP BY source),
        o AS (
          SELECT *, row_number() OVER (ORDER BY most / weight, source) AS place FROM s),
        p AS (
          SELECT *, coalesce(sum(most) OVER w, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight,
                 sum(source_size::DOUBLE) OVER () AS total
          FROM o WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lowest AS (
          SELECT arg_min((total - full_before) / open_weight, place) AS share FROM p
          WHERE full_before + open_weight * most / weight >= total),
        t AS (
          SELECT source, source_size, least(most, (SELECT share FROM lowest) * weight) AS target FROM s),
        r AS (
          SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
                 ('0x' || substr(md5('20:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
                   / 4503599627370496.0::DOUBLE AS draw
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (
          SELECT *, floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT AS copies FROM r)
        SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source FROM c""",
    "op9_warc": r"""
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages),
        f AS (
          SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op4_substring_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (
          SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
        f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
        gone AS (
          SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM g JOIN f USING (h) WHERE doc_id > least),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i)
          GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
        g AS (
          SELECT doc_id, p, md5(substr(x, 2 * p + 1, 100)) AS h
          FROM (SELECT doc_id, x, unnest(range(0, n_bytes - 49)) AS p FROM d WHERE n_bytes >= 50)),
        f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
        r AS (
          SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g JOIN f USING (h) WHERE doc_id > least),
        i AS (SELECT *, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
        spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
        gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
        heads AS (
          SELECT doc_id, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head, max(b) AS b,
                 sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
          FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(heads.b, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN heads USING (doc_id)""",
    "op11_phrase_collocations": r"""
        WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (
          SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS phrase, 1 AS k FROM w
          UNION ALL
          SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w WHERE len(w) > 1
          UNION ALL
          SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3
          FROM w WHERE len(w) > 2),
        c AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY lang, phrase, k),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
        f AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE a >= 10),
        inside AS (
          SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM f WHERE k = 3),
        kept AS (
          SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
            SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.phrase = f.phrase AND 100 * i.a >= 50 * f.a)),
        cuts AS (
          SELECT lang, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM kept
          UNION ALL
          SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3),
        scored AS (
          SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r,
                 ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_benchmark_decontamination": r"""
        WITH i AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        d AS (
          SELECT row_number() OVER () AS no, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (
          SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM q),
        windows AS (
          SELECT no, size, p, array_to_string(w[p : p + size - 1], ' ') AS g
          FROM (SELECT no, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d JOIN sizes ON len(w) >= size)),
        found AS (SELECT no, p, size, item_id FROM windows JOIN q USING (size, g)),
        hit AS (
          SELECT no, count(DISTINCT place) AS n_hit
          FROM (SELECT no, unnest(range(p, p + size)) AS place FROM (SELECT DISTINCT no, p, size FROM found)) GROUP BY no),
        items AS (
          SELECT no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT no, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY no),
        whole AS (SELECT item_id, list_distinct(w) AS words, 2 * len(w) AS reach FROM i WHERE len(w) > 0 AND item_id IS NOT NULL),
        rare AS (
          SELECT item_id, words, reach, unnest(words) AS word FROM whole),
        places AS (SELECT no, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        known AS (SELECT word, count(*) AS n FROM places WHERE word IN (SELECT word FROM rare) GROUP BY word),
        anchor AS (
          SELECT item_id, any_value(words) AS words, any_value(reach) AS reach, arg_min(word, coalesce(n, 0)) AS word
          FROM rare LEFT JOIN known USING (word) GROUP BY item_id),
        around AS (
          SELECT DISTINCT no, item_id, words, w[greatest(1, s) : s + reach - 1] AS part
          FROM (SELECT no, item_id, words, reach, unnest(range(p - reach + 1, p + 1)) AS s FROM places JOIN anchor USING (word))
          JOIN d USING (no)),
        near AS (SELECT no, count(DISTINCT item_id) AS n_near_items FROM around WHERE list_has_all(part, words) GROUP BY no)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
               coalesce(n_near_items, 0)::BIGINT AS n_near_items
        FROM d LEFT JOIN hit USING (no) LEFT JOIN items USING (no) LEFT JOIN near USING (no)""",
}
