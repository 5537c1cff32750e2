"""DuckDB SQL with the same results, for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
              FROM scored)
        WHERE place <= 5""",
    "op2_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, low AS component_id, doc_id = low AS kept
        FROM documents LEFT JOIN n USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)""",
    "op6_line_dedup": f"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents),
        l AS (SELECT doc_id, unnest(cut) AS line, generate_subscripts(cut, 1) AS pos FROM t),
        k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")}
                        AS key FROM l),
        gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM gone)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM gone)), ''))
                   AS kept_sha256
        FROM k GROUP BY doc_id""",
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op11_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
        t AS (SELECT doc, lang, source,
                     unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        own AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(own.n, 0) + 5 * v.v) AS p
              FROM g JOIN kept k USING (lang) JOIN v USING (lang)
              LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        total AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
        q AS (SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.n) + 5)) // (any_value(total.n) + 5 * any_value(v.v)) AS q
              FROM c JOIN total USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM found)
        WHERE part = 'pair' OR place <= 50""",
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
        f AS (
            SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
                   doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic,
                   MAP {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
                        'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
                        'D': regexp_matches(text, '[#$%&*|]'),
                        'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS fails
            FROM w),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e
              WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        m AS (SELECT part, fails['A'] AS a, fails['B'] AS b, fails['C'] AS c, fails['D'] AS d, fails['E'] AS e,
                     any_value(fails) AS fails, count(*) AS n, count(*) FILTER (good) AS good,
                     count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
        s AS (SELECT part, filter_order, step, fails[filter_order[step]] AS fail, n, good, toxic,
                     len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone,
                     len(list_filter(range(1, 6), lambda i: fails[filter_order[i]])) = 1 AS lone
              FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
        x AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept,
                     coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
                     coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant,
                     coalesce(sum(n) FILTER (fail AND lone), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost,
                     coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost
              FROM s GROUP BY part, filter_order, step)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
        FROM x""",
}
