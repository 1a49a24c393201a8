"""The results of the llm queries in SQL (DuckDB's dialect), written from their definitions."""

from __future__ import annotations

from ..plans.oracle import doi, sha, title, url_or_doi, words


def _shingles(source: str) -> str:
    """CTEs sh(id, g), n(id, n) and sim(a, b) of pairs with similarity of at least a half, from source(id, t)."""
    return f"""
    w AS (SELECT id, {words('t')} AS w FROM {source}),
    sh AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
    n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
    met AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
    sim AS (SELECT a, b FROM met JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c >= 0.5 * (na.n + nb.n - c))"""


_KEYS = f"""k AS (SELECT DISTINCT paper_id, key FROM (
        SELECT paper_id, 'doi:' || {doi('doi')} AS key FROM papers UNION ALL SELECT paper_id, {url_or_doi('source_url')} FROM papers
        UNION ALL SELECT paper_id, 'hash:' || {sha('content_hash')} FROM papers) WHERE key IS NOT NULL)"""

_SPLIT = "CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('validation', 'valid', 'val', 'dev') THEN 'validation' WHEN lower(trim(split)) IN ('test', 'testing') THEN 'test' END"


def _unmarked(c: str) -> str:
    """The text without markup, and with the character references of these tables resolved."""
    x = f"regexp_replace(regexp_replace({c}, '</?(?:b|i|u|em|strong|span|a|sub|sup|mark|font|small)(?:\\s[^<>]*)?>', '', 'gi'), '</?[a-zA-Z][^<>]*>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#44;", ","), ("&rsquo;", "’"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def oracle_sql() -> dict[str, str]:
    split = _SPLIT
    return {
        "p3_found": f"""WITH RECURSIVE {_KEYS}, e AS (SELECT DISTINCT x.paper_id AS a, y.paper_id AS b FROM k x JOIN k y USING (key)),
            r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS paper_id, min(b) AS group_id FROM r GROUP BY a HAVING count(*) > 1""",
        "p4_found": f"""WITH s AS (SELECT paper_id, max({split}) AS split FROM paper_splits WHERE {split} IS NOT NULL GROUP BY 1),
            p AS (SELECT paper_id AS id, split = 'train' AS train, abstract AS t, {title('title')} AS tk, {sha('content_hash')} AS hk, coalesce(len({words('abstract')}), 0) AS nw FROM papers JOIN s USING (paper_id)),
            big AS (SELECT id, t FROM p WHERE nw >= 20), {_shingles('big')}
            SELECT DISTINCT least(x.id, y.id) AS paper_id_a, greatest(x.id, y.id) AS paper_id_b FROM p x JOIN p y ON x.train AND NOT y.train
            WHERE x.hk = y.hk OR ((x.nw < 20 OR y.nw < 20) AND x.tk = y.tk) OR (least(x.id, y.id), greatest(x.id, y.id)) IN (SELECT (a, b) FROM sim)""",
        "p5_found": "SELECT DISTINCT paper_id, field FROM (SELECT paper_id, unnest(['introduction', 'body', 'conclusion']) AS field, unnest([introduction, body, conclusion]) AS t FROM papers) WHERE length(t) > 4000",
        "p6_found": f"""WITH docs AS (SELECT 'news' AS kind, news_id AS i, coalesce(title_original, '') || ' ' || content_original AS t FROM news WHERE len({words('content_original')}) >= 30
                UNION ALL SELECT 'paper', paper_id, fulltext FROM papers WHERE fulltext IS NOT NULL),
            src AS (SELECT (kind, i) AS id, t FROM docs), {_shingles('src')} SELECT DISTINCT a[1] AS record_kind, a[2] AS id_a, b[2] AS id_b FROM sim WHERE a[1] = b[1]""",
        "p3_splits": f"""WITH RECURSIVE {_KEYS}, e AS (SELECT DISTINCT x.paper_id AS a, y.paper_id AS b FROM k x JOIN k y USING (key)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
            g AS (SELECT p.paper_id, coalesce(min(b), p.paper_id) AS group_id FROM (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL) p LEFT JOIN r ON a = p.paper_id GROUP BY 1, p.paper_id),
            n AS (SELECT group_id, count(*) AS n, sum(count(*)) OVER () AS total FROM g GROUP BY 1), big AS (SELECT *, row_number() OVER (ORDER BY n DESC, group_id) AS i FROM n WHERE n * 100 > total),
            st AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS group_id, NULL::VARCHAR AS split, (SELECT any_value(total) FROM n) * 0.8::DOUBLE AS train, (SELECT any_value(total) FROM n) * 0.1::DOUBLE AS validation, (SELECT any_value(total) FROM n) * 0.1::DOUBLE AS test
                UNION ALL SELECT b.i, b.group_id, x, train - CASE WHEN x = 'train' THEN n ELSE 0 END, validation - CASE WHEN x = 'validation' THEN n ELSE 0 END, test - CASE WHEN x = 'test' THEN n ELSE 0 END
                FROM (SELECT *, CASE WHEN validation >= greatest(train, test) AND validation > test AND validation > train THEN 'validation' WHEN train > test THEN CASE WHEN validation >= train THEN 'validation' ELSE 'train' END WHEN validation >= test THEN 'validation'
                    ELSE CASE WHEN train >= test THEN 'train' ELSE 'test' END END AS x FROM st) s JOIN big b ON b.i = s.i + 1 AND b.i <= 100),
            sc AS (SELECT DISTINCT group_id, s, -w / ln((('0x' || md5(group_id || ':' || s || ':0')[:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) AS score FROM g, (VALUES ('train', 0.8::DOUBLE), ('validation', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) v(s, w)),
            sp AS (SELECT group_id, arg_max(s, score) AS split FROM sc GROUP BY 1)
            SELECT paper_id, g.group_id, coalesce(st.split, sp.split) AS split FROM g JOIN sp USING (group_id) LEFT JOIN st ON st.group_id = g.group_id""",
        "p4_report": f"""WITH s AS (SELECT paper_id, arg_min({split}, (-epoch_us(coalesce(assigned_at, TIMESTAMP '1970-01-01')), {split})) AS split FROM paper_splits WHERE {split} IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1),
            p AS (SELECT paper_id AS id, split, source, split = 'train' AS train, abstract AS t, {title('title')} AS tk, {sha('content_hash')} AS hk, coalesce(len({words('abstract')}), 0) AS nw FROM papers JOIN s USING (paper_id)),
            big AS (SELECT id, t FROM p WHERE nw >= 20), {_shingles('big')},
            q AS (SELECT x.id AS e, y.id AS t, x.split, x.source, coalesce(x.hk = y.hk, false) AS h, coalesce((x.nw < 20 OR y.nw < 20) AND x.tk = y.tk, false) AS tt, m.c / nx.n AS cont, m.c >= 0.5 * (nx.n + ny.n - m.c) AS si
                FROM p x JOIN p y ON y.train AND NOT x.train LEFT JOIN met m ON m.a = least(x.id, y.id) AND m.b = greatest(x.id, y.id) LEFT JOIN n nx ON nx.id = x.id LEFT JOIN n ny ON ny.id = y.id)
            SELECT split, source, count(DISTINCT e) AS eval_papers, count(*) AS pairs, count(*) FILTER (h) AS by_hash, count(*) FILTER (tt) AS by_title, count(*) FILTER (si) AS by_abstract, round(max(cont) FILTER (si), 6) AS max_containment FROM q WHERE h OR tt OR si GROUP BY 1, 2""",
        "p5_rebuilt": "SELECT DISTINCT paper_id, field, md5(t) AS digest, true AS within, true AS overlap, true AS counted FROM (SELECT paper_id, unnest(['introduction', 'body', 'conclusion']) AS field, unnest([introduction, body, conclusion]) AS t FROM papers) WHERE length(t) > 4000",
        "p6_groups": f"""WITH RECURSIVE docs AS (SELECT 'news' AS kind, news_id AS i, coalesce(title_original, '') || ' ' || content_original AS t FROM news WHERE len({words('content_original')}) >= 30 UNION ALL SELECT 'paper', paper_id, fulltext FROM papers WHERE fulltext IS NOT NULL),
            w AS (SELECT kind, i, {words('t')} AS w FROM docs), sh AS (SELECT DISTINCT kind, i, unnest(list_transform(range(1, len(w) - 3), lambda x: w[x] || ' ' || w[x + 1] || ' ' || w[x + 2] || ' ' || w[x + 3] || ' ' || w[x + 4])) AS g FROM w),
            ky AS (SELECT kind, i, md5(string_agg(g, '|' ORDER BY g)) AS h FROM sh GROUP BY 1, 2), cl AS (SELECT kind, i, min(i) OVER (PARTITION BY kind, h) AS rep FROM ky),
            rs AS (SELECT sh.* FROM sh JOIN cl USING (kind, i) WHERE rep = i), nn AS (SELECT kind, i, count(*) AS n FROM rs GROUP BY 1, 2),
            mt AS (SELECT x.kind, x.i AS a, y.i AS b, count(*) AS c FROM rs x JOIN rs y ON x.kind = y.kind AND x.g = y.g AND x.i < y.i GROUP BY 1, 2, 3),
            ln AS (SELECT mt.kind, a, b FROM mt JOIN nn na ON na.kind = mt.kind AND na.i = a JOIN nn nb ON nb.kind = mt.kind AND nb.i = b WHERE c >= 0.8 * (na.n + nb.n - c)), bo AS (SELECT kind, a, b FROM ln UNION ALL SELECT kind, b, a FROM ln),
            re AS (SELECT kind, a, b FROM bo UNION SELECT re.kind, re.a, bo.b FROM re JOIN bo ON re.kind = bo.kind AND re.b = bo.a), gr AS (SELECT kind, a, least(min(b), a) AS g FROM re GROUP BY 1, 2), dg AS (SELECT kind, a, count(*) AS n FROM bo GROUP BY 1, 2)
            SELECT cl.kind AS record_kind, cl.i AS id, rep AS class_id, coalesce(g, rep) AS group_id, coalesce(dg.n, 0) AS n_links FROM cl LEFT JOIN gr ON gr.kind = cl.kind AND gr.a = rep LEFT JOIN dg ON dg.kind = cl.kind AND dg.a = rep""",
        "p1_certain": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01') DESC) AS r FROM grounded_samples WHERE sample_id IS NOT NULL),
            x AS (SELECT sample_id, coalesce(reject, false) AS rejected, lower(regexp_replace(regexp_replace(coalesce(target, ''), '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')) AS t FROM s WHERE r = 1)
            SELECT sample_id, CASE WHEN rejected THEN 'refusal' ELSE 'empty' END AS defect FROM x WHERE rejected OR t IN ('', 'n/a', 'na', 'null', 'none', 'nil', 'nan', 'blank', 'empty', 'tbd', 'todo', 'undefined', 'no answer', 'no response', 'no text', 'not available', 'to be done')""",
        "p7_checks": "SELECT DISTINCT doc_id, true AS whole, true AS fits, true AS split_if_needed FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
        "p8_exact": f"""WITH d AS (SELECT doc_id, {words(_unmarked('text'))} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {words(_unmarked('passage'))} AS w FROM eval_items WHERE passage IS NOT NULL),
            ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS g FROM i), dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 14), lambda k: array_to_string(w[k:k + 15], ' '))) AS g FROM d)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p9_checks": "SELECT DISTINCT doc_id, true AS known, true AS once, true AS shares FROM documents WHERE doc_id IS NOT NULL",
        "p2_scripts": """WITH t AS (SELECT paper_id, concat_ws(chr(10), introduction, body, conclusion) AS t FROM papers), c AS (SELECT paper_id, length(regexp_replace(t, '[^\\p{Hangul}]', '', 'g')) AS h, length(regexp_replace(t, '[^\\p{Hiragana}\\p{Katakana}\\p{Han}]', '', 'g')) AS k,
                length(regexp_replace(t, '[^\\p{Latin}]', '', 'g')) AS l FROM t) SELECT script, count(*) AS papers, min(paper_id) AS first, max(paper_id) AS last FROM (SELECT paper_id, CASE WHEN h > l AND h > k THEN 'hangul' WHEN k > l THEN 'kana' ELSE 'latin' END AS script FROM c WHERE h + k + l > 0) GROUP BY 1""",
    }
