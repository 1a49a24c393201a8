"""The registered queries' results in SQL (DuckDB's dialect), written from their definitions."""

from __future__ import annotations

# Fixed values, stated anew here: what the queries are asked with.
CORE = r"fans?\b|followers"
CONTEXTS = {"platforms": r"online groups|posts", "performance": r"\btour\b|concert", "commerce": r"market|prices", "learning": r"students|teachers"}
LEAST_SECTION = {"introduction": 300, "body": 1000, "conclusion": 200}

_RESOLVER = r"(?:(?:www|dx)\.)*doi\.(?:example|org)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def doi(c: str) -> str:
    x = (
        f"lower(regexp_replace(regexp_replace(url_decode(lower(regexp_replace({c}, '\\s+', '', 'g'))), "
        f"'^(?:https?://)?(?:{_RESOLVER}/)?(?:doi:)?', ''), '\\s+', '', 'g'))"
    )
    return f"CASE WHEN regexp_matches({x}, '^10\\.[0-9]{{4,9}}/.+') THEN {x} END"


def url(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({c}), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '')"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    params = (
        f"array_to_string(list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), "
        "lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(?:utm_[^=]*|fbclid|gclid)(?:=|$)'))), '&')"
    )
    return f"CASE WHEN regexp_matches({host}, '^[^\\s.]+(?:\\.[^\\s.]+)+$') THEN {host} || {path} || CASE WHEN {params} <> '' THEN '?' || {params} ELSE '' END END"


def url_or_doi(c: str) -> str:
    inner = f"regexp_replace({c}, '[?#].*$', '')"
    return f"coalesce('doi:' || CASE WHEN regexp_matches({c}, '(?i)^\\s*(?:https?://)?{_RESOLVER}/') THEN {doi(inner)} END, 'url:' || {url(c)})"


def sha(c: str) -> str:
    x = f"lower(trim({c}))"
    return f"CASE WHEN regexp_matches({x}, '^[0-9a-f]{{64}}$') AND {x} <> sha256('') AND len(list_distinct(string_split({x}, ''))) > 1 THEN {x} END"


def title(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"


def terms(c: str) -> str:
    from .oracle_training import _STOP

    stop = ", ".join(_quoted(w) for w in _STOP.split())
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]{{4,}}')), lambda w: NOT list_contains([{stop}], w))"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def _held(table: str, key: str) -> str:
    """CTEs ending in held(chunk_id, owner, vec_id): chunk c belongs to the c-th owner and has the c-th vector, both lists being gone round as often as needed."""
    return f"""w AS (SELECT {key} AS owner, row_number() OVER (ORDER BY {key}) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table} WHERE {key} IS NOT NULL)),
        v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)),
        held AS (SELECT c AS chunk_id, owner, vec_id FROM range((SELECT greatest((SELECT count(*) FROM w), (SELECT count(*) FROM v)))) t(c) JOIN w ON w.p = c % w.n JOIN v ON v.p = c % v.n)"""


_PAIRS = """pairs AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)"""


def _hits(k: int = 40) -> str:
    """CTEs ending in h(query_id, chunk_id, owner, similarity): each query's k nearest chunks of papers."""
    return f"""{_held('papers', 'paper_id')}, {_PAIRS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM pairs) WHERE r <= {k}),
        h AS (SELECT query_id, chunk_id, owner, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id, chunk_id) AS k FROM near JOIN held USING (vec_id)) WHERE k <= {k})"""


_CHECKED = """x AS (SELECT query_id, owner, max(similarity) AS best, count(*) AS n FROM h JOIN papers ON paper_id = owner WHERE length(abstract) > 0 GROUP BY 1, 2),
            y AS (SELECT query_id, count(*) AS p, count(*) FILTER (best >= 0.45) AS rel, sum(n)::BIGINT AS c FROM x GROUP BY 1),
            z AS (SELECT q.query_id, coalesce(p, 0) AS evidence_papers, coalesce(rel, 0) AS relevant_papers, coalesce(c, 0) AS evidence_chunks FROM (SELECT DISTINCT query_id FROM h) q LEFT JOIN y USING (query_id)),
            r AS (SELECT *, array_to_string(list_filter([CASE WHEN evidence_papers < 3 THEN 'evidence_papers' END, CASE WHEN relevant_papers < 2 THEN 'relevant_papers' END,
                CASE WHEN evidence_chunks < 4 THEN 'evidence_chunks' END], lambda v: v IS NOT NULL), ',') AS reasons FROM z)"""


def _related(seeds: str) -> str:
    """CTEs ending in rel(q, related, relation_score, relation_paths, rank): papers within two hops over keywords of any seed of a set, from seeds(q, seed). Papers have no edges of the other kinds."""
    return f"""{_EDGES}, ku AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'HAS_KEYWORD' UNION ALL SELECT dst, src FROM edges WHERE type = 'HAS_KEYWORD'), sd AS (SELECT DISTINCT q, seed FROM ({seeds})),
        hop AS (SELECT q, x.b AS related, 'HAS_KEYWORD' AS path FROM sd JOIN ku x ON x.a = seed UNION ALL SELECT q, y.b, 'HAS_KEYWORD>HAS_KEYWORD' FROM sd JOIN ku x ON x.a = seed JOIN ku y ON y.a = x.b),
        cnt AS (SELECT q, related, count(*) AS relation_score, array_to_string(list_sort(list(DISTINCT path)), ',') AS relation_paths FROM hop WHERE starts_with(related, 'Paper:') AND (q, related) NOT IN (SELECT (q, seed) FROM sd) GROUP BY 1, 2),
        rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY relation_score DESC, related)::INT AS rank FROM cnt) WHERE rank <= 10)"""


_EDGES = """edges AS (
        SELECT DISTINCT 'Author:' || trim(a) AS src, 'Paper:' || paper_id AS dst, 'WRITTEN_BY' AS type FROM (
            SELECT paper_id, unnest(CASE WHEN starts_with(trim(authors), '[') THEN from_json(authors, '["VARCHAR"]') ELSE string_split(authors, ';') END) AS a FROM papers
            WHERE authors IS NOT NULL) WHERE trim(a) <> ''
        UNION SELECT 'Paper:' || paper_id, 'Keyword:' || trim(k), 'HAS_KEYWORD' FROM (SELECT paper_id, unnest(keywords) AS k FROM papers) WHERE trim(k) <> ''
        UNION SELECT 'Paper:' || paper_id, 'Source:' || trim(source), 'PUBLISHED_BY' FROM papers WHERE trim(source) <> '')"""


def _flags() -> str:
    lows = ", ".join(f"CASE WHEN length(coalesce({n}, '')) < {m} THEN 'missing_or_short_{n}' END" for n, m in LEAST_SECTION.items())
    tw = "list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}_]{3,}'))"
    fw = "list_distinct(regexp_extract_all(lower(left(coalesce(fulltext, ''), 12000)), '[\\p{L}\\p{N}_]{3,}'))"
    return f"""list_filter([CASE WHEN length(coalesce(fulltext, '')) < 5000 THEN 'insufficient_fulltext' END,
        CASE WHEN len({tw}) > 0 AND len(list_intersect({tw}, {fw})) / len({tw}) < 0.6 THEN 'source_title_mismatch' END, {lows},
        CASE WHEN (length(coalesce(fulltext, '')) - length(replace(coalesce(fulltext, ''), chr(65533), ''))) / greatest(length(coalesce(fulltext, '')), 1) > 0.005
            THEN 'text_encoding_damage' END], lambda x: x IS NOT NULL)"""


def _relevance() -> str:
    both = "(coalesce(title, '') || ' ' || coalesce(abstract, ''))"
    has = lambda c, p: f"regexp_matches({c}, {_quoted('(?i)' + p)})"
    topics = "list_filter([" + ", ".join(f"CASE WHEN {has(both, p)} THEN '{n}' END" for n, p in CONTEXTS.items()) + "], lambda x: x IS NOT NULL)"
    named = " + ".join(f"{has(chr(34) + 't' + chr(34), p)}::INT" for p in CONTEXTS.values())
    return f"""SELECT paper_id, (CASE WHEN fits THEN 5 * {has('t', CORE)}::INT + len(topics) + {named} ELSE 0 END)::INT AS score,
        CASE WHEN fits THEN array_to_string(topics, ',') ELSE '' END AS topics
        FROM (SELECT paper_id, coalesce(title, '') AS t, {topics} AS topics, {has(both, CORE)} AND len({topics}) > 0 AS fits FROM papers)"""


def _sentences() -> str:
    from .oracle_training import _METADATA

    meta = _quoted("(?i)" + "|".join(f"(?:{p})" for p in _METADATA))
    t = "trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'))"
    t = f"regexp_replace({t}, '\\[(?:\\d+[\\s,;–-]*)+\\]', '', 'g')"
    t = f"regexp_replace({t}, '\\([^)]*\\b(?:19|20)\\d{{2}}[a-z]?[^)]*\\)', '', 'g')"
    parts = f"string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""WITH f AS (SELECT paper_id, unnest(['introduction', 'body', 'conclusion']) AS section, unnest([introduction, body, conclusion]) AS t FROM papers),
        s AS (SELECT paper_id, section, trim(regexp_replace(unnest({parts}), '\\s+', ' ', 'g')) AS s FROM f),
        m AS (SELECT *, len(string_split(s, ' ')) AS n, len(list_filter(string_split(s, ' '), lambda w: regexp_matches(w, '\\d'))) AS digits,
            length(s) - length(regexp_replace(s, '[a-zA-Z]', '', 'g')) AS letters FROM s WHERE s <> ''),
        ok AS (SELECT * FROM m WHERE n BETWEEN 8 AND 70 AND regexp_matches(s, '[.!?]["''”’]?\\s*$') AND NOT regexp_matches(s, '(?:\\.{{3,}}|[_=]{{3,}}|\\s[,;:]\\s[,;:])')
            AND NOT (digits >= 4 AND digits / n >= 0.12) AND letters / length(s) > 0.55 AND NOT regexp_matches(s, {meta}))
        SELECT f.paper_id, f.section, count(ok.s)::INT AS sentences, coalesce(sum(ok.n), 0)::INT AS words FROM f LEFT JOIN ok USING (paper_id, section) GROUP BY 1, 2"""


_CATALOGUE = """nm AS (SELECT name, count(DISTINCT paper_id) AS n, min(paper_id) AS first FROM (SELECT paper_id, unnest(list_distinct(regexp_extract_all(coalesce(title, ''), '\\b(?:[A-Z]{3,}|[A-Z][a-z]+[A-Z][A-Za-z]*)\\b'))) AS name FROM papers WHERE paper_id IS NOT NULL) GROUP BY 1),
        ce AS (SELECT CASE WHEN regexp_matches(name, '^[A-Z]+$') THEN 'Group' ELSE 'Platform' END AS entity_type, name, [name] || CASE WHEN lower(name) <> name THEN [lower(name)] ELSE [] END AS aliases FROM nm WHERE n >= 3),
        ci AS (SELECT lower(entity_type) || '_' || sha256('https://names.example/' || name)[:24] AS entity_id, entity_type, name, aliases FROM ce),
        al AS (SELECT alias, CASE WHEN count(DISTINCT entity_id) = 1 THEN min(entity_id) END AS entity_id, CASE WHEN count(DISTINCT entity_id) = 1 THEN min(entity_type) END AS entity_type, CASE WHEN count(DISTINCT entity_id) = 1 THEN min(name) END AS canonical_name
            FROM (SELECT lower(unnest(aliases)) AS alias, entity_id, entity_type, name FROM ci) GROUP BY 1)"""


def _mentioned(table: str, key: str, text: str) -> str:
    """The catalogue's names of one Latin word among a text's words."""
    return f"""SELECT DISTINCT {key}, alias, entity_id, entity_type, canonical_name, CASE WHEN entity_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN entity_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
        FROM (SELECT {key}, unnest(list_distinct(regexp_split_to_array(lower({text}), '[^a-z0-9가-힣]+'))) AS alias FROM {table}) JOIN al USING (alias)"""


_NEWS_TEXT, _PAPER_TEXT = "concat_ws(chr(10), title_original, content_original)", "concat_ws(chr(10), title, abstract, introduction, body, conclusion)"


def _load_checks() -> str:
    tables = (
        ("papers", "paper_id", "source_url", ("title", "source_url"), {"title": 500, "authors": 0, "abstract": 0, "introduction": 0, "body": 0, "conclusion": 0, "keywords": -1, "source": 200, "source_url": 0, "doi": 255, "language": 10}),
        ("news", "news_id", "url", ("title_original", "content_original", "url", "title_en_for_rag", "content_en_for_rag", "published_at"),
         {"original_language": 10, "title_original": 500, "title_en_for_rag": 500, "content_original": 0, "content_en_for_rag": 0, "source": 200, "url": 0, "category": 100, "keywords": -1}),
    )
    out = []
    for name, key, link, required, columns in tables:
        found = [f"CASE WHEN coalesce({c}::VARCHAR, '') = '' THEN '{c}:required' END" for c in required]
        for c, most in columns.items():
            value = f"coalesce({doi('doi')}, lower(doi))" if c == "doi" else c
            found.append(f"CASE WHEN contains({'array_to_string(' + c + ', chr(1))' if most < 0 else value}, chr(0)) THEN '{c}:nul' END")
            if most > 0:
                found.append(f"CASE WHEN length({value}) > {most} THEN '{c}:length' END")
        found.append(f"CASE WHEN NOT regexp_matches({link}, '(?i)^\\s*https?://[^/?#@\\s]+(?:[/?#]|\\s*$)') THEN '{link}:url' END")
        out.append(f"SELECT '{name}' AS kind, {key} AS id, array_to_string(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL), ',') AS errors FROM {name}")
    return f"SELECT * FROM ({' UNION ALL '.join(out)}) WHERE errors <> ''"


def first_come(order: str) -> str:
    """CTEs ending in led(id, retained_id), from rows(id, own) and keys(id, place, key): each follows the one before it, in the order (columns of rows), by its first key that one before has."""
    return f"""ky AS (SELECT id, own, place, lag(id) OVER (PARTITION BY place, key ORDER BY {order}) AS prev FROM keys JOIN rows USING (id) WHERE key IS NOT NULL),
        st AS (SELECT id, arg_min(prev, place) AS nxt FROM ky WHERE prev IS NOT NULL AND NOT own GROUP BY 1),
        ch AS (SELECT id, id AS cur FROM rows UNION ALL SELECT ch.id, st.nxt FROM ch JOIN st ON ch.cur = st.id),
        led AS (SELECT id, cur AS retained_id FROM ch WHERE cur NOT IN (SELECT id FROM st))"""


def _pages() -> str:
    from .oracle_training import composed

    fields = ("abstract", "introduction", "body", "conclusion")
    printed = ", ".join(f"coalesce(source, 'Printed') || ' {i}' || chr(10) || coalesce({composed(f)}, '') || chr(10) || 'Page {i} of 4'" for i, f in enumerate(fields, 1))
    layout = "|".join((r"^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$", r"^(?:[PE]-)?ISSN[-\s\w:.,\d]+$", r"^(?:https?://(?:dx\.)?doi\.org/|doi\s*[:：]|\*?\s*corresponding author[,;:]|downloaded from\b|©|copyright\s+\d{4})"))
    return f"""WITH pg AS (SELECT paper_id, unnest([1, 2, 3, 4]) AS page, unnest([{printed}]) AS t FROM papers),
        ln AS (SELECT paper_id, page, generate_subscripts(x, 1) AS i, trim(regexp_replace(unnest(x), '\\s+', ' ', 'g')) AS l FROM (SELECT paper_id, page, string_split_regex(t, '\\r\\n|[\\n\\r]') AS x FROM pg)),
        lk AS (SELECT *, regexp_replace(l, '\\d+', '#', 'g') AS k FROM ln),
        eg AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY i) AS a, row_number() OVER (PARTITION BY paper_id, page ORDER BY i DESC) AS z FROM lk WHERE l <> ''),
        rc AS (SELECT paper_id, k FROM eg WHERE a <= 5 OR z <= 5 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3 AND length(k) < 180),
        kp AS (SELECT *, (paper_id, k) IN (SELECT (paper_id, k) FROM rc) OR regexp_matches(l, '(?i){layout.replace("'", "''")}') OR (contains(l, '@') AND length(l) < 180 AND regexp_matches(l, '\\b[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}\\b')) AS gone FROM lk),
        pt AS (SELECT paper_id, page, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t, count(*) FILTER (gone) AS removed FROM kp GROUP BY 1, 2),
        dt AS (SELECT paper_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS t, sum(removed)::INT AS removed_lines FROM pt GROUP BY 1),
        rt AS (SELECT paper_id, removed_lines, string_split_regex(regexp_replace(regexp_replace(t, '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '([a-z,;])\\n([a-z])', '\\1 \\2', 'g'), '\\n\\s*\\n') AS g FROM dt),
        pa AS (SELECT paper_id, removed_lines, generate_subscripts(g, 1) AS i, unnest(g) AS p FROM rt), pk AS (SELECT *, lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS k FROM pa),
        pr AS (SELECT *, length(k) >= 80 AND row_number() OVER (PARTITION BY paper_id, k ORDER BY i) > 1 AS again FROM pk)
        SELECT paper_id, md5(coalesce(string_agg(regexp_replace(regexp_replace(p, '^\\s+', ''), '\\s+$', ''), chr(10) || chr(10) ORDER BY i) FILTER (k <> '' AND NOT again), '')) AS digest, removed_lines, count(*) FILTER (again)::INT AS removed_paragraphs FROM pr GROUP BY paper_id, removed_lines"""


# Fixed values, stated anew here: headings of sections.
_HEADINGS = (
    ("abstract", "abstract|abstrak|초록|요약"), ("introduction", "introduction|preface|서론|서 론|pendahuluan"),
    ("conclusion", "conclusions?(?: and (?:discussion|implications|recommendations?|research limitations|future work))?|discussion and conclusions?|결론(?: 및 제언)?|결 론|(?:kesimpulan|simpulan)(?: dan saran)?|penutup"),
    ("references", "references|bibliography|works cited|literature cited|참고문헌|참고 문헌|daftar pustaka|referensi"), ("appendix", "appendix(?: [A-Z])?|appendices|supplementary material|supporting information|부록"),
    ("backmatter", "acknowledg(?:e)?ments?|funding|disclosure statement|conflict(?:s)? of interest|notes|endnotes"), ("keywords", "keywords?|key words|kata[- ]kata kunci|kata kunci|주제어|핵심어"),
    ("literature_review", "literature review|review of (?:the )?literature|related work|previous studies|background and related work|선행연구|선행 연구"), ("background", "(?:theoretical|conceptual) (?:framework|background)|background|이론적 배경"),
    ("methodology", "research (?:method|design|methodology)s?|methods?|methodology|materials and methods|연구 방법|연구방법|metode(?: penelitian)?"), ("results", "results?|experimental results|findings|연구 결과|연구결과|hasil"),
    ("discussion", "(?:results?|findings) and discussion|discussion(?: and implications)?|implications|논의|pembahasan|hasil dan pembahasan"), ("other", "case study|case\\s+\\d+|example"),
)


def _sections() -> str:
    """Lines are numbered and classified as rows; a section's lines are those up to the next heading."""
    number = r"^(?:\d{1,2}(?:\.\d{1,2}){0,3}[.)]?\s+|[IVX]+[.)]\s+|[A-H][.)]\s+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][.\s]*)"
    known = " ".join(f"WHEN regexp_matches(b, '(?i)^(?:{p})(?:\\s*[:：]\\s*[^.!?]+)?$') THEN '{k}'" for k, p in _HEADINGS)
    small = "'a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with'"
    parts = "'Abstract', abstract, '1. Introduction', introduction, 'Figure 1. What was seen', '1.1 The Scope of It', title, '2. Methods', 'Table 2', 'Source: own figures', body, '3. Conclusion', conclusion, 'References', source_url, 'Appendix A', doi"
    strip = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
    of = lambda name, cond: f"string_agg(t, chr(10) || chr(10) ORDER BY j) FILTER ({cond} AND t <> '') AS {name}"
    return f"""WITH ln AS (SELECT paper_id, generate_subscripts(x, 1) AS i, unnest(x) AS l FROM (SELECT paper_id, string_split_regex(concat_ws(chr(10), {parts}), '\\r\\n|[\\n\\r]') AS x FROM papers)),
        hd AS (SELECT *, {strip("regexp_replace(" + strip('l') + ", '^#+', '')")} AS h FROM ln),
        nb AS (SELECT *, regexp_replace({strip(f"regexp_replace(h, '{number}', '')")}, ':+$', '') AS n FROM hd),
        br AS (SELECT *, CASE WHEN NOT (right(n, 1) = '.' AND n = lower(n) AND n <> upper(n)) THEN regexp_replace(regexp_replace(n, '\\.+$', ''), '\\s+\\d{{1,2}}$', '') END AS b, h <> '' AND length(h) <= 140 AND len(string_split_regex(h, '\\s+')) <= 18
            AND NOT regexp_matches(h, '(?i)https?://|\\bISSN\\b|\\bISBN\\b|\\bDOI\\b|@') AS fits FROM nb),
        wd AS (SELECT *, regexp_extract_all(b, '[A-Za-z]+(?:[-''][A-Za-z]+)*') AS w, list_filter(regexp_extract_all(b, '[A-Za-z]+(?:[-''][A-Za-z]+)*'), lambda x: lower(x) NOT IN ({small})) AS big FROM br),
        kd AS (SELECT *, CASE WHEN NOT fits OR b IS NULL THEN NULL {known} WHEN NOT regexp_matches(b, '[.!?]$|[,;%=]|\\d') AND len(string_split_regex(trim(b), '\\s+')) <= 12
            AND ((regexp_matches(h, '{number}') AND len(big) > 0 AND len(list_filter(big, lambda x: regexp_matches(x, '^[A-Z]'))) / len(big) >= 0.65) OR (b = upper(b) AND b <> lower(b) AND len(w) >= 2 AND length(b) >= 10)) THEN 'other' END AS kind FROM wd),
        ix AS (SELECT *, count(kind) OVER (PARTITION BY paper_id ORDER BY i) AS j, regexp_matches({strip('l')}, '(?i)^(?:fig(?:ure)?\\.?|table)\\s+\\d+[A-Za-z]?(?:[.:]\\s*.*)?$') AS cap, regexp_matches({strip('l')}, '(?i)^(?:source|note)\\s*[:：]\\s*.{{0,200}}$') AS note FROM kd),
        cn AS (SELECT *, max(CASE WHEN NOT note OR kind IS NOT NULL THEN i END) OVER (PARTITION BY paper_id, j ORDER BY i) AS anchor FROM ix),
        ca AS (SELECT a.*, kind_of.cap AND kind_of.kind IS NULL AS gone FROM cn a LEFT JOIN ix kind_of ON kind_of.paper_id = a.paper_id AND kind_of.i = a.anchor),
        sc AS (SELECT paper_id, j, max(kind) AS kind, max({strip('l')}) FILTER (kind IS NOT NULL) AS head, {strip("coalesce(string_agg(CASE WHEN kind IN ('abstract', 'keywords') THEN regexp_extract(l, '^[^:：]*[:：](.*)$', 1) WHEN kind IS NULL THEN l END, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '')")} AS t,
            list({strip('l')} ORDER BY i) FILTER (coalesce(gone, false)) AS caps FROM ca WHERE j > 0 GROUP BY 1, 2),
        ty AS (SELECT s.*, (SELECT arg_max(x.kind, x.j) FROM sc x WHERE x.paper_id = s.paper_id AND x.j < s.j AND regexp_extract(s.head, '^(\\d+)\\.\\d', 1) <> '' AND regexp_extract(x.head, '^(\\d+)[.)]?\\s', 1) = regexp_extract(s.head, '^(\\d+)\\.\\d', 1)) AS owner FROM sc s),
        tt AS (SELECT *, CASE WHEN kind = 'other' AND owner IN ('introduction', 'literature_review', 'background', 'methodology', 'results', 'discussion', 'conclusion') THEN owner ELSE kind END AS st FROM ty),
        b1 AS (SELECT paper_id, min(j) FILTER (kind = 'introduction') AS ji, max(j) + 1 AS e FROM tt GROUP BY 1),
        b2 AS (SELECT paper_id, ji, e, min(j) FILTER (kind = 'conclusion' AND (ji IS NULL OR j > ji)) AS jc, min(j) FILTER (kind IN ('references', 'appendix', 'backmatter') AND j > ji) AS jt, min(j) FILTER (kind = 'references') AS jr, max(j) FILTER (kind = 'abstract' AND (ji IS NULL OR j < ji)) AS ja,
            regexp_extract(max(head) FILTER (j = ji), '^(\\d+)\\.', 1) AS major FROM tt JOIN b1 USING (paper_id) GROUP BY 1, 2, 3),
        b3 AS (SELECT b2.paper_id, any_value(ji) AS ji, any_value(e) AS e, any_value(jc) AS jc, coalesce(any_value(jt), any_value(e)) AS jt, any_value(jr) AS jr, any_value(ja) AS ja, least(coalesce(any_value(jc), any_value(e)), coalesce(any_value(jt), any_value(e))) AS stop,
            min(j) FILTER (kind IN ('literature_review', 'background', 'methodology', 'results', 'discussion', 'other') AND j > ji AND j < least(coalesce(jc, e), coalesce(jt, e)) AND NOT (coalesce(major, '') <> '' AND regexp_extract(head, '^(\\d+)\\.\\d', 1) = major)) AS jb,
            min(j) FILTER (kind IN ('references', 'appendix', 'backmatter') AND j > jc) AS jce, min(j) FILTER (kind IN ('appendix', 'backmatter') AND j > jr) AS jre FROM b2 JOIN tt USING (paper_id) GROUP BY 1),
        al AS (SELECT paper_id, max(t) FILTER (j = ja) AS abstract, {of('introduction', 'j >= ji AND j < coalesce(jb, jc, jt)')}, {of('body', 'j >= jb AND j < stop')}, {of('conclusion', 'j >= jc AND j < coalesce(jce, e)')}, {of('refs', 'j >= jr AND j < coalesce(jre, e)')},
            {of('appendix', "kind = 'appendix'")}, array_to_string(flatten(list(coalesce(caps, []) ORDER BY j)), '|') AS captions, string_agg(st, ',' ORDER BY j) AS types FROM tt JOIN b3 USING (paper_id) GROUP BY 1)
        SELECT paper_id, md5(abstract) AS abstract, md5(introduction) AS introduction, md5(body) AS body, md5(conclusion) AS conclusion, md5(refs) AS "references", md5(appendix) AS appendix, captions, types FROM al"""


def _numbers(c: str) -> str:
    """Distinct numbers that stand alone in a text, without thousands commas: RE2 has no look-around, so the text is cut at what no number and no word has."""
    return f"list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_.,%]+', ' ', 'g'), ' '), lambda w: regexp_extract(w, '^[.,%]*((?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?%?)[.,%]*$', 1)), lambda w: w <> ''), lambda w: replace(w, ',', '')))"


def _tidy(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def _tidy_nfkc(c: str) -> str:
    from .oracle_training import composed

    return f"trim(regexp_replace({composed(c)}, '\\s+', ' ', 'g'))"


def _plain_html(c: str) -> str:
    x = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    from . import oracle_training

    bare = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
    lines = "list_filter(list_transform(string_split_regex(content_original, '\\r\\n|[\\n\\r\\x{2028}\\x{2029}]'), lambda x: trim(regexp_replace(x, '[\\t ]+', ' ', 'g'))), lambda x: x <> '')"
    content = "regexp_replace(lower(fulltext), '[^\\p{L}\\p{N}]+', '', 'g')"
    return {
        "identity_keys": f"SELECT paper_id, {doi('doi')} AS doi_key, {url_or_doi('source_url')} AS url_key, {sha('content_hash')} AS hash_key, {title('title')} AS title_key FROM papers",
        "news_url_keys": f"SELECT url_key, count(*) AS deliveries, min(news_id) AS first_id FROM (SELECT news_id, {url('url')} AS url_key FROM news) WHERE url_key IS NOT NULL GROUP BY url_key",
        "paper_quality_flags": f"SELECT paper_id, array_to_string({_flags()}, ',') AS flags FROM papers",
        "paper_relevance": _relevance(),
        "abstract_round_trip": """WITH a AS (SELECT paper_id, list_filter(string_split_regex(trim(abstract), '\\s+'), lambda w: w <> '') AS w FROM papers)
            SELECT paper_id, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS abstract, CASE WHEN len(w) > 0 THEN len(list_distinct(w))::INT END AS n_words FROM a""",
        "sample_support": f"""SELECT DISTINCT sample_id, round(len(list_intersect(own, theirs)) / greatest(len(own), 1), 6) AS support FROM (
            SELECT sample_id, {terms('target')} AS own, {terms("array_to_string(list_concat(coalesce(paper_evidence, []), coalesce(news_evidence, [])), ' ')")} AS theirs FROM grounded_samples)""",
        "training_sentence_counts": _sentences(),
        "vector_search": """SELECT query_id, vec_id, round(s, 6) AS similarity, r::INT AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id AS vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS r
            FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE r <= 10""",
        "graph_edges": f"WITH {_EDGES} SELECT src, dst, type FROM edges",
        "graph_nodes": f"""WITH {_EDGES} SELECT id, string_split(id, ':')[1] AS label, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id""",
        "article_cleaning": f"""SELECT news_id, md5(array_to_string(CASE WHEN len({lines}) > 0 AND {bare(lines + '[1]')} = {bare('title_original')} THEN {lines}[2:] ELSE {lines} END, chr(10))) AS digest FROM news""",
        "allocated_ids": "SELECT openalex_id, (SELECT coalesce(max(paper_id), 0) FROM papers) + row_number() OVER (ORDER BY openalex_id) AS paper_id FROM (SELECT DISTINCT openalex_id FROM raw_papers WHERE openalex_id IS NOT NULL)",
        "unsynced_documents": "SELECT 'papers' AS kind, source, count(*) AS n FROM papers WHERE NOT coalesce(graph_synced, false) GROUP BY source UNION ALL SELECT 'news', source, count(*) FROM news WHERE NOT coalesce(graph_synced, false) GROUP BY source",
        "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "raw_existing_match": f"""WITH q AS (SELECT openalex_id, 0 AS place, 'doi' AS reason, {doi('doi')} AS key FROM raw_papers UNION ALL SELECT openalex_id, 1, 'source_url', {url_or_doi('url')} FROM (SELECT openalex_id, unnest(source_locations).url AS url FROM raw_papers)
                UNION ALL SELECT openalex_id, 2, 'openalex_id', upper(openalex_id) FROM raw_papers),
            k AS (SELECT DISTINCT reason, key FROM (SELECT 'doi' AS reason, {doi('doi')} AS key FROM papers UNION ALL SELECT 'source_url', {url_or_doi('source_url')} FROM papers UNION ALL SELECT 'openalex_id', upper(openalex_id) FROM papers
                UNION ALL SELECT 'openalex_id', nullif(upper(regexp_extract(c, '(?i)(?:https?://)?openalex\\.(?:example|org)/(W[0-9]+)', 1)), '') FROM (SELECT unnest([openalex_id, source_url]) AS c FROM papers)))
            SELECT r.openalex_id, arg_min(q.reason, q.place) FILTER (k.key IS NOT NULL) AS reason FROM (SELECT DISTINCT openalex_id FROM raw_papers WHERE openalex_id IS NOT NULL) r LEFT JOIN q ON q.openalex_id = r.openalex_id LEFT JOIN k ON k.reason = q.reason AND k.key = q.key GROUP BY 1""",
        "paper_quality_state": f"""WITH a AS (SELECT *, CASE WHEN length(fulltext) > 0 THEN {content} END AS key FROM papers WHERE paper_id IS NOT NULL),
            b AS (SELECT *, coalesce(paper_id > min(paper_id) OVER (PARTITION BY key) AND key IS NOT NULL, false) AS is_repeat, list_concat({_flags()}, list_filter([
                CASE WHEN language IS NULL OR language_detection_confidence IS NULL OR language_detection_confidence < 0.9 THEN 'language_needs_review' WHEN language <> 'en' THEN 'non_english_fulltext' END,
                CASE fulltext_status WHEN 'unavailable' THEN 'source_not_acquired' WHEN 'extraction_failed' THEN 'extraction_failed' END, CASE WHEN coalesce(length(fulltext), 0) = 0 THEN 'no_extracted_text' END], lambda x: x IS NOT NULL)) AS f FROM a),
            c AS (SELECT *, coalesce(language = 'en' AND language_detection_confidence >= 0.9, false) AS sure, coalesce(language_metadata = 'en', false) AS english FROM b),
            e AS (SELECT *, round(greatest(0.0, 1.0 - least(0.75, len(f) * 0.15) - CASE WHEN sure THEN 0 ELSE 0.15 END - CASE WHEN english THEN 0 ELSE 0.1 END)::DOUBLE, 2) AS s0,
                CASE WHEN list_has_any(f, ['source_not_acquired', 'extraction_failed', 'source_title_mismatch', 'no_extracted_text']) THEN 'rejected' WHEN len(f) = 0 AND sure AND english THEN 'ready' ELSE 'review_required' END AS st FROM c)
            SELECT paper_id, is_repeat, array_to_string(CASE WHEN is_repeat THEN list_append(f, 'duplicate_fulltext') ELSE f END, ',') AS flags, CASE WHEN is_repeat THEN round(greatest(0.0, s0 - 0.15)::DOUBLE, 2) ELSE s0 END AS score,
                CASE WHEN is_repeat THEN 'review_required' ELSE st END AS state FROM e""",
        "unsupported_numbers": f"""WITH x AS (SELECT sample_id, {_numbers("coalesce(target, '')")} AS own, {_numbers("concat_ws(chr(10), title, topic, research_question, array_to_string(list_concat(coalesce(paper_evidence, []), coalesce(news_evidence, [])), chr(10)))")} AS theirs FROM grounded_samples)
            SELECT DISTINCT sample_id, number FROM (SELECT sample_id, unnest(own) AS number, theirs FROM x) WHERE NOT list_contains(theirs, number)""",
        "best_chunk_per_owner": f"""WITH {_held('papers', 'paper_id')}, {_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, owner ORDER BY similarity DESC, chunk_id)::INT AS owner_rank FROM pairs JOIN held USING (vec_id))
            SELECT query_id, owner, chunk_id, owner_rank, round(similarity, 6) AS similarity FROM o WHERE owner_rank <= 2""",
        "news_recency_ranking": f"""WITH {_held('news', 'news_id')}, {_PAIRS}, b AS (SELECT query_id, owner AS news_id, chunk_id, similarity, published_at, row_number() OVER (PARTITION BY query_id, owner ORDER BY similarity DESC, chunk_id) AS o
                FROM pairs JOIN held USING (vec_id) JOIN news ON news_id = owner),
            c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, news_id) AS r FROM b WHERE o = 1),
            s AS (SELECT *, CASE WHEN published_at >= TIMESTAMP '2023-01-01' THEN 1.0 WHEN published_at >= TIMESTAMP '2021-01-01' THEN 0.5 ELSE 0.0 END::DOUBLE AS recency_score FROM c WHERE r <= 20),
            t AS (SELECT *, similarity + recency_score * 0.08::DOUBLE AS score FROM s),
            u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, similarity DESC, news_id)::INT AS news_rank FROM t)
            SELECT query_id, news_id, chunk_id, recency_score, round(score, 6) AS ranking_score, news_rank FROM u WHERE news_rank <= 5""",
        "diversity_ranking": f"""WITH {_hits()}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, owner ORDER BY similarity DESC, chunk_id) - 1 AS seen, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS place FROM h),
            b AS (SELECT *, similarity - 0.015::DOUBLE * least(seen, 4) AS score FROM a) SELECT query_id, owner, chunk_id, round(score, 6) AS diversity_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place)::INT AS final_rank FROM b""",
        "graph_related": f"""WITH {_related("SELECT 'Paper:' || paper_id AS q, 'Paper:' || paper_id AS seed FROM papers WHERE paper_id % 50 = 0")} SELECT q AS seed, related, relation_score, relation_paths, rank FROM rel""",
        "hybrid_fusion": f"""WITH {_hits()}, b AS (SELECT query_id, owner, max(similarity) AS s, arg_max(chunk_id, (similarity, -chunk_id)) AS c FROM h GROUP BY 1, 2), vr AS (SELECT query_id, owner, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c)::INT AS vector_rank FROM b),
            {_related("SELECT query_id AS q, 'Paper:' || owner AS seed FROM vr")}, gr AS (SELECT q AS query_id, replace(related, 'Paper:', '')::BIGINT AS owner, rank AS graph_rank FROM rel),
            f AS (SELECT query_id, owner, vector_rank, graph_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + graph_rank), 0) AS score FROM vr FULL JOIN gr USING (query_id, owner)),
            o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vector_rank NULLS LAST, graph_rank NULLS LAST, owner)::INT AS hybrid_rank FROM f)
            SELECT query_id, owner, vector_rank, graph_rank, round(score, 9) AS rrf_score, hybrid_rank FROM o WHERE hybrid_rank <= 10""",
        "evidence_check": f"""WITH {_hits()}, {_CHECKED} SELECT *, reasons = '' AS can_generate, CASE WHEN reasons = '' THEN 'generate' ELSE 'abstain' END AS action FROM r""",
        "collapsed_papers": f"""WITH {_hits()}, b AS (SELECT query_id, owner, max(similarity) AS s, list(chunk_id ORDER BY similarity DESC, chunk_id) AS c FROM h GROUP BY 1, 2)
            SELECT query_id, owner, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c[1])::INT AS vector_rank, round(s, 6) AS similarity, array_to_string(c, ',') AS chunks FROM b""",
        "live_retrieval": f"""WITH {_hits(5)}, {_related("SELECT query_id AS q, 'Paper:' || owner AS seed FROM h")}, ga AS (SELECT q AS query_id, replace(related, 'Paper:', '')::BIGINT AS owner FROM rel),
            g1 AS (SELECT ga.query_id, chunk_id, owner, list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS similarity FROM ga JOIN held USING (owner) JOIN embeddings e USING (vec_id) JOIN embeddings x ON x.vec_id = ga.query_id),
            g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, owner ORDER BY similarity DESC, chunk_id) AS r FROM g1),
            al AS (SELECT query_id, chunk_id, owner, similarity, 'vector' AS found_by FROM h UNION ALL SELECT query_id, chunk_id, owner, similarity, 'graph' FROM g2 WHERE r <= 2),
            un AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY found_by = 'graph') AS r FROM al) WHERE r = 1),
            a AS (SELECT *, row_number() OVER (PARTITION BY query_id, owner ORDER BY similarity DESC, chunk_id) - 1 AS seen, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS place FROM un),
            b AS (SELECT *, similarity - 0.015::DOUBLE * least(seen, 4) AS score FROM a) SELECT query_id, chunk_id, owner, found_by, round(score, 6) AS diversity_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place)::INT AS final_rank FROM b""",
        "second_retrieval": f"""WITH {_hits(3)}, {_CHECKED}, n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r2 FROM pairs) WHERE r2 <= 12),
            h2 AS (SELECT query_id, chunk_id, owner, similarity FROM (SELECT n2.*, chunk_id, owner, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id, chunk_id) AS k2 FROM n2 JOIN held USING (vec_id)) WHERE k2 <= 12),
            al AS (SELECT *, 1 AS round FROM h UNION ALL SELECT *, 2 FROM h2 WHERE query_id IN (SELECT query_id FROM r WHERE reasons <> ''))
            SELECT query_id, chunk_id, owner, min(round) AS round, round(any_value(similarity), 6) AS similarity FROM al GROUP BY 1, 2, 3""",
        "evidence_texts": f"""WITH {_hits()}, t AS (SELECT query_id, chunk_id, similarity, {_tidy('title')} AS ti, published_year AS y, {_tidy('source')} AS so, {_tidy('doi')} AS di, {_tidy('abstract')} AS c FROM h JOIN papers ON paper_id = owner),
            n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INT AS position FROM t WHERE c <> '')
            SELECT query_id, position, concat_ws(chr(10), '[PAPER ' || position || ']', 'Title: ' || ti, 'Published Year: ' || y, CASE WHEN so <> '' THEN 'Source: ' || so END, CASE WHEN di <> '' THEN 'DOI: ' || di END, 'Evidence:',
                CASE WHEN length(c) > 600 THEN rtrim(left(c, 600)) || '...' ELSE c END) AS evidence FROM n WHERE position <= 5""",
        "graph_context": f"""WITH {_EDGES}, x AS (SELECT CASE WHEN type = 'WRITTEN_BY' THEN dst ELSE src END AS p, type, regexp_replace(CASE WHEN type = 'WRITTEN_BY' THEN src ELSE dst END, '^[A-Za-z]+:', '') AS n FROM edges),
            y AS (SELECT p, array_to_string(list_sort(list(DISTINCT n) FILTER (type = 'WRITTEN_BY')), '|') AS authors, array_to_string(list_sort(list(DISTINCT n) FILTER (type = 'HAS_KEYWORD')), '|') AS keywords, array_to_string(list_sort(list(DISTINCT n) FILTER (type = 'PUBLISHED_BY')), '|') AS sources FROM x GROUP BY 1)
            SELECT paper_id, title, coalesce(y.authors, '') AS authors, coalesce(y.keywords, '') AS keywords, coalesce(y.sources, '') AS sources FROM papers LEFT JOIN y ON p = 'Paper:' || paper_id WHERE paper_id IS NOT NULL""",
        "entity_catalogue": f"WITH {_CATALOGUE} SELECT entity_id, entity_type, name AS canonical_name, array_to_string(aliases, '|') AS aliases, NULL AS problem FROM ci",
        "entity_mentions": f"WITH {_CATALOGUE} {_mentioned('news', 'news_id', _NEWS_TEXT)}",
        "mention_edges": f"""WITH {_CATALOGUE} SELECT DISTINCT 'News:' || news_id AS src, 'Entity:' || entity_id AS dst, 'MENTIONS' AS type FROM ({_mentioned('news', 'news_id', _NEWS_TEXT)}) WHERE entity_id IS NOT NULL
            UNION SELECT DISTINCT 'Paper:' || paper_id, 'Entity:' || entity_id, 'MENTIONS' FROM ({_mentioned('papers', 'paper_id', _PAPER_TEXT)}) WHERE entity_id IS NOT NULL""",
        "name_protection": f"""WITH {_CATALOGUE}, mt AS ({_mentioned('news', 'news_id', _NEWS_TEXT)}), n AS (SELECT news_id, count(*)::INT AS n_names FROM mt WHERE entity_id IS NOT NULL GROUP BY 1)
            SELECT news_id, n_names, md5(lower(content_original)) AS restored FROM n JOIN news USING (news_id) WHERE content_original IS NOT NULL""",
        "korean_titles": """SELECT DISTINCT news_id, trim(s) AS surface FROM (SELECT news_id, unnest(regexp_extract_all(concat_ws(chr(10), title_original, left(content_original, 2000)), '[‘“〈《]([^’”〉》\\n]{2,40})[’”〉》]', 1)) AS s FROM news WHERE lower(trim(original_language)) = 'ko')
            WHERE regexp_matches(s, '[가-힣]')""",
        "load_checks": _load_checks(),
        "content_hashes": f"""SELECT 'papers' AS kind, paper_id AS id, sha256({_tidy_nfkc("coalesce(nullif(fulltext, ''), concat_ws(chr(10), coalesce(title, ''), coalesce(abstract, ''), coalesce(introduction, ''), coalesce(body, ''), coalesce(conclusion, '')))")}) AS content_hash FROM papers
            UNION ALL SELECT 'news', news_id, sha256({_tidy_nfkc("coalesce(content_original, '')")}) FROM news""",
        "load_plan": f"""WITH RECURSIVE a AS (SELECT paper_id AS id, coalesce(graph_synced, false) AS synced, {doi('doi')} AS k0, CASE WHEN trim(source_url) <> '' THEN source_url END AS k1, {sha('content_hash')} AS k2 FROM papers),
            l AS (SELECT id, synced, unnest([0, 1, 2]) AS place, unnest([k0, k1, k2]) AS key FROM a), t AS (SELECT x.id, min(y.id) AS lo, max(y.id) AS hi FROM l x JOIN l y ON x.place = y.place AND x.key = y.key AND NOT x.synced AND y.synced GROUP BY 1),
            rows AS (SELECT a.id, t.id IS NOT NULL AS own FROM a LEFT JOIN t ON t.id = a.id WHERE NOT synced), keys AS (SELECT id, place, key FROM l WHERE NOT synced), {first_come('id')},
            rt AS (SELECT id, (SELECT coalesce(max(id), 0) FROM a WHERE synced) + row_number() OVER (ORDER BY id) AS n FROM led WHERE retained_id = id AND id NOT IN (SELECT id FROM t) AND id IS NOT NULL),
            pl AS (SELECT id, n FROM rt UNION ALL SELECT id, lo FROM t WHERE lo = hi)
            SELECT led.id AS paper_id, CASE WHEN t.lo < t.hi THEN 'conflict' WHEN t.lo IS NOT NULL THEN 'existing' WHEN retained_id <> led.id THEN 'batch_duplicate' ELSE 'insert' END AS action,
                CASE WHEN t.lo < t.hi THEN NULL ELSE coalesce(t.lo, pl.n) END AS target_id FROM led LEFT JOIN t ON t.id = led.id LEFT JOIN pl ON pl.id = retained_id""",
        "embedded_texts": f"""WITH w AS (SELECT paper_id, list_transform({words("coalesce(abstract, '')")}, lambda x: ('0x' || md5(x)[:8])::BIGINT % 16) AS p FROM papers), c AS (SELECT paper_id, list_transform(range(16), lambda b: len(list_filter(p, lambda y: y = b))) AS v FROM w WHERE len(p) > 0),
            u AS (SELECT paper_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c) SELECT w.paper_id, array_to_string(list_transform(v, lambda x: CASE WHEN x = 0 THEN '0.0' ELSE round(x / n, 5)::VARCHAR END), ',') AS embedding FROM w LEFT JOIN u USING (paper_id)""",
        "chunk_index": "SELECT DISTINCT paper_id, true AS embedded, true AS inside, true AS numbered, true AS once FROM papers WHERE paper_id IS NOT NULL AND trim(concat_ws('', abstract, introduction, body, conclusion), ' ' || chr(9) || chr(10) || chr(13)) <> ''",
        "feed_items": f"""WITH i AS (SELECT trim(regexp_replace(coalesce(title_original, ''), '\\s+', ' ', 'g')) AS t, {url('trim(url)')} AS k, published_at AS p, concat_ws(' ', {_plain_html('title_original')}, {_plain_html('content_original')}, array_to_string(coalesce(keywords, []), ' ')) AS x FROM news WHERE news_id IS NOT NULL),
            f AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(x, {_quoted('(?i)' + c)}) THEN '{n}' END" for n, c in CONTEXTS.items())}], lambda v: v IS NOT NULL) AS found FROM i),
            s AS (SELECT found[1] AS category, CASE WHEN k IS NULL OR p IS NULL OR t = '' THEN 'invalid' WHEN p > TIMESTAMP '2026-01-01' OR p < TIMESTAMP '2025-01-01' THEN 'outside_date_window' WHEN len(found) = 0 THEN 'outside_topics' ELSE 'accepted' END AS status FROM f)
            SELECT status, category, count(*) AS n FROM s GROUP BY ALL""",
        "work_records": f"""WITH r AS ({_relevance()}), a AS (SELECT paper_id, list_filter(list_transform(CASE WHEN starts_with(trim(authors), '[') THEN from_json(authors, '["VARCHAR"]') ELSE string_split(authors, ';') END, lambda x: trim(x)), lambda x: x <> '') AS names FROM papers)
            SELECT 'W' || paper_id AS id, trim(title) AS title, published_year, nullif(array_to_string(list_filter(string_split_regex(trim(abstract), '\\s+'), lambda w: w <> ''), ' '), '') AS abstract, {doi('doi')} AS doi, score AS relevance_score,
                coalesce(array_to_string(names, '|'), '') AS authors, coalesce(array_to_string(list_filter(keywords, lambda k: k IS NOT NULL AND k <> ''), '|'), '') AS keywords, replace(r.topics, ',', '|') AS matched_topics, CASE WHEN regexp_matches(source_url, '^https?://') THEN source_url ELSE '' END AS urls
            FROM papers JOIN r USING (paper_id) LEFT JOIN a USING (paper_id) WHERE trim(title) <> '' AND published_year <= 2026 AND score > 0""",
        "news_first_deliveries": f"""SELECT url_key, news_id, epoch(collected_at)::BIGINT AS collected_at FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY collected_at, news_id, url) AS r FROM (SELECT news_id, url, collected_at, {url('url')} AS url_key FROM news) WHERE url_key IS NOT NULL AND collected_at IS NOT NULL) WHERE r = 1""",
        "streamed_deliveries": f"SELECT DISTINCT {url('url')} AS url_key, 1 AS deliveries FROM news WHERE collected_at IS NOT NULL AND {url('url')} IS NOT NULL",
        "news_dedupe": f"""WITH RECURSIVE a AS (SELECT news_id AS id, {url('url')} AS k0, {title('title_original')} AS k1, nullif({bare('content_original')}, '') AS k2 FROM news WHERE news_id IS NOT NULL),
            rows AS (SELECT id, false AS own FROM a), keys AS (SELECT id, unnest([0, 1, 2]) AS place, unnest([k0, k1, k2]) AS key FROM a), {first_come('id')} SELECT id AS news_id, retained_id FROM led""",
        "raw_paper_selection": f"""WITH RECURSIVE a0 AS (SELECT *, list_distinct(list_filter(list_transform(coalesce(source_locations, []), lambda x: x.url), lambda u: u IS NOT NULL)) AS lu FROM raw_papers WHERE openalex_id IS NOT NULL),
            a1 AS (SELECT *, ('0x' || md5(concat_ws('|', openalex_id, title, doi, strftime(retrieved_at, '%Y-%m-%d %H:%M:%S'), strftime(loaded_at, '%Y-%m-%d %H:%M:%S'), array_to_string(coalesce(matched_queries, []), '+'), array_to_string(list_sort(lu), '+')))[:15])::BIGINT AS f FROM a0),
            a AS (SELECT f AS id, any_value(openalex_id) AS w, any_value(title) AS title, any_value(doi) AS doi, any_value(is_oa) AS oa, any_value(relevance_score) AS rel, any_value(matched_queries) AS mq, any_value(lu) AS lu FROM a1 GROUP BY f),
            rows AS (SELECT id, false AS own, -coalesce(oa, false)::INT AS o0, -coalesce(rel, 0) AS o1, w AS o2 FROM a),
            keys AS (SELECT id, unnest([0, 1, 2]) AS place, unnest([upper(w), {title('title')}, {doi('doi')}]) AS key FROM a), {first_come('o0, o1, o2, id')},
            m AS (SELECT retained_id, a.*, b.w AS bw, b.title AS bt FROM led JOIN a ON a.id = led.id JOIN a b ON b.id = retained_id)
            SELECT any_value(bw) AS openalex_id, any_value(bt) AS title, count(*) AS fetches, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(mq, []))))), '|'), '') AS queries, coalesce(array_to_string(list_sort(list_distinct(flatten(list(lu)))), '|'), '') AS urls,
                coalesce(array_to_string(list_sort(list(DISTINCT upper(w)) FILTER (upper(w) <> upper(bw))), '|'), '') AS merged_ids FROM m GROUP BY retained_id""",
        "page_cleaning": _pages(),
        "section_finding": _sections(),
    } | oracle_training.oracle_sql()
