"""The training-set queries' results in SQL (DuckDB's dialect), written from their definitions."""

from __future__ import annotations

from .oracle import doi, sha, url_or_doi

# Fixed values, stated anew here: words that say nothing, layout and metadata, words of titles, names that are none, platforms.
_STOP = (
    "about across after also among based been between could from have into more most other over paper research result results show shows study such than that their there these this those through under using were what "
    "when where which while with would kpop korean culture social media global music fandom fans digital online analysis the and for are not its can has was one"
)
_METADATA = (
    r"^\s*(?:abstract|keywords?|references?|bibliography)\s*:?\s*$", r"^\s*(?:received|accepted|published|copyright|corresponding author)\b", r"^\s*(?:vol(?:ume)?\.?|issue|pages?|pp\.?|issn)\s*[:\d]",
    r"https?://", r"\bdoi\s*:", r"©", r"all rights reserved", r"\b(?:table|figure|appendix|contents)\s+\d+\b", r"\b(?:references|bibliography)\b", r"\b(?:university|department|faculty)\s+of\b.*\bemail\b",
    r"\b(?:bachelor.?s student|department of|faculty of|university of)\b", r"\b(?:CFI|TLI|RMSEA|SRMR)\b",
)
_WORD_STOP = (
    "a an the and or of in on for to from by with as at is are was were be been being this that these those it its their they we our can may which who how what about through into across between within also study paper "
    "evidence research question section introduction body conclusion"
)
_GENERIC_NAMES = "The This These However Overall Furthermore Moreover Together Taken Paper News Introduction Body Conclusion Evidence"
_GENERIC_WORDS = "k pop kpop korean korea music culture cultural paper study research evidence findings impact influence effect global globalization fan fans fandom media digital social platform platforms analysis conclusion"
_ENGLISH = "regexp_matches(lower(trim(language)), '^(?:en|eng|english|inglés|inggris|영어|英語)(?:[\\s_\\-(/,;].*)?$')"


def _in(words: str) -> str:
    return ", ".join("'" + w + "'" for w in words.split())


def composed(c: str) -> str:
    """The NFKC form, as far as the characters of these tables go."""
    return f"replace(replace(replace(nfc_normalize({c}), '：', ':'), '…', '...'), chr(160), ' ')"


def blanks(c: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '\\s+', ' ', 'g'))"


def plain(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def terms(p: str) -> str:
    return f"list_distinct(list_filter(string_split({p}, ' '), lambda w: length(w) >= 4 AND w NOT IN ({_in(_STOP)})))"


def sentence_ctes(source: str) -> str:
    """CTEs ending in ok(id, field, o, s, n): the sentences fit for training of source(id, field, t), numbered from 0."""
    meta = "'(?i)" + "|".join(f"(?:{p})" for p in _METADATA).replace("'", "''") + "'"
    t = "trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'))"
    t = f"regexp_replace(regexp_replace({t}, '\\[(?:\\d+[\\s,;–-]*)+\\]', '', 'g'), '\\([^)]*\\b(?:19|20)\\d{{2}}[a-z]?[^)]*\\)', '', 'g')"
    parts = f"string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""raw AS (SELECT id, field, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT id, field, {parts} AS p FROM {source})),
        m AS (SELECT id, field, i, s, len(string_split(s, ' ')) AS n, len(list_filter(string_split(s, ' '), lambda w: regexp_matches(w, '\\d'))) AS digits, length(s) - length(regexp_replace(s, '[a-zA-Z]', '', 'g')) AS letters
            FROM (SELECT id, field, i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM raw) WHERE s <> ''),
        ok AS (SELECT id, field, row_number() OVER (PARTITION BY id, field ORDER BY i) - 1 AS o, s, n FROM m WHERE n BETWEEN 8 AND 70 AND regexp_matches(s, '[.!?]["''”’]?\\s*$')
            AND NOT regexp_matches(s, '(?:\\.{{3,}}|[_=]{{3,}}|\\s[,;:]\\s[,;:])') AND NOT (digits >= 4 AND digits / n >= 0.12) AND letters / length(s) > 0.55 AND NOT regexp_matches(s, {meta}))"""


_FIELDS = f"""f AS (SELECT paper_id AS id, unnest(['abstract', 'introduction', 'body', 'conclusion']) AS field, unnest([{composed('abstract')}, {composed('introduction')}, {composed('body')}, {composed('conclusion')}]) AS t FROM papers WHERE paper_id IS NOT NULL)"""

_TARGETS = f"""lim(section, field, least, most) AS (VALUES ('Introduction', 'introduction', 50, 130), ('Body', 'body', 100, 180), ('Conclusion', 'conclusion', 40, 110)),
    run AS (SELECT ok.*, section, least, most, coalesce(sum(n) OVER (PARTITION BY id, field ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ok JOIN lim USING (field)),
    stopped AS (SELECT *, bool_or(before >= most OR (before >= least AND before + n > most)) OVER (PARTITION BY id, field ORDER BY o) AS stop FROM run),
    target AS (SELECT id, section, field, list(s ORDER BY o) AS sentences, array_to_string(list(s ORDER BY o), ' ') AS text FROM stopped WHERE NOT stop GROUP BY id, section, field, least HAVING sum(n) >= least)"""

_MINED = f"""{_FIELDS}, {sentence_ctes('f')}, {_TARGETS},
    whole AS (SELECT id FROM target GROUP BY id HAVING count(*) = 3),
    t AS (SELECT target.*, {terms(plain("text"))} AS wanted, list_transform(sentences, lambda x: {plain('x')}) AS plains FROM target JOIN whole USING (id)),
    c0 AS (SELECT id, field AS source, o, s, {plain('s')} AS p, {terms(plain('s'))} AS w FROM ok),
    src(section, source, nth, bonus) AS (VALUES ('Introduction', 'abstract', 0, 2), ('Introduction', 'body', 1, 1), ('Introduction', 'conclusion', 2, 1), ('Introduction', 'introduction', 3, 0), ('Body', 'abstract', 0, 2), ('Body', 'introduction', 1, 1),
        ('Body', 'conclusion', 2, 1), ('Body', 'body', 3, 0), ('Conclusion', 'abstract', 0, 2), ('Conclusion', 'introduction', 1, 1), ('Conclusion', 'body', 2, 1), ('Conclusion', 'conclusion', 3, 0)),
    c1 AS (SELECT c0.*, t.section, nth, bonus, plains, len(list_intersect(w, wanted)) AS common, len(wanted) AS nw FROM c0 JOIN t USING (id) JOIN src ON src.section = t.section AND src.source = c0.source),
    c2 AS (SELECT *, common / greatest(len(w), 1) + common / greatest(nw, 1) AS score, row_number() OVER (PARTITION BY id, section, p ORDER BY nth, o) AS again FROM c1 WHERE common >= 2),
    c3 AS (SELECT * FROM c2 WHERE again = 1 AND NOT list_bool_or(list_transform(plains, lambda x: x = p OR len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(p, ' '))))
        / len(list_distinct(string_split(x || ' ' || p, ' '))) >= 0.82))),
    mined AS (SELECT id AS paper_id, section, s AS sentence, source, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, section ORDER BY score DESC, bonus DESC, o, s DESC, source DESC) AS r FROM c3) WHERE r <= 4)"""

_SUPPORTED = f"""{_MINED},
    have AS (SELECT paper_id AS id, section, count(*)::INT AS n_evidence, list(sentence ORDER BY rank) AS es, list(source ORDER BY rank) AS ss, {terms(plain("array_to_string(list(sentence ORDER BY rank), ' ')"))} AS have FROM mined GROUP BY 1, 2),
    b0 AS (SELECT id, section, n_evidence, es, ss, have, array_to_string(list_filter(sentences, lambda x: len(list_intersect({terms(plain('x'))}, have)) >= 2 AND len(list_intersect({terms(plain('x'))}, have)) / greatest(len({terms(plain('x'))}), 1) >= 0.16), ' ') AS target
        FROM t JOIN have USING (id, section)),
    b1 AS (SELECT *, len(list_intersect({terms(plain('target'))}, have)) / greatest(len({terms(plain('target'))}), 1) AS support FROM b0),
    supported AS (SELECT id AS paper_id, section, target, n_evidence, es, ss, round(support, 4) AS support FROM b1 WHERE len(string_split(target, ' ')) >= CASE section WHEN 'Introduction' THEN 50 WHEN 'Body' THEN 100 ELSE 40 END AND support >= 0.16)"""


def _names(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '\\b(?:[A-Z]{{2,}}|[A-Z][a-z]+[A-Z][A-Za-z]*)\\b'), lambda w: lower(w)), lambda w: w NOT IN ('kpop', 'korean', 'hallyu', 'ip', 'pop')))"


def _news(targets: str) -> str:
    """CTEs ending in quoted(paper_id, section, news_id, title, source, sentence, score), from targets(paper_id, section, target, own)."""
    platforms = "['tiktok', 'youtube', 'instagram', 'facebook', 'twitter', 'netflix']"
    both = lambda a, b: f"len(list_intersect({a}, {b}))"
    return f"""nf AS (SELECT news_id AS id, 'content' AS field, {composed('content_en_for_rag')} AS t FROM news),
    {sentence_ctes('nf').replace('raw AS', 'nraw AS').replace('FROM raw', 'FROM nraw').replace('m AS (', 'nm AS (', 1).replace('FROM m ', 'FROM nm ').replace('ok AS', 'nok AS')},
    n0 AS (SELECT id, list(s ORDER BY o) AS s, list({terms(plain('s'))} ORDER BY o) AS st FROM nok WHERE o < 8 GROUP BY id),
    n1 AS (SELECT id AS news_id, {blanks(composed('title_en_for_rag'))} AS title, {blanks('source')} AS source, s, st FROM n0 JOIN news ON news_id = id),
    n2 AS (SELECT *, {terms(plain('title'))} AS tt, {_names('title')} AS tn FROM n1 WHERE title <> '' AND source <> ''),
    n3 AS (SELECT *, list_distinct(list_concat(tt, flatten(st))) AS ta FROM n2),
    q0 AS (SELECT paper_id, section, {terms(plain('target'))} AS g, {terms(plain('own'))} AS a, {_names('own')} AS nm FROM {targets}),
    q1 AS (SELECT *, list_filter(list_intersect(nm, g), lambda w: NOT list_contains({platforms}, w)) AS named FROM q0),
    q2 AS (SELECT q1.*, n3.* FROM q1 JOIN n3 ON list_has_any(named, ta) WHERE (list_has_any(named, tt) OR {both(f'list_intersect(list_intersect(nm, tn), g)', platforms)} > 0)
        AND {both('a', 'ta')} >= 2 AND {both('g', 'ta')} >= 2 AND ({both('a', 'tt')} > 0 OR {both('a', 'ta')} >= 3)),
    q3 AS (SELECT *, list_transform(st, lambda x: {both('x', 'list_distinct(list_concat(a, g))')}) AS per FROM q2),
    q4 AS (SELECT paper_id, section, news_id, title, source, s[list_position(per, list_max(per))] AS sentence, ({both('a', 'ta')} + {both('g', 'ta')} + {both('a', 'tt')})::INT AS score FROM q3 WHERE list_max(per) >= 2),
    quoted AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, section ORDER BY score DESC, news_id::VARCHAR) AS r FROM q4) WHERE r = 1)"""


def _groups(source: str) -> str:
    """CTEs ending in grp(paper_id, group_id) of source's papers, and split(paper_id, group_id, split, h)."""
    title = f"nullif(array_to_string(list_filter(string_split({plain(composed('title'))}, ' '), lambda w: w NOT IN ('a', 'an', 'the', 'in', 'on', 'of', 'and', 'to') AND w <> ''), ' '), '')"
    text = " || chr(10) || ".join(plain(composed(c)) for c in ("introduction", "body", "conclusion"))
    return f"""gp AS (SELECT * FROM {source}),
    gk AS (SELECT DISTINCT paper_id, key FROM (SELECT paper_id, 'doi:' || {doi('doi')} AS key FROM gp UNION ALL SELECT paper_id, {url_or_doi('source_url')} FROM gp UNION ALL SELECT paper_id, 'hash:' || {sha('content_hash')} FROM gp
        UNION ALL SELECT paper_id, 'title:' || {title} FROM gp UNION ALL SELECT paper_id, CASE WHEN trim({text}, ' ' || chr(10)) <> '' THEN 'text:' || sha256({text}) END FROM gp) WHERE key IS NOT NULL),
    ge AS (SELECT DISTINCT x.paper_id AS a, y.paper_id AS b FROM gk x JOIN gk y USING (key)),
    gr AS (SELECT a, b FROM ge UNION SELECT gr.a, ge.b FROM gr JOIN ge ON gr.b = ge.a),
    grp AS (SELECT p.paper_id, coalesce(min(b), p.paper_id) AS group_id FROM (SELECT DISTINCT paper_id FROM gp) p LEFT JOIN gr ON a = p.paper_id GROUP BY p.paper_id),
    gn AS (SELECT group_id, md5('42:' || group_id) AS h FROM grp GROUP BY 1),
    gs AS (SELECT *, row_number() OVER (ORDER BY h, group_id) AS r, count(*) OVER () AS total FROM gn),
    gz AS (SELECT *, greatest(1, floor(total * 0.1 + 0.5)) AS k FROM gs),
    split AS (SELECT paper_id, group_id, h, CASE WHEN r > total - k THEN 'test' WHEN r > total - 2 * k THEN 'validation' ELSE 'train' END AS split FROM grp JOIN gz USING (group_id))"""


_LATEST = """s0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01') DESC, md5(coalesce(target, '')) DESC) AS latest FROM grounded_samples WHERE sample_id IS NOT NULL),
    s1 AS (SELECT * FROM s0 WHERE latest = 1)"""


def _checked() -> str:
    """CTEs ending in checked(sample_id, section, split, research_question, t, reasons, support): the reasons without those of copied sentences."""
    word = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9''-]*'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ({_in(_WORD_STOP)}))"
    # RE2 has no look-around: a number that something of a word follows is cut short, so what follows is looked at in the text itself.
    numbers = lambda c: f"list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_.,%]+', ' ', 'g'), ' '), lambda w: regexp_extract(w, '^[.,%]*((?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?%?)[.,%]*$', 1)), lambda w: w <> '')"
    sent = lambda c: f"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
    # In RE2 a letter that isn't ASCII ends a word; here it is made one that doesn't.
    names = "list_distinct(regexp_extract_all(regexp_replace(t, '[\\p{Hangul}\\p{Han}\\p{Hiragana}\\p{Katakana}\\x{C0}-\\x{24F}]', '0', 'g'), '\\b(?:[A-Z]{2,}|[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b'))"
    items = "array_to_string(list_filter(list_concat(coalesce(paper_evidence, []), coalesce(news_evidence, [])), lambda x: x IS NOT NULL), ' ')"
    generic = f"len(list_filter(regexp_split_to_array(n, '\\s+'), lambda p: p NOT IN ({_in(_GENERIC_NAMES)}))) = 0"
    return f"""{_LATEST},
    k0 AS (SELECT *, {blanks('target')} AS t, {items} AS e FROM s1),
    k1 AS (SELECT *, concat_ws(' ', title, topic, research_question, e) AS al, {word('t')} AS w, len(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9''-]*')) AS n, {sent('t')} AS ss FROM k0),
    k2 AS (SELECT *, list_distinct(w) AS dw, list_distinct({word('e')}) AS ew, list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS runs,
        list_transform(ss, lambda x: lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))) AS sk FROM k1),
    k3 AS (SELECT *, len(list_intersect(dw, ew)) / greatest(len(dw), 1) AS support FROM k2),
    checked AS (SELECT sample_id, section, split, research_question, t, ss, support, list_sort(list_filter([
        CASE WHEN t <> '' AND right(t, 1) NOT IN ('.', '!', '?', '"', '''', '’', '”') THEN 'broken_sentence' END, CASE WHEN t = '' THEN 'empty' END,
        CASE WHEN regexp_matches(t, '(?i)^\\s*(?:#{{1,6}}\\s*)?(?:introduction|body|conclusion)\\s*:') THEN 'heading' END, CASE WHEN support < 0.24 THEN 'low_evidence_relevance' END,
        CASE WHEN len(list_distinct(sk)) < len(sk) OR (len(w) >= 12 AND (len(runs) - len(list_distinct(runs))) / len(runs) > 0.12) THEN 'repetition' END,
        CASE WHEN (coalesce(section, '') <> 'Conclusion' AND regexp_matches(t, '(?i)^(?:in conclusion|to conclude|taken together|overall)\\b'))
            OR (section = 'Conclusion' AND NOT regexp_matches(t, '(?i)\\b(?:overall|together|therefore|thus|suggest|indicat|conclud|synthesi|implication|evidence)\\w*\\b')) THEN 'section_mismatch' END,
        CASE WHEN reject THEN 'teacher_reject' END, CASE WHEN n > 170 THEN 'too_long' END, CASE WHEN t <> '' AND n < CASE WHEN section = 'Body' THEN 40 ELSE 35 END THEN 'too_short' END,
        CASE WHEN len(list_filter({names}, lambda n: NOT contains(lower(al), lower(n)) AND NOT {generic})) > 0 THEN 'unsupported_entity' END,
        CASE WHEN len(list_filter({numbers('t')}, lambda x: NOT list_contains({numbers('al')}, x))) > 0 THEN 'unsupported_number' END], lambda x: x IS NOT NULL)) AS reasons FROM k3)"""


def oracle_sql() -> dict[str, str]:
    item = "array_to_string(list_transform(range(1, len(es) + 1), lambda i: '[PAPER ' || i || ']' || chr(10) || 'Title: ' || p.title || chr(10) || 'Evidence: ' || es[i]), '|')"
    important = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9''-]*'), lambda w: lower(w)), lambda w: length(w) >= 4 AND w NOT IN ({_in(_WORD_STOP)}, {_in(_GENERIC_WORDS)})))"
    own = "regexp_replace(e, '^\\[PAPER \\d+\\]', '')"
    share = f"CASE WHEN a <> '' AND b <> '' THEN len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(string_split(a || ' ' || b, ' '))) ELSE 0 END"
    inputs = lambda c: f"array_to_string(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL), chr(1))"
    return {
        "section_targets": f"WITH {_FIELDS}, {sentence_ctes('f')}, {_TARGETS} SELECT id AS paper_id, section, text AS target FROM target JOIN papers ON paper_id = id WHERE {_ENGLISH}",
        "paper_gates": f"""WITH {_FIELDS}, {sentence_ctes('f')}, {_TARGETS}, have AS (SELECT id, list(section) AS has FROM target GROUP BY id)
            SELECT paper_id, CASE WHEN NOT coalesce({_ENGLISH}, false) THEN 'non_english_or_unknown_language' WHEN {blanks('title')} = '' THEN 'missing_title'
                WHEN NOT coalesce(list_contains(has, 'Introduction'), false) THEN 'section_too_short_introduction' WHEN NOT list_contains(has, 'Body') THEN 'section_too_short_body'
                WHEN NOT list_contains(has, 'Conclusion') THEN 'section_too_short_conclusion' END AS reason FROM papers LEFT JOIN have ON id = paper_id""",
        "mined_evidence": f"WITH {_MINED} SELECT * FROM mined",
        "supported_targets": f"WITH {_SUPPORTED} SELECT paper_id, section, target, n_evidence, support FROM supported",
        "news_evidence": f"""WITH sm AS (SELECT *, row_number() OVER (PARTITION BY paper_id, section ORDER BY sample_id, target, title) AS k FROM grounded_samples WHERE paper_id IS NOT NULL AND section IS NOT NULL AND target IS NOT NULL AND title IS NOT NULL),
            st AS (SELECT paper_id, section || ':' || sample_id AS section, target, min(title) OVER (PARTITION BY paper_id) AS own FROM sm WHERE k = 1), {_news('st')} SELECT * FROM quoted""",
        "near_copies": f"""WITH e AS (SELECT sample_id, {plain(composed('target'))} AS a, unnest(paper_evidence) AS e FROM grounded_samples WHERE sample_id IS NOT NULL), x AS (SELECT sample_id, a, {plain(composed(own))} AS b FROM e WHERE e IS NOT NULL),
            y AS (SELECT sample_id, a = b AS same, {share} AS s FROM x) SELECT sample_id, round(max(s), 6) AS most, count(*) FILTER (same OR s >= 0.82) AS copies, count(*) FILTER (s >= 0.55 AND s < 0.82) AS plausible FROM y GROUP BY 1""",
        "training_split": f"WITH RECURSIVE {_groups(f'(SELECT * FROM papers WHERE paper_id IS NOT NULL AND {_ENGLISH})')} SELECT paper_id, group_id, split FROM split",
        "training_samples": f"""WITH RECURSIVE {_SUPPORTED},
            able AS (SELECT * FROM papers WHERE {_ENGLISH} AND {blanks('title')} <> '' AND paper_id IN (SELECT paper_id FROM supported)), {_groups('able')},
            reps AS (SELECT group_id, split, h, arg_min(paper_id, paper_id::VARCHAR) AS paper_id, array_to_string(list_sort(list(paper_id::VARCHAR)), '|') AS source_paper_ids FROM split GROUP BY ALL),
            o0 AS (SELECT supported.*, split, h, source_paper_ids, {plain('target')} AS tk FROM supported JOIN reps USING (paper_id)),
            o1 AS (SELECT *, first_value(paper_id) OVER (PARTITION BY tk ORDER BY h, paper_id) <> paper_id AS late FROM o0),
            o2 AS (SELECT * FROM o1 WHERE paper_id NOT IN (SELECT paper_id FROM o1 WHERE late)),
            ot AS (SELECT o2.paper_id, section, target, title AS own FROM o2 JOIN papers USING (paper_id)), {_news('ot')},
            p AS (SELECT paper_id, {blanks('title')} AS title, keywords FROM papers)
            SELECT o2.paper_id, source_paper_ids, o2.section, p.title, coalesce(nullif(array_to_string(keywords[:4], ', '), ''), p.title) AS topic, 'What does the evidence show about ' || regexp_replace(p.title, '[.?]+$', '') || '?' AS research_question,
                {item} AS paper_evidence, CASE WHEN q.news_id IS NULL THEN '[NO_NEWS_EVIDENCE]' ELSE '[NEWS 1]' || chr(10) || 'Title: ' || q.title || chr(10) || 'Source: ' || q.source || chr(10) || 'Evidence: ' || q.sentence END AS news_evidence,
                target, array_to_string(list_transform(ss, lambda x: 'paper:' || o2.paper_id || ':' || x), '|') || coalesce('|news:' || q.news_id, '') AS evidence_sources, support, split
            FROM o2 JOIN p USING (paper_id) LEFT JOIN quoted q ON q.paper_id = o2.paper_id AND q.section = o2.section""",
        "grounding_gate": f"WITH {_checked()} SELECT sample_id, array_to_string(reasons, ',') AS reasons, round(support, 4) AS support, len(reasons) = 0 AS passed FROM checked",
        "conclusion_gate": f"""WITH {_checked()}, c AS (SELECT sample_id, list_distinct(list_concat(reasons, list_filter([CASE WHEN len(ss) NOT BETWEEN 2 AND 7 THEN 'conclusion_structure' END,
            CASE WHEN len(list_intersect({important("coalesce(research_question, '')")}, {important('t')})) = 0 THEN 'research_question_not_answered' END,
            CASE WHEN regexp_matches(t, '(?i)^(this paper|this study|the study)\\s+(examines|explores|aims|focuses)') THEN 'body_or_introduction_style' END,
            CASE WHEN len(ss) > 0 AND NOT regexp_matches(array_to_string(ss[-2:], ' '), '(?i)\\b(?:overall|together|therefore|thus|suggest|indicat|conclud|synthesi|implication|evidence|findings|ultimately|supports|underscores)\\w*\\b') THEN 'missing_synthesis' END,
            CASE WHEN contains(t, chr(65533)) OR regexp_matches(t, '(?i)({"|".join(chr(97 + i) + "{4,}" for i in range(26))})') THEN 'corrupt_text' END], lambda x: x IS NOT NULL))) AS reasons FROM checked WHERE section = 'Conclusion')
            SELECT sample_id, array_to_string(list_sort(reasons), ',') AS reasons FROM c""",
        "split_leaks": f"""WITH s AS (SELECT paper_id, split, md5(concat_ws(chr(2), {blanks('section')}, {blanks('title')}, {blanks('topic')}, {blanks('research_question')}, {inputs('paper_evidence')}, {inputs('news_evidence')}, {blanks('target')})) AS digest,
                CASE WHEN paper_id IS NULL THEN 'paper_id' WHEN {blanks('title')} = '' THEN 'title' WHEN {inputs('paper_evidence')} = '' AND {inputs('news_evidence')} = '' THEN 'evidence' WHEN {blanks('section')} NOT IN ('Introduction', 'Body', 'Conclusion') THEN 'section'
                    WHEN {blanks('target')} = '' THEN 'target' END AS reason FROM grounded_samples),
            ok AS (SELECT * FROM s WHERE reason IS NULL AND split IS NOT NULL)
            SELECT * FROM (SELECT 'paper' AS kind, paper_id::VARCHAR AS key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM ok GROUP BY 2 UNION ALL SELECT 'sample', digest, array_to_string(list_sort(list(DISTINCT split)), ',') FROM ok GROUP BY 2) WHERE contains(splits, ',')
            UNION ALL SELECT 'invalid', reason, count(*)::VARCHAR FROM s WHERE reason IS NOT NULL GROUP BY 2""",
        "dataset_report": f"WITH {_checked()} SELECT section, split, reason, count(*) AS n FROM (SELECT section, split, unnest(list_concat(['all'], CASE WHEN len(reasons) = 0 THEN ['passed'] ELSE reasons END)) AS reason FROM checked) GROUP BY ALL",
    }
