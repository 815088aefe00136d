"""The same queries in SQL, written independently, for DuckDB."""

from __future__ import annotations

from folioquery import rules
from folioquery.functions import russian as R

def plain(pattern: str) -> str:
    """The pattern without possessive marks, which RE2 neither has nor needs."""
    return pattern.replace("*+", "*").replace("++", "+")


TOKEN = plain(rules.TOKEN)
STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


def words(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), 'ё', 'е'), '{TOKEN}')"


def forms(token: str) -> str:
    return (
        f"CASE WHEN contains({token}, '-') AND NOT regexp_matches({token}, '\\p{{N}}') "
        f"THEN list_concat([{token}], string_split({token}, '-')) ELSE [{token}] END"
    )


def plural(t: str) -> str:
    return (
        f"CASE WHEN ends_with({t}, 's') AND NOT ends_with({t}, 'ss') AND length({t}) >= 4 "
        f"THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def verb(t: str) -> str:
    return (
        f"CASE WHEN ends_with({t}, 'ing') AND length({t}) >= 7 THEN left({t}, length({t}) - 3) "
        f"WHEN ends_with({t}, 'ed') AND length({t}) >= 6 THEN left({t}, length({t}) - 2) "
        f"WHEN ends_with({t}, 'e') AND length({t}) >= 4 THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def en_stem(t: str) -> str:
    """Stem of a non-Cyrillic token given as a column."""
    return (
        f"CASE WHEN regexp_matches({t}, '\\p{{N}}') THEN {t} "
        f"ELSE {verb('(' + plural(t) + ')')} END"
    )


DOC_ID = "source || ':u' || doc_id || ':0'"
CHUNKS = f"""
chunks AS (
  SELECT {DOC_ID} AS id, source AS doc, 'Source ' || source AS doc_title, lang, text,
    CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) END AS section,
    CAST(doc_id % 7 AS INTEGER) AS chapter, doc_id AS pdf_page, doc_id + doc_id % 3 AS pdf_page_end,
    CASE WHEN doc_id % 10 = 0 THEN doc_id || '.jpg' END AS image,
    CASE doc_id % 5 WHEN 1 THEN ['K7M'] WHEN 2 THEN ['K4M'] WHEN 3 THEN ['K4M', 'K7M']
      WHEN 4 THEN ['H4M'] END AS engines
  FROM documents)"""

PART_CHUNKS = """
chunks AS (
  SELECT p_brand || ':u' || p_partkey || ':0' AS id, p_brand AS doc, 'en' AS lang,
    p_name AS section,
    'Fit the ' || p_name || '. Tightening torque '
      || CASE WHEN p_size % 2 = 0 THEN p_size || ' N.m.' ELSE 'by hand.' END
      || ' Type ' || p_type || '.' AS text, CAST(NULL AS VARCHAR[]) AS engines
  FROM part)"""

POSTINGS = f"""
found AS (
  SELECT id, TRUE AS in_title, unnest({words('section')}) AS w, -1 AS pos FROM chunks
  UNION ALL
  SELECT id, FALSE, w, pos FROM (
    SELECT id, unnest(l) AS w, unnest(range(len(l))) AS pos
    FROM (SELECT id, {words('text')} AS l FROM chunks))),
terms AS (
  SELECT id, in_title, pos, {en_stem('f')} AS term
  FROM (SELECT id, in_title, pos, unnest({forms('w')}) AS f FROM found)),
postings AS (
  SELECT id, term, count(*) AS tf, count(*) FILTER (in_title) AS title_tf,
    list(pos ORDER BY pos) FILTER (NOT in_title) AS positions
  FROM terms GROUP BY id, term),
lens AS (SELECT c.id, coalesce(sum(p.tf), 0) AS len FROM chunks c LEFT JOIN postings p USING (id) GROUP BY c.id),
totals AS (SELECT count(*) AS n, sum(len) AS tokens FROM lens),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

INDEX = f"{CHUNKS},{POSTINGS}"


def bm25_hits(
    qterms: str,
    *,
    strict: bool = True,
    title_bonus: float = 0.0,
    proximity: str | None = None,
    cover: bool = False,
    torque: str | None = None,
    where: str = "TRUE",
) -> str:
    """CTEs up to ``scores(query_id, id, doc, score)``.

    ``qterms`` is a query giving (query_id, n_concepts, concept_id, phrase_id,
    phrase_len, term, weight).
    """
    factor = "1.0" if strict else "power(covered::DOUBLE / n_concepts, 2)"
    keep = "WHERE covered = n_concepts" if strict else ""
    bonus = ""
    near = ""
    join = ""
    if proximity:
        near = f"""
pos AS (
  SELECT DISTINCT m.query_id, m.id, m.concept_id, unnest(m.positions) AS p
  FROM matched m JOIN phrases USING (query_id, id, concept_id, phrase_id)),
near AS (
  SELECT query_id, id, count(*) AS pairs FROM (
    SELECT DISTINCT a.query_id, a.id, a.concept_id FROM pos a JOIN pos b
      ON a.query_id = b.query_id AND a.id = b.id AND b.concept_id = a.concept_id + 1
      AND abs(a.p - b.p) <= {proximity}) GROUP BY query_id, id),"""
        if cover:
            near = f"""
pos AS (
  SELECT DISTINCT m.query_id, m.id, m.concept_id, unnest(m.positions) AS p
  FROM matched m JOIN phrases USING (query_id, id, concept_id, phrase_id)),
near AS (
  SELECT DISTINCT query_id, id, 2 AS pairs FROM pos a JOIN pos b USING (query_id, id) JOIN pos c USING (query_id, id)
  WHERE a.concept_id = 0 AND b.concept_id = 1 AND c.concept_id = 2
    AND greatest(a.p, b.p, c.p) - least(a.p, b.p, c.p) <= 2 * {proximity}),"""
        join = "LEFT JOIN near USING (query_id, id)"
        bonus = " + 0.25 * coalesce(pairs, 0)"
    if torque:
        bonus += f" + CASE WHEN {torque} THEN 0.25 ELSE 0 END"
    return f"""
q AS ({qterms}),
matched AS (
  SELECT q.*, p.id, p.title_tf, p.positions,
    ln(1 + (t.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
      / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.len / (t.tokens::DOUBLE / t.n))) AS s
  FROM q JOIN postings p USING (term) JOIN dfs d USING (term) JOIN lens l USING (id)
    JOIN chunks c USING (id) CROSS JOIN totals t
  WHERE {where}),
phrases AS (
  SELECT query_id, n_concepts, id, concept_id, phrase_id, max(weight) * sum(s) AS s_phrase,
    count(*) FILTER (title_tf > 0) = max(phrase_len) AS in_title, max(phrase_len) AS phrase_len
  FROM matched GROUP BY ALL HAVING count(*) = max(phrase_len)),
concept_best AS (
  SELECT query_id, n_concepts, id, concept_id, max(s_phrase) AS s_best,
    max(s_phrase) * (1 + CASE WHEN bool_or(in_title) THEN {title_bonus} ELSE 0 END) AS s_concept
  FROM phrases GROUP BY ALL),{near}
covered AS (
  SELECT query_id, n_concepts, id, sum(s_concept) AS total, count(*) AS covered
  FROM concept_best GROUP BY ALL),
scores AS (
  SELECT query_id, id, c.doc, {factor} * total{bonus} AS score
  FROM covered JOIN chunks c USING (id) {join} {keep})"""


ORDER = "round(score, 6) DESC, id"


def ranked(hits: str, top_k: int, index: str = INDEX, source: str = "scores") -> str:
    return f"""WITH {index},{hits}
SELECT query_id, rank, id AS chunk_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM {source})
WHERE rank <= {top_k}"""


def fixed_terms(rows: list[tuple], query_id: int = 1) -> str:
    """Hand-written concepts: (concept_id, phrase_id, phrase_len, term, weight)."""
    n = len({r[0] for r in rows})
    values = ", ".join(
        f"({query_id}::BIGINT, {n}, {c}, {p}, {size}, '{t}', {w}::DOUBLE)" for c, p, size, t, w in rows
    )
    return (
        f"SELECT * FROM (VALUES {values}) v(query_id, n_concepts, concept_id, phrase_id, "
        "phrase_len, term, weight)"
    )


def one_word_concepts(*stems: str) -> str:
    return fixed_terms([(i, 0, 1, s, 1.0) for i, s in enumerate(stems)])


BENCHMARK_TERMS = f"""
SELECT query_id, count(*) OVER (PARTITION BY query_id) AS n_concepts, 0 AS phrase_id, 1 AS phrase_len,
  row_number() OVER (PARTITION BY query_id ORDER BY term) AS concept_id, term, 1.0::DOUBLE AS weight
FROM (SELECT DISTINCT item_id AS query_id, {en_stem('w')} AS term
  FROM (SELECT item_id, unnest({words('text')}) AS w FROM benchmark) WHERE w NOT IN ({STOPS}))"""

THING = [(0, 0, 1, "thing", 1.0), (0, 1, 1, "eau", 0.9), (0, 2, 1, "erung", 0.9)]
REED = [
    (0, 0, 1, "reed", 1.0), (0, 1, 2, "anhely", 0.9), (0, 1, 2, "atshsh", 0.9),
    (0, 2, 1, "erst", 0.9),
]

# --- page parsing ---------------------------------------------------------------

H1 = r"nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '')"
PARAGRAPHS = (
    r"array_to_string(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), "
    r"lambda p: trim(regexp_replace(p, '<[^>]*>', ' ', 'g'))), chr(10))"
)
ASCII_UPPER = (
    "translate(regexp_replace(lower(" + H1 + "), '[^a-z ]', '', 'g'), "
    "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
)
HANDBOOK = f"""
raw AS (
  SELECT page_id, 'Jaune Cyan Noir fond' || chr(10) || 'RUS_UD' || (page_id // 3 + 57000) || '_' || (page_id % 3) || chr(10)
    || '1 2' || chr(10) || (page_id % 9 + 1) || '.' || (page_id % 40) || chr(10)
    || {ASCII_UPPER} || ': part (' || (page_id % 3 + 1) || '/3)' || chr(10)
    || 'broken wo -' || chr(10) || 'rds are joined.' || chr(10) || '75' || chr(10)
    || {PARAGRAPHS} AS text FROM pages),
lines AS (
  SELECT page_id, unnest(range(len(l))) AS n, trim(unnest(l)) AS line
  FROM (SELECT page_id, string_split(text, chr(10)) AS l FROM raw))"""
IS_NOISE = (
    f"(regexp_matches(line, '{rules.PRINTER_COLOUR_LINE}') OR regexp_matches(line, '{rules.LAYOUT_ID_LINE}') "
    f"OR regexp_matches(line, '{rules.FOREIGN_HEADING_LINE}'))"
)
IS_FOOTER = (
    f"(regexp_matches(line, '{rules.STYLESHEET_LINE}') OR regexp_matches(line, '{rules.XML_NAME_LINE}'))"
)
IS_LABEL = f"regexp_matches(line, '{rules.PAGE_LABEL_LINE}')"
IS_CALLOUT = f"regexp_matches(line, '{plain(rules.CALLOUT_LINE)}')"


def is_heading(line: str = "line") -> str:
    return f"regexp_matches({line}, '{plain(rules.HEADING_LINE)}')"


DEHYPHEN = r"regexp_replace({t}, '(\p{{L}}) ?-\n(\p{{Ll}})', '\1\2', 'g')"

PARSED_PAGES = f"""{HANDBOOK},
kept AS (SELECT * FROM lines WHERE NOT {IS_NOISE}),
chosen AS (
  SELECT page_id, arg_min(line, n) FILTER ({IS_LABEL}) AS page_label, arg_min(line, n) FILTER ({is_heading()}) AS section,
    min(n) FILTER ({IS_LABEL}) AS label_n, min(n) FILTER ({is_heading()}) AS head_n
  FROM kept GROUP BY page_id),
head AS (
  SELECT page_id, any_value(page_label) AS page_label, any_value(section) AS section,
    string_agg(line, chr(10) ORDER BY n) FILTER (n IS DISTINCT FROM label_n AND n IS DISTINCT FROM head_n AND NOT {IS_CALLOUT}) AS body
  FROM kept JOIN chosen USING (page_id) GROUP BY page_id)"""

MANUAL = f"""
raw AS (
  SELECT page_id, '- ' || page_id || ' -' || chr(10) || '4. ASSEMBLY STEPS' || chr(10)
    || 'Tighten to ' || CASE WHEN page_id % 2 = 0 THEN '25 N.m .' ELSE 'stop .' END || chr(10)
    || coalesce(CASE WHEN page_id % 3 = 0 THEN 'See (' || (page_id % 90 + 10) || 'A, Gearbox) there.' || chr(10) END, '')
    || {PARAGRAPHS} || chr(10) || 'XSL version : 4.10 du 01/02/15' || chr(10)
    || 'Notice-' || page_id || 'x01x03-1-6-1.xml' AS text FROM pages),
lines AS (
  SELECT page_id, unnest(range(len(l))) AS n, trim(unnest(l)) AS line
  FROM (SELECT page_id, string_split(text, chr(10)) AS l FROM raw))"""

PLAIN_LINE = r"regexp_replace(trim(line), '[!#$%&*]', '', 'g')"
DOC_LINES = """
lines AS (
  SELECT doc_id, source, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""

# --- packing ------------------------------------------------------------------------


def packed(source: str, key: str, target: int) -> str:
    """CTE ``parts(key, parts)``: greedy packing of paragraphs, sentences, words, slices."""
    return f"""
paragraphs AS (
  SELECT k, n, trim(p) AS p FROM (
    SELECT {key} AS k, unnest(range(len(l))) AS n, unnest(l) AS p
    FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {source}))
  WHERE length(trim(p)) > 0),
sentences AS (
  SELECT k, n, 0 AS m, p AS s FROM paragraphs WHERE length(p) <= {target}
  UNION ALL
  SELECT k, n, m, trim(s) FROM (
    SELECT k, n, unnest(range(len(l))) AS m, unnest(l) AS s
    FROM (SELECT k, n, regexp_extract_all(p, '{rules.SENTENCE}') AS l FROM paragraphs WHERE length(p) > {target}))
  WHERE length(trim(s)) > 0),
pieces AS (
  SELECT k, n, m, 0 AS w, s AS t FROM sentences WHERE length(s) <= {target}
  UNION ALL
  SELECT k, n, m, w, t FROM (
    SELECT k, n, m, unnest(range(len(l))) AS w, unnest(l) AS t
    FROM (SELECT k, n, m, regexp_split_to_array(s, '\\s+') AS l FROM sentences WHERE length(s) > {target}))
  WHERE length(t) > 0),
slices AS (
  SELECT k, n, m, w, i, substring(t, i * {target} + 1, {target}) AS t FROM (
    SELECT *, unnest(range((length(t) - 1) // {target} + 1)) AS i FROM pieces)),
atoms AS (
  SELECT k, list({{'sep': CASE WHEN o = 1 THEN chr(10) WHEN i > 0 THEN '' ELSE ' ' END, 'text': t}}
      ORDER BY n, m, w, i) AS a
  FROM (SELECT *, row_number() OVER (PARTITION BY k, n ORDER BY m, w, i) AS o FROM slices)
  GROUP BY k),
folded AS (
  SELECT k, list_reduce(
    list_transform(a, lambda x: {{'parts': []::VARCHAR[], 'open': x.text, 'sep': x.sep}}),
    lambda acc, x: CASE
      WHEN acc.open = '' THEN {{'parts': acc.parts, 'open': x.open, 'sep': ''}}
      WHEN length(acc.open) + length(x.sep) + length(x.open) <= {target}
        THEN {{'parts': acc.parts, 'open': acc.open || x.sep || x.open, 'sep': ''}}
      ELSE {{'parts': list_append(acc.parts, acc.open), 'open': x.open, 'sep': ''}} END) AS f
  FROM atoms),
parts AS (
  SELECT k, CASE
    WHEN length(f.open) < {rules.MIN_CHUNK_CHARS} AND len(f.parts) > 0
      THEN list_append(f.parts[1:len(f.parts) - 1], f.parts[len(f.parts)] || chr(10) || f.open)
    ELSE list_append(f.parts, f.open) END AS parts
  FROM folded)"""


def grams(word: str) -> str:
    padded = f"('  ' || {word} || ' ')"
    return (
        f"list_distinct(list_transform(range(1, length({padded}) - 1), "
        f"lambda i: substring({padded}, i::BIGINT, 3)))"
    )


SURFACES = f"""
surfaces AS (
  SELECT DISTINCT unnest({forms('w')}) AS surface
  FROM (SELECT DISTINCT unnest({words("concat_ws(chr(10), section, text)")}) AS w FROM chunks))"""


def ru_stem_ctes(source: str) -> str:
    """The published stemming steps, one CTE each, over ``source(token)``."""
    def sub(column: str, pattern: str, both: bool) -> str:
        return f"regexp_replace({column}, '{pattern}', '{chr(92)}1{chr(92) + '2' if both else ''}')"

    return f"""
a AS (SELECT token, {sub('token', R.GERUND_RE, True)} AS g, {sub('token', R.REFLEXIVE_RE, False)} AS r FROM {source}),
b AS (SELECT *, {sub('r', R.ADJECTIVE_RE, False)} AS adj, {sub('r', R.VERB_RE, True)} AS v,
  {sub('r', R.NOUN_RE, False)} AS nn FROM a),
c AS (SELECT token, CASE WHEN g <> token THEN g
    WHEN adj <> r THEN {sub('adj', R.PARTICIPLE_RE, True)}
    WHEN v <> r THEN v ELSE nn END AS s1 FROM b),
d AS (SELECT token, {sub(sub('s1', R.FINAL_I_RE, False), R.DERIVATIONAL_RE, False)} AS s3 FROM c),
e AS (SELECT token, s3, {sub('s3', R.SUPERLATIVE_RE, False)} AS sup FROM d),
f AS (SELECT token, s3, {sub('sup', R.DOUBLE_N_RE, False)} AS un FROM e),
stemmed AS (SELECT token, CASE WHEN un <> s3 THEN un ELSE {sub('s3', R.SOFT_SIGN_RE, False)} END AS stem FROM f)"""


LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абсдефгхийклмнопярстуввхыз"

CITATION = f"""concat_ws('{rules.CITATION_SEPARATOR}', coalesce(doc_title, doc), section,
  '{rules.PAGE_LABEL} ' || CASE WHEN pdf_page_end > pdf_page THEN pdf_page || '-' || pdf_page_end
    ELSE pdf_page::VARCHAR END,
  CASE WHEN unit_parts > 1 THEN '{rules.PART_LABEL} 1 {rules.PART_OF_LABEL} ' || unit_parts END,
  '{rules.IMAGE_LABEL} ' || image)"""


def snippet(width: int, *terms: str) -> str:
    hits = ", ".join(f"nullif(strpos(lower(text), '{t}'), 0)" for t in terms)
    start = f"greatest(coalesce(least({hits}), 1) - {width // 2}, 1)"
    return (
        f"CASE WHEN {start} > 1 THEN '… ' ELSE '' END"
        f" || regexp_replace(substring(text, {start}, {width}), '\\s+', ' ', 'g')"
        f" || CASE WHEN {start} + {width} <= length(text) THEN ' …' ELSE '' END"
    )


CODES = "d4f|h4m|hr16de|k4m|k7m|k9k"


def codes(text: str) -> str:
    raw = (
        f"regexp_extract_all(lower({text}), "
        f"'(?:^|[^\\p{{L}}\\p{{N}}])({CODES})(?:$|[^\\p{{L}}\\p{{N}}])', 1)"
    )
    return (
        f"list_transform({raw}, lambda w: CASE w WHEN 'hr16de' THEN 'H4M' ELSE upper(w) END)"
    )


def in_order(list_sql: str) -> str:
    """Distinct values of a list in first-seen order, joined."""
    return (
        f"array_to_string(list_filter({list_sql}, lambda x, i: "
        f"list_position({list_sql}, x) = i), '|')"
    )


ASKED_ENGINE = "(CASE q.query_id % 3 WHEN 0 THEN 'K9K' WHEN 1 THEN 'H4M' ELSE 'K7M' END)"

# Limits of the labelled questions: their filters by shape, and the engine every fourth one names.
GATE_LIMITS = """(q.query_id % 4 <> 0 OR (
    (CAST(replace(c.doc, 'src', '') AS INTEGER) >= 10 OR CAST(replace(c.doc, 'src', '') AS INTEGER) % 3 = 0)
    AND (c.engines IS NULL OR list_contains(c.engines, 'K4M'))))
  AND CASE q.query_id % 6 WHEN 1 THEN c.lang = 'en' WHEN 2 THEN c.lang IN ('fr', 'de')
    WHEN 3 THEN c.engines IS NULL OR list_has_any(c.engines, ['K4M', 'H4M']) WHEN 4 THEN FALSE
    WHEN 5 THEN c.doc IN ('src1', 'src2', 'src3', 'src5', 'src8') AND (c.engines IS NULL OR list_contains(c.engines, 'K7M'))
    ELSE TRUE END"""

COVERED = """
volumes AS (
  SELECT source || ':u' || doc_id || ':0' AS id,
    source || '/' || CASE WHEN doc_id % 20 < 2 THEN doc_id % 20 ELSE doc_id % 20 // 2 + 100 END AS doc,
    CASE doc_id % 5 WHEN 1 THEN ['K7M'] WHEN 2 THEN ['K4M'] WHEN 3 THEN ['K4M', 'K7M'] WHEN 4 THEN ['H4M'] END AS engines
  FROM documents),
coverage AS (SELECT DISTINCT doc, unnest(engines) AS engine FROM volumes),
wanted AS (SELECT unnest(['K7M', 'D4F']) AS engine),
docs AS (SELECT DISTINCT doc FROM volumes),
allowed AS (
  SELECT w.engine, d.doc FROM docs d CROSS JOIN wanted w
  WHERE NOT EXISTS (SELECT 1 FROM coverage c WHERE c.doc = d.doc)
     OR EXISTS (SELECT 1 FROM coverage c WHERE c.doc = d.doc AND c.engine = w.engine))"""

BENCH_HITS = (
    f"{INDEX},{bm25_hits(BENCHMARK_TERMS)},"
    f"""
top AS (SELECT query_id, id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM scores) WHERE rank <= 5),
hay AS (
  SELECT query_id, lower({CITATION} || ' ' || text) AS h
  FROM top JOIN (SELECT *, 1 AS unit_parts FROM chunks) USING (id))"""
)

MISSPELT = f"""
bw AS (SELECT item_id, unnest({words('text')}) AS w FROM benchmark),
longest AS (SELECT item_id, w FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w DESC) AS r FROM bw) WHERE r = 1),
unknown AS (SELECT DISTINCT w || right(w, 1) AS surface FROM longest)"""

OUTLINE = """RECURSIVE m AS (
  SELECT user_id AS doc, event_type || ' ' || event_id AS title, event_id // 100 AS page,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 6 END AS level,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal FROM events),
p AS (
  SELECT m.doc, m.ordinal, m.level, m.title, m.page,
    max(o.ordinal) FILTER (o.ordinal < m.ordinal AND o.level < m.level) AS parent,
    arg_min(o.page, o.ordinal) FILTER (o.ordinal > m.ordinal AND o.level <= m.level) AS end_page
  FROM m JOIN m o ON o.doc = m.doc GROUP BY ALL),
t AS (
  SELECT *, title AS path FROM p WHERE parent IS NULL
  UNION ALL SELECT p.*, t.path || ' > ' || p.title FROM p JOIN t ON t.doc = p.doc AND t.ordinal = p.parent)"""

ORACLE: dict[str, str] = {
    "scan_corpus": f"WITH {CHUNKS} SELECT id, doc, lang, length(text) AS chars FROM chunks",
    "list_sources": "SELECT source AS doc, lang, count(*) AS units, count(*) AS chunks FROM documents GROUP BY ALL",
    "corpus_stats": """SELECT source AS doc, count(*) AS units, count(*) AS chunks,
  CAST(sum(length(text)) AS BIGINT) AS chars, min(length(text)) AS min_chars,
  max(length(text)) AS max_chars, max(doc_id) AS max_page FROM documents GROUP BY source""",
    "indexed_sources": """SELECT d.source AS doc, count(*) AS texts FROM documents d
JOIN (SELECT source, max(doc_id) % 2 = 0 AS indexed FROM documents GROUP BY source) r ON r.source = d.source
WHERE r.indexed AND length(trim(d.text)) > 0 GROUP BY d.source""",
    "global_paging": """WITH p AS (
  SELECT o_custkey AS doc, o_orderkey AS part, CAST(l_linenumber AS BIGINT) AS page
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT doc, part, max(page) AS n FROM p GROUP BY ALL),
o AS (SELECT doc, part, coalesce(sum(n) OVER (PARTITION BY doc ORDER BY part
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM f)
SELECT doc, part, page, CAST(page + off AS BIGINT) AS pdf_page FROM p JOIN o USING (doc, part)""",
    "union_units": f"""SELECT source AS doc, doc_id AS unit_id, lang,
  CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) END AS section,
  CAST(NULL AS VARCHAR) AS image, length(text) AS chars FROM documents
UNION ALL SELECT 'pictures', page_id, NULL, {H1}, page_id || '.jpg', length({PARAGRAPHS}) FROM pages""",
    "asset_lookup": """SELECT d.source || ':u' || d.doc_id || ':0' AS id,
  CASE WHEN d.doc_id % 10 = 0 THEN d.doc_id || '.jpg' END AS image, 'assets/' || p.page_id || '.jpg' AS path
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id AND d.doc_id % 10 = 0""",
    "page_range_lookup": f"""SELECT {DOC_ID.replace('source', 'c.source').replace('doc_id', 'c.doc_id')} AS id,
  string_agg('p' || p.doc_id, '|' ORDER BY p.doc_id) AS pictures
FROM documents c JOIN documents p ON p.source = c.source
  AND p.doc_id BETWEEN c.doc_id AND c.doc_id + c.doc_id % 3
GROUP BY c.source, c.doc_id""",
    "topic_filter": f"""SELECT page_id, title FROM (SELECT page_id, html, {H1} AS title FROM pages)
WHERE contains(html, 'class="ad"') AND NOT coalesce(contains(lower(title), 'tion'), FALSE)""",
    "filter_eq": f"WITH {CHUNKS} SELECT id, lang, chapter FROM chunks WHERE lang = 'fr' AND chapter = 3",
    "filter_in": f"WITH {CHUNKS} SELECT id, doc FROM chunks WHERE doc IN ('src1', 'src3')",
    "filter_empty_in": "SELECT count(*) AS n FROM documents WHERE FALSE",
    "filter_tag_null_ok": f"""WITH {CHUNKS} SELECT id, array_to_string(engines, '|') AS engines FROM chunks
WHERE engines IS NULL OR list_contains(engines, 'K7M')""",
    "min_length": f"WITH {CHUNKS} SELECT id, length(text) AS chars FROM chunks WHERE length(text) >= 40",
    "citation": f"""WITH {CHUNKS}, c AS (SELECT *, chapter + 1 AS unit_parts FROM chunks)
SELECT id, {CITATION} AS citation FROM c""",
    "snippet": f"WITH {CHUNKS} SELECT id, {snippet(80, 'thing', 'eau')} AS snippet FROM chunks",
    "tokenize": f"""SELECT doc_id, token, count(*) AS n
FROM (SELECT doc_id, unnest({words('text')}) AS token FROM documents) GROUP BY ALL""",
    "compound_split": f"""WITH t AS (SELECT doc_id, lang || '-Stop-' || lang || ' ' || source || '-' || lang || ' '
  || replace(text, ' ', '-') AS text FROM documents)
SELECT doc_id, token, count(*) AS n FROM (
  SELECT doc_id, unnest({forms('w')}) AS token FROM (SELECT doc_id, unnest({words('text')}) AS w FROM t)) GROUP BY ALL""",
    "stem_en": f"""SELECT token, {en_stem('token')} AS stem FROM (
  SELECT DISTINCT unnest({forms('w')}) AS token FROM (SELECT DISTINCT unnest({words('text')}) AS w FROM documents))""",
    "stem_ru": f"""WITH t AS (
  SELECT DISTINCT token FROM (
    SELECT unnest({words(f"translate(lower(text), '{LATIN}', '{CYRILLIC}')")}) AS token FROM documents)),{ru_stem_ctes('t')}
SELECT token, stem FROM stemmed""",
    "yo_folding": "SELECT doc_id, TRUE AS same FROM documents",
    "trigrams": f"""SELECT word, unnest({grams('word')}) AS gram
FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)""",
    "contains_ci": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the th')",
    "build_chunks": f"""WITH {PARSED_PAGES},
langs AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS doc FROM pages),
u AS (
  SELECT doc, doc || ':uRUS_UD' || (page_id // 3 + 57000) AS unit, min(page_id) AS first_page, max(page_id) AS last_page,
    arg_min(regexp_replace(section, ' *\\(\\d+/\\d+\\) *$', ''), page_id) AS section,
    min(CAST(split_part(page_label, '.', 1) AS INTEGER)) AS chapter,
    string_agg({DEHYPHEN.format(t='body')}, chr(10) ORDER BY page_id) AS text
  FROM head JOIN langs USING (page_id) GROUP BY 1, 2),{packed('u', 'unit', rules.CHUNK_TARGET)},
page_at AS (
  SELECT unit, page_id, sum(n) OVER (PARTITION BY unit ORDER BY page_id) - n AS start FROM (
    SELECT doc || ':uRUS_UD' || (page_id // 3 + 57000) AS unit, page_id,
      length(regexp_replace(coalesce({DEHYPHEN.format(t='body')}, ''), '\\s', '', 'g')) AS n FROM head JOIN langs USING (page_id))),
part_at AS (
  SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) AS stop FROM (
    SELECT k, parts, i, length(regexp_replace(parts[i + 1], '\\s', '', 'g')) AS n
    FROM (SELECT k, parts, unnest(range(len(parts))) AS i FROM parts))),
paged AS (
  SELECT k, i, any_value(parts) AS parts, CAST(max(page_id) FILTER (start <= stop - n) AS INTEGER) AS part_page,
    CAST(max(page_id) FILTER (start < stop) AS INTEGER) AS part_page_end
  FROM part_at JOIN page_at ON unit = k GROUP BY k, i)
SELECT unit || ':' || i AS id, part_page, part_page_end, 'Book in ' || doc AS doc_title, section, chapter,
  CAST(first_page AS INTEGER) AS pdf_page, CAST(last_page AS INTEGER) AS pdf_page_end,
  len(parts) AS unit_parts,
  CASE WHEN length(parts[i + 1]) < 40 THEN section || chr(10) || parts[i + 1] ELSE parts[i + 1] END AS text
FROM paged JOIN u ON unit = k""",
    "parse_page": f"""WITH {PARSED_PAGES}
SELECT page_id, page_label, CAST(split_part(page_label, '.', 1) AS INTEGER) AS chapter, section,
  {DEHYPHEN.format(t='body')} AS text FROM head""",
    "parse_manual_page": f"""WITH {MANUAL},
kept AS (SELECT * FROM lines WHERE NOT {IS_FOOTER}),
chosen AS (
  SELECT page_id, arg_min(line, n) FILTER (regexp_matches(line, '{rules.STEP_LINE}')) AS step_line,
    arg_min(line, n) FILTER ({is_heading()}) AS section, min(n) FILTER ({is_heading()}) AS head_n
  FROM kept GROUP BY page_id),
head AS (
  SELECT page_id, any_value(step_line) AS step_line, any_value(section) AS section, string_agg(line, chr(10) ORDER BY n) AS every,
    string_agg(line, chr(10) ORDER BY n)
      FILTER (NOT regexp_matches(line, '{rules.STEP_LINE}') AND n IS DISTINCT FROM head_n) AS body
  FROM kept JOIN chosen USING (page_id) GROUP BY page_id),
clean AS (SELECT *, {DEHYPHEN.format(t='body')} AS text, {DEHYPHEN.format(t='every')} AS whole FROM head)
SELECT page_id, TRY_CAST(regexp_extract(step_line, '{rules.STEP_LINE}', 1) AS INTEGER) AS step, section,
  nullif(regexp_extract(whole, '{rules.SYSTEM_CODE}', 1), '') AS section_src,
  regexp_matches(whole, '{rules.TORQUE_VALUE}') AS has_torque, text FROM clean""",
    "line_classify": f"""WITH {HANDBOOK} SELECT CASE WHEN length(line) = 0 THEN 'blank' WHEN {IS_LABEL} THEN 'label'
  WHEN {IS_NOISE} OR {IS_FOOTER} THEN 'noise' WHEN {IS_CALLOUT} THEN 'callout'
  WHEN {is_heading()} THEN 'heading' ELSE 'text' END AS line_class, count(*) AS n FROM lines GROUP BY 1""",
    "noise_lines": f"""WITH h AS (WITH {HANDBOOK} SELECT page_id, line FROM lines),
m AS (WITH {MANUAL} SELECT page_id, line FROM lines)
SELECT page_id, count(*) AS lines FROM (SELECT * FROM h UNION ALL SELECT * FROM m)
WHERE NOT ({IS_NOISE} OR {IS_FOOTER}) GROUP BY page_id""",
    "callout_lines": """SELECT event_id, line FROM (SELECT event_id, CASE WHEN event_id % 3 = 0
  THEN (user_id % 100) || ' ' || hour(ts) ELSE (user_id % 20)::VARCHAR END AS line FROM events)
WHERE contains(line, ' ') OR length(line) = 1""",
    "heading_lines": f"""WITH {DOC_LINES} SELECT doc_id, line_no, trim(line) AS line FROM lines
WHERE {is_heading(PLAIN_LINE)}""",
    "dehyphenate": """SELECT doc_id, text FROM documents""",
    "section_key": """SELECT o_orderpriority AS section, count(*) AS n FROM orders GROUP BY 1""",
    "has_number_unit": f"WITH {PART_CHUNKS} SELECT id, text LIKE '% N.m.%' AS has_torque FROM chunks",
    "chunk_unit": f"""WITH {packed('documents', 'doc_id', rules.CHUNK_TARGET)}
SELECT source || ':u' || doc_id || ':' || i AS id,
  CASE WHEN contains(d.text, chr(10)) THEN split_part(d.text, chr(10), 1) END AS section,
  parts[i + 1] AS text, len(parts) AS unit_parts
FROM (SELECT k, parts, unnest(range(len(parts))) AS i FROM parts) x JOIN documents d ON d.doc_id = x.k""",
    "chunk_page": f"""WITH src AS (SELECT page_id, {PARAGRAPHS} AS text FROM pages),{packed('src', 'page_id', 300)}
SELECT k AS page_id, i AS part, parts[i + 1] AS text
FROM (SELECT k, parts, unnest(range(len(parts))) AS i FROM parts)
UNION ALL SELECT page_id, 0, {H1} FROM pages
WHERE page_id NOT IN (SELECT k FROM parts) AND {H1} IS NOT NULL""",
    "units_range": """WITH m AS (
  SELECT user_id, event_id AS first_page, 'p' || event_id AS title,
    lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_page
  FROM events WHERE event_type = 'purchase')
SELECT e.user_id AS doc, m.title, m.first_page, m.next_page, e.event_id AS pdf_page
FROM events e JOIN m ON m.user_id = e.user_id AND e.event_id >= m.first_page
  AND (m.next_page IS NULL OR e.event_id < m.next_page)""",
    "bookmark_tree": f"""WITH {OUTLINE}
SELECT doc, ordinal, level, title, path, parent, page AS first_page, end_page FROM t""",
    "units_depth": f"""WITH {OUTLINE},
cut AS (
  SELECT *, lead(level) OVER w AS next_level, lead(page) OVER w AS page_after
  FROM t WHERE level <= 2 WINDOW w AS (PARTITION BY doc ORDER BY ordinal)),
opened AS (
  SELECT doc, page, string_agg(path, ' / ' ORDER BY ordinal) AS title FROM cut
  WHERE next_level IS NULL OR next_level <= level OR page_after <> page GROUP BY ALL),
r AS (SELECT *, lead(page) OVER (PARTITION BY doc ORDER BY page) AS next_page FROM opened)
SELECT r.doc, r.title, r.page AS first_page, r.next_page, count(*) AS events
FROM r JOIN m ON m.doc = r.doc AND m.page >= r.page AND (r.next_page IS NULL OR m.page < r.next_page) GROUP BY ALL""",
    "units_groupid": """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text,
  min(turn) AS first_page, max(turn) AS last_page FROM conversations GROUP BY conv_id""",
    "units_islands": f"""WITH {DOC_LINES}, f AS (
  SELECT *, sum(CASE WHEN {is_heading(PLAIN_LINE)} THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines)
SELECT doc_id, CAST(island AS BIGINT) AS island, count(*) AS lines, min(line_no) AS first_line FROM f GROUP BY ALL""",
    "short_units": """WITH u AS (
  SELECT p_brand AS doc, p_partkey AS id, CAST(p_partkey // 3 AS INTEGER) AS page,
    CASE WHEN p_size % 4 = 0 THEN p_type END AS section,
    repeat(left(p_name, p_size % 7 + 2) || '.', p_size % 9) AS text FROM part),
f AS (
  SELECT *, length(trim(text)) AS n, length(trim(text)) >= 40 AS is_long,
    count(*) FILTER (length(trim(text)) >= 40) OVER w AS island
  FROM u WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc ORDER BY page, id)),
g AS (
  SELECT *, sum(n) OVER (PARTITION BY doc, island ORDER BY page, id) - n AS before,
    sum(n) OVER (PARTITION BY doc, island) AS total FROM f WHERE NOT is_long),
h AS (
  SELECT g.*, total >= 40 OR longs IS NULL AS alone, CAST(before * greatest(total // 120, 1) // total AS BIGINT) AS part,
    least(island + 1, longs) AS host, island < longs AS leads
  FROM g LEFT JOIN (SELECT doc, max(island) AS longs FROM f WHERE is_long GROUP BY doc) USING (doc)),
own AS (
  SELECT *, row_number() OVER (PARTITION BY doc, island, part ORDER BY page, id) AS i FROM h WHERE alone),
made AS (
  SELECT doc, arg_min(id, i) AS unit_id, min(page) AS first_page, max(page) AS last_page, max(section) FILTER (i = 1) AS section,
    string_agg(CASE WHEN i = 1 THEN text ELSE concat_ws(chr(10), section, text) END, chr(10) ORDER BY i) AS text
  FROM own GROUP BY doc, island, part),
taken AS (
  SELECT doc, host, leads, min(page) AS first_page, max(page) AS last_page,
    string_agg(concat_ws(chr(10), section, text), chr(10) ORDER BY page, id) AS text
  FROM h WHERE NOT alone GROUP BY ALL)
SELECT * FROM made
UNION ALL
SELECT f.doc, f.id, least(f.page, a.first_page), greatest(f.page, b.last_page), f.section,
  concat_ws(chr(10), a.text, f.text, b.text)
FROM f LEFT JOIN taken a ON a.doc = f.doc AND a.host = f.island AND a.leads
  LEFT JOIN taken b ON b.doc = f.doc AND b.host = f.island AND NOT b.leads WHERE is_long
UNION ALL
SELECT doc, id, page, page, section, text FROM u WHERE trim(text) = ''""",
    "title_fallback": """SELECT d.source AS doc, d.doc_id AS unit_id, CASE WHEN contains(d.text, chr(10))
  THEN split_part(d.text, chr(10), 1) ELSE (SELECT 'entry ' || max(t.doc_id) FROM documents t
    WHERE t.source = d.source AND t.doc_id % 9 = 0 AND t.doc_id <= d.doc_id) END AS section
FROM documents d""",
    "engine_tagging": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'K7M' WHEN 1 THEN 'K4M' END AS engines FROM part""",
    "derive_tags": """SELECT p_brand AS doc, engine, count(*) AS mentions FROM (
  SELECT p_brand, unnest(CASE p_size % 4 WHEN 0 THEN ['H4M'] WHEN 1 THEN ['K4M'] WHEN 2 THEN ['K7M', 'K9K'] END) AS engine
  FROM part) GROUP BY ALL""",
    "tf": f"WITH {INDEX} SELECT id AS chunk_id, term, tf FROM postings",
    "df": f"WITH {INDEX} SELECT term, df FROM dfs",
    "doc_len": f"""WITH {INDEX} SELECT l.id AS chunk_id, CAST(l.len AS BIGINT) AS chunk_len, t.n AS n_chunks,
  CAST(t.tokens AS BIGINT) AS n_tokens FROM lens l CROSS JOIN totals t""",
    "idf": f"""WITH {INDEX} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 4) AS idf FROM dfs CROSS JOIN totals""",
    "tf_title": f"WITH {INDEX} SELECT id AS chunk_id, term, title_tf FROM postings WHERE title_tf > 0",
    "positions": f"""WITH {INDEX} SELECT id AS chunk_id, term, array_to_string(positions, ',') AS positions
FROM postings WHERE len(positions) > 0""",
    "vocab": f"WITH {CHUNKS},{SURFACES} SELECT surface FROM surfaces",
    "trigram_index": f"""WITH {CHUNKS},{SURFACES}
SELECT unnest({grams('surface')}) AS gram, surface, len({grams('surface')}) AS n_grams FROM surfaces""",
    "synonym_expand": f"""WITH w AS (
  SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY n) AS pos FROM (
    SELECT item_id, unnest(range(len(l))) AS n, unnest(l) AS w
    FROM (SELECT item_id, {words('text')} AS l FROM benchmark)) WHERE w NOT IN ({STOPS})),
s AS (SELECT item_id, pos, {en_stem('w')} AS s FROM w),
pairs AS (SELECT a.item_id, a.s AS s1, b.s AS s2 FROM s a LEFT JOIN s b ON b.item_id = a.item_id AND b.pos = a.pos + 1)
SELECT DISTINCT item_id AS query_id, unnest(CASE WHEN s1 = 'thing' THEN ['eau', 'erung']
  WHEN s1 = 'ananbl' AND s2 = 'anlye' THEN ['blebl'] WHEN s1 = 'reed' THEN ['anhely', 'atshsh', 'erst']
  WHEN s1 = 'eron' AND s2 = 'oron' THEN ['y', 'z', 'w'] ELSE [] END) AS term FROM pairs""",
    "concepts": f"""SELECT query_id, count(*) AS concepts, max(n_concepts) AS n_concepts FROM ({BENCHMARK_TERMS}) GROUP BY 1""",
    "phrase_all_words": f"""WITH {INDEX},{bm25_hits(fixed_terms(REED))}
SELECT id AS chunk_id, round(s_phrase, 4) AS s_phrase FROM phrases WHERE phrase_len > 1""",
    "concept_max": f"""WITH {INDEX},{bm25_hits(fixed_terms(THING))}
SELECT id AS chunk_id, round(s_best, 4) AS s_best FROM concept_best""",
    "bm25": ranked(bm25_hits(one_word_concepts("erst", "thing")), 10),
    "bm25_coverage": " UNION ALL ".join(
        f"SELECT *, '{mode}' AS mode FROM ("
        + ranked(bm25_hits(one_word_concepts("reed", "erst", "ananbl"), strict=mode == "strict"), 50)
        + ")"
        for mode in ("strict", "soft")
    ),
    "bm25_crosslang": ranked(bm25_hits(fixed_terms(THING), where="c.lang IN ('fr', 'de')"), 20),
    "bm25_title": ranked(bm25_hits(one_word_concepts("thing", "ered"), title_bonus=1.0), 20),
    "bm25_proximity": ranked(bm25_hits(one_word_concepts("thing", "ered", "oned"), proximity="8"), 50),
    "bm25_cover": ranked(
        bm25_hits(one_word_concepts("thing", "ered", "oned"), proximity="8", cover=True), 50
    ),
    "bm25_numeric_boost": ranked(
        bm25_hits(
            one_word_concepts("ring", "tighten", "torqu"), torque="c.text LIKE '% N.m.%'"
        ), 200, index=f"{PART_CHUNKS},{POSTINGS}",
    ),
    "bm25_per_doc": ranked(
        bm25_hits(one_word_concepts("erst", "thing"))
        + f""",
capped AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY {ORDER}) AS n FROM scores) WHERE n <= 1)""",
        15, source="capped",
    ),
    "no_match": "SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'qqqqzz')",
    "bm25_filtered": ranked(
        bm25_hits(
            one_word_concepts("thing"),
            where="c.lang = 'en' AND c.doc IN ('src1', 'src2', 'src3') "
            "AND (c.engines IS NULL OR list_contains(c.engines, 'K7M'))",
        ), 10,
    ),
    "bm25_batch": ranked(bm25_hits(BENCHMARK_TERMS, strict=False), 3),
    "bm25_pruned": " UNION ALL ".join(
        f"SELECT *, '{mode}' AS mode FROM ({sql})"
        for mode, sql in (
            ("strict", ranked(bm25_hits(one_word_concepts("erst", "thing")), 10)),
            ("soft", ranked(bm25_hits(one_word_concepts("reed", "erst", "ananbl"), strict=False), 50)),
            ("batch", ranked(bm25_hits(BENCHMARK_TERMS, strict=False), 3)),
        )
    ),
    "corpus_layers": ranked(bm25_hits(one_word_concepts("erst", "thing")), 50),
    "bm25_guarded": ranked(
        bm25_hits(
            BENCHMARK_TERMS, strict=False,
            where="(CASE WHEN CAST(replace(c.doc, 'src', '') AS INTEGER) >= 10 THEN TRUE "
            "ELSE list_contains(CASE CAST(replace(c.doc, 'src', '') AS INTEGER) % 3 "
            "WHEN 0 THEN ['K7M', 'K4M'] WHEN 1 THEN ['K9K'] ELSE ['H4M'] END, "
            f"{ASKED_ENGINE}) END) AND (c.engines IS NULL OR list_contains(c.engines, {ASKED_ENGINE}))",
        ), 3,
    ),
    "coverage_selective": ranked(bm25_hits(one_word_concepts("ananbl", "er", "re", "thing")), 50),
    "fuzzy_term": f"""WITH {CHUNKS},{SURFACES},{MISSPELT},
g AS (SELECT surface AS correction, len({grams('surface')}) AS n, unnest({grams('surface')}) AS gram FROM surfaces),
u AS (SELECT surface, len({grams('surface')}) AS n, unnest({grams('surface')}) AS gram FROM unknown),
j AS (SELECT u.surface, g.correction, count(*) AS shared, u.n + g.n - count(*) AS united
  FROM u JOIN g USING (gram) GROUP BY u.surface, g.correction, u.n, g.n)
SELECT surface, correction, shared, united FROM (
  SELECT *, row_number() OVER (PARTITION BY surface ORDER BY round(shared / united, 6) DESC, correction) AS r FROM j
  WHERE round(shared / united, 6) >= 0.3) WHERE r = 1""",
    "fuzzy_then_expand": f"""WITH {INDEX},{SURFACES},
unknown AS (SELECT * FROM (VALUES (1::BIGINT, 'anhelyyq'), (2::BIGINT, 'reedq')) v(query_id, surface)),
g AS (SELECT surface AS correction, len({grams('surface')}) AS n, unnest({grams('surface')}) AS gram FROM surfaces),
u AS (SELECT query_id, surface, len({grams('surface')}) AS n, unnest({grams('surface')}) AS gram FROM unknown),
j AS (SELECT query_id, correction, count(*) AS shared, u.n + g.n - count(*) AS united
  FROM u JOIN g USING (gram) GROUP BY query_id, correction, u.n, g.n),
best AS (SELECT query_id, correction FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(shared / united, 6) DESC, correction) AS r FROM j
  WHERE round(shared / united, 6) >= 0.3) WHERE r = 1),
fixed AS (SELECT query_id, {en_stem('correction')} AS stem FROM best),
groups AS (SELECT * FROM (VALUES ('reed', 1, 2, 'anhely'), ('reed', 1, 2, 'atshsh'), ('reed', 2, 1, 'erst'),
  ('thing', 1, 1, 'eau'), ('thing', 2, 1, 'erung')) v(key, phrase_id, phrase_len, term)),
{bm25_hits('''SELECT query_id, 1 AS n_concepts, 0 AS concept_id, 0 AS phrase_id, 1 AS phrase_len, stem AS term,
    1.0::DOUBLE AS weight FROM fixed
  UNION ALL SELECT query_id, 1, 0, phrase_id, phrase_len, term, 0.9::DOUBLE FROM fixed JOIN groups ON key = stem''')}
SELECT query_id, rank, id AS chunk_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM scores) WHERE rank <= 20""",
    "render_hits": f"""WITH {INDEX},{bm25_hits(one_word_concepts("erst", "thing"))},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM scores)
SELECT query_id, rank, id, {CITATION} AS citation, printf('%.2f', score) AS score,
  {snippet(240, 'erst', 'thing')} AS snippet, image
FROM (SELECT query_id, id, score, rank FROM top WHERE rank <= 5)
  JOIN (SELECT *, 1 AS unit_parts FROM chunks) USING (id)""",
    "best_passage": f"""WITH {INDEX},{bm25_hits(BENCHMARK_TERMS, strict=False)},
hits AS (SELECT query_id, id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM scores) WHERE rank <= 3),
ev AS (
  SELECT h.query_id, h.id, q.term, unnest(p.positions) AS place,
    CAST(round(ln(1 + (t.n - d.df + 0.5) / (d.df + 0.5)) * 1000000) AS BIGINT) AS w
  FROM hits h JOIN q USING (query_id) JOIN postings p ON p.id = h.id AND p.term = q.term
    JOIN dfs d ON d.term = q.term CROSS JOIN totals t),
held AS (
  SELECT e.query_id, e.id, e.place AS last, f.term, max(f.w) AS w, max(f.place) AS place
  FROM (SELECT DISTINCT query_id, id, place FROM ev) e JOIN ev f
    ON f.query_id = e.query_id AND f.id = e.id AND f.place <= e.place AND f.place > e.place - 30 GROUP BY ALL),
best AS (
  SELECT query_id, id, min(place) AS first, last, sum(w) AS weight FROM held GROUP BY query_id, id, last
  QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY sum(w) DESC, last) = 1),
texts AS (
  SELECT h.query_id, h.id, b.first, b.last, coalesce(b.weight, 0) AS weight,
    regexp_extract_all(text, '{TOKEN}') AS l, regexp_split_to_array(text, '{TOKEN}') AS gaps
  FROM hits h LEFT JOIN best b USING (query_id, id) JOIN chunks c ON c.id = h.id),
cut AS (
  SELECT *, greatest(0, least(coalesce(first - (29 - (last - first)) // 2, 0), len(l) - 30)) AS a FROM texts)
SELECT query_id, id, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word, CAST(weight AS BIGINT) AS weight,
  CASE WHEN len(l) > 0 THEN regexp_replace(array_to_string(list_transform(range(a, least(a + 30, len(l))),
    lambda i: l[i + 1] || CASE WHEN i < least(a + 30, len(l)) - 1 THEN gaps[i + 2] ELSE '' END), ''), '\\s+', ' ', 'g')
  END AS passage FROM cut""",
    "code_extract": f"""WITH n AS (SELECT p_partkey, concat_ws(' ', 'for',
  CASE p_size % 3 WHEN 0 THEN 'hr16de,' WHEN 1 THEN 'K9K' END, p_type,
  CASE WHEN p_size % 5 = 0 THEN '(H4M) k4m' END, 'xk7m') AS note FROM part),
c AS (SELECT p_partkey, {codes('note')} AS l FROM n)
SELECT p_partkey, {in_order('l')} AS engines FROM c""",
    "coalesce_profile": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'K4M'
  WHEN c_nationkey % 2 = 0 THEN 'K7M' END AS engine FROM customer""",
    "allowed_docs": f"WITH {COVERED} SELECT engine, doc FROM allowed",
    "blocked_docs": f"""WITH {COVERED} SELECT w.engine, d.doc FROM docs d CROSS JOIN wanted w
EXCEPT SELECT engine, doc FROM allowed""",
    "two_level_gate": f"""WITH {COVERED} SELECT id, doc FROM volumes
WHERE doc IN (SELECT doc FROM allowed WHERE engine = 'K7M') AND (engines IS NULL OR list_contains(engines, 'K7M'))""",
    "eval_hit_at_k": f"""WITH {BENCH_HITS}
SELECT b.item_id AS query_id, coalesce(bool_or(contains(h, lower(split_part(b.text, '.', 1)))), FALSE) AS hit
FROM benchmark b LEFT JOIN hay ON hay.query_id = b.item_id WHERE b.item_id % 4 <> 3 GROUP BY b.item_id""",
    "eval_forbid": f"""WITH {BENCH_HITS}
SELECT b.item_id AS query_id, coalesce(bool_or(contains(h, 'fr/') OR contains(h, 'elle eau')), FALSE) AS found
FROM benchmark b LEFT JOIN hay ON hay.query_id = b.item_id WHERE b.item_id % 4 > 1 GROUP BY b.item_id""",
    "eval_gate": f"""WITH {INDEX},{bm25_hits(BENCHMARK_TERMS, strict=False, where=GATE_LIMITS)},
top AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM scores)
  WHERE rank <= query_id % 3 + 2),
hay AS (
  SELECT query_id, lower({CITATION} || ' ' || text) AS h
  FROM top JOIN (SELECT *, 1 AS unit_parts FROM chunks) USING (id))
SELECT b.item_id AS query_id, 'expected' AS kind,
  coalesce(bool_or(contains(h, lower(split_part(b.text, '.', 1))) OR contains(h, 'thing')), FALSE) AS passed
FROM benchmark b LEFT JOIN hay ON hay.query_id = b.item_id GROUP BY b.item_id
UNION ALL SELECT b.item_id, 'forbidden', NOT coalesce(bool_or(contains(h, 'fr/') OR contains(h, 'elle eau')), FALSE)
FROM benchmark b LEFT JOIN hay ON hay.query_id = b.item_id WHERE b.item_id % 2 = 0 GROUP BY b.item_id""",
    "dup_ids": "SELECT conv_id::VARCHAR AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "completeness": """SELECT count(*) AS n_rows, count(*) FILTER (doc_id IS NULL) AS missing_id,
  count(*) FILTER (source IS NULL) AS missing_doc, count(*) FILTER (source IS NULL) AS missing_doc_title,
  count(*) FILTER (lang IS NULL) AS missing_lang, count(*) FILTER (text IS NULL) AS missing_text,
  0::BIGINT AS missing_unit_parts, count(*) FILTER (NOT contains(text, chr(10))) AS missing_section FROM documents""",
    "document_set_difference": """WITH l AS (SELECT DISTINCT source || '/' || length(text) // 40 AS doc FROM documents WHERE lang = 'fr'),
r AS (SELECT DISTINCT source || '/' || length(text) // 40 AS doc FROM documents WHERE lang = 'de')
SELECT doc, 'left' AS side FROM l WHERE doc NOT IN (SELECT doc FROM r)
UNION ALL SELECT doc, 'right' FROM r WHERE doc NOT IN (SELECT doc FROM l)""",
    "title_ratio": f"""WITH {packed('documents', 'doc_id', rules.CHUNK_TARGET)}
SELECT coalesce(CAST(sum(len(parts)) AS BIGINT), 0) AS parts,
  coalesce(CAST(sum(len(parts)) FILTER (NOT contains(d.text, chr(10))) AS BIGINT), 0) AS untitled
FROM parts JOIN documents d ON d.doc_id = k WHERE len(parts) > 1""",
}
