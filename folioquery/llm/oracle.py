"""DuckDB counterparts of the queries that SQL can express, written from the contracts."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
g AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.words = win.words),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
""",
    "op7_url_lists": r"""
WITH p AS (
  SELECT page_id, url, CAST(page_id % 360 AS INTEGER) AS fetch_day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg
  FROM pages
),
h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
keys AS (
  SELECT host AS key FROM h UNION SELECT regexp_extract(host, '[^.]+[.][^.]+$') FROM h UNION SELECT host || '/en' FROM h
),
e AS (
  SELECT key, CAST('0x' || substr(md5(key || '|' || k), 1, 4) AS INTEGER) % 360 AS day,
    CAST('0x' || substr(md5(key || '|' || k), 5, 4) AS INTEGER) % 3 AS a
  FROM keys, (SELECT unnest([0, 1, 2]) AS k)
),
v AS (
  SELECT key, day, a, lead(day) OVER (PARTITION BY key ORDER BY day) AS until
  FROM (SELECT key, day, min(a) AS a FROM e GROUP BY key, day)
),
k AS (
  SELECT page_id, fetch_day, array_to_string(list_slice(string_split(host, '.'), -i, -1), '.') AS key, i AS rank
  FROM (SELECT *, unnest(range(2, len(string_split(host, '.')) + 1)) AS i FROM p)
  UNION ALL SELECT page_id, fetch_day, host || '/' || seg, 1000 FROM p WHERE seg <> ''
),
m AS (
  SELECT page_id, arg_max(CASE a WHEN 0 THEN 'block' ELSE 'allow' END, rank) AS decision, arg_max(v.key, rank) AS key, arg_max(day, rank) AS listed_day
  FROM k JOIN v ON k.key = v.key AND fetch_day >= day AND (until IS NULL OR fetch_day < until) WHERE a < 2 GROUP BY page_id
)
SELECT p.page_id, p.url, p.fetch_day, p.host, coalesce(decision, 'none') AS decision, key, listed_day FROM p LEFT JOIN m USING (page_id)
""",
    # The checksum of a word is folded over its bytes with the usual table of 256 remainders.
    "op12_resampling": rf"""
WITH step AS (
  SELECT list(list_reduce(range(1, 9), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256)) AS n)
),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
u AS (SELECT DISTINCT w FROM (SELECT unnest(w) AS w FROM d UNION ALL SELECT unnest(w) AS w FROM b)),
k AS (
  SELECT w, xor(list_reduce(list_transform(range(1, len(hex(encode(w))), 2), lambda i: CAST(('0x' || substr(hex(encode(w)), i, 2)) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM u, step
),
e AS (SELECT doc_id, unnest(w) AS w FROM d),
s AS (SELECT bucket, count(*) AS n FROM e JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) JOIN k USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM e JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (doc_id)
),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM f),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM r LEFT JOIN o USING (doc_id)
""",
}
