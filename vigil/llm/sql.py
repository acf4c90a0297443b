"""DuckDB SQL of the registered queries of this subpackage that SQL can express."""

OP4 = r"""
WITH sizes AS (SELECT coalesce(source, chr(1) || 'none') AS src, count(*) AS n FROM documents GROUP BY 1),
sums AS (SELECT sum(pow(n, 0.5)) AS w, sum(n) AS total FROM sizes),
exact AS (SELECT src, pow(n, 0.5) / w * total / n AS r FROM sizes, sums),
scaled AS (SELECT src, r, pow(10.0, greatest(6.0, 6.0 - floor(log10(r)))) AS s FROM exact WHERE r > 0),
rate AS (SELECT src, round(r * s) / s AS mix_rate FROM scaled),
terms AS (SELECT src, mix_rate, k, exp(-mix_rate + k * ln(mix_rate)
    - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY src ORDER BY k)) AS p
  FROM (SELECT src, mix_rate, unnest(range(0, CAST(ceil(mix_rate + 12 * sqrt(mix_rate) + 30) AS BIGINT) + 1)) AS k FROM rate WHERE mix_rate > 0)),
cdf AS (SELECT src, mix_rate, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
lists AS (SELECT src, mix_rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY 1, 2),
counts AS (SELECT d.*, mix_rate, len(list_filter(cs, lambda c: c < u)) AS n
  FROM (SELECT *, (CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents) d
  JOIN lists ON src = coalesce(source, chr(1) || 'none'))
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, mix_rate, md5('17:' || doc_id || ':' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counts WHERE n > 0)
"""

_CANON = r"""(CASE WHEN host || path = '' THEN NULL ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN q <> '' THEN '?' || q ELSE '' END END)"""
OP5 = rf"""
WITH parts AS (SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q
  FROM pages),
keyed AS (SELECT *, {_CANON} AS url_key FROM parts),
listed AS (SELECT DISTINCT url_key FROM keyed WHERE url_key IS NOT NULL
  AND (html LIKE '% trash %' OR html LIKE '% scum %' OR html LIKE '% pathetic %' OR html LIKE '% loser %')),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR l.url_key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  l.url_key IS NOT NULL AS listed
FROM ruled r LEFT JOIN listed l ON r.url_key = l.url_key
"""

_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP7 = f"""
WITH dw AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
bw AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM wins))),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(html) AS digest FROM p),
f AS (SELECT digest, n, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY 1, 2)
SELECT page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n = f.n
"""

_PIECES = r"""unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'))"""
OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all({_PIECES}, '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS ws, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY 1),
c AS (SELECT * FROM g WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.ws, c.f AS a, k, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * c.f // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN g l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, k) JOIN g r ON r.lang = c.lang AND r.ws = list_slice(c.ws, k + 1, c.m)),
best AS (SELECT lang, ws, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM cuts GROUP BY ALL),
longer AS (SELECT lang, list_slice(ws, i, i + q - 1) AS ws, max(f) AS most
  FROM (SELECT lang, ws, f, q, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c)) GROUP BY ALL),
kept AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score AS score
  FROM best LEFT JOIN longer USING (lang, ws) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": OP4, "op5_url_filter": OP5, "op7_decontaminate": OP7, "op9_warc_archive": OP9, "op11_collocations": OP11}
