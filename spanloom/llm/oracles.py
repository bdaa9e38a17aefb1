"""DuckDB twins of the queries that SQL can express.

Without one: mixing and sharding (drawn), the classifier (fitted), the fuzzy labels of the
license scan, and the pipeline, which holds some of them; tests/llm has plain versions of these.
"""

from __future__ import annotations

from spanloom.llm.quality import RULES, STOP_WORDS

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTER_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOLID = r"'[^\x20\x09-\x0D]+'"

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_LETTER_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_LETTER_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT cast(item_id AS varchar) AS item, least(len(w), 10) AS k, w[p:p + least(len(w), 10) - 1] AS gram
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, p, k, w[p:p + k - 1] AS gram FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(p) WHERE len(w) >= k),
hit AS (SELECT doc_id, p, dw.k, item FROM dw JOIN iw ON iw.k = dw.k AND iw.gram = dw.gram),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + k)) AS t(q) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_CAPTURES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (cast('0x' || substr(hex, 1 + (q * 5) // 4, 2) AS INTEGER) >> cast(3 - (q * 5) % 4 AS INTEGER)) % 32, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g"""

_REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SOLID}) AS w FROM documents),
win AS (SELECT doc_id, p, w[p:p + 12] AS gram FROM d, unnest(range(1, len(w) - 11)) AS t(p) WHERE len(w) >= 13),
least_ AS (SELECT gram, min(doc_id) AS first FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, q FROM win JOIN least_ USING (gram), unnest(range(p, p + 13)) AS t(q) WHERE first < doc_id),
word AS (SELECT doc_id, q, w[q] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(q)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id)"""


def _broken_rules() -> str:
    tests = []
    for r in RULES:
        tests += [f"coalesce({r.measure} < {r.low}, false)"] if r.low is not None else []
        tests += [f"coalesce({r.measure} > {r.high}, false)"] if r.high is not None else []
    return " OR ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SOLID}) AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SOLID})) AS lines FROM documents),
g AS (SELECT doc_id, p, w[p:p + 2] AS gram FROM d, unnest(range(1, len(w) - 1)) AS t(p) WHERE len(w) >= 3),
often AS (SELECT doc_id, gram FROM g GROUP BY 1, 2 HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM g JOIN often USING (doc_id, gram), unnest(range(p, p + 3)) AS t(q) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_marks,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, strlen(t) > 1.5 * length(t) AS other_script FROM d LEFT JOIN hit USING (doc_id)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio, n_marks / nullif(n_words, 0) AS mark_ratio,
  CASE WHEN NOT other_script THEN n_stop_words / nullif(n_words, 0) END AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_broken_rules()}) AS kept FROM r"""


def _level(groups: str, n: str, bad: str, name: str) -> str:
    """Strength of the prior of one level, as hosts._strength works it out."""
    return f"""{name} AS (SELECT coalesce(h / t, 0) AS rate, CASE WHEN t IS NULL THEN 2 WHEN h / t * (1 - h / t) <= 0 OR between_ <= 0 THEN 1000
    ELSE round(least(1000, greatest(2, h / t * (1 - h / t) / between_ - 1)), 6) END AS k FROM (SELECT *, (s / t - (h / t) * (h / t) - (h / t) * (1 - h / t) * c / t) / greatest(1e-9, 1 - c / t) AS between_
    FROM (SELECT count(*)::DOUBLE AS c, sum({n})::DOUBLE AS t, sum({bad})::DOUBLE AS h, sum({bad} * {bad} / {n})::DOUBLE AS s FROM {groups} WHERE {n} > 0)))"""


_URLS = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
hs AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS b, string_split(host, '.')[-1] AS suffix,
  array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM u LEFT JOIN o USING (page_id) GROUP BY host),
ds AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM hs GROUP BY 1, 2),
ss AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM ds GROUP BY 1),
{_level('ss', 'n', 'b', 'ks')}, {_level('ds', 'n', 'b', 'kd')}, {_level('hs', 'n', 'b', 'kh')},
ms AS (SELECT suffix, (b + ks.k * ks.rate) / (n + ks.k) AS m FROM ss, ks),
md AS (SELECT ds.suffix, domain, (b + kd.k * ms.m) / (n + kd.k) AS m FROM ds JOIN ms USING (suffix), kd),
mh AS (SELECT host, (b + kh.k * md.m) / (n + kh.k) AS rate, n + kh.k AS weight FROM hs JOIN md USING (suffix, domain), kh),
j AS (SELECT page_id, u.host, path, greatest(0, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1))) AS bound,
  CASE WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (u.host = 'example.net' OR u.host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (u.host = 'com' OR u.host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (u.host = 'net' OR u.host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (u.host = 'org' OR u.host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM u JOIN mh ON mh.host = u.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM j"""

_NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_SOLID}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[p:p + 1] AS gram FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

_RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_LETTER_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS query, item_id, {_LETTER_WORDS} AS w FROM benchmark),
t AS (SELECT DISTINCT query, term FROM i, unnest(w) AS u(term)),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
f AS (SELECT row, term, count(*)::BIGINT AS tf FROM d, unnest(w) AS u(term) WHERE term IN (SELECT term FROM t) GROUP BY 1, 2),
v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, total GROUP BY term, n_docs),
c AS (SELECT f.row, f.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w)::BIGINT * n_docs) // n_words))) AS part
  FROM f JOIN v USING (term) JOIN d USING (row), total),
s AS (SELECT query, row, sum(part)::BIGINT AS score FROM t JOIN c USING (term) GROUP BY 1, 2 HAVING sum(part) > 0),
r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (row))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN i USING (query) WHERE rank <= 10"""

_NEGATIVES = """
WITH raw AS (SELECT row_number() OVER () AS row, vec_id, label, embedding AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(e, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM raw WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT row, p, x[p] AS x FROM v, unnest(range(1, len(x) + 1)) AS t(p)),
s AS (SELECT a.row AS anchor, c.row AS row, sum(a.x * c.x)::BIGINT AS score FROM c a JOIN c ON a.p = c.p WHERE a.row IN (SELECT row FROM v WHERE vec_id % 100 = 0) GROUP BY 1, 2),
r AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, v.vec_id, v.row, v.label = a.label AS same, score FROM s JOIN v a ON a.row = s.anchor JOIN v ON v.row = s.row WHERE v.row <> a.row),
pos AS (SELECT anchor, anchor_id, vec_id AS positive_id, row, score AS positive_score FROM r WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT pos.anchor_id, positive_id, r.vec_id AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY pos.anchor, pos.row ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM pos JOIN r ON r.anchor = pos.anchor AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": _CONTAMINATION,
    "op3_warc": _CAPTURES,
    "op4_substring_dedup": _REPEATS,
    "op7_quality_rules": _QUALITY,
    "op9_url_filter": _URLS,
    "op10_minhash_near_dedup": _NEAR_DUPLICATES,
    "op12_lexical_search": _RANKED,
    "op13_hard_negatives": _NEGATIVES,
}
