"""DuckDB SQL for the operators that SQL can express, on whole tables.

Latent vectors, networks, byte-pair merges, tokenizer counts and graph search
are beyond it.  Windows and shingles are compared as texts here, not as fingerprints.
"""

from __future__ import annotations

from querymill.llm.mixing import MOST_COPIES, SALT
from querymill.llm.ngram_join import DENOMINATOR, NUMERATOR, WIDTH
from querymill.llm.quality_rules import HOST_LIMIT
from querymill.llm.substring_dedup import MIN_WORDS
from querymill.llm.url_filter import RULES, SOFT, SOFT_TERMS, SOFT_WEIGHT, STRICT

WORD = r"[^\x20\x09-\x0D]+"

_OP1 = f"""
WITH d AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 8)) AS j) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY 1),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
  CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INTEGER)) AS DOUBLE) AS f FROM b GROUP BY 1),
p0 AS (SELECT sum(f) / sum(n) AS mean, sum((f / n) * (f / n) * n) / sum(n) AS m2, avg(n) AS size FROM h),
p AS (SELECT mean, greatest(2.0, least(mean * (1 - mean) / greatest(m2 - mean * mean, 1e-9) - 1, size)) AS s FROM p0),
v AS (SELECT source, (f + mean * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {HOST_LIMIT} AS kept, b.source AS host, round(rate, 9) AS shrunk_rate
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source"""


def _listed(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_RULES = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in RULES)
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP3 = f"""
WITH b AS (SELECT page_id, coalesce({_LOWER.format('url')}, '') AS u, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS host0, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
c AS (SELECT page_id, u, {_LOWER.format('host0')} AS host, path FROM b),
r AS ({_RULES}),
fit AS (SELECT page_id, h || p AS rule, v FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1),
t AS (SELECT *, {' OR '.join(map(_listed, STRICT))} AS strict, {' + '.join(f'CAST({_listed(k)} AS INTEGER)' for k in SOFT)} AS n, {' + '.join(f'{w} * CAST({_listed(k)} AS INTEGER)' for k, w in SOFT.items())} AS weight FROM c)
SELECT t.page_id, host, path, rule, coalesce(v, CASE WHEN strict OR (n >= {SOFT_TERMS} AND weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN fit ON t.page_id = fit.page_id"""

_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, md5('{SALT}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, {MOST_COPIES} * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS r FROM s1),
s3 AS (SELECT x.*, (SELECT sum(source_size) FROM s2) - coalesce((SELECT sum(cap) FROM s2 y WHERE y.r < x.r), 0) AS rest, (SELECT sum(w) FROM s2 y WHERE y.r >= x.r) AS w_rest FROM s2 x),
f AS (SELECT rest, w_rest, r FROM s3 WHERE CAST(w AS DOUBLE) * rest <= CAST(cap AS DOUBLE) * w_rest ORDER BY r LIMIT 1),
s AS (SELECT source, source_size, CASE WHEN r >= (SELECT r FROM f) THEN CAST(w * (SELECT rest FROM f) AS DOUBLE) / (SELECT w_rest FROM f) ELSE CAST(cap AS DOUBLE) END AS target FROM s3),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size) AS c FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, CAST(e * source_size + c AS DOUBLE) / target AS v FROM c, (SELECT unnest(range(0, {MOST_COPIES})) AS e) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY v, source NULLS FIRST, h, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS upto FROM q),
t AS (SELECT rid, sum(size) AS taken FROM o WHERE upto - size / 2 <= (SELECT sum(size) FROM d) GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN t USING (rid)"""

_OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {MIN_WORDS - 1}], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS i FROM rep, (SELECT unnest(range(0, {MIN_WORDS})) AS j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN cov USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WIDTH - 2}, least(len(w), 1) + 1))) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE {DENOMINATOR} * i >= {NUMERATOR} * (na.n + nb.n - i)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON d.doc_id = r.a"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": _OP1,
    "op3_url_filter": _OP3,
    "op5_substring_dedup": _OP5,
    "op6_mix_sources": _OP6,
    "op10_jaccard_join": _OP10,
}
