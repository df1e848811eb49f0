"""DuckDB SQL for the queries that SQL can express, straight from their definitions."""
from __future__ import annotations

WORDS = "[w FOR w IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> '']"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS.replace('text', LOWER.format('text'))} AS w FROM documents),
b AS (SELECT item_id, {WORDS.replace('text', LOWER.format('text'))} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM b WHERE len(w) > 0)),
q AS (SELECT item_id, k, count(*) AS q FROM i GROUP BY ALL),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
n AS (SELECT doc_id, item_id, k, count(*) AS n FROM ds JOIN i USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, q AS n_shingles, n AS n_held, n / q AS containment FROM n JOIN q USING (item_id, k) WHERE n >= 0.8 * q"""

OP3 = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, p AS line_no, ls[p] AS line, {WORDS.replace('text', 'ls[p]')} AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM raw)),
f AS (SELECT w, min(struct_pack(d := doc_id, n := line_no)) AS a0 FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, a0, len(w) AS n, i, w[:i - 1] || w[i + 1:] AS c FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 5)),
near AS (
  SELECT w, min(o) AS o FROM (
    SELECT w, min(a0) OVER (PARTITION BY n, i, c) AS o FROM v
    UNION ALL SELECT v.w, f.a0 FROM v JOIN f ON f.w = v.c WHERE len(f.w) >= 5
    UNION ALL SELECT f.w, v.a0 FROM v JOIN f ON f.w = v.c WHERE len(f.w) >= 5) GROUP BY w),
first AS (SELECT f.w, least(f.a0, coalesce(near.o, f.a0)) AS o FROM f LEFT JOIN near USING (w)),
j AS (SELECT l.*, len(l.w) > 0 AND first.o < struct_pack(d := doc_id, n := line_no) AS gone FROM l LEFT JOIN first ON first.w = l.w),
g AS (SELECT doc_id, count(*) FILTER (len(w) > 0) AS n_lines, count(*) FILTER (gone) AS n_removed,
      coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(gone, false)), '') AS kept FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256 FROM raw LEFT JOIN g USING (doc_id)"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, strlen(h) AS n, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS largest FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to FROM m"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, {WORDS} AS w,
      [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
win AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM w)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - p, 8))) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM rep) GROUP BY r),
c AS (SELECT doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      len(ls) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
k AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines OR word_chars / greatest(n_words, 1) < 3 OR word_chars / greatest(n_words, 1) > 12 AS soft_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed OR soft_failed AS DOUBLE)) AS x FROM k GROUP BY source),
t AS (SELECT sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) AS sq, count(*) / sum(n) AS inv FROM h),
prior AS (SELECT m, greatest(m * (1 - m) / greatest(sq - m * m - m * (1 - m) * inv, 1e-6) - 1, 1) AS k FROM t),
v AS (SELECT source, (x + m * k) / (n + k) > 0.3 AS host_bad FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, host_bad,
  NOT base_failed AND NOT (host_bad AND soft_failed) AS kept FROM k JOIN v ON v.source IS NOT DISTINCT FROM k.source"""

OP10 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
x AS (SELECT d.doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
         WHERE gone.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _spans(kind: str, rank: int, pattern: str, ok: str) -> str:
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, ends[i] - length(m[i]) AS start, ends[i] AS stop FROM (
  SELECT r, m, [CAST(list_sum([length(x) FOR x IN g[:j]]) + list_sum([length(x) FOR x IN m[:j]]) AS BIGINT) FOR j IN range(1, len(m) + 1)] AS ends,
    unnest(range(1, len(m) + 1)) AS i
  FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d WHERE regexp_matches(text, '{pattern}'))) WHERE {ok}"""


def secrets_sql(rules: dict, base: tuple) -> str:
    """All kinds of the secret scan; positions from the pieces between the matches."""
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(rules.items()):
        pattern = pattern.replace("'", "''")
        size = "length(m[i])" if group == 0 else f"length(regexp_extract(m[i], '{pattern}', {group}))"
        parts.append(_spans(kind, rank, pattern, f"{size} >= {least}"))
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(parts)}),
a AS (SELECT r, {count}, {text} FILTER (rank < {len(base)}) AS base, {text} AS spans FROM s GROUP BY r)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
