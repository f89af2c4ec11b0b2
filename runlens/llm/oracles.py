"""SQL twins of the registered queries that SQL can express."""

from __future__ import annotations

from runlens.llm.mixing import MOST_PASSES, PACKET_WORDS, WEIGHTS
from runlens.llm.rules import GRIDS, Risk
from runlens.llm.spelling import LEAST_COUNT, LEAST_LENGTH, RATIO, TYPO_MODULUS

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

OP4 = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWERED)} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
d AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, there) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, d.y FROM r JOIN d ON r.there = d.x)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(there) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

OP2 = """
WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, encode(coalesce(text, '')) AS h FROM documents),
m AS (SELECT doc_id, unnest(range(n - 99)) AS p, unnest(list_transform(range(n - 99), lambda p: md5(h[p + 1 : p + 100]))) AS m FROM b WHERE n >= 100),
w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM m),
g AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM w WHERE k > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN upto IS NULL OR p > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS z FROM i GROUP BY ALL),
k AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS gone,
      string_agg(hex(h[before + 1 : a]), '' ORDER BY a) || hex(any_value(h)[max(z) + 1 :]) AS kept
      FROM (SELECT s.*, b.h, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s JOIN b USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(coalesce(unhex(kept), h)) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
"""


def _metric(rule: str) -> str:
    return {"symbol_share": "n_symbols / word_chars", "dup_line_share": "n_dup_lines / n_lines", "same_word_share": "1 - n_distinct / n_words",
            "word_length": "word_chars / n_words", "upper_share": "n_upper / word_chars"}[rule]


def _rules(risk: Risk = Risk()) -> str:
    allowed, level, steps = risk.false_rejection, (1 - risk.confidence) / (len(risk.bands) + 1), max(map(len, GRIDS.values()))
    grid = ", ".join(f"('{rule}', {step}, CAST({cutoff} AS DOUBLE))" for rule, cuts in GRIDS.items() for step, cutoff in enumerate(cuts))
    band = " + ".join(f"CASE WHEN n_words >= {edge} THEN 1 ELSE 0 END" for edge in risk.bands)
    # Where nothing is there to divide by, a share of distinct words is 1 and any other metric 0.
    metric = "CASE rule " + " ".join(f"WHEN '{r}' THEN coalesce({_metric(r)}, {1.0 if r == 'same_word_share' else 0.0})" for r in GRIDS) + " END"
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
v AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(words[p : p + 7], ' ')) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)),
o AS (SELECT doc_id, p, lag(p, 1, -8) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM v WHERE times > 1),
c AS (SELECT doc_id, CAST(sum(least(8, p - before)) AS BIGINT) AS n_repeat_words FROM o GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS word_chars0,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(list_distinct(words)) AS n_distinct FROM w),
b AS (SELECT * EXCLUDE (word_chars0), coalesce(word_chars0, 0) AS word_chars, coalesce(n_repeat_words, 0) AS repeats,
  n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed, {band} AS stratum FROM m LEFT JOIN c USING (doc_id)),
grid(rule, step, cutoff) AS (VALUES {grid}),
x AS (SELECT doc_id, stratum, base_failed, rule, {metric} AS metric FROM b, (SELECT DISTINCT rule FROM grid)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
y AS (SELECT doc_id, any_value(stratum) AS stratum, any_value(base_failed) AS base_failed, min(step) FILTER (metric > cutoff) AS step FROM x JOIN grid USING (rule) GROUP BY doc_id),
k AS (SELECT stratum, t AS step, count(*) AS n, count(*) FILTER (step <= t) AS k FROM y JOIN good USING (doc_id), range({steps}) r(t) WHERE NOT base_failed GROUP BY ALL),
q AS (SELECT *, CASE WHEN k >= n * {allowed!r} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({allowed!r}) + (n - i) * ln(1 - {allowed!r})))
  FROM (SELECT unnest(range(k + 1)) AS i)) END AS tail FROM k),
z AS (SELECT stratum, max(step) AS certified FROM (SELECT *, min(CASE WHEN tail <= {level!r} THEN 1 ELSE 0 END) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM q)
  WHERE ok = 1 GROUP BY ALL),
f AS (SELECT doc_id FROM y JOIN z ON y.stratum = z.stratum WHERE y.step <= z.certified)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, repeats AS n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM f) AS kept FROM b
"""


def _mix() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    q = PACKET_WORDS
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size,
  CAST('0x' || substr(md5('0:' || doc_id), 1, 15) AS BIGINT) AS turn FROM documents),
s AS (SELECT source, sum(size) AS source_size, ([{weights}])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM d GROUP BY source),
level(k, level) AS (
  SELECT 0, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) / (SELECT sum(weight) FROM s)
  UNION ALL
  SELECT k + 1, (SELECT (sum(source_size) - sum(CASE WHEN weight * level <= {MOST_PASSES} * source_size THEN 0 ELSE {MOST_PASSES} * source_size END))
    / sum(CASE WHEN weight * level <= {MOST_PASSES} * source_size THEN weight ELSE 0 END) FROM s) FROM level WHERE k < 50),
t AS (SELECT s.*, CAST(least(weight * (SELECT arg_max(level, k) FROM level), {MOST_PASSES} * source_size) AS DOUBLE) AS target FROM s),
u AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, unnest(range(CAST(least({MOST_PASSES}, floor(target / source_size) + 1) AS BIGINT))) AS round FROM u WHERE size > 0 AND target > 0),
p AS (SELECT *, unnest(range(CAST(ceil(size / {q}) AS BIGINT))) AS k FROM r),
f AS (SELECT doc_id, turn, round, k, least(size, (k + 1) * {q}) - k * {q} AS words,
  CAST(round * source_size + ahead + least(size, (k + 1) * {q}) AS DOUBLE) / target AS finish FROM p),
c AS (SELECT *, sum(words) OVER (ORDER BY finish, turn, doc_id, round, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f),
g AS (SELECT doc_id, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - (upto - words)))) AS taken FROM c GROUP BY doc_id)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM u LEFT JOIN g USING (doc_id)
"""


def _spelling() -> str:
    """Counts with crc32 spelled out, near words by equal strings with a code point left out, forms by recursion."""
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tab),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all({LOWERED}, '[a-zÀ-ÿ]+')) AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS times, encode(doc_id || ':' || run) AS bytes FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
h AS (SELECT run, times, xor(list_reduce(list_transform(range(octet_length(bytes)), lambda i: CAST('0x' || hex(bytes[i + 1 : i + 1]) AS BIGINT)),
  lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) AS h FROM k, crc),
w AS (SELECT CASE WHEN h % {TYPO_MODULUS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
g AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word AS x, b.word AS y FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word FROM g JOIN v ON g.rest = v.word),
b AS (SELECT x AS word, count(*) AS n_near, min(struct_pack(minus := -v.n, other := encode(v.word))) AS best FROM e JOIN v ON e.y = v.word GROUP BY x),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= {RATIO} * n THEN decode(best.other) END AS form,
  CASE WHEN -best.minus >= {RATIO} * n THEN -best.minus END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
c(word, reached, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON c.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(reached, steps) AS root FROM c GROUP BY word) t ON f.word = t.word
"""


ORACLES = {
    "op2_suffix_dedup": OP2,
    "op3_ngram_jaccard": OP3,
    "op4_exact_dedup": OP4,
    "op8_quality_rules": _rules(),
    "op10_mixing": _mix(),
    "op13_spelling": _spelling(),
}
