"""Queries over artifact trees, files and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import artifacts as ops
from runlens.plans.bindings import define, events, snapshots, table
from runlens.plans.events import EXTENSION, uploads
from runlens.plans.registry import query


def hashed(spark, sf):
    return tuple(ops.snapshot(side) for side in snapshots(spark, sf))


STATUS = ("CASE WHEN r.name IS NULL THEN 'only_left' WHEN l.name IS NULL THEN 'only_right' "
          "WHEN l.sha256 = r.sha256 THEN 'identical' ELSE 'differing' END")


@query("compare_artifacts", f"""SELECT coalesce(l.name, r.name) AS name, {STATUS} AS status FROM @left l FULL JOIN @right r ON l.name = r.name""")
def compare_artifacts(spark, sf):
    return ops.compare_artifacts(*hashed(spark, sf))


@query("parity_summary", f"""WITH c AS (SELECT {STATUS} AS s FROM @left l FULL JOIN @right r ON l.name = r.name)
SELECT count(*) FILTER (s = 'identical') AS identical, count(*) FILTER (s = 'differing') AS differing, count(*) FILTER (s = 'only_left') AS only_left,
  count(*) FILTER (s = 'only_right') AS only_right, bool_and(s = 'identical') AS ok FROM c""")
def parity_summary(spark, sf):
    return ops.parity_summary(ops.compare_artifacts(*hashed(spark, sf)))


@query("pair_renamed", """WITH l AS (SELECT * FROM @left WHERE name NOT IN (SELECT name FROM @right)),
r AS (SELECT * FROM @right WHERE name NOT IN (SELECT name FROM @left)),
p AS (SELECT l.name AS left_name, r.name AS right_name, CASE WHEN l.sha256 = r.sha256 THEN 'identical' ELSE 'differing' END AS status
  FROM l JOIN r ON r.name = concat('input_', l.name)),
a AS (SELECT * FROM p UNION ALL SELECT name, NULL, 'unpaired_left' FROM l WHERE name NOT IN (SELECT left_name FROM p)
  UNION ALL SELECT NULL, name, 'unpaired_right' FROM r WHERE name NOT IN (SELECT right_name FROM p))
SELECT *, (SELECT bool_and(status = 'identical') FROM a) AND NOT EXISTS (SELECT 1 FROM @left x JOIN @right y ON x.name = y.name AND x.sha256 <> y.sha256) AS content_ok FROM a""")
def pair_renamed(spark, sf):
    return ops.pair_renamed(*hashed(spark, sf), [("d", "input_d")])


@query("json_key_diff", """WITH d AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'k' END AS a, CASE WHEN event_id % 7 = 0 THEN 't.b' END AS b,
  CASE WHEN event_id % 11 = 0 THEN 'l[length]' WHEN event_id % 13 = 0 THEN 'l[1].x' END AS c, CASE WHEN event_id % 17 = 0 THEN 't.a' END AS e FROM @evt)
SELECT concat('e', event_id) AS name, true AS readable, path FROM (UNPIVOT d ON a, b, c, e INTO NAME n VALUE path)""")
def json_key_diff(spark, sf):
    log = events(spark, sf)
    name = F.concat(F.lit("e"), "event_id").alias("name")
    n, k = F.col("event_id"), F.col("k")

    def document(k, a, b, l):
        return F.to_json(F.struct(k.alias("k"), F.struct(a.alias("a"), b.alias("b")).alias("t"), l.alias("l"))).alias("content")

    def listed(x, longer):
        first = F.struct(F.lit(1).alias("x"))
        two = F.array(first, F.struct(x.cast("int").alias("x")))
        return F.when(longer, F.array_append(two, first)).otherwise(two)

    none = F.lit(None).cast("long")
    left = log.select(name, document(k, k, k, listed(F.lit(2), F.lit(False))))
    right = log.select(name, document(F.when(n % 5 == 0, k + 1).otherwise(k), F.when(n % 17 == 0, k + 1).otherwise(k),
                                      F.when(n % 7 == 0, none).otherwise(k),
                                      listed(F.when(n % 13 == 0, 3).otherwise(2), n % 11 == 0)))
    return ops.json_key_diff(left, right)


LINES = ("list_filter(string_split_regex({t}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), "
         "lambda x, i: i < len(string_split_regex({t}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) OR x <> '')")


@query("text_line_diff", f"""WITH p AS (SELECT l.name, {LINES.format(t='l.content')} AS a, {LINES.format(t='r.content')} AS b FROM @left l JOIN @right r ON l.name = r.name),
c AS (SELECT *, list_slice(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]), 1, 40) AS c FROM p)
SELECT name, len(a) AS left_lines, len(b) AS right_lines, len(c) >= 40 AS truncated, line, substr(a[line], 1, 200) AS left, substr(b[line], 1, 200) AS right
FROM (SELECT *, unnest(CASE WHEN len(c) > 0 THEN c ELSE [NULL] END) AS line FROM c)""")
def text_line_diff(spark, sf):
    return ops.text_line_diff(*snapshots(spark, sf))


@query("byte_diff", """WITH p AS (SELECT l.name, l.size AS ls, r.size AS rs, hex(encode(l.content)) AS a, hex(encode(r.content)) AS b FROM @left l JOIN @right r ON l.name = r.name),
d AS (SELECT *, least(ls, rs) AS n, CASE WHEN a = b THEN [] ELSE list_filter(range(least(ls, rs)), lambda i: substr(a, 2 * i + 1, 2) <> substr(b, 2 * i + 1, 2)) END AS d FROM p)
SELECT name, ls AS left_size, rs AS right_size, n AS compared_bytes, false AS truncated,
  CASE WHEN len(d) > 0 THEN d[1] WHEN ls <> rs THEN n END AS first_differing_offset, len(d) AS differing_bytes,
  CASE WHEN n > 0 THEN len(d) / n ELSE 0 END AS differing_fraction FROM d""")
def byte_diff(spark, sf):
    return ops.byte_diff(*snapshots(spark, sf))


@query("numeric_distance", """WITH p AS (SELECT a.vec_id, a.embedding AS x, CASE WHEN a.vec_id % 10 = 0 THEN list_slice(b.embedding, 1, 5) ELSE b.embedding END AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
g AS (SELECT *, CASE WHEN len(x) = len(y) THEN list_transform(list_zip(x, y), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)) END AS g FROM p)
SELECT vec_id, len(x) = len(y) AS size_equal, len(g) AS elements, len(list_filter(g, lambda v: v <> 0)) AS differing,
  len(list_filter(g, lambda v: v <> 0)) / len(g) AS differing_fraction, list_max(g) AS max_abs, round_even(list_sum(g) / len(g) * 1e9, 0) / 1e9 AS mean_abs,
  round_even(sqrt(list_sum(list_transform(g, lambda v: v * v)) / len(g)) * 1e9, 0) / 1e9 AS rms,
  CASE WHEN len(x) <> len(y) THEN 'the two do not have the same size' END AS reason FROM g""")
def numeric_distance(spark, sf):
    vectors = table(spark, sf, "embeddings")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.when((F.col("vec_id") - 1) % 10 == 0, F.slice("embedding", 1, 5))
                           .otherwise(F.col("embedding")).alias("right"))
    pairs = vectors.select("vec_id", F.col("embedding").alias("left")).join(other, "vec_id")
    out = ops.numeric_distance(pairs)
    return out.withColumns({c: F.rint(F.col(c) * 1e9) / 1e9 for c in ("mean_abs", "rms")})


@query("exact_dedup", """WITH f AS (SELECT *, octet_length(encode(text)) AS size, CASE WHEN doc_id % 3 = 0 THEN concat(source, '/', lang, '/', doc_id) ELSE concat(source, '/', doc_id) END AS path,
  CASE WHEN doc_id % 3 = 0 THEN [source, '1', lang, CAST(doc_id AS VARCHAR)] ELSE [source, '0', CAST(doc_id AS VARCHAR)] END AS walk FROM documents),
k AS (SELECT sha256(text) AS sha, size, arg_min(path, walk) AS keeper FROM f WHERE size >= 100 GROUP BY ALL)
SELECT path, keeper, f.size AS freed FROM f JOIN k ON sha256(text) = sha AND f.size = k.size WHERE path <> keeper""")
def exact_dedup(spark, sf):
    folder = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "source", "lang")).otherwise(F.col("source"))
    files = table(spark, sf, "documents").select(
        F.concat_ws("/", folder, "doc_id").alias("path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    return ops.exact_dedup(files, 100)


@query("shared_copies", """SELECT distribution, path, copies, inodes, CASE WHEN inodes = 1 THEN size * (copies - 1) ELSE 0 END AS saved,
  CASE WHEN inodes > 1 AND size >= 1024 THEN size * (copies - 1) ELSE 0 END AS wasted
FROM (SELECT l_partkey AS distribution, l_linenumber AS path, count(*) AS copies, count(DISTINCT l_orderkey % 3) AS inodes, l_partkey * 10 AS size
  FROM lineitem GROUP BY l_partkey, l_linenumber) WHERE copies > 1""")
def shared_copies(spark, sf):
    entries = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("distribution"), F.col("l_linenumber").alias("path"), F.col("l_suppkey").alias("environment"),
        (F.col("l_orderkey") % 3).alias("inode"), (F.col("l_partkey") * 10).alias("size"))
    return ops.shared_copies(entries)


@query("tree_fingerprint", """SELECT source AS tree, count(*) AS files, source <> 'src1' AS stale,
  sha256(string_agg(concat(lang, '/', doc_id, '.txt', chr(0), text, chr(0)), '' ORDER BY lang, concat(doc_id, '.txt'))) AS digest FROM documents WHERE lang <> 'es' GROUP BY source""")
def tree_fingerprint(spark, sf):
    documents = table(spark, sf, "documents")
    ending = F.when(F.col("lang") == "es", ".pyc").otherwise(".txt")
    files = documents.select(F.col("source").alias("tree"), F.concat("lang", F.lit("/"), "doc_id", ending).alias("path"), F.col("text").alias("content"))
    stored = ops.tree_fingerprint(files.filter(F.col("tree") == "src1"))
    return ops.tree_fingerprint(files, stored)


@query("input_shape", """WITH f AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS run_id, regexp_extract(url, '^https?://[^/]*/([a-z]*)', 1) AS argument,
  file AS path, length(html) AS size, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]*)', 1), regexp_extract(url, '^https?://[^/]*/([a-z]*)', 1) ORDER BY file, page_id) AS n,
  """ + EXTENSION.format(f='file') + """ AS e FROM @pagefiles)
SELECT run_id, argument, least(count(*), 6) AS files, sum(size) FILTER (n <= 5) AS bytes, coalesce(string_agg(DISTINCT e, ' ' ORDER BY e) FILTER (n <= 5 AND e <> ''), '') AS extensions,
  count(*) > 5 AS partial, CASE WHEN argument = 'fr' THEN 'fr' END AS hosted FROM f GROUP BY run_id, argument""")
def input_shape(spark, sf):
    pages = uploads(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    argument = F.regexp_extract("url", "^https?://[^/]*/([a-z]*)", 1)
    files = pages.select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("run_id"), argument.alias("argument"),
        F.when(argument == "fr", "/data/tool/fr/").alias("hosted"),
        F.col("file").alias("path"), F.char_length("html").alias("size"), "page_id")
    return ops.input_shape(files, 5, ["path", "page_id"])


define("pagefiles", "(SELECT u.*, p.html FROM @uploads u JOIN pages p USING (page_id))")
TERMS = ["the", "and", "les", "der", "und", "que", "los", "of"]


@query("term_counts", """WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
h AS (SELECT kind, id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda w: list_contains(['the', 'and', 'les', 'der', 'und', 'que', 'los', 'of'], w)) AS h FROM t)
SELECT kind, id, len(h) AS hits, array_to_string(list_sort(list_distinct(h)), ' ') AS words, len(h) > 30 AS over_budget FROM h""")
def term_counts(spark, sf):
    texts = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").union(
        table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    return ops.term_counts(texts, TERMS, 30)


@query("normalize_paths", """SELECT page_id, key, CASE WHEN starts_with(value, '/out/a/') THEN concat('<artifact:', substr(value, 8), '>') WHEN value = '/out/a' THEN '<output root>'
  WHEN starts_with(value, '/') THEN '<path>' ELSE value END AS value FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'result' WHEN 2 THEN 'elapsed' ELSE 'note' END AS key,
  CASE WHEN page_id % 10 = 0 THEN '/out/a' WHEN page_id % 3 = 0 THEN concat('/out/a/', regexp_replace(url, '^https?://', '')) WHEN page_id % 3 = 1 THEN concat('/', regexp_replace(url, '^https?://', '')) ELSE url END AS value FROM pages) WHERE key <> 'elapsed'""")
def normalize_paths(spark, sf):
    n = F.col("page_id")
    bare = F.regexp_replace("url", "^https?://", "")
    rows = table(spark, sf, "pages").select(
        n, F.when(n % 4 == 0, "log").when(n % 4 == 1, "result").when(n % 4 == 2, "elapsed").otherwise("note").alias("key"),
        F.when(n % 10 == 0, "/out/a").when(n % 3 == 0, F.concat(F.lit("/out/a/"), bare)).when(n % 3 == 1, F.concat(F.lit("/"), bare))
        .otherwise(F.col("url")).alias("value"))
    return ops.normalize_paths(rows, ["/out/a"])


@query("only_right", "SELECT name FROM @right EXCEPT SELECT name FROM @left")
def only_right(spark, sf):
    return ops.only_right(*snapshots(spark, sf))


@query("key_union", "SELECT name FROM @left UNION SELECT name FROM @right")
def key_union(spark, sf):
    return ops.key_union(*snapshots(spark, sf))


@query("ordered_distinct", """SELECT text, row_number() OVER (ORDER BY conv_id, turn) AS position FROM (SELECT text, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS n,
  conv_id, turn FROM conversations) WHERE n = 1""")
def ordered_distinct(spark, sf):
    return ops.ordered_distinct(table(spark, sf, "conversations"), "text", ["conv_id", "turn"])
