"""Queries over the tool catalogue, run reports, data manifests and changed paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import catalogue as ops
from runlens.plans.bindings import calls, define, manifest, stamps, table
from runlens.plans.registry import query


@query("missing_callees", """SELECT caller, string_agg(DISTINCT callee, ', ' ORDER BY callee) AS missing FROM @calls
WHERE callee NOT IN (SELECT tool FROM @tools) GROUP BY caller""")
def missing_callees(spark, sf):
    return ops.missing_callees(*calls(spark, sf))


WALK = """WITH RECURSIVE walk AS (SELECT caller AS tool, callee AS last, callee AS point, [pos] AS place, [caller] AS open FROM @calls
UNION ALL SELECT w.tool, c.callee, concat(w.point, '/', c.callee), list_append(w.place, c.pos), list_append(w.open, w.last)
FROM walk w JOIN @calls c ON c.caller = w.last WHERE NOT list_contains(w.open, w.last))"""


@query("stop_points", WALK + """SELECT tool, point, row_number() OVER (PARTITION BY tool ORDER BY list_append(place, 1000)) AS position FROM walk""")
def stop_points(spark, sf):
    tools, edges = calls(spark, sf)
    return ops.stop_points(tools, edges.withColumn("is_call", F.lit(True))).select("tool", "position", "point")


define("declared", """(SELECT caller AS tool, callee AS point, 'confirm' AS kind FROM @calls WHERE pos = 2 AND caller < 'NATION_2')""")


@query("stop_kinds", WALK + """SELECT w.tool, w.point, coalesce(d.kind, CASE WHEN t.tool IS NOT NULL THEN t.review_kind ELSE s.kind END, 'view') AS kind FROM walk w
LEFT JOIN @declared d ON d.tool = w.tool AND d.point = w.point LEFT JOIN @tools t ON t.tool = w.last LEFT JOIN @declared s ON s.tool = w.tool AND s.point = w.last""")
def stop_kinds(spark, sf):
    tools, edges = calls(spark, sf)
    points = ops.stop_points(tools, edges.withColumn("is_call", F.lit(True))).select("tool", "point")
    declared = edges.filter((F.col("pos") == 2) & (F.col("caller") < "NATION_2")).select(
        F.col("caller").alias("tool"), F.col("callee").alias("point"), F.lit("confirm").alias("kind"))
    return ops.stop_kinds(points, tools, declared)


@query("duplicate_names", """SELECT replace(replace(n, ' ', ''), '_', '') AS canonical, count(*) AS copies, min(n) AS first, max(n) AS last
FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END AS n FROM part) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_names(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    return ops.duplicate_names(table(spark, sf, "part").select(name.alias("name")))


define("argspecs", """(SELECT p_brand AS mode, CAST(substr(p_brand, 7) AS BIGINT) AS mode_pos, p_name AS arg, CASE WHEN length(p_name) % 2 = 0 THEN 'choice'
  WHEN p_brand = 'Brand#3' THEN 'int' ELSE 'multichoice' END AS type, true AS required FROM part GROUP BY p_brand, p_name)""")
define("argoptions", """(SELECT p_brand AS mode, CAST(substr(p_brand, 7) AS BIGINT) AS mode_pos, p_name AS arg, p_type AS option, max(p_size) > 25 AS "on", min(p_partkey) AS pos
  FROM part GROUP BY p_brand, p_name, p_type)""")


@query("schema_merge", """WITH m AS (SELECT arg, count(DISTINCT type) AS kinds, arg_min(type, mode_pos) AS type, count(DISTINCT mode) AS n, string_agg(mode, ',' ORDER BY mode_pos) AS modes FROM @argspecs GROUP BY arg),
f AS (SELECT arg, option, arg_min("on", row(mode_pos, pos)) AS "on", min(row(mode_pos, pos)) AS place FROM @argoptions GROUP BY arg, option),
s AS (SELECT f.arg, option, place, "on" AND (type <> 'choice' OR place = min(CASE WHEN "on" THEN place END) OVER (PARTITION BY f.arg)) AS "on" FROM f JOIN m USING (arg)),
l AS (SELECT arg, string_agg(concat(option, '=', CAST("on" AS VARCHAR)), ',' ORDER BY place) AS options FROM s GROUP BY arg), t AS (SELECT count(DISTINCT mode) AS t FROM @argspecs)
SELECT arg, type, kinds > 1 AS conflict, n = t AS required, CASE WHEN n < t THEN modes END AS visible_in, coalesce(options, '') AS options FROM m LEFT JOIN l USING (arg) CROSS JOIN t""")
def schema_merge(spark, sf):
    part = table(spark, sf, "part").withColumn("mode_pos", F.substring("p_brand", 7, 10).cast("long"))
    keys = [F.col("p_brand").alias("mode"), "mode_pos", F.col("p_name").alias("arg")]
    kind = F.when(F.char_length("arg") % 2 == 0, "choice").when(F.col("mode") == "Brand#3", "int").otherwise("multichoice")
    specs = part.select(*keys).distinct().withColumns({"type": kind, "accepts": F.lit(None).cast("string"), "required": F.lit(True)})
    options = part.groupBy(*keys, F.col("p_type").alias("option")).agg(
        (F.max("p_size") > 25).alias("on"), F.min("p_partkey").alias("pos"))
    return ops.schema_merge(specs, options)


define("report", """(SELECT conv_id, turn, concat('c', conv_id, '_', turn) AS case_id, CASE WHEN turn % 3 < 2 THEN concat('in/', conv_id * 7 % 1000) END AS input,
  role, text FROM conversations)""")


def report(spark, sf):
    """Cases of a run report in order, from conversations."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        F.struct(conv, turn).alias("pos"), F.concat(F.lit("c"), conv, F.lit("_"), turn).alias("case_id"),
        F.when(turn % 3 < 2, F.concat(F.lit("in/"), conv * 7 % 1000)).alias("input"),
        F.when(F.col("role") == "user", F.create_map(F.lit("t1"), F.concat(F.lit("T1/"), conv), F.lit("t2"), F.concat(F.lit("T2/"), conv)))
        .alias("inputs"), F.split("text", " ").alias("produced"), conv)


def marked(spark, sf):
    """The cases a reader marked: those of good quality."""
    good = table(spark, sf, "labels").filter(F.col("quality") == 1)
    return report(spark, sf).join(good.select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi").select("case_id")


@query("report_inputs", """WITH k AS (SELECT * FROM @report WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT conv_id, turn, case_id, NULL AS argument, input AS path FROM k WHERE input IS NOT NULL
UNION ALL SELECT conv_id, turn, case_id, 't1', concat('T1/', conv_id) FROM k WHERE role = 'user'
UNION ALL SELECT conv_id, turn, case_id, 't2', concat('T2/', conv_id) FROM k WHERE role = 'user'""")
def report_inputs(spark, sf):
    return ops.report_inputs(report(spark, sf), marked(spark, sf)).select("pos.conv_id", "pos.turn", "case_id", "argument", "path")


@query("report_produced", """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS path, generate_subscripts(string_split(text, ' '), 1) AS i FROM @report
  WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT path, row_number() OVER (ORDER BY min(row(conv_id, turn, i))) AS position FROM w GROUP BY path""")
def report_produced(spark, sf):
    return ops.report_produced(report(spark, sf), marked(spark, sf))


@query("case_of_files", """WITH n AS (SELECT conv_id, turn, case_id, CAST(conv_id AS VARCHAR) AS name FROM @report UNION ALL SELECT conv_id, turn, case_id, concat('x', turn) FROM @report
  UNION ALL SELECT conv_id, turn, case_id, CAST(conv_id * 7 % 1000 AS VARCHAR) FROM @report WHERE input IS NOT NULL)
SELECT page_id, coalesce(arg_min(case_id, row(conv_id, turn)), '') AS case_id FROM pages LEFT JOIN n ON name = regexp_extract(url, '([^/]*)$', 1) AND name <> '' GROUP BY page_id""")
def case_of_files(spark, sf):
    conv = F.col("pos.conv_id")
    cases = report(spark, sf).withColumn("produced", F.array(
        F.concat(F.lit("out/"), conv), F.concat(F.lit("out/x"), F.col("pos.turn"))))
    files = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return ops.case_of_files(cases, files).select("page_id", "case_id")


define("jobs", """(SELECT source AS job, CASE WHEN doc_id % 2 = 0 THEN 't1' ELSE 't2' END AS argument, concat(lang, '/', doc_id) AS path, doc_id FROM documents)""")
define("askedcases", """(SELECT d.source AS job, CAST(d.doc_id AS VARCHAR) AS case_id, d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id))""")


@query("narrow_to_cases", """WITH s AS (SELECT a.job, a.case_id, g.argument, CASE WHEN (a.doc_id % 2 = 0) = (g.argument = 't1') OR a.job <> 'src7' THEN coalesce(
    (SELECT concat(d.lang, '/', d.doc_id) FROM documents d WHERE d.source = a.job AND d.lang = a.lang AND (d.doc_id % 2 = 0) = (g.argument = 't1') ORDER BY d.doc_id LIMIT 1), '../x') ELSE 'gone' END AS path
  FROM @askedcases a JOIN (SELECT DISTINCT job, argument FROM @jobs) g USING (job)),
b AS (SELECT s.job, bool_and(j.path IS NOT NULL) AS sure FROM s LEFT JOIN @jobs j ON j.job = s.job AND j.argument = s.argument AND j.path = s.path GROUP BY s.job)
SELECT j.job, j.argument, j.path, coalesce(b.sure, false) AS narrowed FROM @jobs j LEFT JOIN b USING (job)
WHERE NOT coalesce(b.sure, false) OR EXISTS (SELECT 1 FROM s WHERE s.job = j.job AND s.argument = j.argument AND s.path = j.path)""")
def narrow_to_cases(spark, sf):
    documents = table(spark, sf, "documents")
    number = F.col("doc_id")
    path = F.concat("lang", F.lit("/"), "doc_id")
    argument = F.when(number % 2 == 0, "t1").otherwise("t2")
    inputs = documents.select(
        F.col("source").alias("job"), argument.alias("argument"), path.alias("path"))
    asked = documents.join(table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("job"), number.cast("string").alias("case_id"), number, "lang")
    first = documents.groupBy(F.col("source").alias("job"), "lang", argument.alias("argument")).agg(F.min("doc_id").alias("_first"))
    pairs = asked.join(inputs.select("job", "argument").distinct(), "job").join(first, ["job", "lang", "argument"], "left")
    aside = (F.col("job") == "src7") & ((number % 2 == 0) != (F.col("argument") == "t1"))
    stated = pairs.select("job", "case_id", "argument", F.when(aside, "gone").otherwise(
        F.coalesce(F.concat("lang", F.lit("/"), "_first"), F.lit("../x"))).alias("path"))
    return ops.narrow_to_cases(inputs, asked.select("job", "case_id"), stated)


@query("manifest_flatten", """SELECT tool, kind, index, name, size FROM (SELECT tool, 'models' AS kind, 0 AS index, name, size FROM @manifest UNION ALL
  SELECT tool, 'testfiles', 0, name, size FROM @manifest UNION ALL SELECT tool, 'testfiles', 1, name || '.b', size * 2 FROM @manifest) WHERE tool <> 'Brand#4'""")
def manifest_flatten(spark, sf):
    entry = F.struct("name", "size")
    second = F.struct(F.concat("name", F.lit(".b")).alias("name"), (F.col("size") * 2).alias("size"))
    rows = manifest(spark, sf)
    nested = rows.select("tool", F.create_map(F.lit("models"), F.array(entry), F.lit("testfiles"), F.array(entry, second),
                                              F.lit("notes"), F.array(entry)).alias("sections"))
    wanted = [f"Brand#{n}" for n in range(0, 60) if n != 4]
    return ops.manifest_flatten(nested, only_tools=wanted)


@query("manifest_rules", """SELECT pos, array_to_string(list_filter([CASE WHEN name IS NULL THEN 'name and url required' END, CASE WHEN starts_with(url, 'http://') THEN 'https only' END,
  CASE WHEN sha256 IS NULL AND NOT unpinned THEN 'sha256 or unpinned' END, CASE WHEN contains(name, '/') THEN 'bare name' END, CASE WHEN dest IN ('../e', '/abs') THEN 'relative dest' END,
  CASE WHEN split IS NOT NULL AND NOT extract THEN 'split needs extract' END], lambda r: r IS NOT NULL), '; ') AS broken FROM @manifest
WHERE name IS NULL OR starts_with(url, 'http://') OR (sha256 IS NULL AND NOT unpinned) OR contains(name, '/') OR dest IN ('../e', '/abs') OR (split IS NOT NULL AND NOT extract)""")
def manifest_rules(spark, sf):
    return ops.manifest_rules(manifest(spark, sf)).select("pos", "broken")


@query("resolve_aliases", """WITH i AS (SELECT concat('brand', n) AS name, concat('Brand#', n) AS key FROM (SELECT DISTINCT substr(p_brand, 7) AS n FROM part)
  UNION ALL SELECT concat('tool', n), concat('Brand#', n) FROM (SELECT DISTINCT substr(p_brand, 7) AS n FROM part) UNION ALL SELECT 'shared', min(p_brand) FROM part),
a AS (SELECT c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN concat('BRAND_', c_custkey % 50) WHEN 1 THEN concat('Tool ', c_custkey % 50) WHEN 2 THEN 'Shared' ELSE concat('nope', c_custkey % 9) END AS name FROM customer),
j AS (SELECT pos, a.name, key FROM a LEFT JOIN i ON i.name = regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g'))
SELECT min(pos) AS pos, key, NULL AS unknown FROM j WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT min(pos), NULL, name FROM j WHERE key IS NULL GROUP BY name""")
def resolve_aliases(spark, sf):
    number = F.substring("p_brand", 7, 10)
    keys = table(spark, sf, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("key"), F.array(F.concat(F.lit("Tool_"), number), F.lit("Sha-red")).alias("provides"))
    n = F.col("c_custkey")
    name = (F.when(n % 4 == 0, F.concat(F.lit("BRAND_"), n % 50)).when(n % 4 == 1, F.concat(F.lit("Tool "), n % 50))
            .when(n % 4 == 2, "Shared").otherwise(F.concat(F.lit("nope"), n % 9)))
    return ops.resolve_aliases(keys, table(spark, sf, "customer").select(n.alias("pos"), name.alias("name")))


define("states", """(SELECT m.tool, m.pos, CASE WHEN NOT present THEN 'missing' WHEN sha256 IS NOT NULL AND stamp <> sha256 THEN 'outdated'
  WHEN split IS NOT NULL AND NOT view_present THEN 'outdated' ELSE 'current' END AS state FROM @manifest m LEFT JOIN @stamps s USING (pos))""")


@query("manifest_state", "SELECT tool, pos, state FROM @states")
def manifest_state(spark, sf):
    return ops.manifest_state(manifest(spark, sf), stamps(spark, sf)).select("tool", "pos", "state")


@query("refresh_targets", """SELECT tool FROM (SELECT concat(tool, '/', pos % 100) AS tool, state FROM @states) GROUP BY tool
HAVING bool_or(state <> 'missing') AND bool_or(state <> 'current')""")
def refresh_targets(spark, sf):
    states = ops.manifest_state(manifest(spark, sf), stamps(spark, sf))
    return ops.refresh_targets(states.withColumn("tool", F.concat("tool", F.lit("/"), F.col("pos") % 100)))


@query("manifest_rollup", """SELECT tool, kind, count(*) AS entries, sum(size) AS bytes, grouping(tool, kind) AS level FROM @manifest GROUP BY ROLLUP (tool, kind)""")
def manifest_rollup(spark, sf):
    return ops.manifest_rollup(manifest(spark, sf))


define("changed", """(SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('docker/', p) WHEN 1 THEN concat('server/requirements-', p) WHEN 2 THEN concat('tools/', p)
  WHEN 3 THEN concat('tools/', host, '/pyproject.toml') WHEN 4 THEN CASE WHEN page_id % 5 = 0 THEN 'docker-compose.yml' ELSE 'scripts/data-manifest.yml' END ELSE concat('docs/', p) END AS path, host
  FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages))""")


def changed(spark, sf):
    """Changed paths of a release, from pages."""
    n = F.col("page_id")
    bare, host = F.regexp_replace("url", "^https?://", ""), F.regexp_extract("url", "^https?://([^/]*)", 1)
    path = (F.when(n % 6 == 0, F.concat(F.lit("docker/"), bare)).when(n % 6 == 1, F.concat(F.lit("server/requirements-"), bare))
            .when(n % 6 == 2, F.concat(F.lit("tools/"), bare)).when(n % 6 == 3, F.concat(F.lit("tools/"), host, F.lit("/pyproject.toml")))
            .when(n % 6 == 4, F.when(n % 5 == 0, "docker-compose.yml").otherwise("scripts/data-manifest.yml"))
            .otherwise(F.concat(F.lit("docs/"), bare)))
    return table(spark, sf, "pages").select(n, path.alias("path"), host.alias("host"))


@query("classify_changes", """SELECT 'server' AS scope, CASE WHEN bool_or(starts_with(path, 'docker/')) THEN 'image' WHEN bool_or(path = 'docker-compose.yml' OR starts_with(path, 'server/requirements')) THEN 'recreate'
    WHEN count(*) > 0 THEN 'restart' END AS name, count(*) FILTER (starts_with(path, 'docker/') OR path = 'docker-compose.yml' OR starts_with(path, 'server/requirements')) AS files,
  bool_or(path = 'scripts/data-manifest.yml') AS flag FROM @changed
UNION ALL SELECT 'heavy', path, 1, starts_with(path, 'docker/') FROM @changed WHERE starts_with(path, 'docker/') OR path = 'docker-compose.yml' OR starts_with(path, 'server/requirements')
UNION ALL SELECT 'tool', string_split(path, '/')[2], count(*), bool_or(ends_with(path, '/pyproject.toml') OR ends_with(path, '/uv.lock')) FROM @changed
WHERE starts_with(path, 'tools/') AND len(string_split(path, '/')) >= 3 AND NOT regexp_matches(string_split(path, '/')[2], '^[_.]') GROUP BY 2""")
def classify_changes(spark, sf):
    return ops.classify_changes(changed(spark, sf).select("path"))


define("deps", """(SELECT DISTINCT concat('tools/', regexp_extract(url, '^https?://([^/]*)', 1), '/', page_id % 3) AS environment, concat('p', page_id % 5) AS package,
  CASE page_id % 3 WHEN 0 THEN concat('tools/', regexp_extract(url, '^https?://([^/]*)', 1)) WHEN 1 THEN 'docs' ELSE concat('tools/', regexp_extract(url, '^https?://([^/]*/[a-z]*)', 1)) END AS folder FROM pages)""")


@query("changed_dependents", "SELECT DISTINCT environment, package FROM @deps d JOIN @changed c ON c.path = d.folder OR starts_with(c.path, concat(d.folder, '/'))")
def changed_dependents(spark, sf):
    n = F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    deps = table(spark, sf, "pages").select(
        F.concat(F.lit("tools/"), host, F.lit("/"), n % 3).alias("environment"), F.concat(F.lit("p"), n % 5).alias("package"),
        F.when(n % 3 == 0, F.concat(F.lit("tools/"), host)).when(n % 3 == 1, "docs")
        .otherwise(F.concat(F.lit("tools/"), F.regexp_extract("url", "^https?://([^/]*/[a-z]*)", 1))).alias("folder"))
    return ops.changed_dependents(changed(spark, sf).select("path"), deps.distinct())
