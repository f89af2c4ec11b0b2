"""Queries that check requests against argument specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import args as fa
from runlens.functions.text import compound_extension
from runlens.operators import validate as ops
from runlens.plans.bindings import define, events, table
from runlens.plans.events import EXTENSION, uploads
from runlens.plans.registry import query

# Fixed input of the checks: the arguments a request may have.
SPEC = """SELECT * FROM VALUES
  (1, 'count', 'int', true, array(), NULL, array()),
  (2, 'ratio', 'float', false, array(), '0.5', array()),
  (3, 'verbose', 'bool', false, array(), NULL, array()),
  (4, 'mode', 'choice', false, array(struct('fast', false), struct('slow', true), struct('full', false)), NULL, array()),
  (5, 'label', 'str', true, array(), NULL, array()),
  (6, 'depth', 'int', false, array(), NULL, array(struct('mode', array('slow', 'full')))),
  (7, 'note', 'str', false, array(), NULL, array(struct('mode', array('fast')), struct('ratio', array('0.5')))),
  (8, 'parts', 'multichoice', false, array(struct('a', true), struct('b', true), struct('c', false)), NULL,
   array(struct('verbose', array('true', '1'))))
  AS s(pos, arg, type, required, options, initial, visible_when)"""
OPTIONS = "array<struct<option:string,on:boolean>>"
CONDITIONS = "array<struct<other:string,allowed:array<string>>>"
SPEC_SQL = """(SELECT * FROM (VALUES (1, 'count', 'int', true, NULL, NULL), (2, 'ratio', 'float', false, NULL, '0.5'),
  (3, 'verbose', 'bool', false, NULL, NULL), (4, 'mode', 'choice', false, 'slow', NULL), (5, 'label', 'str', true, NULL, NULL),
  (6, 'depth', 'int', false, NULL, NULL), (7, 'note', 'str', false, NULL, NULL), (8, 'parts', 'multichoice', false, 'a,b', NULL))
  AS s(pos, arg, type, required, on_default, initial))"""
define("spec", SPEC_SQL)
define("sentwide", """(SELECT event_id, CASE WHEN event_id % 9 = 0 THEN concat('x', json_extract_string(props, '$.k')) WHEN event_id % 23 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS "count",
  CASE WHEN event_id % 8 = 0 THEN '0.5' WHEN event_id % 16 = 4 THEN 'abc' END AS ratio,
  (['true', 'FALSE', '1', 'maybe'])[event_id % 4 + 1] AS verbose, CASE event_id % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'full' WHEN 2 THEN 'odd' END AS mode,
  CASE WHEN event_id % 7 > 0 THEN event_type END AS label, CASE WHEN event_id % 10 = 0 THEN 'v1' END AS extra1, CASE WHEN event_id % 15 = 0 THEN 'v2' END AS extra0 FROM events)""")
define("sent", """(SELECT event_id AS row_id, arg, value FROM (UNPIVOT (SELECT * FROM @sentwide) ON "count", "ratio", "verbose", "mode", "label", "extra1", "extra0" INTO NAME arg VALUE value)
  UNION ALL SELECT event_id, 'count', NULL FROM events WHERE event_id % 23 = 0 AND event_id % 9 <> 0)""")


def spec(spark):
    return spark.sql(SPEC).select(
        "pos", "arg", "type", "required", F.col("options").cast(OPTIONS).alias("options"),
        F.col("initial").cast("string").alias("initial"), F.col("visible_when").cast(CONDITIONS).alias("visible_when"))


def requests(spark, sf):
    """Requests in long form, from events: some arguments absent, null, unknown or of the wrong kind."""
    n, k = F.col("event_id"), F.col("k")

    def pair(arg, value, when=None):
        row = F.struct(F.lit(arg).alias("arg"), value.cast("string").alias("value"))
        return row if when is None else F.when(when, row)

    entries = F.array(
        pair("count", F.when(n % 9 == 0, F.concat(F.lit("x"), k)).when(n % 23 == 0, F.lit(None)).otherwise(k.cast("string"))),
        pair("ratio", F.when(n % 8 == 0, "0.5").otherwise("abc"), (n % 8 == 0) | (n % 16 == 4)),
        pair("verbose", F.get(F.array(*[F.lit(v) for v in ("true", "FALSE", "1", "maybe")]), (n % 4).cast("int"))),
        pair("mode", F.when(n % 5 == 0, "fast").when(n % 5 == 1, "full").otherwise("odd"), n % 5 < 3),
        pair("label", F.col("event_type"), n % 7 > 0), pair("extra1", F.lit("v1"), n % 10 == 0), pair("extra0", F.lit("v2"), n % 15 == 0))
    source = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return source.select(n.alias("row_id"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("row_id", "e.*")


@query("check_unknown_args", """SELECT row_id, string_agg(DISTINCT arg, ', ' ORDER BY arg) AS unknown FROM @sent
WHERE arg NOT IN (SELECT arg FROM @spec) GROUP BY row_id""")
def check_unknown_args(spark, sf):
    return ops.check_unknown_args(requests(spark, sf), spec(spark))


@query("check_required_args", """SELECT event_id AS row_id, s.arg, CASE WHEN required THEN 'missing' ELSE 'default' END AS finding,
  CASE WHEN NOT required THEN on_default END AS value FROM events CROSS JOIN @spec s LEFT JOIN @sent q ON q.row_id = event_id AND q.arg = s.arg
WHERE q.value IS NULL AND (required OR type = 'choice')""")
def check_required_args(spark, sf):
    return ops.check_required_args(requests(spark, sf), spec(spark))


@query("coerce_scalars", """WITH v AS (SELECT row_id, q.arg, type, value, CASE WHEN type = 'int' AND regexp_full_match(value, '[+-]?[0-9]+') THEN CAST(try_cast(value AS BIGINT) AS DOUBLE)
  WHEN type = 'float' THEN try_cast(value AS DOUBLE) END AS number, CASE WHEN type = 'bool' THEN CASE WHEN lower(value) IN ('true', '1') THEN true WHEN lower(value) IN ('false', '0') THEN false END END AS flag
  FROM @sent q JOIN @spec s USING (arg) WHERE value IS NOT NULL AND type IN ('str', 'int', 'float', 'bool'))
SELECT row_id, arg, CASE WHEN type = 'str' THEN value END AS text, number, flag,
  CASE WHEN type <> 'str' AND number IS NULL AND flag IS NULL THEN concat('must be a ', type) END AS error FROM v""")
def coerce_scalars(spark, sf):
    return ops.coerce_scalars(requests(spark, sf), spec(spark))


@query("check_choice", """SELECT o_orderkey AS row_id, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def check_choice(spark, sf):
    options = spark.sql("SELECT * FROM VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM') AS o(option)")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("value"))
    return ops.check_choice(rows, options).select("row_id", "value")


define("effective", """(SELECT event_id AS row_id, s.arg, coalesce(q.value, on_default, initial) AS value FROM events CROSS JOIN @spec s
  LEFT JOIN (SELECT * FROM @sent WHERE value IS NOT NULL) q ON q.row_id = event_id AND q.arg = s.arg)""")


@query("effective_values", "SELECT row_id, arg, value FROM @effective WHERE value IS NOT NULL")
def effective_values(spark, sf):
    return ops.effective_values(requests(spark, sf), spec(spark)).select(
        "row_id", "arg", F.array_join("values", ",").alias("value"))


@query("visible_when", """WITH e AS (SELECT row_id, max(value) FILTER (arg = 'mode') AS mode, max(value) FILTER (arg = 'ratio') AS ratio,
  max(value) FILTER (arg = 'verbose') AS loud FROM @effective GROUP BY row_id)
SELECT row_id, arg, CASE arg WHEN 'depth' THEN mode IN ('slow', 'full') WHEN 'note' THEN mode = 'fast' AND ratio = '0.5'
  WHEN 'parts' THEN loud IN ('true', '1') ELSE true END AS applies FROM e CROSS JOIN @spec""")
def visible_when(spark, sf):
    return ops.visible_when(requests(spark, sf), spec(spark))


define("lists", """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(' ["', lang, '", "', source, '"] ') WHEN 1 THEN concat('[', lang) ELSE text END AS t FROM documents)""")


@query("parse_list_arg", """SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN len(l) END AS items, CASE WHEN doc_id % 4 <> 1 THEN array_to_string(l, '|') END AS joined FROM (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN from_json(t, '["VARCHAR"]') WHEN doc_id % 4 > 1 THEN
    list_filter(list_transform(string_split(t, ','), lambda p: regexp_replace(p, '^[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1680}\\x0b\\x1c-\\x1f]+|[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1680}\\x0b\\x1c-\\x1f]+$', '', 'g')), lambda p: p <> '') END AS l FROM @lists)""")
def parse_list_arg(spark, sf):
    n = F.col("doc_id")
    value = (F.when(n % 4 == 0, F.concat(F.lit(' ["'), "lang", F.lit('", "'), "source", F.lit('"] ')))
             .when(n % 4 == 1, F.concat(F.lit("["), "lang")).otherwise(F.col("text")))
    items = fa.parse_list(value)
    return table(spark, sf, "documents").select(n, items.alias("_i")).select(
        "doc_id", F.size("_i").alias("items"), F.array_join("_i", "|").alias("joined")).withColumn(
        "items", F.when(F.col("items") >= 0, F.col("items")))


@query("parse_multichoice", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a=true,b=false,c=true' WHEN 1 THEN 'a=true,b=true,c=false' END AS selection,
  CASE p_partkey % 6 WHEN 2 THEN 'unknown option' WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'not a boolean' WHEN 5 THEN 'too few selected' END AS error FROM part""")
def parse_multichoice(spark, sf):
    texts = ["{\"a\": true, \"b\": \"0\", \"c\": \"TRUE\"}", " a, b ,", "a,z", "{oops", "{\"a\": \"maybe\"}", ""]
    value = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 6).cast("int"))
    parsed = fa.parse_multichoice(value, ["a", "b", "c"], 1)
    return table(spark, sf, "part").select("p_partkey", parsed.alias("p")).select(
        "p_partkey", F.array_join(F.transform("p.selection", lambda f: F.concat(f["option"], F.lit("="), f["on"].cast("string"))), ",")
        .alias("selection"), "p.error")


@query("parse_vec2", """WITH v AS (SELECT event_id, value / 100 AS x, k / 50 AS y FROM @evt),
e AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'two numbers expected' WHEN event_id % 13 = 0 THEN 'not numbers' WHEN NOT x BETWEEN 0 AND 1 THEN 'x outside its range'
  WHEN NOT y BETWEEN CAST(0.2 AS DOUBLE) AND CAST(1.5 AS DOUBLE) THEN 'y outside its range' END AS error FROM v)
SELECT event_id, CASE WHEN error IS NULL THEN x END AS x, CASE WHEN error IS NULL THEN y END AS y, error FROM e""")
def parse_vec2(spark, sf):
    n = F.col("event_id")
    x, y = F.col("fraction").cast("string"), (F.col("k") / 50).cast("string")
    text = (F.when(n % 11 == 0, F.concat(F.lit("["), x, F.lit("]"))).when(n % 13 == 0, F.concat(x, F.lit(", up")))
            .otherwise(F.concat(F.lit("("), x, F.lit(", "), y, F.lit(")"))))
    return events(spark, sf).select("event_id", fa.parse_vec2(text, (0.0, 1.0), (1.5, 0.2)).alias("v")).select("event_id", "v.*")


@query("plain_settings", """SELECT doc_id, array_to_string(list_slice(list_sort(list_transform(string_split(text, ' '), lambda w: substr(w, 1, 60))), 1, 40), '|') AS listed,
  array_to_string(list_filter(['c', 'lang', 'x'], lambda o: (o = 'c' AND doc_id % 2 = 0) OR (o = 'lang' AND lang = 'en') OR (o = 'x' AND doc_id % 3 = 0)), '|') AS flags,
  substr(text, 1, 120) AS scalar FROM documents""")
def plain_settings(spark, sf):
    n = F.col("doc_id")
    flags = F.create_map(F.lit("x"), n % 3 == 0, F.lit("lang"), F.col("lang") == "en", F.lit("c"), n % 2 == 0)
    return table(spark, sf, "documents").select(
        n, F.array_join(fa.plain_list(F.split("text", " ")), "|").alias("listed"),
        F.array_join(fa.plain_map(flags), "|").alias("flags"), fa.plain_scalar(F.col("text")).alias("scalar"))


@query("count_items", """SELECT event_id, nullif((CASE WHEN k > 50 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END), 0) AS ticked,
  nullif(event_id % 4, 0) AS listed, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS parts FROM @evt""")
def count_items(spark, sf):
    n, k = F.col("event_id"), F.col("k")
    flags = F.create_map(F.lit("a"), k > 50, F.lit("b"), n % 2 == 0, F.lit("c"), F.lit(False))
    items = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (n % 4).cast("int"))
    text = F.when(n % 3 == 0, "alone").when(n % 3 == 1, " a, ,").otherwise("a,b")
    return events(spark, sf).select(n, fa.count_flags(flags).alias("ticked"), fa.count_list(items).alias("listed"),
                                    fa.count_text(text).alias("parts"))


@query("type_by_extension", f"""SELECT page_id, CASE WHEN e IN ('.nii', '.nii.gz') THEN 'nifti_file' WHEN e IN ('.nrrd', '.nrrd.gz', '.gipl', '.gipl.gz', '.zip') THEN 'volume_or_zip_file'
  WHEN e = '.csv' THEN 'csv_file' END AS type FROM (SELECT page_id, {EXTENSION.format(f='file')} AS e FROM @uploads)""")
def type_by_extension(spark, sf):
    return uploads(spark, sf).select("page_id", fa.type_by_extension(
        compound_extension(F.col("file")), ["nifti_file", "volume_or_zip_file", "csv_file"]).alias("type"))
