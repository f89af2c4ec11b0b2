"""Queries over peak measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import costs as ops
from runlens.plans.bindings import PEAK_ORDER, define, peaks, table
from runlens.plans.registry import query

KEY = ["tool", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "ram"]
KEY_SQL = "tool, l_orderkey, l_linenumber, l_partkey, l_quantity, ram"

# The first release of every tool, before 1995, had no epoch of its own.
RELEASE_US = 788_918_400_000_000
# A width is missing on one line in six, and stated as unknown on half of those.
define("measured", f"""(SELECT * REPLACE (CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE width END AS width, CASE WHEN ship_us >= {RELEASE_US} THEN epoch ELSE 0 END AS epoch),
  l_partkey % 12 = 0 AS width_stated, ram AS peak_ram FROM @peaks)""")
define("guarded", """(SELECT tool, l_orderkey, l_linenumber, l_partkey, l_quantity, peak_ram, pos,
  CASE WHEN vram IS NOT NULL AND source = 'card' AND NOT solo THEN NULL ELSE coalesce(vram, 0) END AS vram, ram,
  coalesce(width, 1) AS width, cores, own_only, epoch, ship_us FROM @measured WHERE NOT (width IS NULL AND width_stated) AND ram > 0)""")


def measured(spark, sf):
    part = F.col("l_partkey")
    return peaks(spark, sf).withColumns({
        "width": F.when(part % 6 != 0, F.col("width")), "width_stated": part % 12 == 0, "peak_ram": F.col("ram"),
        "epoch": F.when(F.col("ship_us") >= RELEASE_US, F.col("epoch"))})


GUARD_ORDER = [*PEAK_ORDER[:-1], "peak_ram"]


@query("learn_guard", """SELECT tool, l_orderkey, l_linenumber, l_partkey, l_quantity, vram, ram, width, cores FROM @guarded""")
def learn_guard(spark, sf):
    return ops.learn_guard(measured(spark, sf)).select(
        "tool", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "vram", "ram", "width", "cores")


@query("per_channel", """SELECT tool, l_orderkey, l_linenumber, l_partkey, l_quantity, CAST((vram + width - 1) // width AS BIGINT) AS vram,
  CAST((ram + width - 1) // width AS BIGINT) AS ram, width, round_even(cores / width * 1e3, 0) / 1e3 AS cores FROM @peaks""")
def per_channel(spark, sf):
    return ops.per_channel(peaks(spark, sf)).select(
        "tool", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "vram", "ram", "width", "cores")


@query("trim_window", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY pos DESC) AS age FROM @peaks),
k AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY pos DESC) AS n FROM a WHERE age <= 20 OR vram IS NOT NULL)
SELECT {KEY_SQL}, vram, n AS age FROM k WHERE n <= 40""")
def trim_window(spark, sf):
    return ops.trim_window(peaks(spark, sf), PEAK_ORDER).select(*KEY, "vram", "age")


define("cardwindow", """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY pos DESC) AS age FROM
  (SELECT *, max(vram) OVER (PARTITION BY tool) AS top FROM @peaks WHERE vram IS NOT NULL) WHERE vram > 0 OR top = 0) WHERE age <= 20)""")


@query("vram_window", f"SELECT {KEY_SQL}, vram, age FROM @cardwindow")
def vram_window(spark, sf):
    return ops.vram_window(peaks(spark, sf), PEAK_ORDER).select(*KEY, "vram", "age")


def fit_sql(points: str) -> str:
    """The fit in SQL; `points` has tool, total, width. Suppliers of one width come out proportional."""
    return f"""(WITH w AS (SELECT tool, width, max(total) AS worst FROM {points} WHERE total IS NOT NULL GROUP BY tool, width),
e AS (SELECT tool, count(*) AS widths, min(width) AS lo, max(width) AS hi, arg_min(worst, width) AS wl, arg_max(worst, width) AS wh FROM w GROUP BY tool),
l AS (SELECT *, greatest(0, (wh - wl) / nullif(hi - lo, 0)) AS slope FROM e),
o AS (SELECT *, greatest(0, wl - slope * (lo - 1)) AS one0 FROM l),
s AS (SELECT o.tool, max(CASE WHEN one0 + slope * (width - 1) > 0 THEN worst / (one0 + slope * (width - 1)) END) AS scale FROM o JOIN w USING (tool) GROUP BY o.tool)
SELECT tool, widths, CASE WHEN widths < 2 THEN wl WHEN one0 = 0 AND slope = 0 THEN 0 ELSE CAST(ceil(one0 * scale) AS BIGINT) END AS one,
  CASE WHEN widths < 2 THEN CAST((wl + lo - 1) // lo AS BIGINT) WHEN one0 = 0 AND slope = 0 THEN 0 ELSE CAST(ceil(slope * scale) AS BIGINT) END AS marginal
FROM o JOIN s USING (tool))"""


# Every seventh supplier ran at one width only.
define("points", """(SELECT tool, CASE WHEN vram > 0 THEN vram * width END AS total, CASE WHEN tool % 7 = 0 THEN 3 ELSE width END AS width, ram FROM @peaks)""")
define("fit", fit_sql("@points"))


def points(spark, sf):
    return peaks(spark, sf).select(
        "tool", F.when(F.col("vram") > 0, F.col("vram") * F.col("width")).alias("total"),
        F.when(F.col("tool") % 7 == 0, 3).otherwise(F.col("width")).cast("long").alias("width"), "ram")


@query("affine_fit", "SELECT tool, widths, one, marginal FROM @fit")
def affine_fit(spark, sf):
    return ops.affine_fit(points(spark, sf))


define("wide", f"""(SELECT f.tool, f.widths, f.one AS vram_one, f.marginal AS vram_marginal, g.one AS ram_one, g.marginal AS ram_marginal,
  CAST(f.tool % 5 AS DOUBLE) / 4 AS cores FROM @fit f JOIN {fit_sql('(SELECT tool, ram * width AS total, width FROM @points)')} g USING (tool))""")


def wide(spark, sf):
    base = points(spark, sf)
    card = ops.affine_fit(base).withColumnsRenamed({"one": "vram_one", "marginal": "vram_marginal"})
    host = ops.affine_fit(base.select("tool", (F.col("ram") * F.col("width")).alias("total"), "width")).select(
        "tool", F.col("one").alias("ram_one"), F.col("marginal").alias("ram_marginal"))
    return card.join(host, "tool").withColumn("cores", F.col("tool") % 5 / 4)


@query("predict_cost", """SELECT tool, channels, CASE WHEN channels = 1 THEN vram_one WHEN widths >= 2 THEN vram_one + vram_marginal * (channels - 1)
    ELSE greatest(vram_one, vram_marginal * channels) END AS vram_bytes,
  CASE WHEN channels = 1 THEN ram_one WHEN widths >= 2 THEN ram_one + ram_marginal * (channels - 1) ELSE greatest(ram_one, ram_marginal * channels) END AS ram_bytes,
  cores * channels AS cpu_cores FROM (SELECT *, 1 + tool % 8 AS channels FROM @wide)""")
def predict_cost(spark, sf):
    return ops.predict_cost(wide(spark, sf), 1 + F.col("tool") % 8).select(
        "tool", "channels", "vram_bytes", "ram_bytes", "cpu_cores")


@query("channels_within", """WITH r AS (SELECT *, tool % 4 * 150000000 AS vroom, tool % 5 * 200000000 AS rroom FROM @wide), b AS (SELECT tool,
  CASE WHEN vroom = 0 OR vram_one = 0 THEN NULL WHEN vroom < vram_one THEN 1 WHEN vram_marginal = 0 THEN NULL WHEN widths >= 2 THEN 1 + (vroom - vram_one) // vram_marginal ELSE vroom // vram_marginal END AS v,
  CASE WHEN rroom = 0 OR ram_one = 0 THEN NULL WHEN rroom < ram_one THEN 1 WHEN ram_marginal = 0 THEN NULL WHEN widths >= 2 THEN 1 + (rroom - ram_one) // ram_marginal ELSE rroom // ram_marginal END AS m FROM r)
SELECT tool, CAST(greatest(1, coalesce(least(v, m), v, m, 1)) AS BIGINT) AS channels FROM b""")
def channels_within(spark, sf):
    return ops.channels_within(wide(spark, sf), F.col("tool") % 4 * 150000000, F.col("tool") % 5 * 200000000).select(
        "tool", "channels")


@query("cost_spread", """WITH r AS (SELECT tool, total / (CASE WHEN widths >= 2 THEN one + marginal * (width - 1) ELSE greatest(one, marginal * width) END) AS r
  FROM (SELECT tool, vram * CASE WHEN tool % 7 = 0 THEN 3 ELSE width END AS total, CASE WHEN tool % 7 = 0 THEN 3 ELSE width END AS width FROM @peaks WHERE vram > 0) JOIN @fit USING (tool))
SELECT tool, round_even(CASE WHEN count(r) < 2 THEN 1 ELSE max(r) / min(r) END * 1e6, 0) / 1e6 AS spread FROM r GROUP BY tool""")
def cost_spread(spark, sf):
    width = F.when(F.col("tool") % 7 == 0, 3).otherwise(F.col("width")).cast("long")
    rows = peaks(spark, sf).filter(F.col("vram").isNotNull()).select("tool", F.col("vram").alias("value"), width.alias("width"))
    return ops.cost_spread(rows, ops.affine_fit(points(spark, sf))).select(
        "tool", (F.rint(F.col("spread") * 1e6) / 1e6).alias("spread"))


# A tool's runs one after the other: the window as a list, the held run as a struct, and what each step decides.
ENTRY = "STRUCT(v BIGINT, m BIGINT, w BIGINT, n BIGINT)"
BOUND = ("CASE WHEN len(list_filter(win, lambda x: x.w = width AND x.{f} IS NOT NULL)) >= 3 THEN coalesce(nullif(2 * "
         "list_median(list_transform(list_filter(win, lambda x: x.w = width AND x.{f} IS NOT NULL), lambda x: x.{f})), 0), 'infinity') ELSE 'infinity' END")
PAIRED = "(NOT {o} OR coalesce(held.{f} <= 2 * {f} AND {f} <= 2 * held.{f}, false))"
FOLD = f"""(WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY pos) AS n, CAST((vram + width - 1) // width AS BIGINT) AS v,
  CAST((ram + width - 1) // width AS BIGINT) AS m FROM {{rows}}),
f AS (SELECT DISTINCT tool, CAST(0 AS BIGINT) AS n, CAST([] AS {ENTRY}[]) AS win, CAST(NULL AS {ENTRY}) AS held, false AS own, CAST(0 AS BIGINT) AS samples,
  CAST([] AS STRUCT(n BIGINT, status VARCHAR)[]) AS fate FROM g
UNION ALL
SELECT tool, n, list_filter(grown, lambda x, i: i > len(grown) - 20 OR x.v IS NOT NULL)[-40:], CASE WHEN NOT (ov OR om) THEN held WHEN pair THEN NULL ELSE cur END, own,
  samples + CASE WHEN NOT (ov OR om) OR pair THEN 1 ELSE 0 END,
  CASE WHEN NOT (ov OR om) THEN [{{'n': n, 'status': 'learned'}}] WHEN pair THEN [{{'n': held.n, 'status': 'confirmed'}}, {{'n': n, 'status': 'confirmed'}}]
    WHEN held IS NOT NULL THEN [{{'n': held.n, 'status': 'held'}}] ELSE [] END
FROM (SELECT *, list_concat(win, CASE WHEN NOT (ov OR om) THEN [cur] WHEN pair THEN [held, cur] ELSE [] END) AS grown
FROM (SELECT *, held IS NOT NULL AND held.w = width AND {PAIRED.format(o='ov', f='v')} AND {PAIRED.format(o='om', f='m')} AS pair
FROM (SELECT *, coalesce(v > {BOUND.format(f='v')}, false) AS ov, coalesce(m > {BOUND.format(f='m')}, false) AS om
FROM (SELECT f.tool, g.n, CASE WHEN own_only AND NOT own THEN CAST([] AS {ENTRY}[]) ELSE win END AS win, held, own OR own_only AS own, samples, g.width, g.v, g.m,
  CAST({{'v': g.v, 'm': g.m, 'w': g.width, 'n': g.n}} AS {ENTRY}) AS cur FROM f JOIN g ON g.tool = f.tool AND g.n = f.n + 1)))))
SELECT * FROM f)"""
define("folded", FOLD.replace("{rows}", "@guarded"))
# Since the epoch of the tool last changed.
define("current", """(SELECT * FROM (SELECT *, max(CASE WHEN before <> epoch THEN pos END) OVER (PARTITION BY tool) AS since
  FROM (SELECT *, lag(epoch) OVER (PARTITION BY tool ORDER BY pos) AS before FROM @guarded)) WHERE since IS NULL OR pos >= since)""")
define("refolded", FOLD.replace("{rows}", "@current"))
NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY tool ORDER BY pos) AS n FROM {rows})"


@query("quarantine_outliers", f"""WITH f AS (SELECT * FROM @folded),
d AS (SELECT tool, unnest(fate) AS fate FROM f),
s AS (SELECT tool, fate.n AS n, fate.status AS status FROM d UNION ALL SELECT tool, last.n, 'held' FROM (SELECT tool, arg_max(held, n) AS last FROM
  (SELECT tool, n, CASE WHEN held IS NULL THEN CAST({{'v': NULL, 'm': NULL, 'w': NULL, 'n': NULL}} AS {ENTRY}) ELSE held END AS held FROM f) GROUP BY tool) WHERE last.n IS NOT NULL)
SELECT tool, l_orderkey, l_linenumber, l_partkey, l_quantity, status FROM s JOIN {NUMBERED.format(rows='@guarded')} USING (tool, n)""")
def quarantine_outliers(spark, sf):
    rows = ops.per_channel(ops.learn_guard(measured(spark, sf)))
    return ops.quarantine_outliers(rows, GUARD_ORDER).select("tool", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "status")


def _spread_sql(fit: str, points: str) -> str:
    """Largest over smallest ratio of what a run took to what the fit expects at its width."""
    expected = "nullif(CASE WHEN c.widths >= 2 THEN f.one + f.marginal * (p.width - 1) ELSE greatest(f.one, f.marginal * p.width) END, 0)"
    return f"""(SELECT tool, CASE WHEN runs > 1 AND least > 0 THEN most / least ELSE 1.0 END AS spread FROM (SELECT tool, count(*) AS runs,
  max(total / {expected}) AS most, min(total / {expected}) AS least FROM {points} p JOIN {fit} f USING (tool) JOIN counted c USING (tool) WHERE total > 0 GROUP BY tool))"""


@query("cost_table", f"""WITH last AS (SELECT tool, arg_max(win, n) AS win, arg_max(samples, n) AS samples FROM @refolded GROUP BY tool),
w AS (SELECT tool, samples, unnest(win) AS e, unnest(range(len(win))) AS place FROM last),
x AS (SELECT w.tool, samples, place, e.v AS v, e.m AS m, e.w AS width, round_even(CASE WHEN cores > 0 THEN cores ELSE 0 END / width * 1e3, 0) / 1e3 AS cores
  FROM w JOIN {NUMBERED.format(rows='@current')} g ON g.tool = w.tool AND g.n = e.n),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY place DESC) AS age FROM x) WHERE age <= 20),
carded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY place DESC) AS age FROM
  (SELECT *, max(v) OVER (PARTITION BY tool) AS top FROM x WHERE v IS NOT NULL) WHERE v <> 0 OR top = 0) WHERE age <= 20),
counted AS (SELECT tool, max(samples) AS samples, count(DISTINCT width) AS widths, greatest(max(cores), 0) AS cores FROM recent GROUP BY tool),
vp AS (SELECT tool, v * width AS total, width FROM carded), rp AS (SELECT tool, m * width AS total, width FROM recent),
vf AS (SELECT * FROM {fit_sql('vp')}), rf AS (SELECT * FROM {fit_sql('rp')}),
vs AS (SELECT * FROM {_spread_sql('vf', 'vp')}), rs AS (SELECT * FROM {_spread_sql('rf', 'rp')})
SELECT tool, samples, counted.widths AS widths, cores, vf.one IS NOT NULL AS vram_known, coalesce(vf.one, 0) AS vram_one, coalesce(vf.marginal, 0) AS vram_marginal,
  coalesce(vs.spread, 1.0) AS vram_spread, coalesce(rf.one, 0) AS ram_one, coalesce(rf.marginal, 0) AS ram_marginal, coalesce(rs.spread, 1.0) AS ram_spread,
  greatest(coalesce(vs.spread, 1.0), coalesce(rs.spread, 1.0)) >= 1.5 AS input_dependent, updated, e.epoch AS epoch
FROM counted JOIN (SELECT tool, max(ship_us) AS updated, max(epoch) AS epoch FROM @current GROUP BY tool) e USING (tool)
LEFT JOIN (SELECT p_partkey AS tool, p_size % 3 AS declared FROM part) d USING (tool) LEFT JOIN vf USING (tool) LEFT JOIN rf USING (tool) LEFT JOIN vs USING (tool) LEFT JOIN rs USING (tool) WHERE declared IS NULL OR declared = e.epoch""")
def cost_table(spark, sf):
    declared = table(spark, sf, "part").select(F.col("p_partkey").alias("tool"), (F.col("p_size") % 3).cast("long").alias("epoch"))
    return ops.cost_table(measured(spark, sf), GUARD_ORDER, declared=declared)


@query("cost_banner", """WITH w AS (SELECT * FROM @wide) SELECT 'heaviest' AS note, arg_min(tool, row(-vram_one, tool)) AS tool FROM w
UNION ALL SELECT 'memory varies', tool FROM w WHERE tool % 3 = 0 UNION ALL SELECT 'split measured', tool FROM w WHERE widths >= 2 AND vram_one > vram_marginal""")
def cost_banner(spark, sf):
    return ops.cost_banner(wide(spark, sf).withColumn("input_dependent", F.col("tool") % 3 == 0))


@query("epoch_reconcile", """SELECT p.tool, p.stored, d.declared, d.declared IS NULL OR p.stored = d.declared AS kept
FROM (SELECT tool, CASE WHEN tool % 4 = 0 THEN 0 ELSE min(epoch) END AS stored FROM @peaks GROUP BY tool) p
LEFT JOIN (SELECT p_partkey AS tool, CAST(p_size % 3 AS BIGINT) AS declared FROM part) d USING (tool)""")
def epoch_reconcile(spark, sf):
    entries = peaks(spark, sf).groupBy("tool").agg(F.min("epoch").alias("_e")).select(
        "tool", F.when(F.col("tool") % 4 == 0, "none").otherwise(F.col("_e").cast("string")).alias("epoch"))
    declared = table(spark, sf, "part").select(
        F.col("p_partkey").alias("tool"), (F.col("p_size") % 3).cast("long").alias("epoch"))
    return ops.epoch_reconcile(entries, declared).select("tool", "stored", "declared", "kept")


@query("price_requests", """WITH q AS (SELECT o_orderkey AS run_id, o_custkey % 120 AS tool, o_custkey % 2 = 0 AS uses_gpu, 1 + o_orderkey % 6 AS channels FROM orders),
j AS (SELECT q.*, w.widths, w.cores, vram_one, vram_marginal, ram_one, ram_marginal, w.tool IS NOT NULL AND (NOT uses_gpu OR q.tool % 9 <> 0) AS measured FROM q LEFT JOIN @wide w USING (tool)),
p AS (SELECT *, CASE WHEN channels = 1 THEN vram_one WHEN widths >= 2 THEN vram_one + vram_marginal * (channels - 1) ELSE greatest(vram_one, vram_marginal * channels) END AS v,
  CASE WHEN channels = 1 THEN ram_one WHEN widths >= 2 THEN ram_one + ram_marginal * (channels - 1) ELSE greatest(ram_one, ram_marginal * channels) END AS m FROM j)
SELECT run_id, tool, uses_gpu, channels, measured, CASE WHEN measured AND cores > 0 THEN greatest(4, CAST(floor(cores * channels * CAST(1.3 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) ELSE 4 END AS cpus,
  CASE WHEN measured THEN CAST(floor(m * CAST(1.3 AS DOUBLE)) AS BIGINT) ELSE 1000000000 END AS ram_bytes,
  CASE WHEN NOT measured THEN 2000000000 WHEN uses_gpu THEN CAST(floor(v * CAST(1.3 AS DOUBLE)) AS BIGINT) ELSE 0 END AS vram_bytes FROM p""")
def price_requests(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 120).alias("tool"),
        (F.col("o_custkey") % 2 == 0).alias("uses_gpu"), (1 + F.col("o_orderkey") % 6).alias("channels"))
    costs = wide(spark, sf).withColumn("vram_known", F.col("tool") % 9 != 0)
    return ops.price_requests(requests, costs, 4, 1_000_000_000, 2_000_000_000)
