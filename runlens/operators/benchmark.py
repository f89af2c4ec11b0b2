"""Tables over benchmark records: latency, network, start-up, concurrency, comparisons.

A record has `tool`, `path`, `status` (ok or failed), `warmup`, `total_seconds`,
`error_message` and whatever columns a table reads beside them. `order` names
the columns that give the records their place in the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numbers import as_micros, count_if, rounded
from runlens.operators.ordered import (along, join_on, lower_middle, medians_of, order_statistics, rank,
                                       summary_of, top_per_group, upper_middle, wide_medians, with_totals)

# The closed list of phases a record may time.
PHASES = ["pack", "upload", "server_exec", "download", "unpack", "job_setup", "interpreter_start",
          "import_stack", "compute", "collect", "other"]


def failed() -> Column:
    return F.col("status") == "failed"


def succeeded() -> Column:
    return F.col("status") == "ok"


def measured() -> Column:
    return succeeded() & ~F.col("warmup")


def measured_only(records: DataFrame) -> DataFrame:
    """Successful records that are not warm-ups."""
    return records.filter(measured())


def stats_summary(records: DataFrame, keys: Sequence[str], value: str = "total_seconds") -> DataFrame:
    """n, median, min, max and nearest-rank p95 of the measured records; empty groups stay."""
    stats = summary_of(measured_only(records), keys, value)
    groups = records.select(*keys).distinct()
    return join_on(groups, stats, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _first_error(order: Sequence[str], length: int = 160) -> Column:
    """The error message of the first failed record in file order."""
    place = F.when(failed(), F.struct(*order))
    message = F.min_by(F.substring(F.coalesce("error_message", F.lit("")), 1, length), place)
    return F.coalesce(message, F.lit(""))


def latency_table(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per tool and path: runs, discarded warm-ups, failures and the latency of what was measured."""
    keys = ["tool", "path"]
    counts = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), count_if(F.col("warmup")).alias("warmup_discarded"),
        count_if(failed()).alias("failed"), _first_error(order).alias("first_error"))
    stats = order_statistics(measured_only(records), keys, "total_seconds",
                             _lo=lower_middle, _hi=upper_middle)
    return join_on(counts, stats, keys, "left").select(
        *keys, "runs", "warmup_discarded", "failed", F.coalesce("n", F.lit(0)).alias("n"),
        rounded((F.col("_lo") + F.col("_hi")) / 2).alias("median_s"), rounded(F.col("min")).alias("min_s"),
        rounded(F.col("max")).alias("max_s"), "first_error")


def network_table(records: DataFrame) -> DataFrame:
    """Per tool, payload and parallelism: medians of the total, the megabytes and each phase."""
    keys = ["tool", "payload", "parallelism"]
    counts = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), count_if(failed()).alias("failed"), count_if(measured()).alias("n"))
    values = {"total_s": F.col("total_seconds"),
              **{f"{n}_mb": F.coalesce(F.col(f"bytes_{n}"), F.lit(0)) / 1e6 for n in ("uploaded", "downloaded")},
              **{f"{p}_s": F.try_element_at(F.col("phases"), F.lit(p)) for p in PHASES}}
    wide = wide_medians(measured_only(records), keys, values)
    return join_on(counts, wide, keys, "left").select(
        *keys, "runs", "failed", "n",
        *[rounded(F.col(m), 1 if m.endswith("_mb") else 4).alias(m) for m in values])


def startup_chain_table(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Start-up records one by one, and chain medians per tool and mode, in one schema."""
    startup = records.filter(F.col("measurement") == "startup").select(
        "measurement", "tool", F.lit("").alias("mode"),
        F.coalesce("local_mode", F.lit("")).alias("local_mode"), F.lit(1).cast("long").alias("runs"),
        F.when(failed(), 1).otherwise(0).cast("long").alias("failed"),
        F.when(succeeded(), 1).otherwise(0).cast("long").alias("n"), F.lit(None).cast("double").alias("median_s"),
        rounded(F.col("interpreter_start_seconds")).alias("interpreter_start_s"),
        rounded(F.col("import_stack_seconds")).alias("import_stack_s"),
        F.coalesce("package", F.lit("")).alias("package"),
        F.substring(F.coalesce("error_message", F.lit("")), 1, 160).alias("error"))
    chains = records.filter(F.coalesce(F.col("measurement") != "startup", F.lit(True)))
    keys = ["tool", "mode"]
    counts = chains.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), count_if(failed()).alias("failed"),
        F.min_by("local_mode", F.when(measured(), F.struct(*order))).alias("_local"),
        _first_error(order).alias("error"))
    stats = order_statistics(measured_only(chains), keys, "total_seconds", _lo=lower_middle, _hi=upper_middle)
    medians = join_on(counts, stats, keys, "left").select(
        F.lit("chain").alias("measurement"), *keys, F.coalesce("_local", F.lit("")).alias("local_mode"),
        "runs", "failed", F.coalesce("n", F.lit(0)).alias("n"),
        rounded((F.col("_lo") + F.col("_hi")) / 2).alias("median_s"), F.lit("").alias("package"), "error")
    return startup.unionByName(medians, allowMissingColumns=True)


def concurrency_table(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per tool and level: jobs, failures, tail latency, throughput, and the card's peak.

    The window and the device readings come from the group's first record.
    """
    keys = ["tool", "concurrency"]
    first = F.min_by(F.struct("window_seconds", "peak_mib", "baseline_mib"), F.struct(*order))
    counts = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs"), count_if(failed()).alias("failed"), count_if(succeeded()).alias("_ok"),
        first.alias("_first"))
    stats = summary_of(measured_only(records), keys, "total_seconds")
    return join_on(counts, stats, keys, "left").select(
        *keys, "jobs", "failed", F.coalesce("n", F.lit(0)).alias("n"),
        rounded(F.col("_first.window_seconds")).alias("window_s"),
        rounded(F.col("_ok") / F.col("_first.window_seconds") * 60, 2).alias("throughput_jobs_per_min"),
        rounded(F.col("median")).alias("p50_s"), rounded(F.col("p95")).alias("p95_s"),
        rounded(F.col("max")).alias("max_s"),
        F.array_max(F.map_values("_first.peak_mib")).alias("peak_vram_mib"),
        F.array_max(F.map_values("_first.baseline_mib")).alias("baseline_vram_mib"))


# Configurations whose names are sent to every task.
MOST_CONFIGS = 10_000
# A name and its separator take three characters at least, so this many names fill 400.
NAMES_SHOWN = 150


def parity_table(records: DataFrame, names: DataFrame) -> DataFrame:
    """One row per comparison or control record, with counts and cut lists of differing names.

    `records` has (record_id, tool, pair, side, status, parity_ok, content_parity_ok,
    error_message); `names` has one row per compared file (record_id, name, result, renamed).
    A control without a comparison is kept only when it failed.
    """
    counts = names.groupBy("record_id").agg(
        count_if(F.col("result") == "identical").alias("identical"),
        count_if(F.col("result") == "differing").alias("differing"),
        count_if(F.col("result") == "only_left").alias("only_local"),
        count_if(F.col("result") == "only_right").alias("only_remote"),
        count_if(F.col("renamed").isNotNull()).alias("renamed_pairs"),
        count_if(F.col("renamed")).alias("renamed_identical"))
    shown = top_per_group(names.filter(F.col("result") == "differing"), ["record_id"],
                          [F.col("name")], NAMES_SHOWN).groupBy("record_id").agg(
        F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("_list"))
    control = F.col("side") == "local_control"
    joined = join_on(join_on(records, counts, ["record_id"], "left"), shown, ["record_id"], "left")
    kept = joined.filter((F.col("side") == "comparison")
                         | (control & (F.col("identical").isNotNull() | failed())))
    listed = F.coalesce("_list", F.lit(""))
    return kept.select(
        "tool", "pair", "status", "parity_ok",
        F.when(control, F.col("parity_ok")).otherwise(F.col("content_parity_ok")).alias("content_parity_ok"),
        "identical", "differing", F.coalesce("only_local", F.lit(0)).alias("only_local"),
        F.coalesce("only_remote", F.lit(0)).alias("only_remote"),
        F.when(control, 0).otherwise(F.coalesce("renamed_pairs", F.lit(0))).alias("renamed_pairs"),
        F.when(control, 0).otherwise(F.coalesce("renamed_identical", F.lit(0))).alias("renamed_identical"),
        F.when(control, F.concat(F.lit("LOCAL-VS-LOCAL CONTROL: "), F.substring(listed, 1, 380)))
        .otherwise(F.substring(listed, 1, 400)).alias("differing_files"),
        F.substring(F.coalesce("error_message", F.lit("")), 1, 200).alias("error"))


def failure_rows(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Failed records, their message cut at 300 characters."""
    return records.filter(failed()).select(
        *columns, F.substring(F.coalesce("error_message", F.lit("")), 1, 300).alias("error_message"))


def campaign_header(records: DataFrame) -> DataFrame:
    """How many records, failures, warm-ups and source files a campaign holds."""
    return records.agg(F.count(F.lit(1)).alias("records"), count_if(failed()).alias("failed"),
                       count_if(F.col("warmup")).alias("warmups"),
                       F.count_distinct("source_file").alias("source_files"))


def hardware_fingerprint(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct host, processor and card lines in first-seen order, flagged when there are several."""
    line = F.concat_ws(" - ", "hostname", "cpu", "gpu")
    lines = records.groupBy(line.alias("line")).agg(
        F.min(F.struct(*order)).alias("_place"), F.count(F.lit(1)).alias("records"))
    placed = along(lines, [], ["_place"], position=rank())
    return with_totals(placed, [], _lines=F.count(F.lit(1))).select(
        "position", "line", "records", (F.col("_lines") > 1).alias("several_machines"))


def throughput_probe(records: DataFrame) -> DataFrame:
    """Per tool and parallelism: the spread of seconds and megabytes per second at the median."""
    keys = ["tool", "parallelism"]
    stats = summary_of(records.filter(succeeded()), keys, "total_seconds")
    moved = records.filter(succeeded()).groupBy(*keys).agg(F.max("bytes_uploaded").alias("_bytes"))
    return join_on(stats, moved, keys).select(
        *keys, "n", rounded(F.col("median")).alias("median_s"), rounded(F.col("min")).alias("min_s"),
        rounded(F.col("max")).alias("max_s"),
        rounded(F.col("_bytes") / 1e6 / F.col("median"), 2).alias("mb_per_s"))


def config_compare(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per configuration in first-run order: spread of seconds and of computing, and the change
    against the first one. Nothing when there is only one configuration."""
    keys = ["config"]
    usable = records.filter(F.col("config").isNotNull())
    counts = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), count_if(succeeded()).alias("ok"), F.min(F.struct(*order)).alias("_place"))
    tables = [counts]
    for value, name in (("total_seconds", "seconds"), ("running", "running")):
        rows = usable.filter(succeeded() & F.col(value).isNotNull())
        if name == "running":
            rows = rows.filter(F.col(value) != 0)
        spread = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{name}_n"),
            rounded(F.sum(as_micros(F.col(value))) / 1e6 / F.count(F.lit(1)), 2).alias(f"{name}_mean"),
            rounded(F.when(F.count(F.lit(1)) > 1, F.stddev_samp(value)), 2).alias(f"{name}_sd"),
            rounded(F.min(value), 2).alias(f"{name}_min"), rounded(F.max(value), 2).alias(f"{name}_max"))
        middle = medians_of(rows, keys, value, "_m").select(
            *keys, rounded(F.col("_m"), 2).alias(f"{name}_median"))
        tables.append(join_on(spread, middle, keys))
    wide = tables[0]
    for other in tables[1:]:
        wide = join_on(wide, other, keys, "left")
    base = counts.agg(F.count(F.lit(1)).alias("_configs"), F.min_by("config", "_place").alias("_first"))
    first = join_on(wide.select("config", F.col("running_mean").alias("_base")),
                    base.select(F.col("_first").alias("config"), "_configs"), keys)
    placed = along(wide, [], ["_place"], position=rank())
    gate = first.select("_base", "_configs").filter(F.col("_configs") >= 2)
    return placed.join(F.broadcast(gate)).select(
        "config", "position", "runs", "ok",
        *[f"{n}_{s}" for n in ("seconds", "running") for s in ("n", "mean", "sd", "median", "min", "max")],
        rounded(F.when(F.col("position") > 1,
                       (F.col("running_mean") - F.col("_base")) / F.col("_base") * 100), 1)
        .alias("delta_percent"))


def config_diff(params: DataFrame) -> DataFrame:
    """Parameters (config, param, value) whose value is not the same in every configuration.

    A configuration that does not set a parameter has the value `default`. Each row of the answer names every
    configuration, so their number is looked at before their names are sent to every task.
    """
    names = params.select("config").distinct()
    known = names.limit(MOST_CONFIGS + 1).count()
    if known > MOST_CONFIGS:
        raise ValueError(f"at most {MOST_CONFIGS} configurations can be compared side by side")
    # Told apart by counts, so that only parameters that differ have their values brought together.
    told = params.groupBy("param").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("config"))).alias("_set"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    unset = (F.col("_set") < known) & ((F.col("_low") != "default") | (F.col("_high") != "default"))
    differing = told.filter((F.col("_low") != F.col("_high")) | unset).select("param")
    values = params.join(differing, "param", "left_semi").groupBy("param").agg(
        F.map_from_entries(F.collect_set(F.struct("config", "value"))).alias("_set"))
    configs = names.agg(F.array_sort(F.collect_list("config")).alias("_configs"))
    return values.join(F.broadcast(configs)).select("param", F.array_join(F.transform("_configs", lambda c: F.concat(
        c, F.lit("="), F.coalesce(F.element_at(F.col("_set"), c), F.lit("default")))), ";").alias("values"))


def arm_summary(records: DataFrame, phases: DataFrame) -> DataFrame:
    """Per arm and phase: how the arm's successful runs spread, and the phase's mean, max and runs.

    `phases` has one row per closed span (arm, phase, seconds).
    """
    counts = records.groupBy("arm").agg(F.count(F.lit(1)).alias("total"), count_if(succeeded()).alias("ok"))
    stats = order_statistics(records.filter(succeeded()), ["arm"], "total_seconds", _lo=lower_middle, _hi=upper_middle)
    detail = phases.groupBy("arm", "phase").agg(
        rounded(F.sum(as_micros(F.greatest("seconds", F.lit(0.0)))) / 1e6 / F.count(F.lit(1)), 2)
        .alias("phase_mean"),
        rounded(F.max(F.greatest("seconds", F.lit(0.0))), 2).alias("phase_max"),
        F.count(F.lit(1)).alias("phase_runs"))
    arms = join_on(counts, stats, ["arm"], "left").select(
        "arm", "ok", "total", rounded(F.col("min"), 2).alias("fastest_seconds"),
        rounded(F.col("max"), 2).alias("slowest_seconds"),
        rounded((F.col("_lo") + F.col("_hi")) / 2, 2).alias("median_seconds"))
    return join_on(arms, detail, ["arm"], "left")


REACHED = 0.75


def limit_verdict(arms: DataFrame) -> DataFrame:
    """Whether a limit test broke, fell short of its budget, or held. A zero peak is no reading."""
    ratio = F.when((F.col("budget_vram") > 0) & (F.col("peak_vram") > 0),
                   F.col("peak_vram") / F.col("budget_vram"))
    broke = ((F.coalesce("failed", F.lit(0)) > 0) | (F.coalesce("oom", F.lit(0)) > 0)
             | (F.coalesce("health_failures", F.lit(0)) > 0))
    return arms.withColumn("reached", rounded(ratio)).withColumn(
        "verdict", F.when(broke, "broke").when(ratio < REACHED, "short").otherwise("held"))


def campaign_tiles(arms: DataFrame) -> DataFrame:
    """The figures a campaign is introduced with, one row each, and one row per arm that lost runs
    or did not hold its limit. The first arm wins a tie."""
    judged = limit_verdict(arms)
    place = -F.col("pos")
    lost = F.col("total") - F.col("ok")
    totals = judged.agg(
        F.sum("total").alias("runs"), F.count(F.lit(1)).alias("arms"), F.sum(lost).alias("failures"),
        F.max("peak_running").alias("widest"),
        F.max_by(F.concat_ws(" ", "arm", "tool"), F.struct("peak_running", place)).alias("widest_arm"),
        F.max("peak_vram").alias("vram"),
        F.max_by("arm", F.struct("peak_vram", place)).alias("vram_arm"),
        rounded(F.sum(as_micros(F.col("wall_seconds"))) / 1e6, 3).alias("wall"))
    tiles = totals.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("tile"), F.col(value).cast("double").alias("value"), note.alias("note"))
        for name, value, note in (
            ("runs", "runs", F.col("arms").cast("string")), ("failures", "failures", F.lit(None).cast("string")),
            ("most at once", "widest", F.when(F.col("widest") > 0, F.col("widest_arm"))),
            ("peak vram", "vram", F.when(F.col("vram") > 0, F.col("vram_arm"))),
            ("on the clock", "wall", F.lit(None).cast("string")))])).alias("t")).select("t.*")
    failed = judged.filter(lost > 0).select(
        F.lit("failed arm").alias("tile"), lost.cast("double").alias("value"), F.col("arm").alias("note"))
    limits = judged.filter(F.col("verdict") != "held").select(
        F.concat(F.lit("limit "), F.col("verdict")).alias("tile"), F.col("reached").alias("value"),
        F.col("arm").alias("note"))
    return tiles.unionByName(failed).unionByName(limits)


def arm_families(arms: DataFrame) -> DataFrame:
    """Arms by the leading letters of their code, on one common scale per family."""
    letters = F.regexp_extract(F.coalesce("arm", F.lit("?")), "^[A-Za-z]+", 0)
    keyed = arms.withColumn("family", F.when(letters == "", "?").otherwise(F.upper(letters)))
    # Names and levels are counted before they are listed: only three names are ever shown.
    names = keyed.groupBy("family", "tool").agg(F.min("pos").alias("_at"))
    few = top_per_group(names, ["family"], [F.col("_at"), F.col("tool")], 3).groupBy("family").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_position", "tool"))),
                                 lambda t: t["tool"]), ", ").alias("_few"))
    tools = join_on(names.groupBy("family").agg(F.count(F.lit(1)).alias("_tools")), few, ["family"])
    levels = keyed.filter(F.col("clients").isNotNull()).groupBy("family").agg(
        F.array_join(F.array_sort(F.collect_set("clients")), ", ").alias("client_levels"))
    scale = keyed.groupBy("family").agg(
        F.count(F.lit(1)).alias("arms"), rounded(F.max("wall_seconds"), 3).alias("max_wall"))
    return join_on(join_on(scale, tools, ["family"]), levels, ["family"], "left").select(
        "family", "arms", "max_wall", "client_levels",
        F.when(F.col("_tools") <= 3, F.col("_few")).otherwise(F.concat("_tools", F.lit(" tools"))).alias("tools"))


def device_peaks(samples: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per device: the highest reading, the first reading, how many; and the highest of all devices."""
    devices = samples.groupBy("device").agg(
        F.max("used").alias("peak"), F.min_by("used", F.struct(*order)).alias("baseline"),
        F.count(F.lit(1)).alias("samples"))
    overall = devices.agg(F.max("peak").alias("overall_peak"))
    return devices.join(F.broadcast(overall))


def phase_other(records: DataFrame) -> DataFrame:
    """The part of the total no named phase accounts for; a negative one is a finding."""
    named = F.aggregate(F.map_values(F.col("phases")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return records.withColumn("other", F.col("total_seconds") - named)
