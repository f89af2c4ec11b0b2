"""The tool catalogue, its call graph, run reports and data manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numbers import count_if
from runlens.functions.text import base_name, canonical_name
from runlens.operators.artifacts import ordered_distinct
from runlens.operators.ordered import along, join_on, rank
from runlens.session import checkpointed

# The kinds of a manifest, and which changed path asks for what.
KINDS = ["models", "testfiles"]
IMAGE_PREFIXES = ["docker/"]
RECREATE_PATHS = ["docker-compose.yml"]
RECREATE_PREFIXES = ["server/requirements"]
DATA_MANIFEST = "scripts/data-manifest.yml"
ENVIRONMENT_FILES = ["pyproject.toml", "uv.lock"]


def missing_callees(tools: DataFrame, calls: DataFrame) -> DataFrame:
    """Per caller, the tools it calls that the catalogue does not have, sorted."""
    absent = calls.select("caller", "callee").distinct().join(
        tools.select(F.col("tool").alias("callee")), "callee", "left_anti")
    return absent.groupBy("caller").agg(F.array_join(F.array_sort(F.collect_list("callee")), ", ").alias("missing"))


def stop_points(tools: DataFrame, calls: DataFrame) -> DataFrame:
    """Every point a run of a tool can be stopped at, those inside its callees included.

    A callee's own points come before the call; a tool already open on the branch is not
    entered again. `calls` has (caller, pos, callee, is_call).
    """
    known = tools.select("tool", F.lit(True).alias("_known"))
    entered = calls.join(known.withColumnRenamed("tool", "callee"), "callee", "left").select(
        "caller", "pos", "callee", (F.col("is_call") & F.col("_known").isNotNull()).alias("enters"))
    edges = checkpointed(entered.join(known.withColumnRenamed("tool", "caller"), "caller", "left").select(
        "caller", "pos", "callee", (F.col("enters") & (F.col("caller") != F.col("callee"))).alias("enters"),
        F.col("_known").isNotNull().alias("starts")))
    # One level a round: a path grows by one call, until no path enters another tool.
    level = checkpointed(edges.filter("starts").select(
        F.col("caller").alias("tool"), F.col("callee").alias("last"), F.col("callee").alias("point"),
        F.array("pos").alias("place"), F.array("caller").alias("open"), "enters"))
    steps = edges.select(F.col("caller").alias("last"), F.col("pos").alias("_pos"), F.col("callee").alias("_callee"), F.col("enters").alias("_enters"))
    levels = []
    while True:
        levels.append(level.select("tool", "point", "last", "place"))
        inside = level.filter("enters")
        if inside.isEmpty():
            break
        opened = F.array_append("open", F.col("last"))
        level = checkpointed(inside.join(steps, "last").select(
            "tool", F.col("_callee").alias("last"), F.concat("point", F.lit("/"), "_callee").alias("point"),
            F.array_append("place", F.col("_pos")).alias("place"), opened.alias("open"),
            (F.col("_enters") & ~F.array_contains(opened, F.col("_callee"))).alias("enters")))
    while len(levels) > 1:
        # In pairs, so that the plan is not as deep as the calls.
        levels = [a.unionByName(b) for a, b in zip(levels[::2], levels[1::2])] + levels[len(levels) // 2 * 2:]
    # A place ends in a high mark while it is compared, so that what lies inside a call sorts before the call itself.
    walked = levels[0].withColumn("place", F.array_append("place", F.lit(2147483647)))
    return along(checkpointed(walked), ["tool"], ["place"], position=rank()).select("tool", "position", "point", "last")


def stop_kinds(points: DataFrame, tools: DataFrame, declared: DataFrame) -> DataFrame:
    """What a reader may do at each point: as the tool declared it, else as the tool named by its
    last segment reviews, else `view`. `declared` has (tool, point, kind)."""
    own = join_on(points, declared.select("tool", "point", F.col("kind").alias("_own")), ["tool", "point"], "left")
    named = own.withColumn("_last", F.element_at(F.split("point", "/"), -1))
    called = named.join(tools.select(F.col("tool").alias("_last"), F.lit(True).alias("_known"), F.col("review_kind").alias("_review")),
                        "_last", "left")
    short = declared.select("tool", F.col("point").alias("_last"), F.col("kind").alias("_short"))
    both = join_on(called, short, ["tool", "_last"], "left")
    inherited = F.when(F.col("_known"), F.col("_review")).otherwise(F.col("_short"))
    return both.select("tool", "point", F.coalesce("_own", inherited, F.lit("view")).alias("kind"))


def duplicate_names(tools: DataFrame, name: str = "name") -> DataFrame:
    """Names that are the same once case and separators are gone."""
    return tools.groupBy(canonical_name(F.col(name)).alias("canonical")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(name).alias("first"), F.max(name).alias("last")).filter(F.col("copies") > 1)


def schema_merge(specs: DataFrame, options: DataFrame) -> DataFrame:
    """One specification for several modes: per argument its modes, whether it is required, its
    options, and whether its meaning conflicts between modes.

    `specs` has (mode, mode_pos, arg, type, accepts, required); `options` has (mode, mode_pos, arg,
    option, on, pos). The first mode's default wins and a choice keeps a single one.
    """
    modes = specs.select("mode").distinct().agg(F.count(F.lit(1)).alias("_modes"))
    identity = F.struct("type", F.coalesce("accepts", F.lit("")), "required")
    merged = specs.groupBy("arg").agg(
        F.count_distinct(identity).alias("_kinds"), F.min_by("type", "mode_pos").alias("type"),
        F.bool_and("required").alias("_required"), F.count_distinct("mode").alias("_in"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("mode_pos", "mode"))), lambda m: m["mode"]), ",")
        .alias("modes")).join(F.broadcast(modes))
    first = options.groupBy("arg", "option").agg(
        F.min(F.struct("mode_pos", "pos")).alias("_place"), F.min_by("on", F.struct("mode_pos", "pos")).alias("on"))
    default = first.filter("on").groupBy("arg").agg(F.min("_place").alias("_default"))
    kinds = merged.select("arg", F.col("type").alias("_type"))
    single = join_on(join_on(first, default, ["arg"], "left"), kinds, ["arg"]).withColumn(
        "on", F.col("on") & ((F.col("_type") != "choice") | (F.col("_place") == F.col("_default"))))
    listed = single.groupBy("arg").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_place", "option", "on"))),
        lambda o: F.concat(o["option"], F.lit("="), o["on"].cast("string"))), ",").alias("options"))
    everywhere = F.col("_in") == F.col("_modes")
    return join_on(merged, listed, ["arg"], "left").select(
        "arg", "type", (F.col("_kinds") > 1).alias("conflict"), (F.col("_required") & everywhere).alias("required"),
        F.when(~everywhere, F.col("modes")).alias("visible_in"), F.coalesce("options", F.lit("")).alias("options"))


# -- run reports: (pos, case_id, input, inputs map, produced array), `pos` giving their order ----------


def report_inputs(report: DataFrame, wanted: DataFrame) -> DataFrame:
    """What the wanted cases were given, in report order: one row per argument, or one without a name."""
    kept = report.join(wanted.select("case_id").distinct(), "case_id", "left_semi")
    entries = F.coalesce(F.map_entries("inputs"), F.array())
    named = F.transform(entries, lambda e: F.struct(e["key"].alias("argument"), e["value"].alias("path")))
    single = F.filter(F.array(F.struct(F.lit(None).cast("string").alias("argument"), F.col("input").alias("path"))),
                      lambda e: e["path"].isNotNull())
    return kept.select("pos", "case_id", F.explode(F.concat(single, named)).alias("i")).select("pos", "case_id", "i.argument", "i.path")


def report_produced(report: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files the wanted cases produced, each once, in the order of first mention."""
    kept = report.join(wanted.select("case_id").distinct(), "case_id", "left_semi")
    files = kept.select("pos", F.posexplode("produced").alias("_at", "path")).filter(F.col("path").isNotNull())
    return ordered_distinct(files, "path", ["pos", "_at"])


def case_of_files(report: DataFrame, files: DataFrame) -> DataFrame:
    """The first case of the report that produced, or was given, a file of each file's name; else empty."""
    names = report.select("pos", "case_id", F.explode(F.array_distinct(F.filter(F.transform(
        F.concat(F.coalesce("produced", F.array()), F.array("input")), base_name),
        lambda n: F.coalesce(n != "", F.lit(False))))).alias("_name"))
    first = names.groupBy("_name").agg(F.min_by("case_id", "pos").alias("case_id"))
    return files.withColumn("_name", base_name(F.col("path"))).join(first, "_name", "left").withColumn(
        "case_id", F.coalesce("case_id", F.lit(""))).drop("_name")


def narrow_to_cases(inputs: DataFrame, wanted: DataFrame, stated: DataFrame) -> DataFrame:
    """The inputs a job is run again on: those of the wanted cases, or all of them whenever anything
    about the wanted ones is not certain.

    `inputs` has (job, argument, path), `wanted` (job, case_id), `stated` (job, case_id, argument, path),
    where a report says which file a case has under an argument; without it the case names the file.
    """
    arguments = inputs.select("job", "argument").distinct()
    several = arguments.groupBy("job").agg(F.count(F.lit(1)).alias("_arguments"))
    said = stated.select("job").distinct().withColumn("_said", F.lit(True))
    asked = wanted.select("job", "case_id").distinct()
    need = join_on(join_on(asked, arguments, ["job"]), stated.select("job", "case_id", "argument", F.col("path").alias("_path")),
                   ["job", "case_id", "argument"], "left").withColumn("path", F.coalesce("_path", "case_id"))
    present = join_on(need, inputs.select("job", "argument", "path", F.lit(True).alias("_there")), ["job", "argument", "path"], "left")
    escapes = F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), "..")
    jobs = present.groupBy("job").agg(F.bool_and(F.col("_there").isNotNull() & ~escapes).alias("_sure"))
    sure = join_on(join_on(jobs, several, ["job"]), said, ["job"], "left").filter(
        F.col("_sure") & ((F.col("_arguments") == 1) | F.col("_said"))).select("job", F.lit(True).alias("_narrow"))
    judged = join_on(join_on(inputs, sure, ["job"], "left"),
                     need.select("job", "argument", "path", F.lit(True).alias("_kept")).distinct(), ["job", "argument", "path"], "left")
    return judged.filter(F.col("_narrow").isNull() | F.col("_kept")).select(
        *inputs.columns, F.col("_narrow").isNotNull().alias("narrowed"))


# -- data manifests: entries (tool, kind, pos, name, url, sha256, size, dest, extract, split, unpinned) --


def manifest_flatten(manifest: DataFrame, kinds: Sequence[str] = tuple(KINDS), only_tools: Sequence[str] | None = None) -> DataFrame:
    """Nested manifests (tool, sections: map of kind to entries) as one row per entry."""
    rows = manifest if only_tools is None else manifest.filter(F.col("tool").isin(list(only_tools)))
    return rows.select("tool", F.explode("sections").alias("kind", "_entries")).filter(F.col("kind").isin(list(kinds))).select(
        "tool", "kind", F.posexplode("_entries").alias("index", "_e")).select("tool", "kind", "index", "_e.*")


def _bare(name: Column) -> Column:
    return ~name.contains("/") & ~name.isin("", ".", "..")


def manifest_rules(entries: DataFrame) -> DataFrame:
    """Entries that break a rule, with the names of the rules they break."""
    no = F.lit(False)
    named = F.col("name").isNotNull()
    broken = {
        "name and url required": ~named | F.col("url").isNull(),
        "https only": ~F.startswith(F.lower("url"), F.lit("https://")),
        "sha256 or unpinned": (F.coalesce("sha256", F.lit("")) == "") & ~F.coalesce("unpinned", no),
        "bare name": named & ~_bare(F.col("name")),
        "relative dest": F.startswith("dest", F.lit("/")) | F.array_contains(F.split("dest", "/"), ".."),
        "bare split": ~_bare(F.col("split")),
        "split needs extract": F.col("split").isNotNull() & ~F.coalesce("extract", no),
    }
    failed = F.filter(F.array(*[F.when(F.coalesce(c, no), name) for name, c in broken.items()]), lambda r: r.isNotNull())
    return entries.withColumn("broken", F.array_join(failed, "; ")).filter(F.col("broken") != "")


def resolve_aliases(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Asked-for names as manifest keys, through their canonical form or what a key provides.

    `manifest` has (key, provides), `wanted` (pos, name). Known names give their key once, at its
    first request; unknown names keep a row without a key.
    """
    aliases = manifest.select("key", F.posexplode(F.concat(F.array("key"), F.coalesce("provides", F.array()))).alias("_at", "_alias"))
    index = aliases.groupBy(canonical_name(F.col("_alias")).alias("_name")).agg(F.min_by("key", F.struct("key", "_at")).alias("key"))
    asked = wanted.withColumn("_name", canonical_name(F.col("name"))).join(index, "_name", "left")
    known = asked.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("pos").alias("pos")).withColumn(
        "name", F.lit(None).cast("string"))
    unknown = asked.filter(F.col("key").isNull()).groupBy("name").agg(F.min("pos").alias("pos")).withColumn(
        "key", F.lit(None).cast("string"))
    return known.unionByName(unknown).select("pos", "key", F.col("name").alias("unknown"))


def manifest_state(entries: DataFrame, stamps: DataFrame, keys: Sequence[str] = ("pos",)) -> DataFrame:
    """Each entry as missing, outdated or current. No stamp or no hash reads as current; a current
    entry whose derived view is gone is outdated."""
    joined = join_on(entries, stamps, list(keys), "left")
    state = (F.when(~F.coalesce("present", F.lit(False)), "missing")
             .when(F.col("sha256").isNotNull() & (F.col("stamp") != F.col("sha256")), "outdated")
             .when(F.col("split").isNotNull() & ~F.coalesce("view_present", F.lit(True)), "outdated").otherwise("current"))
    return joined.withColumn("state", state)


def refresh_targets(states: DataFrame) -> DataFrame:
    """Tools with something on disk and something that is not current."""
    return states.groupBy("tool").agg(
        F.bool_or(F.col("state") != "missing").alias("_some"), F.bool_or(F.col("state") != "current").alias("_stale")).filter(
        F.col("_some") & F.col("_stale")).select("tool")


def manifest_rollup(entries: DataFrame) -> DataFrame:
    """Entries and bytes per tool and kind, per tool, and in all."""
    return entries.rollup("tool", "kind").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
        F.grouping_id().alias("level"))


# -- changed paths -----------------------------------------------------------------------------------


def _starts(path: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.startswith(path, F.lit(prefix))
    return found


def classify_changes(paths: DataFrame) -> DataFrame:
    """What a set of changed paths asks for: the heaviest action, the paths behind it, and per tool
    how many files changed and whether its environment did."""
    path = F.col("path")
    weight = F.when(_starts(path, IMAGE_PREFIXES), 3).when(
        path.isin(RECREATE_PATHS) | _starts(path, RECREATE_PREFIXES), 2).otherwise(1)
    weighed = paths.withColumn("_weight", weight)
    names = F.array(F.lit("restart"), F.lit("recreate"), F.lit("image"))
    server = weighed.agg(F.max("_weight").alias("_heaviest"), count_if(F.col("_weight") > 1).alias("files"),
                         F.bool_or(path == DATA_MANIFEST).alias("flag")).select(
        F.lit("server").alias("scope"), F.get(names, F.col("_heaviest") - 1).alias("name"), "files", F.coalesce("flag", F.lit(False)).alias("flag"))
    heavy = weighed.filter(F.col("_weight") > 1).select(
        F.lit("heavy").alias("scope"), path.alias("name"), F.lit(1).cast("long").alias("files"), (F.col("_weight") == 3).alias("flag"))
    parts = F.split(path, "/")
    tool = F.get(parts, 1)
    inside = (F.size(parts) >= 3) & (F.get(parts, 0) == "tools") & ~tool.rlike("^[_.]")
    tools = paths.filter(inside).groupBy(tool.alias("name")).agg(
        F.count(F.lit(1)).alias("files"), F.bool_or(F.element_at(parts, -1).isin(ENVIRONMENT_FILES)).alias("flag")).select(
        F.lit("tool").alias("scope"), "name", "files", "flag")
    return server.unionByName(heavy).unionByName(tools)


def changed_dependents(paths: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Environments to rebuild because a folder they install was changed, with the package each.

    A path is met by any folder above it: its prefixes are listed and joined by equality.
    """
    parts = F.split("path", "/")
    prefixes = paths.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    return dependencies.join(prefixes, "folder").select("environment", "package").distinct()
