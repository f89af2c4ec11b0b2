"""Checking a table of requests against a table of argument specifications.

Requests are (row_id, arg, value), values as text. A spec row has `arg`, `type`,
`required`, `options` (array of struct(option, on), in declared order), `initial` and
`visible_when` (array of struct(other, allowed)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import args as fa

# Declared arguments that are sent to every task.
LARGEST_SPEC = 10_000


def check_unknown_args(requests: DataFrame, spec: DataFrame) -> DataFrame:
    """The argument names of each request that the spec does not have, sorted."""
    unknown = requests.join(spec.select("arg"), "arg", "left_anti").select("row_id", "arg").distinct()
    return unknown.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_list("arg")), ", ").alias("unknown"))


def _one_row(spec: DataFrame, *columns: str) -> DataFrame:
    """The whole spec as one row, to be sent to every task: its size is looked at first.

    Every request has a row for each argument in the answer, so a specification that is refused here
    would multiply the requests by as much.
    """
    declared = spec.limit(LARGEST_SPEC + 1).count()
    if declared > LARGEST_SPEC:
        raise ValueError(f"a specification may declare {LARGEST_SPEC} arguments at most")
    return spec.agg(F.array_sort(F.collect_list(F.struct("pos", "arg", *columns))).alias("_spec"))


def _sent(requests: DataFrame, spec: DataFrame) -> DataFrame:
    """Per request, the values of the arguments the spec knows; every request keeps its row."""
    known = requests.join(spec.select("arg", F.lit(True).alias("_known")), "arg", "left")
    # One value per argument first, so that no more than the spec's arguments are collected.
    present = F.when(F.col("_known"), F.col("value"))
    single = known.groupBy("row_id", F.when(present.isNotNull(), F.col("arg")).alias("arg")).agg(F.max(present).alias("value"))
    return single.groupBy("row_id").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("arg").isNotNull(), F.struct("arg", "value")))).alias("_sent"))


def _per_argument(requests: DataFrame, spec: DataFrame, *columns: str) -> DataFrame:
    return _sent(requests, spec).join(F.broadcast(_one_row(spec, *columns))).select(
        "row_id", "_sent", F.explode("_spec").alias("s"))


def check_required_args(requests: DataFrame, spec: DataFrame) -> DataFrame:
    """Required arguments that are absent or null, and the default of an absent optional choice."""
    rows = _per_argument(requests, spec, "type", "required", "options").filter(
        ~F.map_contains_key("_sent", F.col("s.arg")))
    default = F.get(F.filter("s.options", lambda o: o["on"]), 0)["option"]
    optional_choice = ~F.col("s.required") & (F.col("s.type") == "choice")
    return rows.filter(F.col("s.required") | optional_choice).select(
        "row_id", F.col("s.arg").alias("arg"), F.when(F.col("s.required"), "missing").otherwise("default").alias("finding"),
        F.when(optional_choice, default).alias("value"))


def coerce_scalars(requests: DataFrame, spec: DataFrame) -> DataFrame:
    """Values of scalar arguments in their declared type, or why they are not of it."""
    rows = requests.filter(F.col("value").isNotNull()).join(
        spec.filter(F.col("type").isin("str", "int", "float", "bool")).select("arg", "type"), "arg")
    kind, value = F.col("type"), F.col("value")
    number = F.when(kind == "int", fa.as_integer(value).cast("double")).when(kind == "float", fa.as_number(value))
    flag = F.when(kind == "bool", fa.as_boolean(value))
    good = (kind == "str") | number.isNotNull() | flag.isNotNull()
    return rows.select("row_id", "arg", F.when(kind == "str", value).alias("text"), number.alias("number"), flag.alias("flag"),
                       F.when(~good, F.concat(F.lit("must be a "), kind)).alias("error"))


def check_choice(requests: DataFrame, options: DataFrame) -> DataFrame:
    """Requests whose value is not one of the declared options (option)."""
    return requests.join(options.select(F.col("option").alias("value")).distinct(), "value", "left_anti")


def effective_values(requests: DataFrame, spec: DataFrame) -> DataFrame:
    """The value each argument will have: what was sent, else the options on by default, else the initial one."""
    rows = _per_argument(requests, spec, "options", "initial")
    on = F.transform(F.filter("s.options", lambda o: o["on"]), lambda o: o["option"])
    default = F.when(F.size("s.options") > 0, F.when(F.size(on) > 0, on)).when(
        F.col("s.initial").isNotNull(), F.array("s.initial"))
    sent = F.try_element_at(F.col("_sent"), F.col("s.arg"))
    values = F.coalesce(F.when(sent.isNotNull(), F.array(sent)), default)
    return rows.select("row_id", F.col("s.arg").alias("arg"), values.alias("values")).filter(F.col("values").isNotNull())


def visible_when(requests: DataFrame, spec: DataFrame) -> DataFrame:
    """Whether each argument applies: every argument it depends on must have one of the values named."""
    effective = effective_values(requests, spec).groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("arg", "values"))).alias("_values"))
    rows = effective.join(F.broadcast(_one_row(spec, "visible_when"))).select("row_id", "_values", F.explode("_spec").alias("s"))
    met = F.forall("s.visible_when", lambda c: F.coalesce(
        F.arrays_overlap(F.try_element_at(F.col("_values"), c["other"]), c["allowed"]), F.lit(False)))
    return rows.select("row_id", F.col("s.arg").alias("arg"), F.coalesce(met, F.lit(True)).alias("applies"))
