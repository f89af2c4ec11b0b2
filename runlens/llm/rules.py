"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose metric is above a cutoff. Cutoffs come from a fixed grid, from
lenient to strict, and all rules are made stricter together, one step of their grids at a time. For
each stratum (band of length) the steps are tested in that order on the labelled documents: a step
is certified if the exact binomial tail shows that its rules together reject less than the allowed
share of good documents; the first that fails ends the walk. The walk needs no correction inside a
stratum, nor do the rules, which are tested as one; over strata the level is divided by their number
(Bonferroni).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import SPACE, SPACES, UPPER, WORD, text_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8

GRIDS = {
    "symbol_share": (0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_line_share": (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4),
    "same_word_share": (0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55),
    "word_length": (20.0, 15.0, 12.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}


@dataclass(frozen=True)
class Risk:
    """At most `false_rejection` of a stratum's good documents are rejected, with `confidence`."""

    false_rejection: float = 0.01
    confidence: float = 0.95
    bands: tuple[int, ...] = (100, 300, 1000)


def named(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row, also where the optimizer merges projections."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight words that occur twice or more."""

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"), i.alias("last")),
            lambda acc: acc["sum"])

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), named(ordered, covered)).otherwise(F.lit(0).cast("bigint"))

    def windows(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    count = lambda words: F.when(F.size(words) > WINDOW, named(windows(words), counted)).otherwise(F.lit(0).cast("bigint"))
    return named(words, count)


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with the base columns and the rules' metrics, all from the whole text."""
    out = docs.withColumn("__text", text_of()).withColumn("__words", words_of(F.col("__text")))
    out = out.withColumn("n_words", F.size("__words").cast("bigint"))
    out = out.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: line.rlike(WORD)))
    out = (
        out.withColumn("word_chars", F.length(F.translate("__text", SPACES, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("bigint"))
        .withColumn("__upper", F.length("__text") - F.length(F.translate("__text", UPPER, "")))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_words(F.col("__words")))
        .withColumn("__distinct", F.size(F.array_distinct("__words")))
        .withColumn("__n_lines", F.size("__lines"))
        .drop("__text", "__words", "__lines")
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    metrics = F.struct(
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "__n_lines").alias("dup_line_share"),
        (1 - share("__distinct", "n_words")).alias("same_word_share"), share("word_chars", "n_words").alias("word_length"),
        share("__upper", "word_chars").alias("upper_share"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (out.withColumn("__metrics", metrics).withColumn("base_failed", failed)
            .drop("__upper", "__distinct", "__n_lines"))


def stratum(risk: Risk) -> Column:
    """The number of the band of length that a document is in."""
    return sum((F.when(F.col("n_words") >= edge, 1).otherwise(0) for edge in risk.bands), F.lit(0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exact: the terms added as logarithms; 1 where k is no less than n p."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, step, lambda acc: acc["sum"])))


def labelled(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """The good documents among the labelled ones: labels without a value count for nothing, and an
    id that is labelled both ways is not good."""
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return measures.join(good.select("doc_id"), "doc_id", "left_semi")


def certify(good: DataFrame, risk: Risk = Risk(), grids: dict[str, tuple[float, ...]] = GRIDS) -> DataFrame:
    """stratum, rule, cutoff: the cutoffs of the strictest certified step in each stratum that has one.

    `good` are measured good documents. Each is counted against every step before anything is
    shuffled: one row per stratum and task leaves the map side. A grid that is shorter than others
    stays at its last cutoff.
    """
    level = (1 - risk.confidence) / (len(risk.bands) + 1)

    def cutoff(grid: tuple[float, ...], step: int) -> float:
        return float(grid[min(step, len(grid) - 1)])

    def rejected(step: int) -> Column:
        return reduce(lambda a, b: a | b, [F.col("__metrics")[rule] > cutoff(grid, step) for rule, grid in grids.items()])

    steps = range(max(map(len, grids.values())))
    beyond = [F.struct(F.lit(step).alias("step"), F.sum(F.when(rejected(step), 1).otherwise(0)).alias("k"),
                       F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cutoff(grid, step)).alias("cutoff")) for rule, grid in grids.items()]).alias("cutoffs"))
              for step in steps]
    counts = (good.where("not base_failed").groupBy(stratum(risk).alias("stratum"))
              .agg(F.count(F.lit(1)).alias("n"), F.array(*beyond).alias("tests")))
    tested = counts.select("stratum", "n", F.explode("tests").alias("t")).select("stratum", "n", "t.*")
    passed = (binomial_tail(F.col("k"), F.col("n"), risk.false_rejection) <= level).cast("int")
    walk = Window.partitionBy("stratum").orderBy("step")
    certified = tested.withColumn("__passed", passed).withColumn("__sofar", F.min("__passed").over(walk)).where("__sofar = 1")
    strictest = certified.groupBy("stratum").agg(F.max_by("cutoffs", "step").alias("cutoffs"))
    return strictest.select("stratum", F.explode("cutoffs").alias("c")).select("stratum", "c.*")


def verdict(cutoffs: list, risk: Risk) -> Column:
    """Whether a measured document passes the base rules and every certified cutoff.

    `cutoffs` holds a row per stratum and rule at most, so it is small at any size of the corpus.
    """
    rejected = [(F.lit(c["stratum"]) == stratum(risk)) & (F.col("__metrics")[c["rule"]] > c["cutoff"]) for c in cutoffs]
    result = ~F.col("base_failed")
    for one in rejected:
        result = result & ~one
    return result


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, the base columns and `kept` of every row of `docs`.

    Null and empty texts have no words and fail the base rules; texts of any length are measured
    whole. Repeated rows are judged each. Without labels, or with too few to certify anything, only
    the base rules reject. An empty table gives no row.
    """
    measures = written(measured(docs.select("doc_id", "text")).drop("text"), "measures")
    cutoffs = certify(labelled(measures, labels), risk).collect()
    return measures.select("doc_id", *BASE, verdict(cutoffs, risk).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of `docs` that `judge` keeps, all columns as they were."""
    names = [F.col(c).alias(f"__doc_{i}") for i, c in enumerate(docs.columns)]
    # Written with their measures, so that each document is measured once.
    measures = written(measured(docs.select(*names, "doc_id", "text")).drop("text"), "measures")
    cutoffs = certify(labelled(measures, labels), risk).collect()
    kept = measures.where(verdict(cutoffs, risk))
    return kept.select(*[F.col(f"__doc_{i}").alias(c) for i, c in enumerate(docs.columns)])
