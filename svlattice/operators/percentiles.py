"""Percentiles of very large numeric columns from mergeable sketches.

Method: randomized compactor hierarchies (KLL). Each level holds a buffer of values; a full buffer is sorted and every
other value, from a random start, moves one level up with twice the weight. Two sketches merge level by level, so the
sketches of partitions, files or days combine into that of the whole. Spark's built-in KLL aggregates are this
structure; they run in the JVM and aggregate before the shuffle, so a hot group ships one sketch per task, never its rows.

The plan sketches by (file, svtype, day) first and attaches the caller to those few rows, so the records themselves are
shuffled neither for the join nor for the groups.

Defined results: a value that is null, not a number, NaN or infinite is left out; a group without values has n = 0 and
null percentiles; null group keys form groups of their own. Up to about k values the percentiles are exact, beyond
that the rank error stays within `rank_error(k)` with 99 % probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 400
RANKS = (0.05, 0.25, 0.5, 0.75, 0.95)
DECIMAL = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"
MEASURES = ("qual", "support", "svlen")


def rank_error(k: int) -> float:
    """The published single-sided rank error bound of the structure at 99 % confidence."""
    return 2.296 / k**0.9723


def finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def sketched(df: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES, k: int = SKETCH_K) -> DataFrame:
    """by + one sketch column per measure, of the finite values."""
    df = df.select(*by, *(finite(F.col(m)).alias(m) for m in measures))
    return df.groupBy(*by).agg(*(F.kll_sketch_agg_double(m, k).alias(m) for m in measures))


def merged(sketches: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Sketches combined over everything but `by`."""
    return sketches.groupBy(*by).agg(*(F.kll_merge_agg_double(m).alias(m) for m in measures))


def read_percentiles(sketches: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES, ranks: tuple[float, ...] = RANKS, k: int = SKETCH_K) -> DataFrame:
    """by + measure, n, one column per rank, rank_error: one row per group and measure."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("sketch")) for m in measures))).alias("_e")
    df = sketches.select(*by, each).select(*by, "_e.measure", F.col("_e.sketch").alias("_s"))
    df = df.withColumn("n", F.coalesce(F.kll_sketch_get_n_double("_s"), F.lit(0)).cast("long"))
    at = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_s", F.array(*map(F.lit, ranks))))
    df = df.select(*by, "measure", "n", at.alias("_q"))
    return df.select(*by, "measure", "n", *(F.get("_q", F.lit(i)).alias(f"p{round(r * 100):02d}") for i, r in enumerate(ranks)), F.lit(rank_error(k)).alias("rank_error"))


def within_bound(values: DataFrame, read: DataFrame, by: list[str], measures: tuple[str, ...] = MEASURES, ranks: tuple[float, ...] = RANKS) -> DataFrame:
    """by + measure, n, within: whether every read percentile's true rank among the values is within the stated error.

    The ranks of a value that repeats are an interval, of which the nearest end counts. n is the exact number of values;
    a group without any is within.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), finite(F.col(m)).alias("_v")) for m in measures))).alias("_e")
    rows = values.select(*(F.col(c).alias(f"_{c}") for c in by), each)
    keys = [*by, "measure"]
    marks = read.select(*keys, "rank_error", F.array(*(F.col(f"p{round(r * 100):02d}") for r in ranks)).alias("_at"))
    rows = rows.select(*(F.col(f"_{c}") for c in by), F.col("_e.measure").alias("_measure"), F.col("_e._v").alias("_v"))
    on = [rows[f"_{c}"].eqNullSafe(marks[c]) for c in keys]
    at = lambda i: F.get("_at", F.lit(i))
    counts = [F.count_if(F.col("_v") < at(i)).alias(f"_below{i}") for i in range(len(ranks))] + [F.count_if(F.col("_v") <= at(i)).alias(f"_to{i}") for i in range(len(ranks))]
    df = rows.join(marks, on).groupBy(*keys, "rank_error").agg(F.count("_v").alias("n"), *counts)
    n = F.col("n")
    off = lambda i, r: F.greatest(F.lit(r) - F.col(f"_to{i}") / n, F.col(f"_below{i}") / n - F.lit(r), F.lit(0.0))
    worst = F.greatest(*(off(i, r) for i, r in enumerate(ranks)))
    return df.select(*keys, "n", F.when(n > 0, worst <= F.col("rank_error")).otherwise(True).alias("within"), F.when(n > 0, worst).alias("worst"))


def daily_sketches(events: DataFrame, files: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """caller, svtype, day + sketches of qual, support and svlen."""
    parts = sketched(measured(events), ["file_id", "svtype", "day"], k=k)
    return merged(parts.join(callers(files), "file_id", "left"), ["caller", "svtype", "day"])


def measured(events: DataFrame) -> DataFrame:
    """file_id, svtype, day, qual, support, svlen; qual only where it is a number: a cast alone would also take suffixes."""
    qual = F.when(F.col("qual").rlike(DECIMAL), F.col("qual"))
    return events.select("file_id", "svtype", F.to_date("loaded_at").alias("day"), qual.alias("qual"), "support", "svlen")


def callers(files: DataFrame) -> DataFrame:
    return files.groupBy("file_id").agg(F.max("caller").alias("caller"))
