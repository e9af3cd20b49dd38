"""Quality filters over caller records, with the first failing rule of each record.

A record with a missing or unreadable value passes the rule on it. All rules are column expressions, so a filtered scan
stays one narrow stage and unused rules cost nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svlattice.functions import fields


@dataclass(frozen=True)
class Limits:
    min_qual: float | None = None
    max_qual: float | None = None
    min_support: int | None = None
    max_support: int | None = None
    min_depth: int | None = None
    max_depth: int | None = None
    min_gq: int | None = None
    min_svlen: int | None = None
    max_svlen: int | None = None
    filter_pass: bool = False
    exclude_nocall: bool = False

    def active(self) -> bool:
        return self != Limits()


#: Genotypes that count as no call.
NO_CALLS = ("./.", ".|.", ".")


def _sample(key: str) -> Column:
    return fields.sample_text(F.col("sample_raw"), F.col("format_raw"), key)


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit("."))


def values(records: DataFrame) -> DataFrame:
    """records + _qual, _support, _depth, _gq, _svlen, _gt, the numbers that the rules test.

    Support is the first present of SUPPORT (or an alias), SUPPREAD, RE and DV in INFO, then DV, DR and AD's second in the
    sample, and that one decides; depth is DP, else the sum of AD's first two.
    """
    info = F.col("info_raw")
    texts = [_given(fields.support_text(info)), *(_given(fields.strict_info_text(info, k)) for k in ("SUPPREAD", "RE", "DV"))]
    kept = records.columns
    df = records.select(
        *kept, F.coalesce(*texts).alias("_in_info"), *(_sample(k).alias(f"_t{k}") for k in ("DV", "DR", "DP", "GQ")), F.split(_sample("AD"), ",", -1).alias("_ad"), _sample("GT").alias("_gt"),
        _given(fields.strict_info_text(info, "SVLEN")).alias("_len"),
    )
    ad = lambda i: fields.whole_number(F.get("_ad", F.lit(i)))
    depth = F.when(F.col("_tDP").isNotNull(), fields.whole_number(F.col("_tDP"))).otherwise(ad(0) + ad(1))
    return df.select(
        *kept, fields.number(F.col("qual")).alias("_qual"), fields.whole_number(F.coalesce("_in_info", "_tDV", "_tDR", F.get("_ad", F.lit(1)))).alias("_support"), depth.alias("_depth"),
        fields.whole_number(F.col("_tGQ")).alias("_gq"), F.abs(fields.whole_number(F.col("_len"))).alias("_svlen"), "_gt",
    )


def outside(value: Column, low: float | None, high: float | None) -> Column:
    """Whether a known value lies outside the limits."""
    out = F.lit(False)
    if low is not None:
        out = out | (value < low)
    if high is not None:
        out = out | (value > high)
    return F.coalesce(out, F.lit(False))


def judged(records: DataFrame, limits: Limits) -> DataFrame:
    """records + rule: the name of the first rule that a record fails, in the fixed order; null if it passes."""
    c = F.col
    rule = (
        F.when(outside(c("_qual"), limits.min_qual, limits.max_qual), "qual").when(F.lit(limits.filter_pass) & (F.upper("filter_raw") != "PASS"), "pass")
        .when(outside(c("_support"), limits.min_support, limits.max_support), "support").when(outside(c("_depth"), limits.min_depth, limits.max_depth), "depth")
        .when(outside(c("_gq"), limits.min_gq, None), "gq").when(outside(c("_svlen"), limits.min_svlen, limits.max_svlen), "svlen")
        .when(F.lit(limits.exclude_nocall) & c("_gt").isin(*NO_CALLS), "nocall")
    )
    return values(records).select(*records.columns, rule.alias("rule"))


def passing(records: DataFrame, limits: Limits) -> DataFrame:
    return judged(records, limits).where(F.col("rule").isNull()).drop("rule") if limits.active() else records


def filter_statistics(records: DataFrame, limits: Limits) -> DataFrame:
    """One row: total, passed, pass_rate and the number that each rule refused first."""
    rules = ("qual", "pass", "support", "depth", "gq", "svlen", "nocall")
    df = judged(records, limits).select("rule")
    counts = [F.count_if(F.coalesce(F.col("rule") == r, F.lit(False))).alias(f"filtered_{r}") for r in rules]
    df = df.agg(F.count("*").alias("total"), F.count_if(F.col("rule").isNull()).alias("passed"), *counts)
    return df.withColumn("pass_rate", F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)))


def in_region(events: DataFrame, svtype: str, chrom: str, start: int, end: int) -> DataFrame:
    """Events of a type that overlap a closed region; translocations and breakends disregard the region."""
    df = events.where(F.col("svtype") == svtype)
    if svtype in ("TRA", "BND"):
        return df
    return df.where((F.col("start_chrom") == chrom) & (F.col("start_pos") <= end) & (F.col("end_pos") >= start))


def known_types(events: DataFrame) -> DataFrame:
    """The events unchanged; a type other than the six makes the query fail when it runs."""
    known = F.coalesce(F.col("svtype").isin("INS", "DEL", "INV", "DUP", "TRA", "BND"), F.lit(False))
    return events.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown SV type: "), F.coalesce("svtype", F.lit("null"))))).cast("boolean"))
