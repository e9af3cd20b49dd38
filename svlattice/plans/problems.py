"""Queries on packed fields, schema drift, refused lines, percentiles and match groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svlattice.operators import drift, groups, packed, percentiles, refused
from svlattice.session import spread, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    caller = table(spark, folder, "sv_event", "ord", "info_raw", "format_raw")
    corrected = table(spark, folder, "svcf_event", "ord", "format_raw", "sample_raw")
    return packed.packed_rows(spread(caller), spread(corrected))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(spread(table(spark, folder, "sv_event", "file_id", "info_raw", "format_raw", "sample_raw")), table(spark, folder, "vcf_header"), table(spark, folder, "call_file"))


def p2_unified(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified_records(spread(table(spark, folder, "sv_event", "ord", "file_id", "chrom", "pos", "sv_id", "info_raw", "format_raw", "sample_raw")), table(spark, folder, "vcf_header"), table(spark, folder, "call_file"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return refused.refused(table(spark, folder, "vcf_line"), table(spark, folder, "call_file")).select("line_id", "reason")


def p3_refused(spark: SparkSession, folder: str) -> DataFrame:
    return refused.refused(table(spark, folder, "vcf_line"), table(spark, folder, "call_file"))


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The loadable records; their sample columns as one text, joined by tabs."""
    df = refused.loaded(table(spark, folder, "vcf_line"), table(spark, folder, "call_file"))
    return df.withColumn("samples", F.array_join("samples", "\t"))


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.daily_sketches(table(spark, folder, "sv_event"), table(spark, folder, "call_file", "file_id", "caller"))


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.read_percentiles(_daily(spark, folder), ["caller", "svtype", "day"])


def p4_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder)


def p4_all_days(spark: SparkSession, folder: str) -> DataFrame:
    """The days' sketches combined into those of the whole time."""
    return percentiles.read_percentiles(percentiles.merged(_daily(spark, folder), ["caller", "svtype"]), ["caller", "svtype"])


def p4_within(spark: SparkSession, folder: str) -> DataFrame:
    """Of the whole time's percentiles by caller and svtype, whether their true ranks lie within the stated error."""
    by = ["caller", "svtype"]
    events, files = table(spark, folder, "sv_event"), table(spark, folder, "call_file", "file_id", "caller")
    read = percentiles.read_percentiles(percentiles.merged(_daily(spark, folder), by), by)
    values = percentiles.measured(events).join(percentiles.callers(files), "file_id", "left")
    return percentiles.within_bound(values, read, by).select(*by, "measure", "n", "within")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.record_groups(table(spark, folder, "svcf_event", "ord", "source_file", "sv_id"), table(spark, folder, "sv_match"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_unified, p3_found, p3_refused, p3_loaded, p4_percentiles, p4_sketches, p4_all_days, p4_within, p5_found)}
