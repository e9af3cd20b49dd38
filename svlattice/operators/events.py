"""Typed views of caller records and of corrected records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svlattice.functions import bnd, fields

RESOLVED = ("svtype", "bnd_alt", "start_chrom", "start_pos", "end_chrom", "end_pos", "svlen_text", "support_n", "qual_n", "caller", "length")


def corrected_events(records: DataFrame) -> DataFrame:
    """The columns of a corrected-record table with svtype, coordinates, lengths, support and source resolved.

    The end of a breakend comes from ALT; both ends of others come from the sample's CO where that is readable, else the end
    from CHR2 and END; without END the end is the start, and where END is '.' the start plus the length. A record without SVTYPE has svtype
    ''; one without a chromosome or position keeps nulls and matches nothing. The stages keep every expression single:
    a column that several others use is a column of an earlier projection, not a repeated expression.
    """
    kept = [c for c in records.columns if c not in RESOLVED]  # a table's own columns of these names give way
    info = F.col("info_raw")
    held = lambda k: fields.cell(F.col("_keys"), F.col("_values"), F.lit(k))
    df = fields.with_cells(records).select(
        *kept, F.coalesce(fields.info_text(info, "SVTYPE"), F.lit("")).alias("svtype"), fields.info_text(info, "CHR2").alias("_chr2"), fields.info_text(info, "END").alias("_end"),
        fields.info_text(info, "SVLEN").alias("svlen_text"), fields.info_number(info, "SUPPORT").alias("support_n"), fields.number(F.col("qual")).alias("qual_n"),
        held("SC").alias("_sc"), held("CO").alias("_co"),
    )
    svtype, chrom, pos, end_text, co = (F.col(c) for c in ("svtype", "chrom", "pos", "_end", "_co"))
    form = r"^([^-_]*)_([0-9]+)-([^-_]*)_([0-9]+)\z"
    breakend = svtype.isin("BND", "TRA")
    how = (
        F.when(breakend & F.coalesce(F.col("alt").rlike(bnd.ANCHORED), F.lit(False)), "alt").when(breakend, "info")
        .when(F.coalesce(co.rlike(form), F.lit(False)), "co").when(end_text == ".", "length").otherwise("info")
    )
    df = df.withColumns({"_how": how, "caller": fields.caller_name(F.col("_sc"))})
    chr2 = F.coalesce("_chr2", "chrom")
    by_co = lambda i, other: F.when(F.col("_how") == "co", F.regexp_extract(co, form, i)).otherwise(other)
    end_chrom = F.when(F.col("_how") == "alt", F.regexp_extract("alt", bnd.ANCHORED, 1)).otherwise(by_co(3, chr2))
    end_pos = (
        F.when(F.col("_how") == "alt", F.regexp_extract("alt", bnd.ANCHORED, 2).try_cast("bigint")).when(F.col("_how") == "co", F.regexp_extract(co, form, 4).try_cast("bigint"))
        .when(F.col("_how") == "length", pos + F.abs(F.col("svlen_text").try_cast("bigint"))).otherwise(end_text.try_cast("bigint"))
    )
    df = df.select(
        *kept, "svtype", F.when(breakend, F.col("alt")).alias("bnd_alt"), "svlen_text", "support_n", "qual_n", "caller",
        fields.settled({"start_chrom": by_co(1, chrom), "start_pos": F.coalesce(by_co(2, F.lit(None)).try_cast("bigint"), pos), "end_chrom": end_chrom, "end_pos": F.coalesce(end_pos, pos)}),
    )
    return df.withColumn("length", fields.event_length(F.col("svlen_text"), F.col("start_pos"), F.col("end_pos")))


def caller_events(records: DataFrame) -> DataFrame:
    """The columns of a caller-record table with svtype, mate, route and support text resolved; format and sample default to GT and 0/1."""
    info = F.col("info_raw")
    df = records.withColumns({"format_raw": F.coalesce("format_raw", F.lit("GT")), "sample_raw": F.coalesce("sample_raw", F.lit("0/1"))})
    df = df.withColumn("_mate", bnd.mate_part(F.col("alt")))
    found = {
        "svtype": F.coalesce(fields.strict_info_text(info, "SVTYPE"), F.lit("")), "end_text": fields.strict_info_text(info, "END"), "svlen_text": fields.strict_info_text(info, "SVLEN"),
        "chr2": fields.strict_info_text(info, "CHR2"), "support_text": fields.support_text(info), "strand": fields.strand_text(info), "rnames": F.coalesce(fields.strict_info_text(info, "RNAMES"), F.lit(".")),
        "mate_chrom": F.substring_index("_mate", ":", 1), "mate_pos": F.substring_index("_mate", ":", -1).try_cast("bigint"), "bnd_form": bnd.pattern(F.col("alt")),
    }
    replaced = [c for c in records.columns if c not in found]  # the loader's own columns of these names give way
    df = df.select(*replaced, fields.settled(found))
    route = F.when(F.col("svtype") != "BND", "other").when(bnd.is_same_chromosome(F.col("svtype"), F.col("chrom"), F.col("alt")), "same").otherwise("diff")
    return df.withColumn("route", route)
