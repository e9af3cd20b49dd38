"""Caller files and corrected files as tables, by built-in text reads: no custom reader, so files split and prune as usual.

A file's lines need their order. Spark's text source gives each row its file and, from the row's block, an ascending
offset, so `ord` is (file, block start, place in the block): monotonic within a file without reading it in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from svlattice.functions import fields

NAMES = ("chrom", "pos_raw", "sv_id", "ref_seq", "alt", "qual", "filter_raw", "info_raw", "format_raw", "sample_raw")


def files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The URIs of all files that the paths name, in their order; those of a folder or a pattern by name."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(conf)
        for found in system.globStatus(path) or []:
            inner = [s for s in system.listStatus(found.getPath()) if s.isFile() and s.getPath().getName()[:1] not in "._"] if found.isDirectory() else [found]
            out += sorted(s.getPath().toUri().toString() for s in inner)
    return list(dict.fromkeys(out))


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, file_idx, place (ascending in file order), line; compressed files read as one block. A file that is named twice is read once."""
    index = spark.createDataFrame(list(enumerate(map(_plain, files(spark, paths)))), "file_idx int, _uri string")
    df = spark.read.text(list(dict.fromkeys(paths))).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")
    )
    # within a block ids ascend in reading order; blocks ascend by their start
    df = df.withColumn("_uri", F.regexp_replace("path", SLASHES, "/")).join(index, "_uri", "left")
    unknown = F.raise_error(F.concat(F.lit("a file that wasn't listed: "), "path")).cast("int")
    return df.select("path", F.coalesce("file_idx", unknown).alias("file_idx"), F.struct("_block", "_id").alias("place"), F.regexp_replace("line", r"\r\z", "").alias("line"))


#: The slashes behind a scheme: one or three for local files.
SLASHES = r"(?<=^file:)/+"


def _plain(uri: str) -> str:
    return re.sub(SLASHES, "/", uri)


def numbered(records: DataFrame) -> DataFrame:
    """records + ord: dense within a file and ascending over the files in their given order.

    Ranks are two-level: rows are counted per block, blocks are summed up (few rows), and rows are numbered inside theirs.
    """
    block = F.col("place._block")
    counts = records.groupBy("file_idx", block.alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy().orderBy("file_idx", "_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("file_idx", "_b").orderBy("place")
    df = records.withColumn("_b", block).withColumn("_in", F.row_number().over(inside)).join(counts, ["file_idx", "_b"])
    return df.withColumn("ord", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before", "place")


def header_source(text: DataFrame) -> DataFrame:
    """path, source, svaba: of each file the last ##source line up to its first space or second '=', and whether any names svaba."""
    df = text.where(F.col("line").startswith("##source="))
    return df.groupBy("path").agg(F.max_by(F.regexp_extract("line", r"^##source=([^ =]*)", 1), "place").alias("source"), F.bool_or(F.contains(F.lower("line"), F.lit("svaba"))).alias("svaba"))


def contig_lines(text: DataFrame) -> DataFrame:
    """file_idx, place, line of the ##contig lines."""
    return text.where(F.col("line").startswith("##contig")).select("file_idx", "place", "line")


def contigs(text: DataFrame) -> DataFrame:
    """contig_id, length by first appearance; of repeated ones the last length counts."""
    line = F.col("line")
    df = text.where(line.startswith("##contig")).select("file_idx", "place", F.regexp_extract(line, r"[<,]ID=([^,>]+)", 1).alias("contig_id"), F.regexp_extract(line, r"[<,]length=([^,>]+)", 1).alias("length"))
    df = df.where("contig_id <> '' and length <> ''").withColumn("_at", F.struct("file_idx", "place"))
    return df.groupBy("contig_id").agg(F.max_by("length", "_at").alias("length"), F.min("_at").alias("_first")).orderBy("_first").select("contig_id", "length")


def _split(text: DataFrame) -> DataFrame:
    return text.where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("_c", F.split("line", "\t", -1))


#: Numbers in words, which a quality may be too.
SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)\z"


def check_format(text: DataFrame) -> DataFrame:
    """path, problem of every caller line that breaks the format: a space, under 8 columns, POS or QUAL that isn't a number; and files without a header."""
    df = _split(text)
    c = lambda i: F.get("_c", F.lit(i))
    problem = (
        F.when(F.contains(F.col("line"), F.lit(" ")), "space").when(F.size("_c") < 8, "columns").when(c(1).try_cast("bigint").isNull(), "pos")
        .when((c(5) != ".") & fields.number(c(5)).isNull() & ~c(5).rlike(SPECIAL), "qual")
    )
    bad = df.select("path", "line", problem.alias("problem")).where("problem is not null")
    without = text.groupBy("path").agg(F.bool_or(F.col("line").startswith("#")).alias("_h")).where("not _h").select("path", F.lit(None).cast("string").alias("line"), F.lit("no header").alias("problem"))
    return bad.unionByName(without)


def read_caller_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ord, path, file_idx, source and the ten columns of caller records.

    8 columns get GT and 0/1; 13 columns are those of files whose source names svaba, of which the first 9 and the last
    are kept. Any other number of columns makes the query fail with the line.
    """
    text = lines(spark, paths)
    df = _split(text).join(header_source(text), "path", "left")
    n = F.size("_c")
    ok = (n == 8) | (n == 9) | (n == 10) | ((n == 13) & F.coalesce("svaba", F.lit(False)))
    df = df.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("unsupported number of columns: "), F.col("line")))).cast("boolean"))
    c = lambda i: F.get("_c", F.lit(i))
    last = F.when(n == 13, c(12)).otherwise(c(9))
    df = df.select("path", "file_idx", "place", "source", *(c(i).alias(NAMES[i]) for i in range(8)), F.coalesce(c(8), F.lit("GT")).alias("format_raw"), F.coalesce(last, F.lit("0/1")).alias("sample_raw"))
    return numbered(df.withColumn("pos", F.col("pos_raw").cast("bigint")).drop("pos_raw"))


def read_corrected_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ord, path, file_idx, source_file, sample_name and the ten columns of corrected records; lines of fewer columns are skipped."""
    text = lines(spark, paths)
    heads = text.where(F.col("line").startswith("#CHROM")).groupBy("path").agg(F.max_by(F.get(F.split("line", "\t", -1), F.lit(9)), "place").alias("_sample"))
    df = _split(text).where(F.size("_c") >= 10).join(heads, "path", "left")
    df = df.select(
        "path", "file_idx", "place", F.col("path").alias("source_file"), F.coalesce("_sample", fields.base_name(F.col("path"))).alias("sample_name"), *(F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(NAMES)),
    )
    return numbered(df.withColumn("pos", F.col("pos_raw").try_cast("bigint")).drop("pos_raw"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """section, key, value of the lines of a statistics report."""
    df = lines(spark, [path])
    order = Window.partitionBy("path").orderBy("place")  # a report is a small file
    section = F.last(F.nullif(F.regexp_extract("line", r"^>>>>>>> (\w+)", 1), F.lit("")), ignorenulls=True).over(order)
    pair = F.split("line", "=", 2)
    df = df.withColumn("section", section).where(F.contains(F.col("line"), F.lit("="))).select("section", F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))
    return df.where("section is not null")
