"""Rows of the text formats as columns: VCF, BED, BEDPE and merged records. Narrow projections; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from svlattice.functions import fields
from svlattice.operators import sourcesets


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("."))


def _tabs(*parts: Column) -> Column:
    return F.concat_ws("\t", *(_text(p) for p in parts))


def vcf_rows(events: DataFrame) -> DataFrame:
    """ord, line of corrected events: REF N as '.', an insertion's END at its start, deletions' lengths negative."""
    info = F.col("info_raw")
    svlen = fields.info_number(info, "SVLEN")
    svlen = F.when(F.col("svtype") == "DEL", -F.abs(svlen)).when(F.col("svtype") == "INS", F.abs(svlen)).otherwise(svlen)
    end = F.when(F.col("svtype") == "INS", F.col("pos")).otherwise(F.col("end_pos"))
    kept = [F.concat(F.lit(f"{k}="), fields.info_text(info, k)) for k in ("CHR2", "SUPPORT", "SVMETHOD", "STRAND")]
    new = F.concat_ws(";", F.concat(F.lit("SVTYPE="), F.col("svtype")), F.concat(F.lit("END="), _text(end)), F.concat(F.lit("SVLEN="), svlen.cast("string")), *kept)
    events = fields.with_cells(events)
    sample = lambda k, other: F.coalesce(fields.cell(F.col("_keys"), F.col("_values"), F.lit(k)), F.lit(other))
    ad = sample("AD", ".,.")
    cells = F.concat_ws(":", sample("GT", "./."), ad, fields.depth_sum(ad).cast("string"), sample("LN", "."))
    ref = F.when(F.col("ref_seq") == "N", ".").otherwise(F.col("ref_seq"))
    return events.select(
        "ord", _tabs(F.col("chrom"), F.col("pos"), F.col("sv_id"), ref, fields.alt_or_type(F.col("alt"), F.col("svtype")), F.col("qual"), F.col("filter_raw"), new, F.lit("GT:AD:DP:LN"), cells).alias("line")
    )


def bed_rows(events: DataFrame, minimal: bool = False) -> DataFrame:
    """ord, line; insertions and translocations take one base, and rows whose END isn't a number are left out."""
    info, start = F.col("info_raw"), F.col("pos") - 1
    point = F.col("svtype").isin("INS", "TRA")
    end_text = fields.info_text(info, "END")
    end = F.when(point | end_text.isNull(), start + 1).otherwise(end_text.try_cast("bigint"))
    df = events.withColumn("_end", end).where(F.col("_end").isNotNull() & F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    if minimal:
        return df.select("ord", _tabs(F.col("chrom"), start, F.col("_end")).alias("line"))
    svlen = F.coalesce(fields.info_text(info, "SVLEN"), F.when(F.col("svtype") == "INS", "0").otherwise((F.col("_end") - start).cast("string")))
    none = F.lit("")
    name = F.when(
        F.col("svtype") == "TRA", F.concat(_text(F.col("sv_id")), F.lit("_TRA_"), F.coalesce(fields.info_text(info, "CHR2"), none), F.lit(":"), F.coalesce(end_text, none))
    ).otherwise(F.concat(_text(F.col("sv_id")), F.lit("_"), F.col("svtype"), F.lit("_"), svlen, F.lit("bp")))
    score = F.coalesce(fields.info_text(info, "SUPPORT"), F.col("qual"))
    return df.select("ord", _tabs(F.col("chrom"), start, F.col("_end"), name, score, fields.strand_of_bed(fields.info_text(info, "STRAND"))).alias("line"))


def bedpe_rows(events: DataFrame, minimal: bool = False) -> DataFrame:
    """ord, line; rows whose END isn't a number are left out."""
    info = F.col("info_raw")
    end_text = fields.info_text(info, "END")
    end = F.when(end_text.isNull(), F.col("pos")).otherwise(end_text.try_cast("bigint"))
    df = events.withColumn("_end", end).where(F.col("_end").isNotNull() & F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    place = [F.col("chrom"), F.col("pos") - 1, F.col("pos"), F.coalesce(fields.info_text(info, "CHR2"), F.col("chrom")), F.col("_end") - 1, F.col("_end")]
    if minimal:
        return df.select("ord", _tabs(*place).alias("line"))
    strand = fields.info_text(info, "STRAND")
    a, b = fields.strands_of_bedpe(F.col("svtype"), F.when(strand.isin("+-", "-+", "++", "--"), strand))
    name = F.concat(_text(F.col("sv_id")), F.lit("_"), F.col("svtype"))
    score = F.coalesce(fields.info_text(info, "SUPPORT"), F.col("qual"))
    return df.select("ord", _tabs(*place, name, score, a, b, F.col("svtype"), fields.info_text(info, "SVLEN")).alias("line"))


def corrected_columns(events: DataFrame) -> DataFrame:
    """out_no, line with the eight fixed columns of corrected events, as written beside a benchmark; flags read True."""
    items = F.transform(fields.info_items_kept(F.col("info_raw")), lambda x: F.concat(x["k"], F.lit("="), F.coalesce(x["v"], F.lit("True"))))
    return events.select("out_no", _tabs(*(F.col(c) for c in ("chrom", "pos", "sv_id", "ref_seq", "alt", "qual", "filter_raw")), F.array_join(items, ";")).alias("line"))


def _laid_out(members: DataFrame, merged: DataFrame) -> DataFrame:
    """members + s: each sample in the layout of its representative's FORMAT, '.' for keys that the member lacks.

    Two trailing missing fields are dropped: they are the keys behind one that took the rest of the sample.
    """
    df = members.join(merged.select("cluster_id", F.col("format_raw").alias("_wanted")), "cluster_id")
    df = fields.with_cells(df)
    cells = F.transform(F.split("_wanted", ":", -1), lambda k: F.coalesce(fields.cell(F.col("_keys"), F.col("_values"), k), F.lit(".")))
    return df.withColumn("s", F.regexp_replace(F.array_join(cells, ":"), r":\.:\.\z", ""))


def _merged_info(sources: Column) -> Column:
    """The representative's INFO in its order with SOURCES replaced or appended; flags read True, and the last of equal keys counts in the place of the first."""
    items = fields.info_items_kept(F.coalesce("info_raw", F.lit(".")))
    keys = F.array_distinct(F.transform(items, lambda x: x["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(items, lambda x: x["k"] == k), -1))
    shown = F.transform(
        F.when(F.size(keys) == F.size(items), items).otherwise(last),
        lambda x: F.when(x["k"] == "SOURCES", F.concat(F.lit("SOURCES="), sources)).otherwise(F.concat(x["k"], F.lit("="), F.coalesce(x["v"], F.lit("True")))),
    )
    text = F.array_join(shown, ";")
    return F.when(F.contains(text, F.lit("SOURCES")), text).otherwise(F.concat(text, F.lit(";SOURCES="), sources))


def inputs(spark: SparkSession, files: list[str], names: list[str] | None = None) -> DataFrame:
    """base, place, shown of the given input files: the base name, the position and the name that is written."""
    rows = [(f.rpartition("/")[2], i, s) for i, (f, s) in enumerate(zip(files, sourcesets.display_names(files, names)))]
    return spark.createDataFrame(rows, "base string, place int, shown string")


def _joined_shown(held: Column) -> Column:
    """SOURCES: the names of the files that hold a member, in file order, of an array of (place, shown)."""
    return F.array_join(F.array_sort(F.array_distinct(held))["shown"], ",")


def merged_rows(merged: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """out_key, line of merged events in caller mode: one sample column per member, by file and then record order.

    merged: representatives with out_key; members: cluster_id, ord, source_file, format_raw, sample_raw; files: as of
    `inputs`, of any number. A cluster's samples come together in one row, as the format demands; a member is found by its own file.
    """
    by_base = files.groupBy("base").agg(F.min("place").alias("_place"), F.collect_list(F.struct("place", "shown")).alias("_named"))
    placed = _laid_out(members, merged).select("cluster_id", "ord", "s", fields.base_name(F.col("source_file")).alias("base")).join(by_base, "base", "left")
    cell = F.struct(F.col("_place").isNull().alias("other"), "_place", "ord", "s")  # members of other files last
    cells = placed.groupBy("cluster_id").agg(F.array_sort(F.collect_list(cell)).alias("_cells"), F.flatten(F.collect_set("_named")).alias("_held"))
    df = merged.join(cells, "cluster_id")
    samples = F.array_join(F.col("_cells")["s"], "\t")
    head = [F.col(c) for c in ("chrom", "pos", "sv_id", "ref_seq", "alt", "qual", "filter_raw")]
    return df.select("cluster_id", "out_key", _tabs(*head, _merged_info(_joined_shown(F.col("_held"))), F.col("format_raw"), samples).alias("line"))


def sample_rows(merged: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """out_key, line of merged events in sample mode: one column per input file, the first member of each file, else a missing genotype.

    The format has a cell for every row and file; runs of missing ones are repeated text between the cells that are held.
    """
    first = _laid_out(members, merged).groupBy("cluster_id", fields.base_name(F.col("source_file")).alias("base")).agg(F.min_by("s", "ord").alias("s"))
    cells = first.join(files, "base").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "shown", "s"))).alias("_cells"))  # one entry per file
    df = merged.join(cells, "cluster_id", "left").crossJoin(F.broadcast(files.agg(F.count("*").cast("int").alias("_n"))))
    held = F.coalesce("_cells", F.expr("cast(array() as array<struct<place: int, shown: string, s: string>>)"))
    n = F.size(F.split("format_raw", ":", -1))
    missing = F.coalesce(F.concat(F.lit("0/0:"), F.array_join(F.array_repeat(F.lit("."), n - 1), ":")), F.lit("."))
    df = df.select("*", held.alias("_held"), missing.alias("_missing"))
    after = lambda i: F.coalesce(F.get(F.col("_held"), i)["place"] + 1, F.lit(0))
    part = lambda x, i: F.concat(F.repeat(F.concat(F.lit("\t"), "_missing"), x["place"] - after(i - 1)), F.lit("\t"), F.coalesce(x["s"], "_missing"))
    rest = F.repeat(F.concat(F.lit("\t"), "_missing"), F.col("_n") - after(F.size("_held") - 1))
    columns = F.concat(F.array_join(F.transform("_held", part), ""), rest)  # every cell after its tab
    head = [F.col(c) for c in ("chrom", "pos", "sv_id", "ref_seq", "alt", "qual", "filter_raw")]
    sources = _joined_shown(F.transform("_held", lambda x: F.struct(x["place"].alias("place"), x["shown"].alias("shown"))))
    return df.select("cluster_id", "out_key", F.concat(_tabs(*head, _merged_info(sources), F.col("format_raw")), columns).alias("line"))
