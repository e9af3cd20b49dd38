"""Descriptive statistics of corrected records: typed tables; text is made of them only in the report sink.

Each is one aggregate with partial sums before the shuffle. Exact quantiles take two: values are counted by their high
bits (sign, exponent and `FINE` steps an octave, so the number of bins is bounded whatever the data), a running count over
the bins finds the few that hold the wanted ranks, and only the values of those are counted one by one.

Defined results: an empty table gives empty histograms and summaries of n = 0 with nulls; unreadable numbers are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svlattice.functions import fields

#: The lengths that the statistics' density uses, and those of the plots (GRCh38, in bases).
STAT_LENGTHS = {f"chr{i}": 100_000_000 for i in range(1, 23)} | {"chrX": 100_000_000, "chrY": 50_000_000}
STAT_OTHER_LENGTH = 1
PLOT_LENGTHS = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636,
    "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345,
    "chr17": 83257441, "chr18": 80373285, "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415,
}


def _share(df: DataFrame) -> DataFrame:
    """pct of n among all rows; df is a histogram, so the window runs over its few rows."""
    return df.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def type_histogram(records: DataFrame) -> DataFrame:
    """svtype ('Unknown' if absent), n, pct."""
    kind = F.coalesce(fields.strict_info_text(F.col("info_raw"), "SVTYPE"), F.lit("Unknown"))
    return _share(records.groupBy(kind.alias("svtype")).agg(F.count("*").alias("n")))


def record_size() -> Column:
    """|SVLEN|, where that is absent or '.' |END - POS| (END defaulting to POS); null if unreadable."""
    length = fields.strict_info_text(F.col("info_raw"), "SVLEN")
    end = fields.strict_info_text(F.col("info_raw"), "END")
    spans = F.abs(F.when(end.isNull(), F.col("pos")).otherwise(end.try_cast("bigint")) - F.col("pos"))
    return F.when(F.coalesce(length, F.lit(".")) != ".", F.abs(length.try_cast("bigint"))).otherwise(spans)


def sizes(records: DataFrame, least: int = 50, most: int | None = None) -> DataFrame:
    """size of every record within the limits; most None or 0 is no limit."""
    df = records.select(record_size().alias("size")).where(F.col("size") >= least)
    return df.where(F.col("size") <= most) if most else df


#: Bins an octave of `high_bits`.
FINE = 1024


def high_bits(value: Column) -> Column:
    """A whole number that never falls as the value rises: the sign and the binary logarithm in steps of 1 / `FINE`."""
    step = lambda v: F.floor(F.log2(v) * FINE) + 2048 * FINE
    return F.when(value > 0, step(value)).when(value < 0, -step(-value)).otherwise(F.lit(0)).cast("long")


def quantiles(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by + n, mean, median, least, most, q1, q3, stdev of a column; quartiles by the exclusive method (null below 4 values)."""
    keys = [F.col(c) for c in by or []] or [F.lit(0).alias("_all")]
    names = by or ["_all"]
    values = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), high_bits(F.col(value).cast("double")).alias("_bin"))
    n = F.col("n")
    low = lambda k: F.greatest(F.lit(1), F.least(F.floor(k * (n + 1) / 4), n - 1))
    ranks = {"_m1": F.floor((n + 1) / 2), "_m2": F.floor(n / 2) + 1, "_a1": low(1), "_b1": low(1) + 1, "_a3": low(3), "_b3": low(3) + 1}
    bins = values.groupBy(*names, "_bin").agg(F.count("*").alias("_c"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    of_all = Window.partitionBy(*names)
    up = of_all.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("_c")
    bins = bins.withColumns({"_before": F.coalesce(F.sum("_c").over(up), F.lit(0)), "n": F.sum("_c").over(of_all), "least": F.min("_lo").over(of_all), "most": F.max("_hi").over(of_all), "_sum": F.sum(c * F.col("_m")).over(of_all)})
    bins = bins.withColumn("mean", F.col("_sum") / n)
    bins = bins.withColumn("stdev", F.sqrt(F.try_divide(F.sum(c * (F.col("_s") + F.pow(F.col("_m") - F.col("mean"), 2))).over(of_all), n - 1)))
    inside = lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_c"))
    whole = ["n", "mean", "least", "most", "stdev"]
    picked = bins.where(reduce(lambda a, b: a | b, map(inside, ranks.values()))).select(*names, "_bin", *whole, F.col("_before").alias("_start"))
    each = values.join(picked, [*names, "_bin"]).groupBy(*names, "_bin", *whole, "_start", "_v").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*names, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_before", F.col("_start") + F.coalesce(before, F.lit(0)))
    found = each.groupBy(*names, *whole).agg(*(F.max(F.when(inside(r), F.col("_v"))).alias(a) for a, r in ranks.items()))
    quartile = lambda k: F.when(n >= 4, (F.col(f"_a{k}") * (4 - (k * (n + 1) - 4 * low(k))) + F.col(f"_b{k}") * (k * (n + 1) - 4 * low(k))) / 4)
    return found.select(
        *(by or []), "n", "mean", ((F.col("_m1") + F.col("_m2")) / 2).alias("median"), F.col("least").cast("double"), F.col("most").cast("double"),
        quartile(1).alias("q1"), quartile(3).alias("q3"), "stdev",
    )


def size_histogram(records: DataFrame, least: int = 50, most: int | None = None) -> DataFrame:
    return sizes(records, least, most).groupBy(fields.size_bin(F.col("size")).alias("bin")).agg(F.count("*").alias("n"))


def _lengths(table: dict[str, int], other: int | None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("chrom"))
    return found if other is None else F.coalesce(found, F.lit(other))


def chromosome_histogram(records: DataFrame) -> DataFrame:
    """chrom, n, density per Mb of the statistics' lengths."""
    df = records.groupBy("chrom").agg(F.count("*").alias("n"))
    return df.withColumn("density", F.col("n") / (_lengths(STAT_LENGTHS, STAT_OTHER_LENGTH) / 1e6))


def plot_density(records: DataFrame) -> DataFrame:
    """chrom, n, density of the 24 chromosomes of the plots in their order, zeros kept."""
    spark = records.sparkSession
    fixed = spark.createDataFrame([(i, c) for i, c in enumerate(PLOT_LENGTHS)], "plot_no int, chrom string")
    n = records.groupBy("chrom").agg(F.count("*").alias("n"))
    df = fixed.join(n, "chrom", "left").select("plot_no", "chrom", F.coalesce("n", F.lit(0)).alias("n"))
    return df.withColumn("density", F.round(F.col("n") / (_lengths(PLOT_LENGTHS, None) / 1e6), 1)).orderBy("plot_no")


def qualities(records: DataFrame) -> DataFrame:
    value = fields.number(F.col("qual"))
    return records.select("ord", value.alias("value")).where(F.col("value") != 0)


def supports(records: DataFrame) -> DataFrame:
    return records.select("ord", fields.info_number(F.col("info_raw"), "SUPPORT").cast("double").alias("value")).where(F.col("value") > 0)


def value_statistics(values: DataFrame) -> DataFrame:
    """Summary of (ord, value); below 4 values the quartiles are the first and the last in record order."""
    ends = values.agg(F.min_by("value", "ord").alias("_first"), F.max_by("value", "ord").alias("_last"))
    df = quantiles(values, "value").crossJoin(ends)  # single rows
    return df.select("n", "mean", "median", "least", "most", F.coalesce("q1", "_first").alias("q1"), F.coalesce("q3", "_last").alias("q3"))


def filter_histogram(records: DataFrame) -> DataFrame:
    return _share(records.groupBy(F.col("filter_raw").alias("status")).agg(F.count("*").alias("n"))).orderBy("status")


def genotype_histogram(records: DataFrame) -> DataFrame:
    gt = fields.sample_text(F.col("sample_raw"), F.col("format_raw"), "GT")
    return _share(records.groupBy(gt.alias("gt")).agg(F.count("*").alias("n")))


def summary_text(records: DataFrame, input_name: str, output_name: str, least: int = 50, most: int | None = None) -> str:
    """The statistics report. Only histograms and single rows reach the driver; rows with equal counts come by name."""

    # the labels below are fixed values
    def line(key: str, value: str) -> str:
        return f"{key:30} = {value}\n"

    def hist(df: DataFrame, key: str) -> str:
        return "".join(line(str(r[key]), f"{r['n']} ({r['pct']:.2f}%)") for r in df.orderBy(F.desc("n"), key).collect())

    def section(name: str, body: str) -> str:
        return f">>>>>>> {name} Analysis\n\n{body}\n\n"

    def stats(values: DataFrame, of: str, title: str) -> str:
        rows = value_statistics(values).collect()
        r = rows[0].asDict() if rows else {"n": 0}
        number = lambda k: f"{r.get(k) or 0:.2f}"
        return (
            line(f"Number of variants with {title}", str(r["n"])) + line(f"Average {of}", number("mean")) + line(f"Median {of}", number("median"))
            + line(f"Min {of}", number("least")) + line(f"Max {of}", number("most")) + line(f"Q1 {of}", number("q1")) + line(f"Q3 {of}", number("q3"))
        )

    rows = quantiles(sizes(records, least, most).select(F.col("size").cast("double").alias("size")), "size").collect()
    s = rows[0].asDict() if rows else {"n": 0, "least": 0, "most": 0, "mean": 0, "median": 0, "stdev": 0}
    size = (
        line("Total SVs analyzed", str(s["n"])) + line("Minimum size", f"{s['least']:.0f} bp") + line("Maximum size", f"{s['most']:.0f} bp") + line("Mean size", f"{s['mean']:.2f} bp")
        + line("Median size", f"{s['median']} bp") + line("Standard deviation", f"{s['stdev'] or 0:.2f} bp") + "\n" + line("Size distribution", "")
        + "".join(line(r["bin"], str(r["n"])) for r in size_histogram(records, least, most).orderBy(F.desc("n"), "bin").collect())
    )
    chrom = line("Chromosome Distribution", "") + "".join(line(r["chrom"], f"{r['n']} SVs (Density: {r['density']:.2f} SVs/Mb)") for r in chromosome_histogram(records).orderBy(fields.natural_key(F.col("chrom"))).collect())
    qc = (
        line("Quality Score (QUAL) Statistics", "") + stats(qualities(records), "QUAL", "QUAL") + "\n" + line("Filter Status", "")
        + "".join(line(str(r["status"]), f"{r['n']} ({r['pct']:.2f}%)") for r in filter_histogram(records).collect())
        + "\n" + line("Read Support Statistics", "") + stats(supports(records), "Read Support", "support info")
    )
    head = f"svlattice report\n{'-' * 40}\n\n>>>>>>> Input\n\ninput file = {input_name}\noutput file = {output_name}\n\n"
    return (
        head + section("Type", line("SV Type Analysis", "") + hist(type_histogram(records), "svtype")) + section("Size", size) + section("Chromosome", chrom)
        + section("Qc", qc) + section("Genotype", line("Genotype Distribution", "") + hist(genotype_histogram(records), "gt"))
    )
