"""Queries of the call-set operators over the whole tables of caller and corrected records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from svlattice.functions import bnd, fields
from svlattice.operators import cluster, correct, filters, greedy, pairing, sourcesets, statistics, truth
from svlattice.operators.events import caller_events, corrected_events
from svlattice.session import cut_lineage, spread, table
from svlattice.sinks import formats
from svlattice.sources import vcf

LIMITS = filters.Limits(min_qual=5, max_qual=95, min_support=3, min_depth=10, min_gq=5, min_svlen=40, max_svlen=20000, filter_pass=True, exclude_nocall=True)
CRITERIA = truth.Criteria()
TRUTH_CALLER, CALL_CALLER = "sniffles", "cutesv"


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    return corrected_events(spread(table(spark, folder, "svcf_event")))


def _caller(spark: SparkSession, folder: str) -> DataFrame:
    return caller_events(spread(table(spark, folder, "sv_event")))


def resolved_coordinates(spark, folder):
    return _corrected(spark, folder).select("ord", "svtype", "start_chrom", "start_pos", "end_chrom", "end_pos", "length")


def bnd_pattern(spark, folder):
    return _caller(spark, folder).select("ord", "bnd_form", "mate_chrom", "mate_pos", "route")


def bnd_alt_parse(spark, folder):
    form, target, pos = bnd.parsed(F.col("alt"))
    return _corrected(spark, folder).where("bnd_alt is not null").select("ord", form.alias("form"), target.alias("target"), pos.alias("target_pos"))


def tra_orientation(spark, folder):
    return _corrected(spark, folder).where("bnd_alt is not null").select("ord", bnd.orientation(F.col("alt")).alias("way"))


def caller_scores(spark, folder):
    score = fields.total_score(F.col("support_n"), F.col("qual_n"), F.col("caller"))
    return _corrected(spark, folder).select("ord", "caller", fields.caller_score(F.col("caller")).alias("caller_score"), score.alias("score"))


def merge_thresholds(spark, folder):
    df = _corrected(spark, folder).where(F.col("svtype").isin(*cluster.REGULAR))
    return df.select("ord", fields.distance_threshold(F.col("svtype"), F.col("length")).alias("distance"), fields.ratio_threshold(F.col("svtype")).alias("ratio"))


def natural_chrom_order(spark, folder):
    return table(spark, folder, "contig").select("contig_name", fields.natural_key(F.col("contig_name")).alias("sort_key"))


def caller_info(spark, folder):
    return _caller(spark, folder).select("ord", "svtype", "support_text", "strand", "rnames", "chr2", "end_text", "svlen_text")


def parsed_samples(spark, folder):
    df = fields.with_cells(table(spark, folder, "svcf_event"))
    return df.select("ord", *(fields.cell(F.col("_keys"), F.col("_values"), F.lit(k)).alias(k.lower()) for k in ("GT", "AD", "LN", "SC")))


def depth_of_alleles(spark, folder):
    df = table(spark, folder, "svcf_event")
    return df.select("ord", fields.depth_sum(fields.corrected_text(F.col("sample_raw"), F.col("format_raw"), "AD")).alias("depth"))


def filter_first_failure(spark, folder):
    return filters.judged(_caller(spark, folder), LIMITS).select("ord", "rule")


def filter_stats(spark, folder):
    return filters.filter_statistics(_caller(spark, folder), LIMITS)


def pair_same_chromosome(spark, folder):
    """Pairs within files. The test tables hold no mates of such breakends, so each record is joined by the mate that a caller would write beside it (ord -1 - ord)."""
    events = _caller(spark, folder).select("ord", "file_id", "chrom", "pos", "mate_chrom", "mate_pos", "bnd_form", "route")
    form = F.when(F.col("bnd_form") == "t[p[", "]p]t").when(F.col("bnd_form") == "]p]t", "t[p[").otherwise(F.col("bnd_form"))
    mates = events.where("route = 'same' and mate_pos is not null").select(
        (-1 - F.col("ord")).alias("ord"), "file_id", "chrom", F.col("mate_pos").alias("pos"), "mate_chrom", F.col("pos").alias("mate_pos"), form.alias("bnd_form"), "route"
    )
    return pairing.same_chromosome_pairs(events.unionByName(mates), ("file_id",))


def breakend_roles(spark, folder):
    return _roles(spark, folder, _caller(spark, folder))


def _roles(spark, folder, events: DataFrame) -> DataFrame:
    """The passes over the places of breakends, written once where islands have to be counted."""
    few = _few(table(spark, folder, "sv_event"))
    df = events.where("route = 'diff'").select("ord", "file_id", "route", "chrom", "pos", "mate_chrom", "mate_pos")
    return pairing.breakend_passes(df if few else cut_lineage(df), by=("file_id",), few=few).select("role", "first_ord", "second_ord")


def breakend_roles_filtered(spark, folder):
    """As breakend_roles, of the records that pass the limits: the filter comes before the pairing."""
    return _roles(spark, folder, filters.passing(_caller(spark, folder), LIMITS))


def dropped_breakends(spark, folder):
    return correct.dropped(spread(table(spark, folder, "sv_event"))).select("ord", "alt")


def typed_events(spark, folder):
    """The type guard over the events of the six types."""
    events = _corrected(spark, folder)
    return filters.known_types(events.where(F.col("svtype").isin(*cluster.REGULAR, "TRA", "BND"))).select("ord", "svtype")


def event_sequences(spark, folder):
    return _corrected(spark, folder).select("ord", fields.event_sequence(F.col("info_raw"), F.col("alt")).alias("seq"))


def _header(spark, folder) -> DataFrame:
    """The header lines of all files as `sources.vcf` reads them."""
    return table(spark, folder, "vcf_header").select(F.col("file_id").cast("string").alias("path"), F.col("file_id").alias("file_idx"), F.struct("line_no").alias("place"), "line")


def header_contigs(spark, folder):
    return vcf.contigs(_header(spark, folder))


def header_sources(spark, folder):
    return vcf.header_source(_header(spark, folder))


def format_problems(spark, folder):
    """Of the raw lines those that break the format, and files whose lines here hold no header."""
    lines = table(spark, folder, "vcf_line").where("line is not null")
    return vcf.check_format(lines.select(F.col("file_id").cast("string").alias("path"), F.regexp_replace("line", r"\r\z", "").alias("line")))


def display_names(spark, folder):
    name = sourcesets.stem(fields.base_name(F.col("svcf_name")))
    return table(spark, folder, "call_file").select("file_id", name.alias("shown"), fields.short_name(F.col("svcf_name")).alias("short"), fields.short_name(F.col("file_name"), 12).alias("shorter"))


def corrected_branches(spark, folder):
    df = correct.corrected(spread(table(spark, folder, "sv_event")), by=("file_id",))
    return df.select("file_id", "branch", "rank", "rank2", "rank3", "ord", "out_type", "out_end", "out_len", "out_chr2", "out_rtid")


def corrected_lines(spark, folder):
    df = correct.corrected(spread(table(spark, folder, "sv_event")), by=("file_id",))
    files = table(spark, folder, "call_file", "file_id", "file_name")
    return correct.serialised(df.join(files, "file_id", "left"), F.col("file_name")).select("file_id", "branch", "rank", "rank2", "rank3", "line")


def _few(records: DataFrame) -> bool | None:
    """True where the whole table, whose files know their number of rows, is too small for a crowded island."""
    return records.count() <= greedy.CROWDED or None


def _places(spark, folder, *more: str, written: bool = False) -> tuple[DataFrame, bool | None]:
    """The typed columns of clustering and matching, without the packed fields, and whether they are few.

    Written once where they are read several times, as they are if islands have to be counted.
    """
    few = _few(table(spark, folder, "svcf_event"))
    df = _corrected(spark, folder).select("ord", "svtype", "start_chrom", "start_pos", "end_chrom", "end_pos", "length", F.col("bnd_alt").alias("alt"), *more)
    return (cut_lineage(df) if written or not few else df), few


def cluster_sv(spark, folder):
    events, few = _places(spark, folder)
    return cluster.regular_clusters(events, few=few)


def cluster_tra(spark, folder):
    events, few = _places(spark, folder)
    return cluster.translocation_clusters(events, few=few)


def cluster_bnd(spark, folder):
    events, few = _places(spark, folder)
    return cluster.breakend_clusters(events, few=few)


def _merged(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Representatives and memberships; of the packed fields only those of the representatives are parsed again."""
    places, few = _places(spark, folder, "source_file", "support_n", "qual_n", "caller", written=True)
    members = cut_lineage(cluster.clusters(places, few=few))
    best = cluster.best_members(places, members)
    return corrected_events(table(spark, folder, "svcf_event").join(best, "ord")), members


def representative(spark, folder):
    return _merged(spark, folder)[0].select("cluster_id", "ord", "score", "n_members", F.array_join("sources", ",").alias("sources"))


def merged_order(spark, folder):
    """The order in which merged events are written: kind, first record of the chromosome's type, cluster."""
    df = cluster.output_order(_merged(spark, folder)[0])
    return df.select("cluster_id", F.col("out_key._kind").cast("int").alias("kind"), F.col("out_key._first").alias("first"))


def region_lookup(spark, folder):
    merged = _merged(spark, folder)[0]
    return filters.in_region(merged, "DEL", "chr1", 1, 60_000_000).select("cluster_id", "start_pos", "end_pos")


def _file_names(spark, folder) -> list[str]:
    """The argument of the set queries (merge_union to merge_expression): the first three files by name, as their SQL has it."""
    return [r[0] for r in table(spark, folder, "call_file", "svcf_name").orderBy("svcf_name").limit(3).collect()]


def _selected(spark, folder, files=None, **how):
    merged = _merged(spark, folder)[0]
    files = files(merged) if files else _file_names(spark, folder)
    how = {k: (v(files) if callable(v) else v) for k, v in how.items()}
    return sourcesets.selected(merged, files, **how).select("cluster_id", F.array_join("sources", ",").alias("sources"))


def merge_union(spark, folder):
    return _selected(spark, folder, union_=True)


def merge_intersect(spark, folder):
    """Clusters that hold both of two files, for which the first two of the widest cluster are taken."""
    widest = lambda merged: merged.orderBy(F.desc(F.size("sources")), "cluster_id").select("sources").first()[0][:2]
    return _selected(spark, folder, widest, intersect=True)


def merge_specific(spark, folder):
    return _selected(spark, folder, only=lambda f: f[:1])


def merge_exact(spark, folder):
    return _selected(spark, folder, exact=2)


def merge_range(spark, folder):
    return _selected(spark, folder, low=2, high=4)


def merge_expression(spark, folder):
    return _selected(spark, folder, expr=lambda f: f"({f[0]} OR {f[1]}) AND NOT {f[2]}")


def upset_counts(spark, folder):
    return sourcesets.intersections(_merged(spark, folder)[0])


def file_totals(spark, folder):
    return sourcesets.file_totals(_merged(spark, folder)[0], table(spark, folder, "call_file").select(F.col("svcf_name").alias("file")))


def _sides(spark, folder) -> tuple[DataFrame, DataFrame, bool | None]:
    events, few = _places(spark, folder, "source_file")
    return events.where(F.col("source_file").startswith(TRUTH_CALLER)), events.where(F.col("source_file").startswith(CALL_CALLER)), few


def bench_eligible(spark, folder):
    return truth.eligible(_corrected(spark, folder), CRITERIA).select("ord", "svtype")


def bench_matches(spark, folder):
    t, c, few = _sides(spark, folder)
    return truth.matches(t, c, CRITERIA, few)


def bench_metrics(spark, folder):
    t, c, few = _sides(spark, folder)
    return truth.metrics(t, c, truth.matches(t, c, CRITERIA, few), CRITERIA)


def reciprocal_overlaps(spark, folder):
    """Of every matched pair the smaller share of overlap."""
    t, c, few = _sides(spark, folder)
    p = truth.matches(t, c, CRITERIA, few).where("truth_ord is not null")
    side = lambda df, n: df.select(F.col("ord").alias(f"{n}_ord"), F.col("start_pos").alias(f"{n}_s"), F.col("end_pos").alias(f"{n}_e"))
    df = p.join(side(t, "truth"), "truth_ord").join(side(c, "call"), "call_ord")
    return df.select("call_ord", "truth_ord", fields.reciprocal_overlap(F.col("truth_s"), F.col("truth_e"), F.col("call_s"), F.col("call_e")).alias("overlap"))


def _records(spark, folder):
    return table(spark, folder, "svcf_event")


def stat_types(spark, folder):
    return statistics.type_histogram(_records(spark, folder))


def stat_sizes(spark, folder):
    return statistics.quantiles(statistics.sizes(_records(spark, folder)), "size").select("n", "least", "most", F.round("mean", 6).alias("mean"), "median", F.round("stdev", 4).alias("stdev"))


def stat_size_bins(spark, folder):
    return statistics.size_histogram(_records(spark, folder))


def stat_chrom(spark, folder):
    return statistics.chromosome_histogram(_records(spark, folder))


def _rounded(df):
    return df.select("n", F.round("mean", 6).alias("mean"), "median", "least", "most", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


def stat_qual(spark, folder):
    return _rounded(statistics.value_statistics(statistics.qualities(_records(spark, folder))))


def stat_support(spark, folder):
    return _rounded(statistics.value_statistics(statistics.supports(_records(spark, folder))))


def stat_filter(spark, folder):
    return statistics.filter_histogram(_records(spark, folder))


def stat_gt(spark, folder):
    return statistics.genotype_histogram(_records(spark, folder))


def plot_density(spark, folder):
    return statistics.plot_density(_records(spark, folder))


def to_vcf(spark, folder):
    return formats.vcf_rows(_corrected(spark, folder))


def to_bed(spark, folder):
    return formats.bed_rows(_corrected(spark, folder))


def to_bedpe(spark, folder):
    return formats.bedpe_rows(_corrected(spark, folder))


def _input_files(spark, folder) -> DataFrame:
    """base, place, shown of every file of the call set, by name. Numbered in one task: a row of sample mode is as long as this list."""
    names = table(spark, folder, "call_file", "svcf_name").where("svcf_name is not null").distinct()
    base = fields.base_name(F.col("svcf_name"))
    return names.select(base.alias("base"), (F.row_number().over(Window.orderBy("svcf_name")) - 1).alias("place"), sourcesets.stem(base).alias("shown"))


def _merged_rows(spark, folder, make) -> DataFrame:
    events = _corrected(spark, folder)
    merged, members = _merged(spark, folder)
    merged = cut_lineage(merged)
    files = _input_files(spark, folder)
    samples = cluster.member_samples(events, members)
    keep = sourcesets.touching(merged, samples, files)
    return make(cluster.output_order(keep), samples, files).select("cluster_id", "line")


def merged_caller_rows(spark, folder):
    return _merged_rows(spark, folder, formats.merged_rows)


def merged_sample_rows(spark, folder):
    return _merged_rows(spark, folder, formats.sample_rows)


QUERIES = {
    f.__name__: f
    for f in (
        resolved_coordinates, bnd_pattern, bnd_alt_parse, tra_orientation, caller_scores, merge_thresholds, natural_chrom_order, caller_info, parsed_samples, depth_of_alleles,
        header_contigs, header_sources, format_problems, display_names, event_sequences, typed_events, dropped_breakends, breakend_roles_filtered, merged_order,
        filter_first_failure, filter_stats, pair_same_chromosome, breakend_roles, corrected_branches, corrected_lines, cluster_sv, cluster_tra, cluster_bnd, representative, region_lookup,
        merge_union, merge_intersect, merge_specific, merge_exact, merge_range, merge_expression, upset_counts, file_totals, bench_eligible, bench_matches, bench_metrics, reciprocal_overlaps,
        stat_types, stat_sizes, stat_size_bins, stat_chrom, stat_qual, stat_support, stat_filter, stat_gt, plot_density, to_vcf, to_bed, to_bedpe, merged_caller_rows, merged_sample_rows,
    )
}
