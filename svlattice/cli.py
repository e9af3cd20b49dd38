"""Command line over files: correct, merge, benchmark, stat, plot, svcf2vcf, svcf2bed, svcf2bedpe."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svlattice.functions import fields
from svlattice.operators import cluster, correct, sourcesets, statistics, truth
from svlattice.operators.events import caller_events, corrected_events
from svlattice.operators.filters import Limits, filter_statistics, known_types
from svlattice.sinks import figures, formats, text
from svlattice.sources import vcf


def _fail(message: str) -> None:
    print(message, file=sys.stderr)
    raise SystemExit(1)


def _contig_lines(spark: SparkSession, paths: list[str]) -> list[str]:
    """Header lines; a header has as many as the genome has contigs."""
    return [r["line"] for r in vcf.contig_lines(vcf.lines(spark, paths)).orderBy("file_idx", "place").collect()]


def run_correct(spark: SparkSession, source: str, target: str, tolerance: int = 3, limits: Limits = Limits()) -> int:
    problem = vcf.check_format(vcf.lines(spark, [source])).limit(1).collect()
    if problem:
        _fail(f"{source}: {problem[0]['problem']}: {problem[0]['line'] or ''}")
    records = vcf.read_caller_files(spark, [source])
    lost = correct.dropped(records).count()
    if lost:
        print(f"{lost} breakends without a readable mate are left out", file=sys.stderr)
    rows = correct.serialised(correct.corrected(records, tolerance, limits), F.col("source"))
    return text.write_lines(rows, ["branch", "rank", "rank2", "rank3"], target, text.corrected_header(_contig_lines(spark, [source])))


def run_merge(
    spark: SparkSession, sources: list[str], target: str, mode: str = "caller", names: list[str] | None = None, tolerances: cluster.Tolerances = cluster.Tolerances(),
    upset: str | None = None, **strategy,
) -> int:
    shown = sourcesets.display_names(sources, names)
    contigs = [(r["contig_id"], r["length"]) for r in vcf.contigs(vcf.lines(spark, sources)).collect()]
    events = corrected_events(vcf.read_corrected_files(spark, sources))
    events = known_types(events).cache()
    membership = cluster.clusters(events, tolerances).cache()
    merged = cluster.output_order(cluster.representatives(events, membership))
    chosen = sourcesets.selected(merged, sources, **strategy)
    members = cluster.member_samples(events, membership)
    make = formats.sample_rows if mode == "sample" else formats.merged_rows
    header = text.merged_header(contigs, shown if mode == "sample" else ["SAMPLE"], "SVCFv1.0" if mode == "sample" else "VCFv4.2")
    n = text.write_lines(make(chosen, members, formats.inputs(spark, sources, names)), ["out_key"], target, header)
    if upset:
        _write_upset(spark, merged, sources, upset)
    events.unpersist()
    membership.unpersist()
    return n


#: The figure shows so many intersections, the largest ones; the table holds all.
DRAWN = 60


def _write_upset(spark: SparkSession, merged: DataFrame, sources: list[str], path: str) -> None:
    """All intersections as a table, and beside it (.svg) the figure of the files and the largest intersections."""
    sizes = sourcesets.intersections(merged)
    text.write_lines(sizes.select(F.concat_ws("\t", "sources_text", "n_files", "n").alias("line"), "n", "n_files", "sources_text"), [F.desc("n"), F.desc("n_files"), "sources_text"], path, ["files\tn_files\tn"])
    files = spark.createDataFrame([(f.rpartition("/")[2],) for f in sources], "file string")
    totals = sourcesets.file_totals(merged, files).select(fields.short_name(F.col("file")).alias("file"), "n").collect()  # one row per input file
    shown = F.transform(F.split("sources_text", ","), fields.short_name)
    largest = sizes.select(shown.alias("files"), "n").limit(DRAWN).collect()
    text.write_text(spark, path.removesuffix(".tsv") + ".svg", figures.upset([tuple(r) for r in totals], [tuple(r) for r in largest]))


def run_benchmark(spark: SparkSession, truth_file: str, call_file: str, folder: str, criteria: truth.Criteria = truth.Criteria()) -> dict:
    t, c = (corrected_events(vcf.read_corrected_files(spark, [p])).cache() for p in (truth_file, call_file))
    pairs = truth.matches(t, c, criteria).cache()
    for name, df in truth.outcome(t, c, pairs, criteria).items():
        text.write_lines(formats.corrected_columns(df), ["out_no"], f"{folder}/{name.replace('_', '-')}.vcf", [text.COLUMNS.rpartition("\t")[0]])
    return text.write_summary(truth.metrics(t, c, pairs, criteria), f"{folder}/summary.json")


def run_stat(spark: SparkSession, source: str, target: str, least: int = 50, most: int | None = None, report: bool = False) -> None:
    records = vcf.read_corrected_files(spark, [source]).cache()
    text.write_text(spark, target, statistics.summary_text(records, source, target, least, most))
    if report:
        drawn = [draw(name, [(r["key"], r["n"]) for r in df.collect()]) for (name, df), draw in zip(plot_tables(spark, target).items(), PLOTS.values())]
        tables = {
            "Types": statistics.type_histogram(records), "Sizes": statistics.size_histogram(records, least, most), "Chromosomes": statistics.plot_density(records),
            "Quality": statistics.value_statistics(statistics.qualities(records)), "Filter": statistics.filter_histogram(records), "Genotypes": statistics.genotype_histogram(records),
        }
        text.write_text(spark, re.sub(r"\.[^./]*$", "", target) + ".html", text.html_report("Structural variants", tables, {"Input": source, "Records": records.count()}, drawn))
    records.unpersist()


#: The order of types and sizes in plots; absent ones are 0.
PLOT_TYPES = ("DEL", "DUP", "INS", "INV", "TRA", "BND")
PLOT_SIZES = ("0-50 bp", "51-100 bp", "101-500 bp", "501-1 kb", "1 kb-10 kb", ">10 kb")


#: How each plot is drawn from (name, number) pairs.
PLOTS = {
    "types": lambda _, rows: figures.donut("SV types", sorted(rows, key=lambda r: PIE_ORDER.index(r[0]) if r[0] in PIE_ORDER else len(PIE_ORDER))),
    "sizes": lambda _, rows: figures.bars("SV sizes", rows, "SVs"),
    "chromosomes": lambda _, rows: figures.bars("SVs per Mb", [(k, round(n / (statistics.PLOT_LENGTHS[k] / 1e6), 1)) for k, n in rows], "SVs per Mb"),
}
#: The order of types around the ring; others follow.
PIE_ORDER = ("TRA", "INV", "DUP", "INS", "DEL")


def plot_tables(spark: SparkSession, report: str) -> dict[str, DataFrame]:
    """The data of the type, size and chromosome plots from a statistics report."""
    df = vcf.read_report(spark, report)
    n = F.regexp_extract("value", r"^([0-9]+)", 1).try_cast("bigint")
    out = {}
    for name, section, order in (("types", "Type", PLOT_TYPES), ("sizes", "Size", PLOT_SIZES), ("chromosomes", "Chromosome", tuple(statistics.PLOT_LENGTHS))):
        fixed = spark.createDataFrame(list(enumerate(order)), "no int, key string")
        found = df.where(F.col("section") == section).select("key", n.alias("n")).dropna()
        out[name] = fixed.join(found, "key", "left").select("no", "key", F.coalesce("n", F.lit(0)).alias("n")).orderBy("no")
    return out


#: The names of the plots' files.
PLOT_NAMES = {"types": "sv_types", "sizes": "sv_sizes", "chromosomes": "chromosome_distribution"}


def run_plot(spark: SparkSession, report: str, prefix: str) -> None:
    """Writes the plots' data and SVG figures; PNG figures too where a plotting package can be imported."""
    for name, df in plot_tables(spark, report).items():
        rows = df.collect()  # a fixed list of names
        text.write_text(spark, f"{prefix}_{name}.tsv", "".join(f"{r['key']}\t{r['n']}\n" for r in rows))
        text.write_text(spark, f"{prefix}_{PLOT_NAMES[name]}.svg", PLOTS[name](name, [(r["key"], r["n"]) for r in rows]))
        try:
            from matplotlib import pyplot
        except ImportError:
            continue
        figure, axes = pyplot.subplots()
        axes.bar([r["key"] for r in rows], [r["n"] for r in rows])
        axes.tick_params(axis="x", rotation=90)
        figure.savefig(f"{prefix}_{PLOT_NAMES[name]}.png", bbox_inches="tight")
        pyplot.close(figure)


def run_convert(spark: SparkSession, kind: str, source: str, target: str, minimal: bool = False) -> int:
    events = corrected_events(vcf.read_corrected_files(spark, [source]))
    if kind == "vcf":
        return text.write_lines(formats.vcf_rows(events), ["ord"], target, text.vcf_header(_contig_lines(spark, [source])))
    if not events.limit(1).count():
        _fail(f"{source} holds no events")
    if kind == "bed":
        return text.write_lines(formats.bed_rows(events, minimal), ["ord"], target, [] if minimal else [text.BED_TRACK])
    return text.write_lines(formats.bedpe_rows(events, minimal), ["ord"], target, [text.BEDPE_MINIMAL if minimal else text.BEDPE_FULL])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="svlattice", description=__doc__)
    top.add_argument("--master", default=None, help="Spark master; by default the configured one")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, many: bool = False, output: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("inputs", nargs="*" if many else "?", default=[] if many else None)
        p.add_argument("-i", "--input-file", dest="input_option", nargs="+" if many else None)
        if output:
            if not many:
                p.add_argument("output", nargs="?")
            p.add_argument("-o", "--output-file", dest="output_option")
        return p

    p = command("correct")
    p.add_argument("-pt", "--pos-tolerance", type=int, default=3)
    for name, kind in (("qual", float), ("support", int), ("depth", int), ("svlen", int)):
        p.add_argument(f"--min-{name}", type=kind)
        p.add_argument(f"--max-{name}", type=kind)
    p.add_argument("--min-gq", type=int)
    p.add_argument("--filter-pass", action="store_true")
    p.add_argument("--exclude-nocall", action="store_true")

    p = command("merge", many=True)
    p.add_argument("--mode", choices=("caller", "sample"), default="caller")
    p.add_argument("--caller-names")
    p.add_argument("--sample-names")
    p.add_argument("--intersect", action="store_true")
    p.add_argument("--union", action="store_true")
    p.add_argument("--specific", nargs="+")
    p.add_argument("--min-support", type=int)
    p.add_argument("--max-support", type=int)
    p.add_argument("--exact-support", type=int)
    p.add_argument("--expression")
    p.add_argument("--tra-delta", type=int, default=50)
    p.add_argument("--bnd-delta", type=int, default=50)
    for name in ("--max-distance", "--max-length-ratio", "--min-jaccard", "--tra-min-overlap"):
        p.add_argument(name, type=float, help="accepted without effect: the thresholds follow from type and length")
    p.add_argument("--tra-strand-consistency", action="store_true", help="accepted without effect")
    p.add_argument("--upsetr", action="store_true")
    p.add_argument("--upsetr-output")

    p = sub.add_parser("benchmark")
    p.add_argument("truth_file")
    p.add_argument("call_file")
    p.add_argument("-o", "--output-dir", required=True)
    p.add_argument("-r", "--reference-distance", type=int, default=500)
    p.add_argument("-P", "--size-similarity", type=float, default=0.7)
    p.add_argument("-O", "--reciprocal-overlap", type=float, default=0.0)
    p.add_argument("-t", "--type-ignore", action="store_true")
    p.add_argument("-s", "--size-min", type=int, default=50)
    p.add_argument("--size-max", type=int, default=50_000)
    p.add_argument("--pass-only", action="store_true")
    p.add_argument("--enable-sequence-comparison", action="store_true")
    p.add_argument("-p", "--sequence-similarity", type=float, default=0.7)
    p.add_argument("--match-chrom", action="store_true", help="also require equal chromosomes outside of translocations")

    p = command("stat")
    p.add_argument("--min-size", type=int, default=50)
    p.add_argument("--max-size", type=int)
    p.add_argument("--report", action="store_true")
    command("plot").add_argument("--output-prefix", "--prefix", dest="output_option2")
    for name in ("svcf2vcf", "svcf2bed", "svcf2bedpe"):
        p = command(name)
        if name != "svcf2vcf":
            p.add_argument("--minimal", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("svlattice").config("spark.ui.enabled", "false")
    if a.master:
        builder = builder.master(a.master)
    spark = SparkSession.getActiveSession() or builder.getOrCreate()

    def one(positional, option, what: str) -> str:
        if bool(positional) == bool(option):
            _fail(f"give {what} either as an argument or as an option")
        return positional or option

    if a.command == "benchmark":
        criteria = truth.Criteria(
            a.reference_distance, a.size_similarity, a.reciprocal_overlap, a.size_min, a.size_max, a.type_ignore, a.pass_only, a.match_chrom, a.sequence_similarity if a.enable_sequence_comparison else None
        )
        print(run_benchmark(spark, a.truth_file, a.call_file, a.output_dir, criteria))
        return 0
    if a.command == "merge":
        sources = a.inputs or a.input_option or []
        if not sources or not a.output_option:
            _fail("merge needs input files and -o")
        names = a.sample_names if a.mode == "sample" else a.caller_names
        how = {"expr": a.expression, "intersect": a.intersect, "union_": a.union, "only": a.specific, "exact": a.exact_support, "low": a.min_support, "high": a.max_support}
        n = run_merge(
            spark, sources, a.output_option, a.mode, names.split(",") if names else None, cluster.Tolerances(a.tra_delta, a.bnd_delta),
            (a.upsetr_output or f"{a.output_option}.upset.tsv") if a.upsetr else None, **how,
        )
        print(f"{n} merged events written to {a.output_option}")
        return 0
    source = one(a.inputs, a.input_option, "the input")
    target = one(a.output, a.output_option or getattr(a, "output_option2", None), "the output")
    if a.command == "correct":
        limits = Limits(a.min_qual, a.max_qual, a.min_support, a.max_support, a.min_depth, a.max_depth, a.min_gq, a.min_svlen, a.max_svlen, a.filter_pass, a.exclude_nocall)
        print(f"{run_correct(spark, source, target, a.pos_tolerance, limits)} corrected events written to {target}")
        if limits.active():
            print(filter_statistics(caller_events(vcf.read_caller_files(spark, [source])), limits).first().asDict())
    elif a.command == "stat":
        run_stat(spark, source, target, a.min_size, a.max_size, a.report)
    elif a.command == "plot":
        run_plot(spark, source, target)
    else:
        print(f"{run_convert(spark, a.command[5:], source, target, getattr(a, 'minimal', False))} rows written to {target}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
