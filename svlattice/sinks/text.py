"""Text sinks: one file with a header, rows in order. Rows go through the file system's streams; none are collected."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Header lines of the written formats.
ALT_LINES = {"DEL": "Deletion", "INV": "Inversion", "INS": "Insertion", "DUP": "Duplication", "TRA": "Translocation", "BND": "Breakend"}
CORRECTED_INFO = {
    "SVTYPE": ("1", "String", "Type of structural variant"), "CHR2": ("1", "String", "Chromosome for end"), "END": ("1", "Integer", "End position of the variant described in this record"),
    "SVLEN": ("1", "Integer", "Difference in length between REF and ALT alleles"), "SUPPORT": ("1", "Integer", "Number of pieces of evidence supporting the variant"),
    "SVMETHOD": ("1", "String", "The software used to identify the SV"), "RTID": ("1", "String", "Associated ID for reciprocal translocations if available"),
    "AF": ("1", "Float", "Allele Frequency"), "STRAND": ("1", "String", "Strand orientation of the SV"),
}
CORRECTED_FORMAT = {
    "GT": ("1", "String", "Genotype"), "AD": ("R", "Integer", "Allelic depths for the ref and alt alleles in the order listed"), "LN": ("1", "Integer", "Length of SV"),
    "ST": ("1", "String", "Strand orientation of SV (e.g., +, -, -+, ++)"), "QV": ("1", "Integer", "Quality value"), "TY": ("1", "String", "Type of SV (e.g., TRA, DEL, INS)"),
    "ID": ("1", "String", "Unique identifier for the SV"), "SC": ("1", "String", "Source from which SV was identified"), "REF": ("1", "String", "Reference allele sequence"),
    "ALT": ("1", "String", "Alternate allele sequence"), "CO": ("1", "String", "Coordinate information of the SV"),
}
VCF_INFO = {k: v for k, v in CORRECTED_INFO.items() if k in ("SVTYPE", "END", "SVLEN")} | {
    "CHR2": ("1", "String", "Chromosome for end coordinate"), "SUPPORT": ("1", "Integer", "Number of reads supporting this variant"),
    "SVMETHOD": ("1", "String", "Method used to detect SV"), "STRAND": ("1", "String", "Strand orientation of the SV"),
}
VCF_FORMAT = {"GT": CORRECTED_FORMAT["GT"], "AD": CORRECTED_FORMAT["AD"], "DP": ("1", "Integer", "Approximate read depth"), "LN": CORRECTED_FORMAT["LN"]}
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
BED_TRACK = 'track name=SVs description="Structural Variants from SVCF"'
BEDPE_MINIMAL = "#chrom1\tstart1\tend1\tchrom2\tstart2\tend2"
BEDPE_FULL = BEDPE_MINIMAL + "\tname\tscore\tstrand1\tstrand2\tsvtype\tsvlen"


def _declared(kind: str, entries: dict[str, tuple[str, str, str]]) -> list[str]:
    return [f'##{kind}=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in entries.items()]


def _alts(names) -> list[str]:
    return [f'##ALT=<ID={k},Description="{ALT_LINES[k]}">' for k in names]


def corrected_header(contigs: list[str], source: str = "svlattice") -> list[str]:
    stamp = datetime.now().strftime("%Y-%m-%d|%I:%M:%S%p|%Z")
    return [
        "##fileformat=VCFv4.2", f"##fileDate={stamp}", f"##source={source}", *contigs, *_alts(ALT_LINES), *_declared("INFO", CORRECTED_INFO),
        '##FILTER=<ID=PASS,Description="All filters passed, variant is most likely true">', *_declared("FORMAT", CORRECTED_FORMAT), f"{COLUMNS}\tSample",
    ]


def merged_header(contigs: list[tuple[str, str]], samples: list[str], file_format: str = "VCFv4.2", source: str = "svlattice") -> list[str]:
    stamp = datetime.now().strftime("%Y-%m-%d|%I:%M:%S%p|")
    return [f"##fileformat={file_format}", f"##fileDate={stamp}", f"##source={source}", *(f"##contig=<ID={c},length={n}>" for c, n in contigs), "\t".join((COLUMNS, *samples))]


def vcf_header(contigs: list[str]) -> list[str]:
    return ["##fileformat=VCFv4.2", *contigs, *_declared("INFO", VCF_INFO), *_alts(("DEL", "INV", "DUP", "INS", "TRA")), *_declared("FORMAT", VCF_FORMAT), f"{COLUMNS}\tSample"]


class OutputError(RuntimeError):
    pass


def _place(spark: SparkSession, path: str):
    """File system and qualified path of a name, as Spark resolves it; local ones without checksum files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path = files.makeQualified(path)
    return (files.getRawFileSystem() if files.getUri().getScheme() == "file" else files), path


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small text that the driver holds as one file."""
    files, target = _place(spark, path)
    out = files.create(target, True)
    out.write(bytearray(content.encode()))
    out.close()


def write_lines(rows: DataFrame, order: list[str | Column], path: str, header: list[str]) -> int:
    """Writes header and the column `line` in order to one file; returns the number of rows.

    The rows are sorted in parallel and written as parts in a folder beside the target, which are then joined by the file
    system's own streams, in the driver's JVM. On a cluster the target must lie on a file system that the driver and all
    executors share; where parts are missing (each executor wrote to its own disk) the call fails and leaves no file.
    """
    spark = rows.sparkSession
    files, target = _place(spark, path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".svlattice-{uuid.uuid4().hex}")
    seen = Observation()
    size = F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0))
    try:
        rows.orderBy(*order).select(F.coalesce("line", F.lit("")).alias("line")).observe(seen, F.count(F.lit(1)).alias("n"), size.alias("size")).write.text(folder.toString() + "/parts")
        parts = sorted((p for p in files.listStatus(jvm.org.apache.hadoop.fs.Path(folder, "parts")) if p.getPath().getName().startswith("part-")), key=lambda p: p.getPath().getName())
        found = sum(p.getLen() for p in parts)
        if found != seen.get["size"]:
            raise OutputError(f"{found} of {seen.get['size']} bytes reached {folder}: the folder of {path} isn't shared by the driver and all executors")
        joined = jvm.org.apache.hadoop.fs.Path(folder, "joined")
        out = files.create(joined, True)
        out.write(bytearray("".join(f"{h}\n" for h in header).encode()))
        for part in parts:
            read = files.open(part.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            read.close()
        out.close()
        if files.exists(target):
            files.delete(target, False)
        if not files.rename(joined, target):
            raise OutputError(f"{path} can't be written")
        return seen.get["n"]
    finally:
        files.delete(folder, True)


#: The names of the metrics in the written summary.
SUMMARY = {"tp": "TP", "fp": "FP", "fn": "FN", "precision": "Precision", "recall": "Recall", "f1": "F1"}


def write_summary(metrics: DataFrame, path: str) -> dict:
    """The single row of metrics as indented JSON."""
    row = metrics.first().asDict()
    summary = {shown: row[name] for name, shown in SUMMARY.items()}
    write_text(metrics.sparkSession, path, json.dumps(summary, indent=2))
    return summary


def html_report(title: str, tables: dict[str, DataFrame], summary: dict[str, object], figures: list[str] = []) -> str:
    """A self-contained page of figures and small tables (histograms and single rows)."""
    from html import escape
    from string import Template

    def grid(df: DataFrame) -> str:
        rows = df.collect()
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else f'{v:.2f}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    page = Template(
        "<!DOCTYPE html><html><head><meta charset='utf-8'><title>$title</title><style>body{font-family:sans-serif;margin:2em}"
        "table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 8px}</style></head><body><h1>$title</h1>$summary$figures$tables</body></html>"
    )
    facts = "<ul>" + "".join(f"<li>{escape(k)}: {escape(str(v))}</li>" for k, v in summary.items()) + "</ul>"
    return page.substitute(title=escape(title), summary=facts, figures="".join(figures), tables="".join(f"<h2>{escape(k)}</h2>{grid(df)}" for k, df in tables.items()))
