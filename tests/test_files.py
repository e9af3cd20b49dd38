"""Files in, files out: the commands over small hand-made files."""

import json

import pytest

from svlattice import cli
from svlattice.sources import vcf

HEAD = "##fileformat=VCFv4.2\n##source=svim v1 x\n##contig=<ID=chr1,length=1000>\n##contig=<ID=chr2,length=900>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n"


def rec(*parts):
    return "\t".join(str(p) for p in parts) + "\n"


CALLS = HEAD + "".join(
    [
        rec("chr1", 100, "a", "N", "N[chr1:300[", 10, "PASS", "SVTYPE=BND", "GT:AD", "0/1:3,4"),
        rec("chr1", 300, "b", "N", "]chr1:100]N", 20, "PASS", "SVTYPE=BND"),
        rec("chr1", 500, "c", "N", "N[chr2:700[", 30, "PASS", "SVTYPE=BND;SUPP=7", "GT:DR:DV", "1/1:2:5"),
        rec("chr2", 702, "d", "N", "]chr1:499]N", ".", "PASS", "SVTYPE=BND", "GT", "0/1"),
        rec("chr1", 800, "e", "N", "N]chr2:10]", 5, "PASS", "SVTYPE=BND;AF", "GT", "0/1"),
        rec("chr1", 900, "f", "N", "<INS>", 5, "PASS", "SVTYPE=INS;SVLEN=50;strand=+-", "GT:PR", "0/1:3,9"),
        rec("chr1", 950, "g", "N", "<DUP:TANDEM>", 5, "q5", "SVTYPE=DUP:TANDEM;END=990", "GT", "./."),
        rec("chr1", 960, "h", "N", "N.", 5, "PASS", "SVTYPE=BND", "GT", "0/1"),
    ]
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("files")


def body(path):
    return [line.split("\t") for line in path.read_text().splitlines() if not line.startswith("#")]


def test_correct(spark, folder):
    source, target = folder / "calls.vcf", folder / "calls.svcf"
    source.write_text(CALLS)
    assert cli.main(["correct", "-i", str(source), "-o", str(target)]) == 0
    rows = body(target)
    assert [r[2] for r in rows] == ["a", "c", "e", "f", "g"]  # pair, mates merged, single, others; the single breakend has no branch
    pair, mates, single, ins, dup = rows
    assert pair[4] == "<DEL>" and pair[7].startswith("SVTYPE=DEL;END=300;SVLEN=200;CHR2=chr1;SUPPORT=.;SVMETHOD=svlattice;RTID=.")
    assert pair[9] == "0/1:3,4:200:.:10:DEL:a:svim:N:N[chr1:300[:chr1_100-chr1_300"
    assert mates[7].startswith("SVTYPE=TRA;END=700;SVLEN=.;CHR2=chr2;SUPPORT=7") and mates[9].startswith("1/1:2,5:.:.:30:TRA:c:svim")
    assert single[7].startswith("SVTYPE=TRA;END=10;SVLEN=.;CHR2=chr2") and ";AF=None;" in single[7]
    assert ins[7].startswith("SVTYPE=INS;END=950;SVLEN=50;CHR2=chr1;SUPPORT=9") and "STRAND=+-" in ins[7]
    assert dup[7].startswith("SVTYPE=DUP;END=990;SVLEN=40")
    assert "##contig=<ID=chr2,length=900>" in target.read_text()
    cli.main(["correct", str(source), str(folder / "few.svcf"), "--min-qual", "20", "--exclude-nocall", "--filter-pass"])
    assert [r[2] for r in body(folder / "few.svcf")] == ["b", "c"]  # the filtered mate leaves its partner single; unknown quality passes


def test_format_problems(spark, folder):
    for text, what in ((HEAD + "chr1\tx\ta\tN\tN\t1\tPASS\tA\n", "pos"), (HEAD + "chr1\t1\ta\tN\tN\tx\tPASS\tA\n", "qual"), (HEAD + "chr1\t1\ta\n", "columns"), ("chr1\t1\ta\tN\tN\t1\tPASS\tA\n", "no header")):
        (folder / "bad.vcf").write_text(text)
        assert [r.problem for r in vcf.check_format(vcf.lines(spark, [str(folder / "bad.vcf")])).collect()] == [what]
        with pytest.raises(SystemExit):
            cli.main(["correct", "-i", str(folder / "bad.vcf"), "-o", str(folder / "x")])


def svcf(name, rows):
    out = HEAD.replace("s1\n", f"{name}\n")
    for i, (chrom, pos, alt, info) in enumerate(rows):
        out += rec(chrom, pos, f"{name}.{i}", "N", alt, 20, "PASS", info, "GT:AD:LN:ST:QV:TY:ID:SC:REF:ALT:CO", f"0/1:1,2:9:+:20:X:{name}.{i}:{name}:N:.:.")
    return out


def test_merge_modes_and_benchmark(spark, folder):
    one, two, three = (folder / f"{n}.svcf" for n in ("one", "two", "three"))
    dele = lambda p, n=100: ("chr1", p, "<DEL>", f"SVTYPE=DEL;END={p + n};SVLEN=-{n};CHR2=chr1;SUPPORT=3")
    one.write_text(svcf("one", [dele(1000), dele(5000), ("chr1", 50, "N[chr2:70[", "SVTYPE=TRA;END=70;CHR2=chr2")]))
    two.write_text(svcf("two", [dele(1100), ("chr1", 90, "N[chr2:99[", "SVTYPE=TRA;END=99;CHR2=chr2")]))
    three.write_text(svcf("three", [dele(1250), dele(9000)]))
    files = [str(one), str(two), str(three)]
    out = folder / "merged.svcf"
    cli.main(["merge", "-i", *files, "-o", str(out), "--union", "--upsetr"])
    rows = body(out)
    assert [r[2].partition(".")[0] for r in rows] == ["one", "one", "one", "three", "three"]
    assert [r[7].partition("SOURCES=")[2] for r in rows] == ["one,two", "one,two", "one", "three", "three"]  # 1250 is too far from the leader at 1000
    assert len(rows[0]) == 11 and len(rows[2]) == 10
    assert "one.svcf (3)" in (folder / "merged.svcf.upset.svg").read_text() and not list(folder.glob(".*"))
    cli.main(["merge", *files[:2], "-o", str(out), "--expression", "one.svcf AND NOT (two OR two.svcf)"])
    assert [r[2] for r in body(out)] == ["one.1"]
    cli.main(["merge", *files, "-o", str(out), "--mode", "sample", "--sample-names", "A,B,C", "--exact-support", "2"])
    assert out.read_text().startswith("##fileformat=SVCFv1.0") and "FORMAT\tA\tB\tC\n" in out.read_text()
    assert [(r[9][:3], r[10][:3], r[11]) for r in body(out)] == [("0/1", "0/1", "0/0:.:.:.:.:.:.:.:.:.:.")] * 2

    cli.main(["benchmark", str(one), str(two), "-o", str(folder / "bench")])
    summary = json.loads((folder / "bench" / "summary.json").read_text())
    assert (summary["TP"], summary["FP"], summary["FN"]) == (2, 0, 1) and list(summary)[3:] == ["Precision", "Recall", "F1"]
    assert (folder / "bench" / "summary.json").read_text().startswith('{\n  "TP": 2') and (folder / "bench" / "fp.vcf").read_text() == "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    assert [r[2] for r in body(folder / "bench" / "fn.vcf")] == ["one.1"]


def test_statistics_and_converters(spark, folder):
    source = folder / "one.svcf"
    cli.main(["stat", str(source), str(folder / "stat.txt"), "--report"])
    text = (folder / "stat.txt").read_text()
    assert "DEL                            = 2 (66.67%)\n" in text and "Total SVs analyzed             = 2\n" in text
    assert "chr1                           = 3 SVs (Density: 0.03 SVs/Mb)\n" in text and "0/1                            = 3 (100.00%)" in text
    assert "<table>" in (folder / "stat.html").read_text()
    cli.main(["plot", str(folder / "stat.txt"), str(folder / "plot")])
    assert (folder / "plot_types.tsv").read_text().splitlines()[0] == "DEL\t2"
    assert all((folder / f"plot_{n}.svg").read_text().startswith("<svg") for n in ("sv_types", "sv_sizes", "chromosome_distribution")) and "<svg" in (folder / "stat.html").read_text()
    assert (folder / "plot_chromosomes.tsv").read_text().splitlines()[:2] == ["chr1\t3", "chr2\t0"]
    cli.main(["svcf2bed", "-i", str(source), "-o", str(folder / "x.bed"), "--minimal"])
    assert (folder / "x.bed").read_text() == "chr1\t999\t1100\nchr1\t4999\t5100\nchr1\t49\t50\n"
    cli.main(["svcf2bedpe", str(source), str(folder / "x.bedpe")])
    assert (folder / "x.bedpe").read_text().splitlines()[1] == "chr1\t999\t1000\tchr1\t1099\t1100\tone.0_DEL\t3\t+\t+\tDEL\t-100"
    cli.main(["svcf2vcf", str(source), str(folder / "x.vcf")])
    assert body(folder / "x.vcf")[0][7:] == ["SVTYPE=DEL;END=1100;SVLEN=-100;CHR2=chr1;SUPPORT=3", "GT:AD:DP:LN", "0/1:1,2:3:9"]


def test_svaba_columns_and_order_over_files(spark, folder):
    a, b = folder / "a.vcf", folder / "b.vcf"
    a.write_text(HEAD.replace("svim v1", "svaba_x") + rec(*["chr1", 5, "x", "N", "N", 1, "PASS", "SVTYPE=DEL", "GT", *"pqr", "last"]) + "".join(rec("chr1", i, f"r{i}", "N", "N", 1, "PASS", "A") for i in range(50)))
    b.write_text(HEAD + rec("chr1", 7, "y", "N", "N", 1, "PASS", "SVTYPE=DEL") + rec("chr1", 7, "z", "N", "N", 1, "PASS", "SVTYPE=DEL"))
    rows = vcf.read_caller_files(spark, [str(b), str(a)]).orderBy("ord").collect()
    assert [r.sv_id for r in rows] == ["y", "z", "x", *(f"r{i}" for i in range(50))] and [r.ord for r in rows] == list(range(1, 54))
    assert rows[2].sample_raw == "last" and rows[0].sample_raw == "0/1"
    b.write_text(HEAD + rec(*["chr1", 5, "x", "N", "N", 1, "PASS", "SVTYPE=DEL", "GT", *"pqrs"]))
    with pytest.raises(Exception, match="unsupported number of columns"):
        vcf.read_caller_files(spark, [str(b)]).collect()


def test_files_by_their_whole_names(spark, tmp_path):
    """A file whose path ends like another's, one named twice, a pattern and a folder: every file has its own place."""
    inner = tmp_path / "x" / str(tmp_path).lstrip("/")
    inner.mkdir(parents=True)
    odd = tmp_path / "a b%20é.vcf"
    for path, name in ((tmp_path / "a.vcf", "outer"), (inner / "a.vcf", "inner"), (odd, "odd")):
        path.write_text(HEAD + rec("chr1", 7, name, "N", "N", 1, "PASS", "SVTYPE=DEL") * 2)
    given = [str(inner / "a.vcf"), str(tmp_path / "a.vcf"), str(odd), str(tmp_path / "a.vcf")]
    rows = vcf.read_caller_files(spark, given).orderBy("ord").collect()
    assert [(r.file_idx, r.sv_id, r.ord) for r in rows] == [(0, "inner", 1), (0, "inner", 2), (1, "outer", 3), (1, "outer", 4), (2, "odd", 5), (2, "odd", 6)]
    assert [r.sv_id for r in vcf.read_caller_files(spark, [str(tmp_path / "a*.vcf")]).orderBy("ord").collect()] == ["odd", "odd", "outer", "outer"]
    assert vcf.read_caller_files(spark, [str(tmp_path)]).count() == 4


def test_source_line_and_qualities(spark, tmp_path):
    """svaba may stand anywhere in the source line; the source ends at a space or a second '='."""
    path = tmp_path / "a.vcf"
    path.write_text(HEAD.replace("svim v1", "foo=2 svaba 1.0") + rec(*["chr1", 5, "x", "N", "N", 1, "PASS", "SVTYPE=DEL", "GT", *"pqr", "last"]))
    assert [(r.source, r.sample_raw) for r in vcf.read_caller_files(spark, [str(path)]).collect()] == [("foo", "last")]
    for qual, ok in (("nan", True), ("-inf", True), ("1e3", True), (".5", True), ("5d", False), ("1_", False), ("0x1", False)):
        path.write_text(HEAD + rec("chr1", 5, "x", "N", "N", qual, "PASS", "SVTYPE=DEL"))
        assert vcf.check_format(vcf.lines(spark, [str(path)])).count() == (0 if ok else 1), qual


def test_parts_that_are_missing(spark, tmp_path, monkeypatch):
    """Where not all parts reach the folder, as on a cluster without a shared one, nothing is written."""
    from pyspark.sql import functions as F

    from svlattice.sinks import text

    monkeypatch.setattr(text, "Observation", lambda: type("Seen", (), {"_jo": None, "_on": lambda *a: a[1], "get": {"n": 9, "size": 99}})())
    monkeypatch.setattr("pyspark.sql.DataFrame.observe", lambda self, *a: self, raising=False)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.observe", lambda self, *a: self, raising=False)
    rows = spark.range(3).select("id", F.col("id").cast("string").alias("line"))
    with pytest.raises(text.OutputError, match="6 of 99 bytes"):
        text.write_lines(rows, ["id"], str(tmp_path / "out.txt"), ["h"])
    assert not list(tmp_path.iterdir())
    monkeypatch.undo()
    assert text.write_lines(rows, ["id"], str(tmp_path / "out.txt"), ["h"]) == 3 and (tmp_path / "out.txt").read_text() == "h\n0\n1\n2\n"
