"""Greedy operators against plain sequential models, and the smaller expressions by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from svlattice.functions import bnd, fields
from svlattice.operators import cluster, filters, greedy, pairing, sourcesets, statistics, truth
from svlattice.operators.events import caller_events, corrected_events


def events_of(spark, rows):
    """rows: (ord, svtype, start_chrom, start_pos, end_chrom, end_pos, length, alt)."""
    df = spark.createDataFrame(rows, "ord long, svtype string, start_chrom string, start_pos long, end_chrom string, end_pos long, length long, alt string")
    return df.withColumns({"filter_raw": F.lit("PASS"), "info_raw": F.lit(""), "_cell": F.lit("clash"), "cluster_id2": F.lit(0)})


def model_regular(rows):
    groups, out = [], {}
    for o, kind, chrom, s, _, e, n, _ in sorted(rows):
        for leader in groups:
            lo, lk, lc, ls, le, ln = leader
            if (lk, lc) != (kind, chrom) or not n or not ln:
                continue
            reach = fields.DISTANCES[kind] * (2 if min(n, ln) >= 1000 else 1.5 if min(n, ln) >= 500 else 1)
            if abs(s - ls) <= reach and (kind == "INS" or abs(e - le) <= reach) and max(n, ln) / min(n, ln) <= fields.RATIOS[kind]:
                out[o] = lo
                break
        else:
            groups.append((o, kind, chrom, s, e, n))
            out[o] = o
    return out


@pytest.mark.parametrize("seed, crowded", [(0, 1 << 60), (1, 1 << 60), (2, 10)])
def test_regular_clusters_equal_the_model(spark, seed, crowded, monkeypatch):
    """Also with islands divided on both axes."""
    monkeypatch.setattr(greedy, "CROWDED", crowded)
    rng = random.Random(seed)
    rows = []
    for o in range(500):
        s = rng.randrange(0, 9000, 20)
        n = rng.choice([0, 60, 60, 90, 499, 500, 1000, 1200])
        rows.append((o, rng.choice(["DEL", "INS", "DUP", "INV"]), rng.choice(["a", "a", "b"]), s, "a", s + n, n, None))
    rows += [(1000, "DEL", None, 5, "a", 50, 45, None), (1001, "DEL", "a", None, "a", 50, 45, None)]
    got = {r.ord: r.cluster_id for r in cluster.regular_clusters(events_of(spark, rows)).collect()}
    assert got == model_regular(rows[:-2]) | {1000: 1000, 1001: 1001}


def model_tra(rows, delta=50):
    buckets = {}
    for r in sorted(rows):
        buckets.setdefault((r[2], r[4]), []).append(r)
    groups, out = [], {}
    way = lambda alt: "RIGHT_TO_LEFT" if alt[0] == "]" else "LEFT_TO_RIGHT" if alt[-1] == "[" else "RIGHT_TO_RIGHT" if alt[-1] == "]" else "LEFT_TO_LEFT"
    swap = lambda a, b: {way(a), way(b)} in ({"RIGHT_TO_LEFT", "LEFT_TO_RIGHT"}, {"RIGHT_TO_RIGHT", "LEFT_TO_LEFT"})
    for r in itertools.chain.from_iterable(buckets.values()):
        for g in groups:
            if {g[2], g[4]} != {r[2], r[4]}:
                continue
            a, b = (r[5], r[3]) if swap(g[7], r[7]) else (r[3], r[5])
            if abs(g[3] - a) <= 2 * delta and abs(g[5] - b) <= 2 * delta:
                out[r[0]] = g[0]
                break
        else:
            groups.append(r)
            out[r[0]] = r[0]
    return out


@pytest.mark.parametrize("seed, crowded", [(0, 1 << 60), (1, 1 << 60), (2, 5)])
def test_translocation_and_breakend_clusters(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(greedy, "CROWDED", crowded)
    rng = random.Random(seed)
    rows = []
    for o in range(300):
        c, d = rng.choice(["a", "b"]), rng.choice(["a", "b", "c"])
        s, e = rng.randrange(0, 900, 30), rng.randrange(0, 900, 30)
        alt = rng.choice([f"N[{d}:{e}[", f"N]{d}:{e}]", f"[{d}:{e}[N", f"]{d}:{e}]N"])
        rows.append((o, "TRA", c, s, d, e, 1, alt))
    got = {r.ord: r.cluster_id for r in cluster.translocation_clusters(events_of(spark, rows)).collect()}
    assert got == model_tra(rows)
    rows = [(o, "BND", *r[2:]) for o, r in enumerate(map(list, rows))] + [(900, "BND", "a", 5, "a", 5, 1, "N."), (901, "BND", "a", 5, "a", 5, 1, "N.")]
    groups, out = [], {}
    for r in sorted(rows, key=lambda r: (min(x[0] for x in rows if x[2] == r[2]), r[0])):
        form = r[7][0] + r[7][-1]
        hit = next((g for g in groups if "." not in r[7] and "." not in g[7] and g[2] == r[2] and g[4] == r[4] and g[7][0] + g[7][-1] == form and abs(g[3] - r[3]) <= 50 and abs(g[5] - r[5]) <= 50), None)
        out[r[0]] = hit[0] if hit else r[0]
        if not hit:
            groups.append(r)
    got = {r.ord: r.cluster_id for r in cluster.breakend_clusters(events_of(spark, rows)).collect()}
    assert got == out


@pytest.mark.parametrize("seed, crowded", [(0, 1 << 60), (1, 1 << 60), (2, 10)])
def test_truth_matching_equals_the_model(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(greedy, "CROWDED", crowded)
    rng = random.Random(seed)
    make = lambda base: [(base + i, rng.choice(["DEL", "TRA"]), rng.choice("ab"), s := rng.randrange(0, 6000, 50), "a", s + rng.choice([40, 60, 90, 100, 300]), 1, None) for i in range(150)]
    t, c = make(0), make(1000)
    eligible = lambda rows: [r for r in rows if r[1] == "TRA" or 50 <= abs(r[5] - r[3]) <= 50_000]

    def meets(a, b):
        if a[1] != b[1] or abs(a[3] - b[3]) > 500 or abs(a[5] - b[5]) > 500:
            return False
        if a[1] == "TRA":
            return a[2] == b[2] and a[4] == b[4]
        x, y = abs(a[5] - a[3]), abs(b[5] - b[3])
        return x and y and min(x, y) / max(x, y) >= 0.7

    used, pairs = set(), {}
    for r in eligible(c):
        hit = next((x for x in eligible(t) if x[0] not in used and meets(x, r)), None)
        if hit:
            used.add(hit[0])
            pairs[r[0]] = hit[0]
    td, cd = events_of(spark, t), events_of(spark, c)
    found = truth.matches(td, cd)
    assert {r.call_ord: r.truth_ord for r in found.collect()} == pairs
    m = truth.metrics(td, cd, found).first()
    assert (m.tp, m.fp, m.fn) == (len(pairs), len(eligible(c)) - len(pairs), len(eligible(t)) - len(pairs))
    empty = truth.metrics(td.limit(0), cd.limit(0), truth.matches(td.limit(0), cd.limit(0))).first()
    assert (empty.tp, empty.precision, empty.f1) == (0, 0.0, 0.0)


def sequential_passes(rows, t=3):
    """Mates, specials and singles of rows (ord, chrom, pos, mate chrom, mate pos), record by record."""
    offsets = list(itertools.product(range(-t, t + 1), repeat=2))
    held, mates = {}, []
    for o, c, p, d, q in rows:
        key = next((k for i, j in offsets if (k := (d, q + i, c, p + j)) in held), None)
        if key:
            mates.append((held.pop(key), o))
        else:
            held[c, p, d, q] = o
    queues = {}
    for o, c, p, d, q in rows:
        key = next((k for i, j in offsets if (k := (d, q + i, c, p + j)) in queues), None)
        if key:
            queues[key].pop(0)
            if not queues[key]:
                del queues[key]
        else:
            queues.setdefault((c, p, d, q), []).append((o, c, p, d, q))
    left, special = {}, []
    for o, c, p, d, q in itertools.chain.from_iterable(queues.values()):
        key = next((k for i, j in offsets if (k := (c, p + i, d, q + j)) in left), None)
        if key:
            special.append((left.pop(key), o))
        else:
            left[c, p, d, q] = o
    return mates, special, list(left.values())


@pytest.mark.parametrize("seed, crowded", [(0, 1 << 60), (1, 1 << 60), (2, 5)])
def test_breakend_passes_equal_the_model(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(greedy, "CROWDED", crowded)
    rng = random.Random(seed)
    rows = []
    for o in range(400):
        a, b = rng.sample(["a", "b", "c"], 2)
        rows.append((o, a, rng.randrange(0, 60), b, rng.randrange(0, 60)))
    unplaced = [(900, None, 5, "a", 5), (901, "a", None, "b", 5), (902, "a", 5, None, None)]
    df = spark.createDataFrame(rows + unplaced, "ord long, chrom string, pos long, mate_chrom string, mate_pos long").withColumn("route", F.lit("diff"))
    got = pairing.breakend_passes(df).collect()
    mates, special, single = sequential_passes(rows)
    pick = lambda role: [(r.first_ord, r.second_ord) for r in sorted(got, key=lambda r: (r["rank"], r.rank2)) if r.role == role]
    assert pick("mate") == mates and pick("special") == special and [a for a, _ in pick("single")] == single


@pytest.mark.parametrize("seed", range(2))
def test_same_chromosome_pairs_equal_the_model(spark, seed):
    rng = random.Random(seed)
    forms = {"t[p[": "N[{}[", "t]p]": "N]{}]", "[p[t": "[{}[N", "]p]t": "]{}]N"}
    rows = []
    for o in range(300):
        p, q, f = rng.choice([10, 20, 30]), rng.choice([10, 20, 30]), rng.choice(list(forms))
        rows.append((o, "a", p, q, f, forms[f].format(f"a:{q}")))

    def kind(x, y):
        if x[2] != y[3] or y[2] != x[3]:
            return None
        fs = {x[4]: x, y[4]: y}
        if set(fs) == {"t[p[", "]p]t"}:
            r = fs["t[p["]
            return "DEL" if r[3] > r[2] else "DUP" if r[3] < r[2] else None
        return "INV" if x[4] == y[4] and x[4] in ("t]p]", "[p[t") else None

    expected, done = [], set()
    for want in ("DEL", "DUP", "INV"):
        for i, x in enumerate(rows):
            if x[0] in done:
                continue
            for y in rows[i + 1 :]:
                if y[0] not in done and kind(x, y) == want:
                    expected.append((want, x[0], y[0], x[0] if x[2] < y[2] else y[0]))
                    done |= {x[0], y[0]}
                    break
    df = spark.createDataFrame([(o, c, p, a, "SVTYPE=BND") for o, c, p, _, _, a in rows], "ord long, chrom string, pos long, alt string, info_raw string").withColumns({"format_raw": F.lit(None).cast("string"), "sample_raw": F.lit(None).cast("string")})
    got = [(r.kind, r.first_ord, r.second_ord, r.base_ord) for r in pairing.same_chromosome_pairs(caller_events(df)).collect()]
    assert sorted(got) == sorted(expected)


def test_expression_parser():
    known = ["NORMAL.svcf", "A AND B.svcf", "b.svcf"]
    tree = sourcesets.parse_expression("NOT NORMAL.svcf AND (b OR A AND B.svcf)", known)
    assert tree == ("and", ("not", ("name", "NORMAL.svcf")), ("or", ("name", "b.svcf"), ("name", "A AND B.svcf")))
    for bad in ("", "b AND", "(b", "b b", "nope", "b)", "__import__('os')"):
        with pytest.raises(sourcesets.ExpressionError):
            sourcesets.parse_expression(bad, known)


def test_representative_ties(spark):
    rows = [(1, 1, 5, 50.0), (2, 1, 9, 50.0), (3, 1, 40, 50.0), (4, 1, 31, 50.0), (5, 2, None, None), (6, 2, None, None)]
    df = spark.createDataFrame(rows, "ord long, cluster_id long, support_n long, qual_n double")
    events = df.drop("cluster_id").withColumns({"caller": F.lit("svim"), "source_file": F.concat(F.lit("f"), (F.col("ord") % 2).cast("string"))})
    got = {r.cluster_id: (r.ord, r.sources, r.n_members) for r in cluster.representatives(events, df.select("ord", "cluster_id")).collect()}
    assert got == {1: (3, ["f0", "f1"], 4), 2: (5, ["f0", "f1"], 2)}  # beyond 30 the score is the same and support decides; else the first


def test_islands_on_both_axes(spark, monkeypatch):
    """Places that lie on one run of the first axis part where the second axis has a gap; each part is one island."""
    monkeypatch.setattr(greedy, "CROWDED", 3)
    rows = [(i, "a", 10 * i, 1000 * (i % 2)) for i in range(40)] + [(100, "b", 5, 5), (101, "a", None, 5)]
    df = spark.createDataFrame(rows, "ord long, k string, x long, y long")
    got = greedy.with_islands(df, ["k"], (F.col("x"), 20), (F.col("y"), F.lit(20))).select("ord", "k", "_island", "_part").collect()
    parts = {}
    for r in got:
        parts.setdefault((r.k, r._island, r._part), set()).add(r.ord)
    assert sorted(map(sorted, parts.values())) == [list(range(0, 40, 2)), list(range(1, 40, 2)), [100]]


def test_caller_priority(spark):
    """One member of each caller with equal support and quality: the earlier in the list wins, any other text is last."""
    order = ["svim", "pbsv", "cutesv", "sniffles", "debreak", "manta", "delly", "svaba", "svdss", "other"]
    rows = [(len(order) - i, c, first) for first in range(len(order)) for i, c in enumerate(order[first:], first)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "ord long, rank long, caller string, cluster_id long").withColumns({"support_n": F.lit(5).cast("long"), "qual_n": F.lit(9.0), "source_file": F.lit("f")})
    got = cluster.representatives(df.drop("cluster_id"), df.select("ord", "cluster_id")).orderBy("cluster_id").collect()
    assert [r.caller for r in got] == order
    assert [r[0] for r in df.where("cluster_id = 0").orderBy("ord").select(fields.caller_score(F.col("caller"))).collect()] == [float(10 - i) for i in range(10)]


def test_corrected_samples(spark):
    """The first key that may hold ':' takes the rest; later keys and those beyond the sample have no value."""
    rows = [("0/1:a:b:c", "GT:REF:SC"), ("0/1:9", "GT:SC:ALT"), ("0/1", "GT:SC:ALT"), ("x:y", "GT:GT"), ("a:b", "CO"), (None, "GT"), ("a", None), ("", "")]
    df = spark.createDataFrame(rows, "s string, f string")
    got = df.select(*(fields.corrected_text(F.col("s"), F.col("f"), k) for k in ("GT", "SC", "REF", "ALT", "CO"))).collect()
    assert [tuple(r) for r in got] == [
        ("0/1", None, "a:b:c", None, None), ("0/1", "9", None, "", None), ("0/1", None, None, None, None), ("y", None, None, None, None), (None, None, None, None, "a:b"), *[(None,) * 5] * 3,
    ]


def test_small_expressions(spark):
    df = spark.createDataFrame([("a=1;b=2=3;FLAG;a=7;strand=+-;SUPP=4;SUPPORT=9",), (None,), ("",)], "i string")
    i = F.col("i")
    rows = df.select(fields.info_text(i, "a"), fields.info_text(i, "b"), fields.strict_info_text(i, "b"), fields.info_has(i, "FLAG"), fields.strand_text(i), fields.support_text(i)).collect()
    assert tuple(rows[0]) == ("7", "2=3", None, True, "+-", "4") and tuple(rows[1]) == (None,) * 6
    alts = ["N[chr1:5[", "N]HLA*01:02:7]", "[a:9[", "N.", "]x:y]N]z:3]", None]
    got = spark.createDataFrame([(a,) for a in alts], "a string").select(bnd.pattern(F.col("a")), bnd.mate_part(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("t[p[", "chr1:5"), ("t]p]", None), ("t[p[", "a:9"), (None, None), (None, "z:3"), (None, None)]
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*(fields.natural_key(F.lit(c)) for c in ("chr10", "chr2", "chrX"))))).collect()] == sorted(f"chr{x}" for x in ("00000000000000000010", "00000000000000000002", "X"))[1::-1] + ["chrX"]


def test_quartiles_and_few_values(spark):
    import statistics as plain

    rng = random.Random(4)
    for n in (4, 5, 11, 40):
        values = [float(rng.randrange(30)) for _ in range(n)]
        r = statistics.value_statistics(spark.createDataFrame(list(enumerate(values)), "ord long, value double")).first()
        q = plain.quantiles(values, n=4)
        assert (r.n, r.median, r.least, r.most) == (n, plain.median(values), min(values), max(values)) and (r.q1, r.q3) == pytest.approx((q[0], q[2]))
    r = statistics.value_statistics(spark.createDataFrame([(2, 5.0), (1, 9.0)], "ord long, value double")).first()
    assert (r.q1, r.q3) == (9.0, 5.0)
    assert statistics.value_statistics(spark.createDataFrame([], "ord long, value double")).count() == 0


def test_filters_by_hand(spark):
    rows = [
        (1, "10", "PASS", "SUPPORT=5;SVLEN=-60", "GT:DP:GQ", "0/1:20:9"), (2, "1", "PASS", "", "GT", "0/1"), (3, None, "pass", "RE=2", "GT", "0/1"), (4, ".", "q5", "", "GT", "./."),
        (5, "nan", "PASS", "", "GT:AD", "0/1:3,4"), (6, "10", "PASS", "SVLEN=x", "GT:DV:DR", "./.:.:9"), (7, "10", "PASS", "SVLEN=10", None, None),
    ]
    df = spark.createDataFrame(rows, "ord long, qual string, filter_raw string, info_raw string, format_raw string, sample_raw string")
    limits = filters.Limits(min_qual=5, min_support=3, min_depth=8, min_svlen=50, filter_pass=True, exclude_nocall=True)
    got = {r.ord: r.rule for r in filters.judged(df, limits).collect()}
    assert got == {1: None, 2: "qual", 3: "support", 4: "pass", 5: "depth", 6: "nocall", 7: "svlen"}
    assert filters.passing(df, filters.Limits()).count() == 7 and filters.filter_statistics(df.limit(0), limits).first().pass_rate == 0.0
    with pytest.raises(Exception, match="unknown SV type"):
        filters.known_types(spark.createDataFrame([("CNV",)], "svtype string")).collect()


def test_events_of_nulls_and_clashing_columns(spark):
    columns = "ord long, source_file string, chrom string, pos long, alt string, qual string, info_raw string, format_raw string, sample_raw string"
    rows = [
        (1, None, None, None, None, None, None, None, None), (2, "f", "chr1", 5, "<DEL>", "nan", "SVTYPE=DEL;END=.;SVLEN=-7", "GT", "0/1"), (3, "f", "chr1", 5, "<DEL>", "1", "SVTYPE=DEL", "CO", "chr1_5-chr2_9"),
        (4, "f", "chr1", 5, "N[x:y:7[", "1", "SVTYPE=BND;CHR2=z;END=8", "SC", "my_SVIM.vcf"), (5, "f", "chr1", 5, "N[c:7[", "1", "SVTYPE=TRA", "GT:REF:CO", "a:b:c-d"), (6, "f", "chr1", 5, "N", "1", "SVTYPE=INS;END=x", "", ""),
    ]
    df = spark.createDataFrame(rows, columns).withColumns({c: F.lit("clash") for c in ("svtype", "length", "caller", "route", "mate_pos", "score", "sources")})
    got = {r.ord: (r.svtype, r.end_chrom, r.end_pos, r.length, r.caller) for r in corrected_events(df).collect()}
    assert got == {
        1: ("", None, None, None, "unknown"), 2: ("DEL", "chr1", 12, 7, "unknown"), 3: ("DEL", "chr2", 9, 5, "unknown"), 4: ("BND", "z", 8, 4, "svim"), 5: ("TRA", "c", 7, 3, "unknown"), 6: ("INS", "chr1", 5, 1, "unknown"),
    }
    assert caller_events(df).where("route = 'diff'").select("mate_pos").collect() == [(None,)]
    events = corrected_events(df)
    merged = cluster.representatives(events, cluster.clusters(events))
    assert sorted(r.cluster_id for r in merged.collect()) == [2, 4, 5, 6] and len(set(merged.columns)) == len(merged.columns)
    assert cluster.clusters(events.limit(0)).count() == 0


def test_merged_rows_of_many_files(spark, tmp_path):
    """Five input files, one of them without records; every cluster, member and file is written."""
    from svlattice.plans.calls import QUERIES

    call = lambda o, file, pos, n, fmt="GT:AD", sample="0/1:{}", info="": (o, file, "s", "chr1", pos, f"r{o}", "N", "<DEL>", "20", "PASS", f"SVTYPE=DEL;END={pos + n};SVLEN=-{n};CHR2=chr1;SUPPORT=3{info}", fmt, sample.format(o))
    rows = [call(1, "e.svcf", 1000, 100), call(2, "d.svcf", 1010, 100), call(3, "a.svcf", 1000, 100), call(4, "d.svcf", 1000, 100), call(5, "e.svcf", 90000, 300)]
    # members laid out otherwise than the representative (20, of more support), whose REF takes the rest of the sample
    rows += [call(20, "a.svcf", 500000, 100, "GT:LN:REF:ALT:CO", "1/1:7:N:<DEL>:c_1-c_2", "0;X;SUPPORT=30"), call(21, "b.svcf", 500000, 100, "LN:GT", "8:0/1"), call(22, "c.svcf", 500000, 100, "AD:ALT", "1,2:N[c:5[")]
    columns = "ord long, source_file string, sample_name string, chrom string, pos long, sv_id string, ref_seq string, alt string, qual string, filter_raw string, info_raw string, format_raw string, sample_raw string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "svcf_event.parquet"))
    spark.createDataFrame([(f"{x}.svcf",) for x in "edcba"], "svcf_name string").write.parquet(str(tmp_path / "call_file.parquet"))
    cells = lambda name: {r.cluster_id: r.line.split("\t") for r in QUERIES[name](spark, str(tmp_path)).collect()}
    caller, sample = cells("merged_caller_rows"), cells("merged_sample_rows")
    assert {k: v[9:] for k, v in caller.items()} == {1: ["0/1:3", "0/1:2", "0/1:4", "0/1:1"], 5: ["0/1:5"], 20: ["1/1:7:N:<DEL>:c_1-c_2", "0/1:8:.", ".:.:.:N[c:5[:."]}
    assert {k: v[9:] for k, v in sample.items()} == {1: ["0/1:3", "0/0:.", "0/0:.", "0/1:2", "0/1:1"], 5: [*["0/0:."] * 4, "0/1:5"], 20: ["1/1:7:N:<DEL>:c_1-c_2", "0/1:8:.", ".:.:.:N[c:5[:.", *["0/0:.:.:.:."] * 2]}
    assert caller[20][7] == "SVTYPE=DEL;END=500100;SVLEN=-100;CHR2=chr1;SUPPORT=30;X=True;SOURCES=a,b,c"
    assert [x[k][7].rpartition("SOURCES=")[2] for x in (caller, sample) for k in (1, 5)] == ["a,d,e", "e"] * 2
