"""The core problems' operators against brute force on small tables, with nulls, ties, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pandas as pd
import packed_model
import pytest
from pyspark.sql import functions as F

from svlattice.operators import drift, packed, percentiles, refused


def test_packed_rows_equal_the_model(spark):
    rng = random.Random(5)
    letters = "ab =,;|\t:\"'[]xy.\x01\x02\x03é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    balanced = lambda: rng.choice(["", "k=", "k = "]) + rng.choice(['"a;b"', "'x,y|z'", '"say ""hi"" "', "v,w", " v , w ", "A]c1:5]", "[c:9[T", "", '""'])
    info = lambda: rng.choice(";|\t").join("k=" + b.partition("=")[2].strip() if "=" in (b := balanced()) else b.strip("\"'") for _ in range(rng.randint(0, 5)))
    caller = [(i, rng.choice([None, info(), f'a=1;b="{text(6).replace(chr(34), "")}";c'.replace("\x01", "\x01\x02")]), rng.choice([None, "", "GT", "GT:DV", "a;b;c", "x|y", ":a"])) for i in range(400)]
    formats = [None, "GT", "GT:AD", "A;B", "A|B|C"]
    sample = lambda: rng.choice(":;|").join(rng.choice(["1,2", "", '"a:b"', "'q,''r'", "A]c:1]", "[c,1[N", " x ", "é", "z'z", '"" '.strip()]) for _ in range(rng.randint(0, 5)))
    corrected = [(i, rng.choice(formats), rng.choice([None, sample(), sample()])) for i in range(600)]
    left = spark.createDataFrame(caller, "ord long, info_raw string, format_raw string").withColumn("val", F.lit("clash"))
    right = spark.createDataFrame(corrected, "ord long, format_raw string, sample_raw string").withColumn("item_key", F.lit(1))
    got = collections.Counter(map(tuple, packed.packed_rows(left, right).collect()))
    assert got == collections.Counter(packed_model.rows(caller, corrected))
    assert packed.packed_rows(left.limit(0), right.limit(0)).count() == 0


def test_packed_long_text(spark):
    long = "k=" + ",".join(["x" * 50] * 4000) + ';n="' + '""' * 3000 + ";" + '"'
    df = spark.createDataFrame([(1, long, None)], "ord long, info_raw string, format_raw string")
    rows = packed.info_items(df, "info_raw", ["ord"]).groupBy("item_no").agg(F.count("*").alias("n"), F.max(F.length("val")).alias("m")).orderBy("item_no").collect()
    assert [(r.n, r.m) for r in rows] == [(4000, 50), (1, 3001)]


def node(name, *children, kind=None, alike=None):
    return drift.Node(name, kind, alike, list(children))


def test_edit_scripts():
    a = node("s", node("info", node("A", kind="integer"), node("B", alike="x"), node("C"), node("M")), node("format", node("G")))
    b = node("s", node("info", node("A", kind="float"), node("D", alike="x"), node("E")), node("format", node("G"), node("M")))
    cost, steps = drift.edit_script(a, b)
    assert sorted(steps) == sorted([
        ("retype", "s/info", "A", "A"), ("rename", "s/info", "B", "D"), ("delete", "s/info", "C", ""), ("delete", "s/info", "M", ""), ("add", "s/info", "", "E"), ("add", "s/format", "", "M"),
    ])
    assert cost == pytest.approx(0.25 + 0.5 + 4)
    assert ("move", "s/info>s/format", "M", "M") in drift.moves(steps)
    assert drift.edit_script(a, a) == (0.0, [])
    nested = node("s", node("x", node("p"), node("q")))
    assert drift.edit_script(nested, node("s")) == (3.0, [("delete", "s", "x", "")])


def drift_tables(spark):
    events = [
        (1, 10, "A=1;B=x;F", "GT", "0/1"), (2, 10, "A=2;A=7", "GT", "1"), (3, 11, "A=2.5;NEW=1;F", "GT:DP", "0/1:4"), (4, 12, "A=.;NEW=3;F=1", "GT:DP", "0/1:x"), (5, 99, "Z=1", None, None), (6, 11, None, None, None), (7, None, "Q=1", "GT", "1"),
    ]
    headers = [(10, 1, '##INFO=<ID=B,Number=1,Type=String,Description="The  same thing.">'), (11, 1, '##INFO=<ID=NEW,Number=1,Type=String,Description="the same thing"'), (11, 2, None), (12, 1, "##INFO=<ID=NEW")]
    files = [(10, "s", 1), (12, "s", 3), (11, "s", 2), (13, "s", 4), (99, None, 1)]
    return (
        spark.createDataFrame(events, "ord long, file_id long, info_raw string, format_raw string, sample_raw string").withColumns({"chrom": F.lit("c"), "pos": F.lit(1), "sv_id": F.lit("i"), "key": F.lit("clash")}),
        spark.createDataFrame(headers, "file_id long, line_no long, line string"),
        spark.createDataFrame(files, "file_id long, series_id string, produced_at int"),
    )


def test_schema_changes_by_hand(spark):
    got = sorted(map(tuple, drift.schema_changes(*drift_tables(spark)).collect()))
    assert got == sorted([
        (11, "info", "renamed", "B", "NEW"), (11, "info", "retyped", "B", "NEW"), (11, "info", "retyped", "A", "A"), (11, "format", "added", "", "DP"),
        (12, "info", "retyped", "F", "F"), (12, "format", "retyped", "DP", "DP"),
        (13, "info", "removed", "A", ""), (13, "info", "removed", "NEW", ""), (13, "info", "removed", "F", ""), (13, "format", "removed", "GT", ""), (13, "format", "removed", "DP", ""),
    ])


def test_unified_records(spark):
    rows = {r.ord: r for r in drift.unified_records(*drift_tables(spark)).collect()}
    assert len(rows) == 7
    assert rows[1].info == {"A": "1", "NEW": "x", "F": "true"} and rows[2].info == {"A": "7"} and rows[3].info["NEW"] == "1"
    assert rows[3].format == {"GT": "0/1", "DP": "4"} and rows[6].info is None and rows[7].info == {"Q": "1"} and rows[5].format is None


def test_unified_kinds(spark):
    rows = {r.ord: r for r in drift.unified_records(*drift_tables(spark)).collect()}
    assert rows[1].info_kinds == {"A": "float", "NEW": "string", "F": "integer"} and rows[1].format_kinds == {"GT": "string"}
    assert rows[3].info_kinds == rows[1].info_kinds and rows[3].format_kinds == {"GT": "string", "DP": "string"}
    assert rows[5].info_kinds == {"Z": "integer"} and rows[7].info_kinds is None


def test_unified_values(spark):
    events, headers, files = drift_tables(spark)
    more = [(20, 10, 'Q="x,y";L=x,y;F;T=true;A=1;A=2,3;E=', "GT:AD:DP", '0/1:"3,4",5')]
    events = events.unionByName(spark.createDataFrame(more, "ord long, file_id long, info_raw string, format_raw string, sample_raw string").withColumns({"chrom": F.lit("c"), "pos": F.lit(1), "sv_id": F.lit("i"), "key": F.lit("clash")}))
    rows = {r.ord: r for r in drift.unified_records(events, headers, files).collect()}
    assert rows[20].info_values == {"Q": ["x,y"], "L": ["x", "y"], "F": [], "T": ["true"], "A": ["1", "2", "3"], "E": [""]}
    assert rows[20].format_values == {"GT": ["0/1"], "AD": ["3,4", "5"], "DP": []} and rows[20].info["A"] == "2,3"
    assert rows[2].info_values == {"A": ["2", "7"]} and rows[6].info_values is None and rows[5].format_values is None


def series(*schemas):
    """A series' files as _projections takes them; a schema is a list of (fld, key, kind, description) or with fits."""
    entry = lambda fld, key, kind="integer", description=None, fits=True: {"fld": fld, "key": key, "kind": kind, "description": description, "fits": fits}
    return pd.DataFrame({"file_id": range(len(schemas)), "produced_at": range(len(schemas)), "entries": [[entry(*e) for e in s] for s in schemas]})


def lasting(*schemas):
    return {(r.file_id, r.fld, r.key): (r.lasting_fld, r.lasting_key, r.kind) for r in drift._projections(series(*schemas)).itertuples()}


def test_lasting_keys():
    """No two keys of a file share a lasting name, also where a name was given up and then taken over by a rename."""
    got = lasting([("info", "A", "integer", "x"), ("info", "B", "float", "y")], [("info", "A", "integer", "x")], [("info", "B", "string", "x")])
    assert got == {(0, "info", "A"): ("info", "B", "string"), (0, "info", "B"): ("info", "B~1", "float"), (1, "info", "A"): ("info", "B", "string"), (2, "info", "B"): ("info", "B", "string")}
    swapped = lasting([("info", "A", "integer", "x"), ("info", "B", "integer", "y")], [("info", "C", "integer", "x")], [("info", "C", "integer", "x"), ("info", "B", "float", "z")])
    assert swapped[0, "info", "A"] == ("info", "C", "integer") and swapped[0, "info", "B"] == swapped[2, "info", "B"] == ("info", "B", "float")


def test_moved_keys_and_long_integers():
    got = lasting([("info", "DP", "integer"), ("format", "GT", "string")], [("format", "DP", "float"), ("format", "GT", "string")], [("format", "DP", None), ("info", "N", "integer", None, False)])
    assert got[0, "info", "DP"] == got[1, "format", "DP"] == ("format", "DP", "float") and got[2, "info", "N"] == ("info", "N", "string")


def test_moved_values_and_numbers(spark, monkeypatch):
    events = [(1, 10, "DP=7;A=1,.;S=x;L=99999999999999999999", "GT", "0/1"), (2, 11, "A=2.5;A=3", "GT:DP", "0/1:8"), (3, 10, None, "GT", "1"), (4, 10, "DP=1", None, None)]
    files = [(10, "s", 1), (11, "s", 2)]
    e = spark.createDataFrame(events, "ord long, file_id long, info_raw string, format_raw string, sample_raw string").withColumns({"chrom": F.lit("c"), "pos": F.lit(1), "sv_id": F.lit("i"), "_moved": F.lit("clash")})
    f = spark.createDataFrame(files, "file_id long, series_id string, produced_at int")
    h = spark.createDataFrame([], "file_id long, line_no long, line string")
    for most in (drift.MOST_RULES, 0):
        monkeypatch.setattr(drift, "MOST_RULES", most)
        rows = {r.ord: r for r in drift.unified_records(e, h, f).collect()}
        assert rows[1].format == {"GT": "0/1", "DP": "7"} and "DP" not in rows[1].info and rows[4].format == {"DP": "1"} and rows[4].info == {}
        assert rows[1].info_numbers == {"A": [1.0, None]} and rows[2].info_numbers == {"A": [2.5, 3.0]} and rows[1].format_numbers == {"DP": [7.0]}
        assert rows[1].info_kinds == {"A": "float", "S": "string", "L": "string"} and rows[1].format_kinds == {"GT": "string", "DP": "integer"} and rows[3].info is None


def test_quote_automaton_over_chunks():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lines = ["".join(rng.choice(list('ab"\t'), rng.integers(0, 30))) for _ in range(rng.integers(1, 12))]
        data = np.frombuffer("".join(lines).encode(), dtype=np.uint8)
        starts = np.cumsum([0, *map(len, lines)])[:-1]
        starts = starts[[len(x) > 0 for x in lines]]
        expected = []
        for x in lines:
            q = False
            for ch in x:
                q ^= ch == '"'
                expected.append(q)
        for chunk in (1, 3, 7, 1000):
            assert list(refused.quoted_at(data, starts, chunk)) == expected


def test_refused_lines(spark):
    good = "chr1\t5\ta\tN\t<DEL>\t.\tPASS\tA=1"
    lines = [
        None, "", "\r", "#c", good, good + "\r", good + "\tGT\t1", good + "\tGT", good + "\tG\t1\t2\t3\t4", good.replace("PASS", 'x"y'), good.replace("PASS", '"a\tb"'), good.replace("\t5\t", "\t0\t"),
        good.replace("\t5\t", "\t9223372036854775807\t"), good.replace("\t5\t", "\t9223372036854775808\t"), good.replace("\t5\t", "\t５\t"), good.replace("\t.\t", "\t1e5\t"), good.replace("\t.\t", "\t-1\t"),
        good.replace("\t.\t", "\t5f\t"), good.replace("<DEL>", "N[a:b:7["), good.replace("<DEL>", "N[chr1:7]"), good.replace("<DEL>", ".A"), good.replace("<DEL>", ""), "\t" * 9, "x" * 100_000, good.replace("\t5\t", "\t007\t"),
    ]
    df = spark.createDataFrame([(i, 1 if i != 8 else 2, i, x) for i, x in enumerate(lines)], "line_id long, file_id long, line_no long, line string").withColumn("alt", F.lit("clash"))
    files = spark.createDataFrame([(1, "svim"), (2, "SvABA"), (2, "svaba"), (3, None)], "file_id long, caller string")
    got = {r.line_id: (r.reason, r.reason_at) for r in refused.refused(df, files).collect()}
    expected = {7: "columns", 9: "quote", 11: "pos", 13: "pos", 14: "pos", 16: "qual", 17: "qual", 19: "alt", 21: "alt", 22: "pos", 23: "columns"}
    assert {k: v[0] for k, v in got.items()} == expected
    assert got[11][1] == 5 and got[9][1] == lines[9].index('"') and got[19][1] == lines[19].index("N[")
    ok = refused.loaded(df, files).orderBy("line_id").collect()
    assert sorted([r.line_id for r in ok] + list(expected)) == list(range(4, len(lines)))
    assert ok[0].qual is None and ok[0].format_raw is None and ok[0].pos == 5
    assert refused.refused(df.limit(0), files).count() == 0


def test_loaded_samples(spark):
    head = "chr1\t5\ta\tN\t<DEL>\t.\tPASS\tA=1"
    tails = {1: "", 2: "\tG\t1", 3: "\tG\tp\tq\tr\tlast", 4: "\tG\tp\tq\tr\tlast\r", 5: "\tG\tp\t\t\t", 6: '\tG\t"a\tb"\tq\tr\t"c\td"', 7: "\tG\t"}
    df = spark.createDataFrame([(i, 1, i, head + x) for i, x in tails.items()], "line_id long, file_id long, line_no long, line string")
    ok = refused.loaded(df, spark.createDataFrame([(1, "svaba")], "file_id long, caller string")).collect()
    assert {r.line_id: (r.format_raw, r.sample_raw, r.samples) for r in ok} == {
        1: (None, None, None), 2: ("G", "1", ["1"]), 3: ("G", "last", ["p", "q", "r", "last"]), 4: ("G", "last", ["p", "q", "r", "last"]), 5: ("G", "", ["p", "", "", ""]),
        6: ("G", '"c\td"', ['"a\tb"', "q", "r", '"c\td"']), 7: ("G", "", [""]),
    }


def test_percentiles_within_the_bound_and_mergeable(spark):
    rng = np.random.default_rng(7)
    n = 60_000
    pdf = pd.DataFrame({"file_id": rng.integers(0, 6, n), "svtype": "DEL", "qual": np.round(rng.lognormal(3, 2, n), 3).astype(str), "support": rng.integers(0, 50, n), "svlen": 1, "day": rng.integers(1, 4, n)})
    pdf.loc[:50, "qual"] = "."
    pdf.loc[51:60, "qual"] = "NaN"
    pdf.loc[61:70, "qual"] = "5d"
    df = spark.createDataFrame(pdf).withColumn("loaded_at", F.expr("make_timestamp(2030, 1, day, 0, 0, 0)"))
    files = spark.createDataFrame([(i, "one" if i < 5 else "two") for i in range(6)], "file_id long, caller string")
    daily = percentiles.daily_sketches(df, files)
    whole = {(r.caller, r.measure): r for r in percentiles.read_percentiles(percentiles.merged(daily, ["caller"]), ["caller"]).collect()}
    values = np.sort(pd.to_numeric(pdf.qual[71:])[pdf.file_id[71:] < 5].to_numpy())
    r = whole["one", "qual"]
    assert r.n == len(values)
    for p in (5, 25, 50, 75, 95):
        v = r[f"p{p:02d}"]
        low, high = np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)
        assert low - 2 * r.rank_error <= p / 100 <= high + 2 * r.rank_error
    assert percentiles.read_percentiles(daily, ["caller", "svtype", "day"]).count() == 2 * 3 * 3


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "x", None, None, None)], "file_id long, svtype string, qual string, support long, svlen long, loaded_at timestamp")
    files = spark.createDataFrame([], "file_id long, caller string")
    rows = percentiles.read_percentiles(percentiles.daily_sketches(df, files), ["caller", "svtype", "day"]).collect()
    assert [(r.n, r.p50, r.caller) for r in rows] == [(0, None, None)] * 3
    assert percentiles.daily_sketches(df.limit(0), files).count() == 0


def test_descriptions_alike(spark):
    texts = ["A  b.", "a B", "a b. .", "a.b", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(drift.same_words(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] == "a b" and got[3] == "a.b" and got[4] == "" and re.match("a", got[0])
