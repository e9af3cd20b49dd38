import random

import pandas as pd
import pytest

from svlattice.operators import groups

RECORDS = "ord long, source_file string, sv_id string"
MATCHES = "match_id long, a_source_file string, a_sv_id string, b_source_file string, b_sv_id string"


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def shapes():
    rng = random.Random(3)
    path = list(range(400))
    rng.shuffle(path)
    yield "path", list(zip(path, path[1:]))
    yield "hub", [(0, i) for i in range(1, 300)] + [(500, i) for i in range(501, 600)]
    yield "random", [(rng.randrange(600), rng.randrange(600)) for _ in range(450)]
    yield "self and repeats", [(5, 5), (1, 2), (2, 1), (1, 2)]


@pytest.mark.parametrize("name,pairs", list(shapes()))
def test_components_equal_union_find(spark, name, pairs, monkeypatch):
    monkeypatch.setattr(groups, "EDGES_PER_CELL", 20)
    monkeypatch.setattr(groups, "n_blocks", lambda n: 4)
    edges = spark.createDataFrame(pd.DataFrame(pairs, columns=["u", "v"]))
    got = {r.vertex: r.root for r in groups.components(edges).collect()}
    assert got == {v: r for v, r in union_find(pairs).items() if v != r}


def test_record_groups_by_hand(spark):
    records = spark.createDataFrame(
        [(1, "a.svcf", "x"), (2, "b.svcf", "x"), (3, "b.svcf", "y"), (4, "a.svcf", "x"), (5, "c.svcf", None), (6, None, "x"), (7, "d.svcf", "q"), (8, "e.svcf", "q"), (9, "f.svcf", "lone")], RECORDS
    )
    matches = spark.createDataFrame(
        [(1, " runs/b.svcf ", "y ", "a.svcf", "x"), (2, "a.svcf", "x", "a.svcf", "x"), (3, "d.svcf", "q", "gone.svcf", "g"), (4, "/data/gone.svcf", "g", "e.svcf", "q"), (5, "a.svcf", None, "b.svcf", "x"), (6, "never.svcf", "1", "never.svcf", "2")],
        MATCHES,
    )
    got = {r.ord: r.group_ord for r in groups.record_groups(records, matches).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}


def test_record_groups_of_empty_tables(spark):
    records = spark.createDataFrame([(1, "a", "x"), (3, "a", "x")], RECORDS)
    none = spark.createDataFrame([], MATCHES)
    assert {r.ord: r.group_ord for r in groups.record_groups(records, none).collect()} == {1: 1, 3: 1}
    assert groups.record_groups(records.limit(0), none).count() == 0
