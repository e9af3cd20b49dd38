"""Pairwise matches consolidated into groups: connected components on a two-dimensional grid.

Method: vertices hash into P blocks and an edge lies in the cell of its two blocks, so even a vertex with a third of all
edges is spread over P cells. Every task runs union-find over the edges of its cells and keeps, for each vertex, the
smallest vertex it reaches there (at most one row per vertex and task). Row and column representatives of a vertex are
then exchanged: the smallest becomes its parent, the others are linked to it. A vertex that represents nobody is then a
leaf and leaves for good with its parent; the links and the parent edges of the rest form the next, smaller edge set. The
number of blocks follows that set, so rounds end when it is empty or fits one cell. The parents of each round are then
looked up among those of the later, smaller rounds, from the last to the first. Edge sets are checkpointed each round in
the folder all executors share; nothing is collected but counts.

Defined results: null names link nothing; a row that is in no match is its own group; self matches, repeats, either
order and records that exist only in matches are allowed; empty match tables leave every record its own group, rows
of the same name being one record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svlattice.session import cut_lineage

EDGES_PER_CELL = 250_000
#: Up to so many rounds are resolved in one plan, more with a checkpoint between each.
FEW_ROUNDS = 4
UNDELIVERED = 1 << 62


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: every vertex that isn't its component's smallest, with that smallest."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(ids))
    while True:
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            break
        a, b, pa, pb = a[open_], b[open_], pa[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[child], ids[parent[child]]


def _local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contracts a task's edges; more than a cell's worth is folded into the forest so far, so memory follows vertices."""
    us, vs, held = [], [], 0
    for p in parts:
        us.append(p["u"].to_numpy())
        vs.append(p["v"].to_numpy())
        held += len(p)
        if held > 4 * EDGES_PER_CELL:
            child, root = contract(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [child], [root], 0
    if us:
        child, root = contract(np.concatenate(us), np.concatenate(vs))
        for lo in range(0, len(child), 100_000):
            yield pd.DataFrame({"v": child[lo : lo + 100_000], "r": root[lo : lo + 100_000]})


def n_blocks(n_edges: int) -> int:
    return max(1, math.ceil(math.sqrt(2 * n_edges / EDGES_PER_CELL)))


def components(edges: DataFrame) -> DataFrame:
    """vertex, root of every vertex of edges (u, v) that isn't the smallest of its component."""
    active = cut_lineage(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds, n = [], active.count()
    while n:
        blocks = n_blocks(n)
        block = lambda c, s=len(rounds), p=blocks: F.pmod(F.xxhash64(F.col(c), F.lit(s)), F.lit(p))
        cells = active.repartition(max(1, blocks * (blocks + 1) // 2), F.least(block("u"), block("v")), F.greatest(block("u"), block("v")))
        forest = cells.mapInPandas(_local, "v long, r long")
        if blocks == 1:  # the edges that are left lie in one cell, so its representatives are the roots
            rounds.append(forest.select("v", F.col("r").alias("m")))
            break
        # of every vertex its representatives, and whether it represents others; at most one representative per task, so
        # the sets are bounded by the grid, not by the data
        both = forest.select(F.explode(F.array(F.struct("v", "r"), F.struct(F.col("r").alias("v"), F.lit(None).cast("long").alias("r")))).alias("_x")).select("_x.*")
        reps = both.groupBy("v").agg(F.min("r").alias("m"), F.collect_set("r").alias("reps"), F.bool_or(F.col("r").isNull()).alias("held")).where("m is not null")
        reps = cut_lineage(reps)
        rounds.append(reps.where("not held").select("v", "m"))
        links = reps.where(F.size("reps") > 1).select(F.col("m").alias("u"), F.explode("reps").alias("v")).where("u <> v")
        active = cut_lineage(links.unionByName(reps.where("held").select(F.col("m").alias("u"), "v")).distinct())
        n = active.count()
    roots = None  # of the later rounds' vertices; a leaf's parent is never a leaf of the same round
    for leaves in reversed(rounds):
        if roots is not None:
            later = roots.select(F.col("v").alias("m"), F.col("m").alias("_root"))
            leaves = roots.unionByName(leaves.join(later, "m", "left").select("v", F.coalesce("_root", "m").alias("m")))
            leaves = cut_lineage(leaves) if len(rounds) > FEW_ROUNDS else leaves
        roots = leaves
    if roots is None:
        return active.select(F.col("v").alias("vertex"), F.col("u").alias("root"))
    return roots.select(F.col("v").alias("vertex"), F.col("m").alias("root"))


def file_part(name: Column) -> Column:
    """A source file's name without outer spaces and directories."""
    return F.trim(F.substring_index(F.trim(name), "/", -1))


def record_groups(records: DataFrame, matches: DataFrame) -> DataFrame:
    """ord, group_ord: of every record row the smallest ord of all rows of its group."""
    rows = records.select("ord", file_part(F.col("source_file")).alias("f"), F.trim("sv_id").alias("s"))
    pairs = matches.select(
        "match_id", file_part(F.col("a_source_file")).alias("af"), F.trim("a_sv_id").alias("as"), file_part(F.col("b_source_file")).alias("bf"), F.trim("b_sv_id").alias("bs")
    ).dropna(subset=["af", "as", "bf", "bs"])
    # a name's vertex is its smallest ord; an undelivered name's lies above all ords, made of its first match and side
    code = lambda side: F.lit(UNDELIVERED) + F.col("match_id") * 2 + side
    names = rows.dropna(subset=["f", "s"]).select("f", "s", "ord")
    names = names.unionByName(pairs.select(F.col("af").alias("f"), F.col("as").alias("s"), code(0).alias("ord")))
    names = names.unionByName(pairs.select(F.col("bf").alias("f"), F.col("bs").alias("s"), code(1).alias("ord")))
    names = cut_lineage(names.groupBy("f", "s").agg(F.min("ord").alias("vertex")))
    a = names.select(F.col("f").alias("af"), F.col("s").alias("as"), F.col("vertex").alias("u"))
    b = names.select(F.col("f").alias("bf"), F.col("s").alias("bs"), F.col("vertex").alias("v"))
    edges = pairs.join(a, ["af", "as"]).join(b, ["bf", "bs"]).select("u", "v")
    roots = components(edges)
    named = rows.join(names, ["f", "s"], "left").select("ord", F.coalesce("vertex", "ord").alias("vertex"))
    return named.join(roots, "vertex", "left").select("ord", F.coalesce("root", "vertex").alias("group_ord"))
