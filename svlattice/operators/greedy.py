"""Ordered greedy operators without a global order: islands of near events, each folded in record order.

Pairing, clustering and truth matching are greedy in record order, but only events within a width of each other on both
axes (start and end, two breakpoints, start and length) can interact. Space is cut into cells of those widths; events of
cells that aren't connected through neighbouring occupied cells never interact. Islands are found in two steps. First
along one axis: maximal runs of occupied neighbouring cells, by a window over the distinct (keys, cell) pairs, which the
genome's length bounds. A run that holds more than `CROWDED` events, as on densely called chromosomes, is then divided
on both axes: the connected components of its occupied two-dimensional cells, by the same grid algorithm as match groups.

Events are sorted by island and order inside each task, and a task folds its islands one after the other, with one
dictionary of cells per island, so the fold is linear in the events but for those within a cell's reach. What remains in
one task is a two-dimensional island: a place where calls touch each other without a gap on either axis. Callers collapse
exact copies beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svlattice.operators.groups import components
from svlattice.session import cut_lineage

#: A one-dimensional island of more events than this is divided on both axes. It changes the plan, never the result.
CROWDED = 100_000
#: Half of a cell's eight neighbours; the other half meets it from their side.
NEIGHBOURS = ((0, 1), (1, -1), (1, 0), (1, 1))


def with_islands(events: DataFrame, keys: list[str], first: tuple[Column, Column | float], second: tuple[Column, Column | float], few: bool | None = None) -> DataFrame:
    """events + _cell, _island, _part; first and second are (place, width) of the two axes.

    Rows with a null key or place are left out (they interact with nothing). _cell is the cell on the first axis. The
    events are read more than once, so they should be a written or cached table. few: whether the caller knows that no
    keys have more than `CROWDED` events, so that no island can; else they are counted.
    """
    cell = lambda axis: F.floor(axis[0] / axis[1]).cast("long")
    df = events.withColumns({"_cell": cell(first), "_cell2": cell(second)}).dropna(subset=[*keys, "_cell", "_cell2"])
    cells = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_cell")
    new = F.coalesce(F.col("_cell") - F.lag("_cell").over(order) > 1, F.lit(True))
    cells = cells.withColumn("_island", F.sum(new.cast("long")).over(order))
    crowded = cells.groupBy(*keys, "_island").agg(F.sum("_n").alias("_n")).where(F.col("_n") > CROWDED).select(*keys, "_island")
    few = df.groupBy(*keys).count().where(F.col("count") > CROWDED).isEmpty() if few is None else few
    df = df.join(cells.drop("_n"), [*keys, "_cell"])
    if few or crowded.isEmpty():
        return df.withColumn("_part", F.lit(0).cast("long")).drop("_cell2")
    return df.join(_parts(df, keys, crowded), [*keys, "_island", "_cell", "_cell2"], "left").withColumn("_part", F.coalesce("_part", F.lit(-1))).drop("_cell2")


def _parts(df: DataFrame, keys: list[str], crowded: DataFrame) -> DataFrame:
    """keys, _island, _cell, _cell2, _part: connected components of the occupied cells of crowded islands."""
    place = [*keys, "_island", "_cell", "_cell2"]
    occupied = df.select(*place).distinct().join(crowded, [*keys, "_island"], "left_semi")
    occupied = cut_lineage(occupied.withColumn("_id", F.monotonically_increasing_id()))  # written once, so the numbers stay
    near = F.explode(F.array(*(F.struct((F.col("_cell") + i).alias("_cell"), (F.col("_cell2") + j).alias("_cell2")) for i, j in NEIGHBOURS))).alias("_near")
    edges = occupied.select(*keys, "_island", F.col("_id").alias("u"), near).select(*keys, "_island", "u", "_near.*")
    edges = edges.join(occupied.withColumnRenamed("_id", "v"), place).select("u", "v")
    roots = components(edges).select(F.col("vertex").alias("_id"), "root")
    return occupied.join(roots, "_id", "left").select(*place, F.coalesce("root", "_id").alias("_part"))


def folded(events: DataFrame, keys: list[str], order: list[str], columns: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold over every island's rows (tuples of `columns`, sorted by `order`); its tuples make the result.

    `fold` runs once per island on an iterator, also over the ends of Arrow batches: rows stream through it, and a task
    holds only what the fold itself keeps.
    """
    names = [part.split()[0] for part in schema.split(",")]
    group = [*keys, "_island", "_part"]
    df = events.select(*group, *order, *(c for c in columns if c not in group and c not in order))
    # an island's rows lie in one task by its keys, sorted
    df = df.repartition(*group).sortWithinPartitions(*group, *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for p in parts:
                yield from zip(zip(*(p[g] for g in group)), zip(*(p[c].astype(object).where(p[c].notna(), None) for c in columns)))

        out: list[tuple] = []
        for _, island in groupby(rows(), key=lambda r: r[0]):
            for made in fold(r[1] for r in island):
                out.append(made)
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)
