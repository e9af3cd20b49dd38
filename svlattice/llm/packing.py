"""Containers of fixed capacity filled with items of varying length.

Method: best-two-fit. A container is filled greedily, largest fitting item first; then its smallest item gives way to
two unpacked items that fill the widened gap more tightly, as long as such a pair exists.

Sizes are whole numbers up to the capacity, so the items are described by a histogram of at most `capacity` counts. The
packing is planned on that histogram: a filled container is a pattern of sizes, used as often as the counts allow at
once, so planning takes time and memory by the capacity and not by the data. Items then find their places in parallel:
an item's rank among those of its size picks the pattern and container. Ranks are two-level (size and hash chunk), so a
size that a third of all items share is spread over many tasks.

Defined results: an item longer than the capacity is cut into full pieces and a rest (piece_no from 1); no other is
split. An item of size 0 takes no room and lies in any container. Null sizes count as 0. Repeated keys are separate
items. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svlattice.session import cut_lineage

CAPACITY = 2048
ITEMS_PER_CHUNK = 200_000


def _best_pair(sizes: np.ndarray, counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two free sizes with the largest sum up to gap."""
    n = int(np.searchsorted(sizes, gap, side="left"))
    if not n:
        return None
    first = sizes[:n]
    at = np.searchsorted(first, gap - first, side="right") - 1
    alone = (at == np.arange(n)) & (counts[:n] < 2)  # an item can't be taken twice
    at = at - alone
    total = np.where(at >= 0, first + first[np.maximum(at, 0)], -1)
    best = int(np.argmax(total))
    return (int(first[best]), int(first[at[best]])) if total[best] > 0 else None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes, descending) and how many containers have each; histogram: size -> number of items."""
    sizes = sorted(s for s, n in histogram.items() if n > 0)
    free = {s: histogram[s] for s in sizes}
    out = []

    def take(s: int) -> None:
        free[s] -= 1
        if not free[s]:
            sizes.pop(bisect.bisect_left(sizes, s))

    def give(s: int) -> None:
        if not free[s]:
            bisect.insort(sizes, s)
        free[s] += 1

    while sizes:
        pattern, room = [], capacity
        while sizes and (i := bisect.bisect_right(sizes, room)):
            s = sizes[i - 1]
            fits = min(free[s], room // s)
            for _ in range(fits):
                take(s)
            pattern += [s] * fits
            room -= s * fits
        while room and len(pattern) > 1 and sizes:
            smallest = pattern[-1]
            pair = _best_pair(np.array(sizes), np.array([free[s] for s in sizes]), room + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            pattern.pop()
            for s in pair:
                take(s)
            give(smallest)
            pattern = sorted((*pattern, *pair), reverse=True)
            room = capacity - sum(pattern)
        uses = {s: pattern.count(s) for s in pattern}
        more = min(free[s] // n for s, n in uses.items())
        for s, n in uses.items():
            if more:
                free[s] -= more * n
                if not free[s]:
                    sizes.pop(bisect.bisect_left(sizes, s))
        out.append((tuple(pattern), 1 + more))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For runs of (size, rank): key of the first rank, first container, items per container; and the number of containers."""
    runs, container, used = [], 0, {}
    for pattern, times in patterns:
        for s in dict.fromkeys(pattern):
            per = pattern.count(s)
            runs.append(((s << 44) + used.get(s, 0), container, per))
            used[s] = used.get(s, 0) + per * times
        container += times
    runs.sort()
    keys, first, per = (np.array([r[i] for r in runs], dtype=np.int64) for i in range(3))
    return keys, first, per, container


def packed(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """key, piece_no, piece_size, container_id: where every item, or every piece of an overlong one, lies."""
    kind = dict(items.dtypes)[key]
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    pieces = items.select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(n / capacity), F.lit(1).cast("long")))).alias("piece_no"))
    pieces = pieces.select(key, "piece_no", F.least(F.lit(capacity), F.col("_n") - (F.col("piece_no") - 1) * capacity).cast("long").alias("piece_size"))
    pieces = cut_lineage(pieces)
    histogram = {r["piece_size"]: r["count"] for r in pieces.groupBy("piece_size").count().collect()}  # at most capacity + 1 rows
    keys, first, per, containers = _places(plan({s: c for s, c in histogram.items() if s > 0}, capacity))
    chunks = max(1, -(-sum(histogram.values()) // ITEMS_PER_CHUNK))

    chunked = pieces.withColumn("_chunk", F.pmod(F.xxhash64(key, "piece_no"), F.lit(chunks)))
    order = Window.partitionBy("piece_size").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunked.groupBy("piece_size", "_chunk").count().withColumn("_before", F.coalesce(F.sum("count").over(order), F.lit(0))).drop("count")
    inside = Window.partitionBy("piece_size", "_chunk").orderBy(key, "piece_no")
    ranked = chunked.withColumn("_in", F.row_number().over(inside)).join(before, ["piece_size", "_chunk"])
    ranked = ranked.select(key, "piece_no", "piece_size", (F.col("_before") + F.col("_in") - 1).alias("_rank"))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s, rank = p["piece_size"].to_numpy(), p["_rank"].to_numpy()
            container = rank % max(1, containers)  # of items without size
            real = s > 0
            run = np.searchsorted(keys, (s[real] << 44) + rank[real], side="right") - 1
            container[real] = first[run] + ((s[real] << 44) + rank[real] - keys[run]) // per[run]
            yield pd.DataFrame({key: p[key], "piece_no": p["piece_no"], "piece_size": s, "container_id": container})

    return ranked.mapInPandas(place, f"{key} {kind}, piece_no long, piece_size long, container_id long")


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_containers, n_pieces, tokens, fill (share of the room that is used), fullest: one row on a packing."""
    each = placed.groupBy("container_id").agg(F.count("*").alias("n"), F.sum("piece_size").alias("s"))
    return each.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("s"), F.lit(0)).alias("tokens"),
        F.try_divide(F.sum("s"), F.count("*") * capacity).alias("fill"), F.max("s").alias("fullest"),
    )
