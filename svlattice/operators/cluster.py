"""Clusters of events that callers report alike: first-fit leaders in record order, and a representative of each.

An event joins the oldest cluster whose leader it matches, else it leads a new one; there is no transitive closure.
Exact copies (same keys, place and length) always share the fate of their first, so each is folded once.

Defined results: an event with a null chromosome, place or end leads its own cluster; so does one of length 0, an
insertion of negative length (it ends before its start) and a breakend whose ALT isn't readable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svlattice.functions import bnd, fields
from svlattice.operators import greedy
from svlattice.operators.greedy import folded, with_islands

REGULAR = ("INS", "DEL", "DUP", "INV")


@dataclass(frozen=True)
class Tolerances:
    tra_delta: int = 50
    bnd_delta: int = 50


def _fold_regular(rows: Iterator[tuple]) -> Iterator[tuple]:
    """rows: (ord, svtype, start, end, length, cell). Leaders lie in a dictionary of cells."""
    leaders: dict[int, list[tuple]] = {}
    for ord_, svtype, start, end, length, cell in rows:
        base, ratio = fields.DISTANCES.get(svtype, fields.OTHER_DISTANCE), fields.RATIOS.get(svtype, fields.OTHER_RATIO)
        best = None
        for c in (cell - 1, cell, cell + 1):
            for l_ord, l_start, l_end, l_length in leaders.get(c, ()):
                if best is not None and l_ord > best:
                    continue
                short, long_ = sorted((length, l_length))
                reach = base * (2 if short >= 1000 else 1.5 if short >= 500 else 1)
                if abs(start - l_start) <= reach and (svtype == "INS" or abs(end - l_end) <= reach) and long_ / short <= ratio:
                    best = l_ord
        if best is None:
            best = ord_
            leaders.setdefault(cell, []).append((ord_, start, end, length))
        yield ord_, best


_RECIPROCAL = (frozenset(("RIGHT_TO_LEFT", "LEFT_TO_RIGHT")), frozenset(("RIGHT_TO_RIGHT", "LEFT_TO_LEFT")))


def _fold_tra(reach: int):
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        """rows: (ord, rank, start, end, direction, cell), in rank order; leaders keep their rank for the oldest."""
        leaders: dict[int, list[tuple]] = {}
        for ord_, rank, start, end, way, cell in rows:
            best = None
            for c in (cell - 1, cell, cell + 1):
                for l_rank, l_ord, l_start, l_end, l_way in leaders.get(c, ()):
                    if best is not None and (l_rank, l_ord) > best:
                        continue
                    a, b = (end, start) if frozenset((way, l_way)) in _RECIPROCAL else (start, end)
                    if abs(l_start - a) <= reach and abs(l_end - b) <= reach:
                        best = (l_rank, l_ord)
            if best is None:
                best = (rank, ord_)
                leaders.setdefault(cell, []).append((rank, ord_, start, end, way))
            yield ord_, best[1]

    return fold


def _fold_bnd(delta: int):
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        """rows: (ord, rank, pos, target, cell)."""
        leaders: dict[int, list[tuple]] = {}
        for ord_, rank, pos, target, cell in rows:
            near = [x for c in (cell - 1, cell, cell + 1) for x in leaders.get(c, ()) if abs(x[2] - pos) <= delta and abs(x[3] - target) <= delta]
            best = min(near)[1] if near else ord_
            if not near:
                leaders.setdefault(cell, []).append((rank, ord_, pos, target))
            yield ord_, best

    return fold


def _clustered(events: DataFrame, keys: list[str], same: list[str], axes: tuple, rank: str | None, columns: list[str], fold, few: bool | None) -> DataFrame:
    """ord, cluster_id of every event: copies collapsed to the first, islands folded, copies joined to their first's leader."""
    by = F.struct(F.col(rank).alias("rank"), F.col("ord")) if rank else F.struct(F.lit(0).cast("long").alias("rank"), F.col("ord"))
    first = events.groupBy(*keys, *same).agg(F.min(by).alias("_f")).select(*keys, *same, "_f.rank", "_f.ord")
    islands = with_islands(first, keys, *axes, few)
    led = folded(islands, keys, ["rank", "ord"], [*columns, "_cell"], fold, "ord long, cluster_id long")
    led = first.join(led, "ord").select(*(F.col(c).alias(f"_l_{c}") for c in (*keys, *same)), "cluster_id")
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in (*keys, *same)))
    return events.join(led, on, "left").select("ord", F.coalesce("cluster_id", "ord").alias("cluster_id"))


def regular_clusters(events: DataFrame, few: bool | None = None) -> DataFrame:
    """ord, cluster_id of insertions, deletions, duplications and inversions."""
    df = events.where(F.col("svtype").isin(*REGULAR)).select("ord", "svtype", "start_chrom", "start_pos", "end_pos", "length")
    width = 2 * fields.by_type(F.col("svtype"), fields.DISTANCES, fields.OTHER_DISTANCE)
    # insertions match whatever their ends; their second axis is the length, in steps of the largest ratio. The slack keeps
    # lengths whose ratio is the limit itself in neighbouring cells
    step = math.log(fields.RATIOS["INS"]) * (1 + 1e-9)
    far, reach = F.when(F.col("svtype") == "INS", F.log(F.abs("length"))).otherwise(F.col("end_pos")), F.when(F.col("svtype") == "INS", step).otherwise(width)
    alone = (F.col("length") == 0) | F.col("length").isNull() | ((F.col("svtype") == "INS") & (F.col("length") < 0))
    lone = df.where(alone).select("ord", F.col("ord").alias("cluster_id"))  # these match nothing, not even copies
    df = df.where(~alone)
    return lone.unionByName(_clustered(df, ["svtype", "start_chrom"], ["start_pos", "end_pos", "length"], ((F.col("start_pos"), width), (far, reach)), None, ["ord", "svtype", "start_pos", "end_pos", "length"], _fold_regular, few))


def translocation_clusters(events: DataFrame, delta: int = 50, few: bool | None = None) -> DataFrame:
    """ord, cluster_id of translocations; they arrive by the first record of their (start, end) chromosomes, then in order.

    Positions are compared as they stand even where the two chromosomes are swapped, unless the directions are reciprocal.
    """
    df = events.where(F.col("svtype") == "TRA").select("ord", "start_chrom", "end_chrom", "start_pos", "end_pos", bnd.orientation(F.col("alt")).alias("way"))
    firsts = df.groupBy("start_chrom", "end_chrom").agg(F.min("ord").alias("bucket"))
    df = df.join(firsts, ["start_chrom", "end_chrom"], "left")
    df = df.select(
        "ord", F.coalesce("bucket", "ord").alias("bucket"), "start_pos", "end_pos", "way", F.least("start_chrom", "end_chrom").alias("c1"), F.greatest("start_chrom", "end_chrom").alias("c2"),
        F.when(F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull(), F.least("start_pos", "end_pos")).alias("low"), F.greatest("start_pos", "end_pos").alias("high"), (F.col("start_chrom") <= F.col("end_chrom")).alias("straight"),
    )
    return _clustered(df, ["c1", "c2"], ["start_pos", "end_pos", "way", "straight", "low", "high"], ((F.col("low"), 2 * delta), (F.col("high"), 2 * delta)), "bucket", ["ord", "rank", "start_pos", "end_pos", "way"], _fold_tra(2 * delta), few)


def breakend_clusters(events: DataFrame, delta: int = 50, few: bool | None = None) -> DataFrame:
    """ord, cluster_id of breakends; they arrive by the first record of their chromosome, then in order. Unreadable ALT leads alone."""
    form, target, target_pos = bnd.parsed(F.col("alt"))
    df = events.where(F.col("svtype") == "BND").select("ord", "start_chrom", "start_pos", form.alias("form"), target.alias("target"), target_pos.alias("target_pos"))
    firsts = df.groupBy("start_chrom").agg(F.min("ord").alias("bucket"))
    df = df.join(firsts, "start_chrom", "left").withColumn("bucket", F.coalesce("bucket", "ord"))
    return _clustered(df, ["start_chrom", "target", "form"], ["start_pos", "target_pos"], ((F.col("start_pos"), delta), (F.col("target_pos"), delta)), "bucket", ["ord", "rank", "start_pos", "target_pos"], _fold_bnd(delta), few)


def clusters(events: DataFrame, tolerances: Tolerances = Tolerances(), few: bool | None = None) -> DataFrame:
    """ord, cluster_id (the leader's ord) of all events of the six types; few as of `greedy.with_islands`."""
    # one count for the three: a pair of chromosomes has the events of two at most
    if few is None:
        few = events.groupBy("svtype", "start_chrom").count().where(F.col("count") > greedy.CROWDED // 2).isEmpty()
    parts = (regular_clusters(events, few), translocation_clusters(events, tolerances.tra_delta, few), breakend_clusters(events, tolerances.bnd_delta, few))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def representatives(events: DataFrame, membership: DataFrame) -> DataFrame:
    """The best event of every cluster, with all its columns, cluster_id, score, sources (distinct, sorted) and n_members."""
    kept = [c for c in events.columns if c not in ("cluster_id", "score", "sources", "n_members")]
    return best_members(events, membership).join(events.select(*kept), "ord").select("cluster_id", *kept, "score", "sources", "n_members")


def best_members(events: DataFrame, membership: DataFrame) -> DataFrame:
    """cluster_id, ord of the best event, score, sources, n_members; events need ord, source_file, support_n, qual_n, caller.

    Best is the highest score, then support, then quality, then the first. Only the numbers that decide go through the
    aggregate, which keeps partial maxima; the wide columns are joined for the winners alone. The set of source files is
    bounded by the number of files.
    """
    score = fields.total_score(F.col("support_n"), F.col("qual_n"), F.col("caller"))
    rank = F.struct(score.alias("score"), F.coalesce("support_n", F.lit(0)).alias("s"), F.coalesce("qual_n", F.lit(50.0)).alias("q"), (-F.col("ord")).alias("o"))
    df = membership.join(events.select("ord", "source_file", rank.alias("_rank")), "ord")
    best = df.groupBy("cluster_id").agg(F.max("_rank").alias("_best"), F.array_sort(F.collect_set("source_file")).alias("sources"), F.count("*").alias("n_members"))
    return best.select("cluster_id", (-F.col("_best.o")).alias("ord"), F.col("_best.score").alias("score"), "sources", "n_members")


def output_order(merged: DataFrame) -> DataFrame:
    """Merged events with out_no: translocations, breakends, then the regular types by the first record of their chromosome."""
    kind = fields.by_type(F.col("svtype"), {"TRA": 0, "BND": 1, "INS": 2, "DEL": 3, "DUP": 4, "INV": 5}, 6)
    firsts = merged.groupBy("svtype", "start_chrom").agg(F.min("cluster_id").alias("_first"))
    df = merged.join(firsts.withColumn("_kind", kind), ["svtype", "start_chrom"], "left")
    return df.withColumn("out_key", F.struct("_kind", "_first", "cluster_id")).drop("_kind", "_first")


def member_samples(events: DataFrame, membership: DataFrame) -> DataFrame:
    """cluster_id + an ordinal and the sample of each member, in record order; one row per member, no collected group."""
    order = Window.partitionBy("cluster_id").orderBy("ord")
    df = membership.join(events, "ord").select("cluster_id", "ord", "source_file", "sample_name", "format_raw", "sample_raw")
    return df.withColumn("member_no", F.row_number().over(order))
