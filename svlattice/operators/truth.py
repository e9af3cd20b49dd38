"""Call sets scored against a truth set: greedy one-to-one matching in record order, and its metrics.

Each call, in order, takes the first truth event that is still free and meets the criteria. Candidates are found in
islands (see `greedy`), never by pairing all calls with all truth events.

Defined results: events without a start, end or type match nothing; an empty side makes every event of the other
unmatched; metrics whose denominator is 0 are 0.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svlattice.functions import fields
from svlattice.operators.greedy import folded, with_islands


@dataclass(frozen=True)
class Criteria:
    distance: int = 500
    size_similarity: float = 0.7
    overlap: float = 0.0
    size_min: int = 50
    size_max: int = 50_000
    ignore_type: bool = False
    pass_only: bool = False
    same_chromosome: bool = False
    sequence_similarity: float | None = None


def eligible(events: DataFrame, criteria: Criteria) -> DataFrame:
    """Events of a size within the limits (translocations of any), with FILTER PASS only if so wanted."""
    size = F.abs(F.col("end_pos") - F.col("start_pos"))
    df = events.where((F.col("svtype") == "TRA") | size.between(criteria.size_min, criteria.size_max))
    return df.where(F.col("filter_raw") == "PASS") if criteria.pass_only else df


def _overlap(s1: int, e1: int, s2: int, e2: int) -> float:
    over = min(e1, e2) - max(s1, s2)
    return min(over / (e1 - s1), over / (e2 - s2)) if over > 0 and e1 != s1 and e2 != s2 else 0.0


def _fold(c: Criteria):
    def meets(truth: tuple, call: tuple) -> bool:
        kind, s1, e1, c1, d1, q1 = truth
        kind2, s2, e2, c2, d2, q2 = call
        if not c.ignore_type and kind != kind2 or abs(s1 - s2) > c.distance or abs(e1 - e2) > c.distance:
            return False
        if kind == "TRA":
            return c1 == c2 and d1 == d2
        if c.same_chromosome and c1 != c2:
            return False
        size1, size2 = abs(e1 - s1), abs(e2 - s2)
        if not size1 or not size2 or min(size1, size2) / max(size1, size2) < c.size_similarity:
            return False
        if c.sequence_similarity is not None and q1 and q2 and float(q1 == q2) < c.sequence_similarity:
            return False
        return kind2 == "TRA" or _overlap(s1, e1, s2, e2) >= c.overlap

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        """rows: (side, ord, type, start, end, chrom, end chrom, sequence, cell), truth (side 0) first, each in order.

        Free truth events lie in their cell, alike ones in one queue, so copies cost no more than one event.
        """
        free: dict[int, dict[tuple, deque]] = {}
        for side, ord_, *event, cell in rows:
            event = tuple(event)
            if side == 0:
                free.setdefault(cell, {}).setdefault(event, deque()).append(ord_)
                continue
            hits = [(queue[0], near, t) for near in (cell - 1, cell, cell + 1) for t, queue in free.get(near, {}).items() if meets(t, event)]
            if hits:
                truth_ord, near, t = min(hits, key=lambda h: h[0])
                free[near][t].popleft()
                if not free[near][t]:
                    del free[near][t]
                yield ord_, truth_ord

    return fold


def matches(truth: DataFrame, calls: DataFrame, criteria: Criteria = Criteria(), few: bool | None = None) -> DataFrame:
    """call_ord, truth_ord of the matched pairs; few as of `greedy.with_islands`."""
    both = []
    for side, df in ((0, truth), (1, calls)):
        df = eligible(df, criteria)
        sequence = fields.event_sequence(F.col("info_raw"), F.col("alt")) if criteria.sequence_similarity is not None else F.lit(None).cast("string")
        both.append(df.select(F.lit(side).alias("side"), "ord", "svtype", "start_pos", "end_pos", "start_chrom", "end_chrom", sequence.alias("seq")))
    df = both[0].unionByName(both[1]).dropna(subset=["svtype", "start_pos", "end_pos"])
    # translocations match on equal chromosomes only; other types unless told otherwise whatever their chromosomes
    ends = F.when(F.col("svtype") == "TRA", F.concat_ws("\t", "svtype", "start_chrom", "end_chrom")).otherwise(F.col("svtype"))
    df = df.withColumn("_type", F.lit("any") if criteria.ignore_type else ends)
    keys = ["_type", "start_chrom"] if criteria.same_chromosome else ["_type"]
    islands = with_islands(df, keys, *((F.col(c), max(1, criteria.distance)) for c in ("start_pos", "end_pos")), few=few)
    columns = ["side", "ord", "svtype", "start_pos", "end_pos", "start_chrom", "end_chrom", "seq", "_cell"]
    return folded(islands, keys, ["side", "ord"], columns, _fold(criteria), "call_ord long, truth_ord long")


def outcome(truth: DataFrame, calls: DataFrame, pairs: DataFrame, criteria: Criteria = Criteria()) -> dict[str, DataFrame]:
    """tp_base, tp_call, fp, fn: the eligible events of either side, matched or not, with out_no: matched truth events come in the order of their calls."""
    truth, calls = eligible(truth, criteria), eligible(calls, criteria)
    t, c = pairs.select(F.col("truth_ord").alias("ord"), F.col("call_ord").alias("out_no")), pairs.select(F.col("call_ord").alias("ord"))
    as_read = {"tp_call": calls.join(c, "ord", "left_semi"), "fp": calls.join(c, "ord", "left_anti"), "fn": truth.join(t, "ord", "left_anti")}
    return {"tp_base": truth.join(t, "ord")} | {name: df.withColumn("out_no", F.col("ord")) for name, df in as_read.items()}


def metrics(truth: DataFrame, calls: DataFrame, pairs: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    side = lambda df, name: eligible(df, criteria).agg(F.count("*").alias(name))
    df = pairs.agg(F.count("*").alias("tp")).crossJoin(side(calls, "n_calls")).crossJoin(side(truth, "n_truth"))  # three single rows
    df = df.select("tp", (F.col("n_calls") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    df = df.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
