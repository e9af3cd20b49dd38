"""Breakend records paired to events: exact same-chromosome pairs, mates, leftovers and same-direction pairs.

Same-chromosome pairs need mutual references at exact positions. All first halves fit all second halves of a place, so
the greedy order pairs the k-th with the k-th: two ranks and an equi-join, all in the JVM.

Mates, records without mates and same-direction pairs are three greedy passes in record order with a tolerance on both
coordinates. Their records interact only within an island of one chromosome pair, so one fold runs all three passes.

Defined results: records with an unreadable mate are in no result; repeated records pair one by one in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svlattice.operators.greedy import folded, with_islands

OPEN_RIGHT, CLOSED_RIGHT, OPEN_LEFT, CLOSED_LEFT = "t[p[", "t]p]", "[p[t", "]p]t"


def same_chromosome_pairs(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """kind (DEL, DUP, INV), first_ord, second_ord, base_ord, chrom, start_pos, end_pos: base is the event at the smaller position.

    by: columns, such as a file's id, whose values must agree within a pair.
    """
    df = events.where((F.col("route") == "same") & (F.col("mate_chrom") == F.col("chrom")) & F.col("bnd_form").isNotNull())
    low, high = F.least("pos", "mate_pos"), F.greatest("pos", "mate_pos")
    up, form = F.col("mate_pos") > F.col("pos"), F.col("bnd_form")
    down = F.col("mate_pos") < F.col("pos")
    kind = (
        F.when((form == OPEN_RIGHT) & up | (form == CLOSED_LEFT) & down, "DEL").when((form == OPEN_RIGHT) & down | (form == CLOSED_LEFT) & up, "DUP")
        .when(form.isin(CLOSED_RIGHT, OPEN_LEFT), F.concat(F.lit("INV"), form))
    )
    df = df.select("ord", *by, "chrom", low.alias("start_pos"), high.alias("end_pos"), kind.alias("kind"), F.when(F.col("pos") < F.col("mate_pos"), 0).when(down, 1).alias("side")).where("kind is not null")
    place = [*by, "chrom", "start_pos", "end_pos", "kind"]
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*place, "side").orderBy("ord")))
    # an inversion at one position has no sides: its records pair up in order
    df = df.select("ord", *place, F.coalesce("side", (F.col("_n") + 1) % 2).alias("side"), F.when(F.col("side").isNull(), F.floor((F.col("_n") + 1) / 2)).otherwise(F.col("_n")).alias("_k"))
    a = df.where("side = 0").select(*place, "_k", F.col("ord").alias("a"))
    b = df.where("side = 1").select(*place, "_k", F.col("ord").alias("b"))
    pairs = a.join(b, [*place, "_k"])
    first, second = F.least("a", "b"), F.greatest("a", "b")
    base = F.when(F.col("start_pos") == F.col("end_pos"), second).otherwise(F.col("a"))
    return pairs.select(F.substring("kind", 1, 3).alias("kind"), first.alias("first_ord"), second.alias("second_ord"), base.alias("base_ord"), "chrom", "start_pos", "end_pos")


def _near(held: dict, chrom: str, pos: int, chrom2: str, pos2: int, t: int) -> tuple | None:
    """The first held key in reach, by ascending offset of its first and then of its second position."""
    for i in range(-t, t + 1):
        for j in range(-t, t + 1):
            key = (chrom, pos + i, chrom2, pos2 + j)
            if key in held:
                return key
    return None


def _passes(t: int):
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        """rows: (ord, chrom, pos, mate_chrom, mate_pos) in order; result (role, first_ord, second_ord, rank, rank2)."""
        waiting: dict[tuple, int] = {}
        # leftovers have their own bookkeeping: equal records queue up instead of replacing each other, and a place
        # ranks by the record that opened its queue
        queues: dict[tuple, tuple[int, deque]] = {}
        for ord_, chrom, pos, chrom2, pos2 in rows:
            hit = _near(waiting, chrom2, pos2, chrom, pos, t)
            if hit is not None:
                yield "mate", waiting.pop(hit), ord_, ord_, 0
            else:
                waiting[chrom, pos, chrom2, pos2] = ord_
            hit = _near(queues, chrom2, pos2, chrom, pos, t)
            if hit is None:
                queues.setdefault((chrom, pos, chrom2, pos2), (ord_, deque()))[1].append(ord_)
            else:
                queues[hit][1].popleft()
                if not queues[hit][1]:
                    del queues[hit]
        left: dict[tuple, tuple[int, int]] = {}
        for (chrom, pos, chrom2, pos2), (begun, queue) in queues.items():
            for ord_ in queue:
                hit = _near(left, chrom, pos, chrom2, pos2, t)
                if hit is not None:
                    yield "special", left.pop(hit)[0], ord_, begun, ord_
                else:
                    left[chrom, pos, chrom2, pos2] = (ord_, begun)
        yield from (("single", ord_, ord_, begun, ord_) for ord_, begun in left.values())

    return fold


def breakend_passes(events: DataFrame, tolerance: int = 3, by: tuple[str, ...] = (), few: bool | None = None) -> DataFrame:
    """role (mate, special, single), first_ord, second_ord, rank, rank2 of the records with ends on two chromosomes.

    A record may be both in a mate pair and left over: the two passes keep equal records differently.
    """
    df = events.where(F.col("route") == "diff").dropna(subset=["chrom", "pos", "mate_chrom", "mate_pos"])
    df = df.select("ord", *by, "chrom", "pos", "mate_chrom", "mate_pos", F.least("chrom", "mate_chrom").alias("c1"), F.greatest("chrom", "mate_chrom").alias("c2"), F.least("pos", "mate_pos").alias("low"), F.greatest("pos", "mate_pos").alias("high"))
    keys = [*by, "c1", "c2"]
    islands = with_islands(df, keys, *((F.col(c), max(1, tolerance)) for c in ("low", "high")), few=few)
    return folded(islands, keys, ["ord"], ["ord", "chrom", "pos", "mate_chrom", "mate_pos"], _passes(tolerance), "role string, first_ord long, second_ord long, rank long, rank2 long")


#: What becomes of a pair by its two forms. R: both, linked to each other; I: both; M: the one of the
#: naturally smaller chromosome. A pair may have several outcomes or none.
MATE_RULES = {
    ("t[p[", "t[p["): "R", ("t]p]", "t]p]"): "I", ("[p[t", "[p[t"): "I", ("]p]t", "]p]t"): "R", ("t[p[", "t]p]"): "IM",
    ("[p[t", "t[p["): "I", ("]p]t", "t[p["): "M", ("[p[t", "t]p]"): "R", ("]p]t", "t]p]"): "I", ("[p[t", "]p]t"): "I",
}
SPECIAL_RULES = {
    ("t[p[", "t]p]"): "I", ("[p[t", "t[p["): "I", ("]p]t", "t[p["): "R", ("[p[t", "t]p]"): "R", ("]p]t", "t]p]"): "I", ("[p[t", "]p]t"): "I",
}


def rules(role: Column, form1: Column, form2: Column) -> Column:
    """The outcomes ('', 'R', 'I', 'M', 'IM') of a pair as a column."""
    out = F.when(F.lit(False), "")
    for name, table in (("mate", MATE_RULES), ("special", SPECIAL_RULES)):
        for (a, b), what in table.items():
            a, b = sorted((a, b))
            out = out.when((role == name) & (F.least(form1, form2) == a) & (F.greatest(form1, form2) == b) & form1.isNotNull() & form2.isNotNull(), what)
    return out.otherwise("")
