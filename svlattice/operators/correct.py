"""Caller records to corrected records: pairs resolved, fields normalised, rows serialised.

Branches in output order: same-chromosome breakends that stay, deletions, duplications and inversions of pairs, mates,
same-direction pairs, single translocations, all other records. Each branch is joins on `ord` and projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svlattice.functions import fields
from svlattice.operators import greedy, pairing
from svlattice.operators.events import caller_events
from svlattice.operators.filters import Limits, passing
from svlattice.session import cut_lineage

METHOD = "svlattice"
KEPT, PAIRED, MATES, SPECIAL, SINGLE, OTHER = range(6)


def shown(raw: Column, key: str) -> Column:
    """An INFO value as it is written out: '.' if absent, 'None' for an item without exactly one '='."""
    item = F.concat(F.lit(";"), raw, F.lit(";"))
    value = F.regexp_extract(item, f"(?s)^.*;{key}=([^;=]*);", 1)
    return F.when(item.rlike(f";{key}=[^;=]*;"), value).when(fields.info_has(raw, key), "None").otherwise(".")


def normalised(events: DataFrame) -> DataFrame:
    """Records other than breakends: type simplified, CHR2, SVLEN and an insertion's END set."""
    simple = F.substring_index("svtype", ":", 1)
    kind = F.when(simple.isin(*fields.CANONICAL_TYPES), simple).otherwise(F.col("svtype"))
    given = F.when(fields.info_has(F.col("info_raw"), "SVLEN"), shown(F.col("info_raw"), "SVLEN"))
    number = lambda text: F.coalesce(text.try_cast("bigint"), F.lit(0))
    end = number(F.col("end_text"))
    span = F.when((F.col("pos") != 0) & (end != 0), F.abs(end - F.col("pos")).cast("string")).otherwise(".")
    length = F.when(simple == "TRA", ".").otherwise(F.coalesce(given, F.when(simple.isin("DEL", "DUP", "INV"), span), F.lit(".")))
    inserted = number(given)
    ins_end = F.when((F.col("pos") != 0) & (inserted != 0), F.col("pos") + inserted).otherwise(F.col("pos")).cast("string")
    chr2 = F.when(fields.info_has(F.col("info_raw"), "CHR2"), shown(F.col("info_raw"), "CHR2")).otherwise(F.col("chrom"))
    return events.withColumns({"out_type": kind, "out_end": F.when(simple == "INS", ins_end).otherwise(shown(F.col("info_raw"), "END")), "out_len": length, "out_chr2": chr2})


def _as(events: DataFrame, kind: str) -> DataFrame:
    """Breakends written as `kind` with the mate's place."""
    return events.withColumns(
        {"out_type": F.lit(kind), "out_end": F.coalesce(F.col("mate_pos").cast("string"), F.lit(".")), "out_len": F.lit("."), "out_chr2": F.coalesce("mate_chrom", F.lit("."))}
    )


def corrected(records: DataFrame, tolerance: int = 3, limits: Limits = Limits(), by: tuple[str, ...] = ()) -> DataFrame:
    """Typed corrected records: the caller columns with out_type, out_end, out_len, out_chr2, out_rtid, out_alt and the order (branch, rank, rank2, rank3).

    by: columns that tell files apart; records pair only within them, so a table of many files is corrected at once.
    """
    # breakends are few; a plain text test keeps their branches from parsing all other records
    # and they are written once, as every branch reads them
    events = passing(caller_events(records.where(F.contains("info_raw", F.lit("SVTYPE=BND")))), limits)
    events = cut_lineage(events.where(F.col("route") != "other"))
    zero = F.lit(0).cast("long")
    parts = []

    pairs = pairing.same_chromosome_pairs(events, by)
    used = pairs.select(F.explode(F.array("first_ord", "second_ord")).alias("ord"))
    same = events.where(F.col("route") == "same")
    stay = _as(same.join(used, "ord", "left_anti"), "BND").withColumns({"branch": F.lit(KEPT), "rank": F.col("ord"), "rank2": zero, "rank3": zero})
    parts.append(stay)
    place = {"DEL": 0, "DUP": 1, "INV": 2}
    made = same.join(pairs.select(F.col("base_ord").alias("ord"), "kind", "first_ord", "start_pos", "end_pos"), "ord")
    made = made.withColumns(
        {
            "out_type": F.col("kind"), "out_end": F.col("end_pos").cast("string"), "out_len": F.abs(F.col("end_pos") - F.col("start_pos")).cast("string"), "out_chr2": F.col("chrom"),
            "out_alt": F.concat(F.lit("<"), F.col("kind"), F.lit(">")), "branch": F.lit(PAIRED), "rank": fields.by_type(F.col("kind"), place, 3).cast("long"), "rank2": F.col("first_ord"), "rank3": zero,
        }
    ).drop("kind", "first_ord", "start_pos", "end_pos")
    parts.append(made)

    roles = pairing.breakend_passes(events, tolerance, by, few=events.count() <= greedy.CROWDED or None)
    diff = events.where(F.col("route") == "diff")
    side = lambda p: diff.select(F.col("ord").alias(f"{p}_ord"), F.col("sv_id").alias(f"_{p}_id"), F.col("bnd_form").alias(f"_{p}_form"), F.col("chrom").alias(f"_{p}_chrom"))
    paired = roles.where("role <> 'single'").join(side("first"), "first_ord").join(side("second"), "second_ord")
    paired = paired.withColumn("_rule", pairing.rules(F.col("role"), F.col("_first_form"), F.col("_second_form"))).where("_rule <> ''")
    smaller = fields.natural_key(F.col("_first_chrom")) <= fields.natural_key(F.col("_second_chrom"))
    row = lambda no, o, rtid: F.struct(F.lit(no).cast("long").alias("no"), o.alias("ord"), rtid.alias("rtid"))
    none, first, second = F.lit(None).cast("string"), F.col("first_ord"), F.col("second_ord")
    both = [row(0, first, none), row(1, second, none)]
    linked = [row(0, first, F.col("_second_id")), row(1, second, F.col("_first_id"))]
    one = row(2, F.when(smaller, first).otherwise(second), none)
    rows = F.when(F.col("_rule") == "R", F.array(*linked)).when(F.col("_rule") == "I", F.array(*both)).when(F.col("_rule") == "M", F.array(one)).otherwise(F.array(*both, one))
    rows = paired.select("role", "rank", "rank2", F.explode(rows).alias("_r")).select(
        F.when(F.col("role") == "mate", MATES).otherwise(SPECIAL).alias("branch"), "rank", "rank2", F.col("_r.no").alias("rank3"), "_r.ord", F.col("_r.rtid").alias("out_rtid")
    )
    single = roles.where("role = 'single'").select(F.lit(SINGLE).alias("branch"), "rank", "rank2", zero.alias("rank3"), F.col("first_ord").alias("ord"), none.alias("out_rtid"))
    parts.append(_as(diff, "TRA").join(rows.unionByName(single), "ord"))

    parts.append(normalised(passing(caller_events(records), limits).where(F.col("route") == "other")).withColumns({"branch": F.lit(OTHER), "rank": F.col("ord"), "rank2": zero, "rank3": zero}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    raw = F.col("info_raw")
    return out.withColumns({"out_rtid": F.coalesce("out_rtid", shown(raw, "RTID")), "out_alt": F.coalesce("out_alt", "alt")})


def dropped(records: DataFrame) -> DataFrame:
    """The breakends that no branch can take, as their ALT has no readable mate."""
    return caller_events(records).where((F.col("route") == "diff") & (F.col("mate_chrom").isNull() | F.col("mate_pos").isNull()))


def sample_string(source: Column) -> Column:
    """The sample field of a corrected record; fields joined by ':'."""
    fmt, sample = F.col("format_raw"), F.col("sample_raw")
    text = lambda k: fields.sample_text(sample, fmt, k)
    ad = F.coalesce(text("AD"), F.concat_ws(",", F.when(text("DR").isNotNull() & text("DV").isNotNull(), text("DR")), F.when(text("DR").isNotNull() & text("DV").isNotNull(), text("DV"))))
    ad = F.when(F.coalesce(ad, F.lit("")) == "", ".,.").otherwise(ad)
    length = F.col("out_len").try_cast("bigint")
    digits = F.col("out_len").rlike(r"^[0-9]+\z")
    end = F.when((F.col("out_type") == "INS") & digits, (F.col("pos_out") + length).cast("string")).otherwise(F.col("out_end"))
    co = F.when((F.col("out_chr2") != ".") & (end != "."), F.concat(F.col("chrom"), F.lit("_"), F.col("pos_out"), F.lit("-"), F.col("out_chr2"), F.lit("_"), end)).otherwise(".")
    parts = [F.coalesce(text("GT"), F.lit(".")), ad, F.coalesce(F.abs(length).cast("string"), F.lit(".")), F.coalesce(F.col("strand"), F.lit(".")), F.col("qual"), F.col("out_type"), F.col("sv_id"), source, F.col("ref_seq"), F.col("alt"), co]
    return F.concat_ws(":", *(F.coalesce(p, F.lit(".")) for p in parts))


def serialised(rows: DataFrame, source: Column, method: str = METHOD) -> DataFrame:
    """rows + line: the tab-separated corrected record. A pair's record starts at the base event, which is the smaller position."""
    raw = F.col("info_raw")
    pair = F.split(fields.sample_text(F.col("sample_raw"), F.col("format_raw"), "PR"), ",", -1)
    support = F.coalesce("support_text", F.when(fields.info_has(raw, "SUPPORT"), shown(raw, "SUPPORT")), F.when(F.col("format_raw") != "GT", F.get(pair, F.lit(1))), F.lit("."))
    length = F.coalesce(F.abs(F.col("out_len").try_cast("bigint")).cast("string"), F.col("out_len"))
    values = {
        "SVTYPE": F.col("out_type"), "END": F.col("out_end"), "SVLEN": length, "CHR2": F.col("out_chr2"), "SUPPORT": support, "SVMETHOD": F.lit(method), "RTID": F.col("out_rtid"),
        "AF": shown(raw, "AF"), "STRAND": F.coalesce("strand", F.lit(".")), "RNAMES": F.col("rnames"),
    }
    info = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), values[k]) for k in fields.INFO_ORDER))
    df = rows.withColumn("pos_out", F.col("pos"))
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "pos_out", "sv_id", "ref_seq", "out_alt", "qual", "filter_raw")), info, F.lit(":".join(fields.FORMAT_ORDER)), sample_string(source))
    return df.withColumn("line", line)
