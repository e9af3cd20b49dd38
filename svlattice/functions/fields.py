"""Column expressions over the packed INFO, FORMAT and SAMPLE fields and over typed event columns.

All are built-in expressions; a field that is missing, empty or not of the wanted type gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of the two serialised records, in their order.
INFO_ORDER = ("SVTYPE", "END", "SVLEN", "CHR2", "SUPPORT", "SVMETHOD", "RTID", "AF", "STRAND", "RNAMES")
FORMAT_ORDER = ("GT", "AD", "LN", "ST", "QV", "TY", "ID", "SC", "REF", "ALT", "CO")
#: Other names of SUPPORT, the first present one counts.
SUPPORT_ALIASES = ("SUPP", "SUPPREAD", "WEIGHT", "RE")
#: Caller names, in the order in which they are looked for and by priority.
CALLERS = ("svim", "pbsv", "cutesv", "sniffles", "debreak", "manta", "delly", "svaba", "svdss")
#: Sample keys whose values may hold ':' themselves.
SWALLOWING = ("ALT", "CO", "REF")
CANONICAL_TYPES = ("INV", "INS", "DEL", "TRA", "DUP")


def settled(columns: dict[str, Column]) -> Column:
    """Columns computed once, in one row per row: filters on them stay above instead of being rewritten in terms of the raw fields."""
    return F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))


def info_text(raw: Column, key: str) -> Column:
    """The value of the last `key=value` item of an info field; null if absent or empty."""
    return F.nullif(F.regexp_extract(F.concat(F.lit(";"), raw), f"(?s)^.*;{key}=([^;]*)", 1), F.lit(""))


def info_number(raw: Column, key: str) -> Column:
    return info_text(raw, key).try_cast("bigint")


def info_has(raw: Column, key: str) -> Column:
    return F.concat(F.lit(";"), raw, F.lit(";")).rlike(f";{key}[=;]")


def strict_info_text(raw: Column, key: str) -> Column:
    """As info_text, of items with exactly one '='; other items have no value."""
    return F.nullif(F.regexp_extract(F.concat(F.lit(";"), raw, F.lit(";")), f"(?s)^.*;{key}=([^;=]*);", 1), F.lit(""))


def strand_text(raw: Column) -> Column:
    """STRAND whatever its case."""
    return F.nullif(F.regexp_extract(F.concat(F.lit(";"), raw, F.lit(";")), "(?si)^.*;strand=([^;=]*);", 1), F.lit(""))


def support_text(raw: Column) -> Column:
    """The first present alias of SUPPORT overrides SUPPORT itself."""
    return F.coalesce(*(strict_info_text(raw, k) for k in (*SUPPORT_ALIASES, "SUPPORT")))


def info_items_kept(raw: Column) -> Column:
    """(k, v) of every item in order, split at the first '='; v is null for flags."""
    return F.transform(
        F.split(raw, ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v"))
    )


def sample_text(sample: Column, fmt: Column, key: str) -> Column:
    """The sample's value at the place of a format key (':' between both), null where either lacks it."""
    return F.get(F.split(sample, ":", -1), (F.array_position(F.split(fmt, ":", -1), F.lit(key)) - 1).cast("int"))


def corrected_cells(sample: Column, fmt: Column) -> tuple[Column, Column]:
    """Keys and values of a corrected record's sample, two arrays for `cell`.

    The first key that may hold ':' itself takes the whole rest of the sample, and the keys after it have no value. Keys
    that the sample is too short for have none either.
    """
    keys, parts = F.split(fmt, ":", -1), F.split(sample, ":", -1)
    place = lambda k: F.nullif(F.array_position(keys, F.lit(k)), F.lit(0))
    at = F.least(*map(place, SWALLOWING)).cast("int")
    rest = F.array_join(F.slice(parts, at, F.greatest(F.size(parts), F.lit(1))), ":")
    swallowed = F.when(F.size(parts) >= at - 1, F.concat(F.slice(parts, F.lit(1), at - 1), F.array(rest)))
    return F.slice(keys, F.lit(1), F.coalesce(at, F.size(keys))), F.coalesce(F.when(at.isNotNull(), swallowed), parts)


def with_cells(records: DataFrame) -> DataFrame:
    """records + _keys, _values as of `corrected_cells`, in steps that keep every expression single."""
    df = records.withColumns({"_k": F.split("format_raw", ":", -1), "_v": F.split("sample_raw", ":", -1)})
    df = df.withColumn("_at", F.least(*(F.nullif(F.array_position("_k", F.lit(k)), F.lit(0)) for k in SWALLOWING)).cast("int"))
    taken = F.concat(F.slice("_v", F.lit(1), F.col("_at") - 1), F.array(F.array_join(F.slice("_v", F.col("_at"), F.greatest(F.size("_v"), F.lit(1))), ":")))
    values = F.when(F.col("_at").isNull() | (F.size("_v") < F.col("_at") - 1), F.col("_v")).otherwise(taken)
    return df.withColumns({"_keys": F.slice("_k", F.lit(1), F.coalesce("_at", F.size("_k"))), "_values": values}).drop("_k", "_v", "_at")


def cell(keys: Column, values: Column, key: Column) -> Column:
    """The value of the last of equal keys, null without one."""
    back = F.array_position(F.reverse(keys), key).cast("int")
    return F.when(back > 0, F.get(values, F.size(keys) - back))


def corrected_text(sample: Column, fmt: Column, key: str) -> Column:
    return cell(*corrected_cells(sample, fmt), F.lit(key))


DECIMAL = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"


def number(text: Column) -> Column:
    """A finite decimal number; a cast alone would also take names and suffixes."""
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def whole_number(text: Column) -> Column:
    """int(float(x)): truncated towards zero, null for text that is no number or beyond 64 bits."""
    return number(text).try_cast("bigint")


def natural_key(name: Column) -> Column:
    """A text by which names sort naturally: runs of digits are padded."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def event_length(svlen: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.abs(svlen.try_cast("bigint")), end - start + 1)


def by_type(svtype: Column, values: dict[str, float], default: float) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for name, value in values.items():
        out = out.when(svtype == name, F.lit(value))
    return out.otherwise(F.lit(default))


#: Base distances and length ratios of clustering.
DISTANCES = {"INS": 200.0, "DEL": 150.0, "DUP": 100.0, "INV": 100.0}
OTHER_DISTANCE = 50.0
RATIOS = {"INS": 3.0, "DEL": 2.0, "DUP": 1.5, "INV": 1.5}
OTHER_RATIO = 1.3


def distance_threshold(svtype: Column, least_length: Column) -> Column:
    factor = F.when(least_length >= 1000, 2.0).when(least_length >= 500, 1.5).otherwise(1.0)
    return by_type(svtype, DISTANCES, OTHER_DISTANCE) * factor


def ratio_threshold(svtype: Column) -> Column:
    return by_type(svtype, RATIOS, OTHER_RATIO)


def caller_name(source: Column) -> Column:
    """The first known caller whose name occurs in a source text, else the text itself; 'unknown' for null."""
    out = F.when(source.isNull(), "unknown")
    for c in CALLERS:
        out = out.when(F.contains(F.lower(source), F.lit(c)), c)
    return out.otherwise(source)


def caller_score(caller: Column) -> Column:
    """(10 - rank + 1) / 10 * 10 with rank 1 for the first of CALLERS and 10 for others."""
    out = F.when(F.lit(False), F.lit(0.0))
    for i, c in enumerate(CALLERS):
        out = out.when(caller == c, F.lit((10 - (i + 1) + 1) / 10 * 10))
    return out.otherwise(F.lit(1 / 10 * 10))


def total_score(support: Column, qual: Column, caller: Column) -> Column:
    """Half support (30 at most), three tenths quality (100 at most, 50 if unknown), two tenths caller, each out of 10."""
    by_support = F.least(F.coalesce(support.cast("double"), F.lit(0.0)) / 30, F.lit(1.0)) * 10
    by_qual = F.least(F.coalesce(qual, F.lit(50.0)) / 100, F.lit(1.0)) * 10
    return by_support * 0.5 + by_qual * 0.3 + caller_score(caller) * 0.2


#: The size bins, by their inclusive upper ends.
SIZE_BINS = {50: "0-50 bp", 100: "51-100 bp", 500: "101-500 bp", 1000: "501-1 kb", 10000: "1 kb-10 kb"}
LAST_SIZE_BIN = ">10 kb"


def size_bin(size: Column) -> Column:
    out = F.when(F.lit(False), "")
    for top, name in SIZE_BINS.items():
        out = out.when(size <= top, name)
    return out.otherwise(LAST_SIZE_BIN)


def strand_of_bed(strand: Column) -> Column:
    return F.when(strand.isin("+-", "-+"), "-").when(strand == "++", "+").when(strand.isin("+", "-"), strand).otherwise(".")


def strands_of_bedpe(svtype: Column, strand: Column) -> tuple[Column, Column]:
    pair = F.length(strand) == 2
    second = F.when(svtype.isin("INV", "TRA"), "-").otherwise("+")
    return F.when(pair, F.substring(strand, 1, 1)).otherwise("+"), F.when(pair, F.substring(strand, 2, 1)).otherwise(second)


def depth_sum(ad: Column) -> Column:
    """The sum of the digit tokens of an allele depth, 0 if there are none."""
    tokens = F.filter(F.split(ad, ","), lambda x: x.rlike(r"^[0-9]+\z"))
    return F.coalesce(F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")), F.lit(0).cast("bigint"))


def alt_or_type(alt: Column, svtype: Column) -> Column:
    return F.when(F.coalesce(alt, F.lit("")).isin("", "N", "."), F.concat(F.lit("<"), svtype, F.lit(">"))).otherwise(alt)


def event_sequence(info: Column, alt: Column) -> Column:
    return F.coalesce(info_text(info, "SVSEQ"), info_text(info, "SEQ"), F.when((F.length(alt) > 1) & ~alt.startswith("<"), alt))


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The smaller share of the two half-open spans that their overlap takes, 0 if there is none."""
    over = F.least(e1, e2) - F.greatest(s1, s2)
    share = F.least(over / F.nullif(e1 - s1, F.lit(0)), over / F.nullif(e2 - s2, F.lit(0)))
    return F.when(over > 0, F.coalesce(share, F.lit(0.0))).otherwise(0.0)


def short_name(name: Column, most: int = 30) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, 15), F.lit("..."), F.right(name, F.lit(10)))).otherwise(name)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")
