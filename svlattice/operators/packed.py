"""Several values packed in one text field, one row per value with its place.

Method: quoted (and, in sample fields, bracketed) spans are replaced by indexed placeholders built from control
characters that were escaped beforehand, so no text can collide with them. The remaining delimiters then split with
plain `split`, `posexplode` numbers the pieces, and the spans come back by array lookup. Everything is a built-in
expression, so the plan is one narrow stage: scan, project, generate.

Defined results
* null field: no rows. Empty or blank info: no rows. Empty sample: item 1 with ''.
* unclosed quote: the mark is ordinary text. Text after a closing mark stays part of the value.
* repeated keys or rows: each occurrence has its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, HOLE, ESC = "\x01", "\x02", "\x03"
QUOTED = "\"[^\"]*+(?:\"\"[^\"]*+)*+\"|'[^']*+(?:''[^']*+)*+'"
BRACKETED = r"\[[^\[]*+\[|\][^\]]*+\]"
INFO_SPAN = rf"(?:(^|[;|\t])([^=;|\t]*+=\x20*)|(,\x20*))({QUOTED})"
FORMAT_SEPARATORS = (":", ";", "|")


def _list_span(separator: str, commas: bool, brackets: bool) -> str:
    start = "^" + (f"|[{separator}]" if separator else "") + ("|," if commas else "")
    return rf"({start})(\x20*)({QUOTED})" + (rf"|({BRACKETED})" if brackets else "")


def escape(raw: Column) -> Column:
    """Texts that hold one of the three control characters get them escaped; others pass untouched."""
    out = F.replace(raw, F.lit(ESC), F.lit(ESC + "0"))
    out = F.replace(F.replace(out, F.lit(SPAN), F.lit(ESC + "1")), F.lit(HOLE), F.lit(ESC + "2"))
    return F.when(raw.rlike(f"[{SPAN}{HOLE}{ESC}]"), out).otherwise(raw)


def unescape(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit(ESC + "2"), F.lit(HOLE)), F.lit(ESC + "1"), F.lit(SPAN))
    return F.when(F.contains(value, F.lit(ESC)), F.replace(out, F.lit(ESC + "0"), F.lit(ESC))).otherwise(value)


def mark(raw: Column, pattern: str, replacement: str, trigger: str) -> Column:
    """Pieces of the text, alternating plain and span, or null where the text can hold no span."""
    return F.when(raw.rlike(trigger), F.split(F.regexp_replace(raw, pattern, replacement), SPAN, -1))


def template(raw: Column, pieces: Column) -> Column:
    """The text with every span replaced by its placeholder."""
    held = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.concat(F.lit(HOLE), i.cast("string"), F.lit(HOLE)))), ""
    )
    return F.when(pieces.isNull(), raw).otherwise(held)


def _plain_span(span: Column) -> Column:
    """A span without its marks; bracketed spans keep theirs."""
    first = F.substring(span, 1, 1)
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    return F.when(first == '"', F.replace(inner, F.lit('""'), F.lit('"'))).when(first == "'", F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(span)


def restore(value: Column, pieces: Column) -> Column:
    """Placeholders back to their spans, by lookup in the array of pieces."""
    parts = F.split(value, HOLE, -1)
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(_plain_span(F.get(pieces, p.cast("int"))))), "")
    return unescape(F.when(F.contains(value, F.lit(HOLE)), whole).otherwise(value))


def info_items(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """keep + item_no, item_key, has_value (the item holds '='), val_no, val: one row per value of an info field."""
    text = escape(F.col(raw))
    df = df.where(F.col(raw).isNotNull()).select(*keep, text.alias("_t"), mark(text, INFO_SPAN, f"$1$2$3{SPAN}$4{SPAN}", "[\"']").alias("_p"))
    items = F.filter(F.transform(F.split(template(F.col("_t"), F.col("_p")), r"[;|\t]", -1), lambda x: F.trim(x)), lambda x: x != "")
    df = df.select(*keep, "_p", F.posexplode(items).alias("_i", "_item"))
    eq = F.instr(F.col("_item"), "=")
    rest = F.substring(F.col("_item"), eq + 1, F.length("_item"))
    values = F.filter(F.transform(F.split(rest, ",", -1), lambda x: F.trim(x)), lambda x: x != "")
    df = df.select(
        *keep, "_p", "_i", F.when(eq > 0, F.trim(F.substring(F.col("_item"), F.lit(1), eq - 1))).otherwise(F.col("_item")).alias("_k"), (eq > 0).alias("has_value"),
        F.when(eq == 0, F.array(F.lit(""))).when(~F.contains(rest, F.lit(",")), F.array(F.trim(rest))).otherwise(values).alias("_v"),
    )
    df = df.select(*keep, "_p", "_i", "_k", "has_value", F.posexplode(F.when(F.size("_v") == 0, F.array(F.lit(""))).otherwise(F.col("_v"))).alias("_n", "_v"))
    return df.select(
        *keep, (F.col("_i") + 1).cast("long").alias("item_no"), restore(F.col("_k"), F.col("_p")).alias("item_key"), "has_value",
        (F.col("_n") + 1).cast("long").alias("val_no"), restore(F.col("_v"), F.col("_p")).alias("val"),
    )


def format_parts(raw: Column) -> tuple[Column, Column, Column]:
    """Pieces, template and separator ('' for a single key) of a format field."""
    pieces = mark(raw, _list_span(":;|", False, False), f"$1$2{SPAN}$3{SPAN}", "[\"']")
    held = template(raw, pieces)
    return pieces, held, F.regexp_extract(held, "[:;|]", 0)


def _by_separator(separator: Column, make) -> Column:
    out = F.when(separator == FORMAT_SEPARATORS[0], make(FORMAT_SEPARATORS[0]))
    for s in FORMAT_SEPARATORS[1:]:
        out = out.when(separator == s, make(s))
    return out.otherwise(make(""))


def _cut(text: Column):
    return lambda s: F.split(text, f"[{s}]", -1) if s else F.array(text)


def format_items(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """keep + item_no, val: one row per key of a format field."""
    df = df.where(F.col(raw).isNotNull()).select(*keep, escape(F.col(raw)).alias("_t"))
    pieces, held, separator = format_parts(F.col("_t"))
    df = df.select(*keep, pieces.alias("_p"), held.alias("_h"), separator.alias("_s"))
    df = df.select(*keep, "_p", F.posexplode(_by_separator(F.col("_s"), _cut(F.col("_h")))).alias("_i", "_v"))
    return df.select(*keep, (F.col("_i") + 1).cast("long").alias("item_no"), restore(F.trim("_v"), F.col("_p")).alias("val"))


def sample_items(df: DataFrame, raw: str, format_raw: str, keep: list[str], keys: bool = False) -> DataFrame:
    """keep + item_no, val_no, val: one row per value of a sample field, split by the separator of its row's format.

    With keys, the rows follow the format's items instead: item_key is the key, and an item that the sample lacks
    gives one row with val null.
    """
    df = df.where(F.col(format_raw if keys else raw).isNotNull()).select(*keep, escape(F.col(raw)).alias("_t"), escape(F.col(format_raw)).alias("_f"))
    pieces, held, separator = format_parts(F.col("_f"))
    df = df.select(*keep, "_t", pieces.alias("_fp"), held.alias("_fh"), F.coalesce(separator, F.lit("")).alias("_s"))
    text = F.col("_t")
    spans = _by_separator(F.col("_s"), lambda s: mark(text, _list_span(s, True, True), f"$1$2{SPAN}$3$4{SPAN}", "[\"'\\[\\]]"))
    df = df.select(*keep, "_t", "_fp", "_fh", "_s", spans.alias("_p"))
    df = df.select(*keep, "_fp", "_fh", "_s", "_p", template(F.col("_t"), F.col("_p")).alias("_h"))
    cells = _by_separator(F.col("_s"), _cut(F.col("_h")))
    if keys:
        df = df.select(*keep, "_fp", "_p", cells.alias("_c"), F.posexplode(_by_separator(F.col("_s"), _cut(F.col("_fh")))).alias("_i", "_k"))
        df = df.select(*keep, "_fp", "_p", "_i", "_k", F.get(F.col("_c"), F.col("_i")).alias("_v"))
        extra = [restore(F.trim("_k"), F.col("_fp")).alias("item_key")]
    else:
        df = df.select(*keep, "_p", F.posexplode(cells).alias("_i", "_v"))
        extra = []
    names = [c for c in df.columns if c != "_v"]
    df = df.select(*names, F.posexplode_outer(F.split("_v", ",", -1)).alias("_n", "_v"))
    return df.select(
        *keep, (F.col("_i") + 1).cast("long").alias("item_no"), *extra, (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("val_no"),
        restore(F.trim("_v"), F.col("_p")).alias("val"),
    )


def info_pairs(df: DataFrame, raw: str, name: str) -> DataFrame:
    """df + an array of (key, val, vals) per row, null for null.

    vals are the single values as of `info_items`, none for a flag; val has them joined by ',', and 'true' for a flag.
    """
    keep = df.columns
    df = df.select(*keep, escape(F.col(raw)).alias("_t"))
    df = df.select(*keep, "_t", mark(F.col("_t"), INFO_SPAN, f"$1$2$3{SPAN}$4{SPAN}", "[\"']").alias("_p"))
    items = F.filter(F.transform(F.split(template(F.col("_t"), F.col("_p")), r"[;|\t]", -1), lambda x: F.trim(x)), lambda x: x != "")
    df = df.select(*keep, "_p", "_t", items.alias("_i"))
    none = F.array().cast("array<string>")

    def values(x: Column, given) -> Column:
        """Of an item (text, eq) its single values; given restores a trimmed one."""
        rest = F.substring(x["text"], x["eq"] + 1, F.length(x["text"]))
        listed = F.filter(F.transform(F.split(rest, ",", -1), lambda v: F.trim(v)), lambda v: v != "")
        listed = F.transform(F.when(F.size(listed) == 0, F.array(F.lit(""))).otherwise(listed), given)
        return F.when(x["eq"] == 0, none).when(~F.contains(x["text"], F.lit(",")), F.array(given(F.trim(rest)))).otherwise(listed)

    def pairs(given) -> Column:
        # in stages, as what a lambda uses twice is computed twice
        cut = F.transform("_i", lambda x: F.struct(x.alias("text"), F.instr(x, "=").alias("eq")))
        key = lambda x: given(F.when(x["eq"] > 0, F.trim(F.substring(x["text"], F.lit(1), x["eq"] - 1))).otherwise(x["text"]))
        held = F.transform(cut, lambda x: F.struct(key(x).alias("key"), (x["eq"] == 0).alias("flag"), values(x, given).alias("vals")))
        return F.transform(held, lambda x: F.struct(x["key"].alias("key"), F.when(x["flag"], "true").otherwise(F.array_join(x["vals"], ",")).alias("val"), x["vals"].alias("vals")))

    plain = F.col("_p").isNull() & ~F.contains("_t", F.lit(ESC))  # nothing to restore
    return df.select(*keep, F.when(plain, pairs(lambda v: v)).otherwise(pairs(lambda v: restore(v, F.col("_p")))).alias(name))


def sample_pairs(df: DataFrame, raw: str, format_raw: str, name: str) -> DataFrame:
    """df + an array of (key, val, vals) per row: format keys with their sample items ('' and no vals where the sample is shorter)."""
    keep = df.columns
    df = df.select(*keep, escape(F.coalesce(F.col(raw), F.lit(""))).alias("_t"), escape(F.col(format_raw)).alias("_f"))
    pieces, held, separator = format_parts(F.col("_f"))
    df = df.select(*keep, "_t", pieces.alias("_fq"), held.alias("_fh"), F.coalesce(separator, F.lit("")).alias("_s"))
    text = F.col("_t")
    spans = _by_separator(F.col("_s"), lambda s: mark(text, _list_span(s, True, True), f"$1$2{SPAN}$3$4{SPAN}", "[\"'\\[\\]]"))
    df = df.select(*keep, "_t", "_fq", "_fh", "_s", spans.alias("_p"))
    df = df.select(*keep, "_fq", "_fh", "_s", "_p", template(F.col("_t"), F.col("_p")).alias("_h"))
    df = df.select(*keep, "_fq", "_p", _by_separator(F.col("_s"), _cut(F.col("_h"))).alias("_c"), _by_separator(F.col("_s"), _cut(F.col("_fh"))).alias("_k"))
    pair = lambda k, i: F.struct(
        restore(F.trim(k), F.col("_fq")).alias("key"), restore(F.trim(F.coalesce(F.get(F.col("_c"), i), F.lit(""))), F.col("_p")).alias("val"),
        F.coalesce(F.transform(F.split(F.get(F.col("_c"), i), ",", -1), lambda v: restore(F.trim(v), F.col("_p"))), F.array().cast("array<string>")).alias("vals"),
    )
    return df.select(*keep, F.when(F.col(format_raw).isNotNull(), F.transform("_k", pair)).alias(name))


def packed_rows(caller: DataFrame, corrected: DataFrame) -> DataFrame:
    """ord, fld, item_no, item_key, val_no, val of the info and format of caller records and the sample of corrected ones."""
    info = info_items(caller, "info_raw", ["ord"]).select("ord", F.lit("info").alias("fld"), "item_no", "item_key", "val_no", "val")
    fmt = format_items(caller, "format_raw", ["ord"]).select("ord", F.lit("format").alias("fld"), "item_no", F.lit("").alias("item_key"), F.lit(1).cast("long").alias("val_no"), "val")
    sample = sample_items(corrected, "sample_raw", "format_raw", ["ord"]).select("ord", F.lit("sample").alias("fld"), "item_no", F.lit("").alias("item_key"), "val_no", "val")
    return info.unionByName(fmt).unionByName(sample)
