"""Raw caller lines split into loadable typed rows and refused lines with a reason and its byte offset.

Method: a quote-aware finite-state tokenizer. The automaton has the states plain and quoted; a quote mark swaps them and
a record's start resets to plain, so the effect of any run of bytes is one of four maps (keep, swap, to plain, to
quoted). The lines of an Arrow batch form one byte buffer that is cut into chunks of fixed size regardless of record
ends; each chunk's map is taken on its own, the maps compose to the state at which every chunk is entered, and tabs
count as separators where the state is plain. Columns are slices of the buffer; the checks on single columns are
built-in expressions after it. The stage is narrow: no shuffle but the join with the files' callers.

Defined results: null, empty and comment lines are no records. One final carriage return is dropped. Of several
failures the first in the order quote, columns, pos, qual, alt counts. Repeated lines are each reported. A record of 13 columns has four samples, of
which `samples` keeps all and `sample_raw` the last, as `sources.vcf` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 16
SAMPLES = ("sample_1", "sample_2", "sample_3", "sample_4")
NAMES = ("chrom", "pos_raw", "sv_id", "ref_seq", "alt", "qual_raw", "filter_raw", "info_raw", "format_raw", *SAMPLES)
N_READ = len(NAMES)  # as many as the widest loadable record has
KEPT = "line_id long, file_id long, line_no long"
TOKENS = KEPT + ", n_quotes int, quote_at int, n_columns int, end_at int, starts array<int>, " + ", ".join(f"{n} string" for n in NAMES)

#: Maps of the state: as (state at the end if entered plain, if entered quoted).
KEEP, SWAP, TO_PLAIN, TO_QUOTED = (0, 1), (1, 0), (0, 0), (1, 1)


def compose(first: tuple[int, int], then: tuple[int, int]) -> tuple[int, int]:
    return then[first[0]], then[first[1]]


def chunk_map(quotes: np.ndarray, resets: np.ndarray) -> tuple[int, int]:
    """The map of one chunk: its quote mark positions and the positions at which records start, both ascending."""
    if len(resets):
        return TO_QUOTED if (len(quotes) - np.searchsorted(quotes, resets[-1])) % 2 else TO_PLAIN
    return SWAP if len(quotes) % 2 else KEEP


def quoted_at(data: np.ndarray, starts: np.ndarray, chunk: int = CHUNK_BYTES) -> np.ndarray:
    """For each byte, whether the tokenizer is inside quotes after reading it."""
    n = len(data)
    state = np.zeros(n, dtype=bool)
    enter = KEEP  # of everything before the chunk
    for lo in range(0, n, chunk):
        part = data[lo : lo + chunk]
        mark = part == 34
        quotes = np.flatnonzero(mark)
        resets = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + len(part))] - lo
        counts = np.cumsum(mark)
        base = np.full(len(part), -enter[0], dtype=np.int64)  # a count that parity is taken against
        if len(resets):
            before = counts[resets] - mark[resets]
            which = np.searchsorted(resets, np.arange(len(part)), side="right")
            base = np.where(which > 0, before[np.maximum(which - 1, 0)], base)
        state[lo : lo + len(part)] = (counts - base) % 2 == 1
        enter = compose(enter, chunk_map(quotes, resets))
    return state


def slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A string array of the buffer's slices, null where not valid."""
    length = np.where(valid, end - begin, 0)
    offsets = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    index = np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])
    values = data[index].tobytes()
    mask = np.packbits(valid, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(length), [pa.py_buffer(mask), pa.py_buffer(offsets.tobytes()), pa.py_buffer(values)]).cast(pa.string())


def tokenize(batch: pa.RecordBatch) -> pa.RecordBatch:
    line = batch.column("line").cast(pa.large_string())
    offsets = np.frombuffer(line.buffers()[1], dtype=np.int64)[line.offset : line.offset + len(line) + 1]
    data = np.frombuffer(line.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    full = end > begin
    cr = np.zeros(len(begin), dtype=bool)
    cr[full] = data[end[full] - 1] == 13
    end = end - cr
    mark = np.concatenate(([0], np.cumsum(data == 34)))
    n_quotes = (mark[end] - mark[begin]).astype(np.int32)
    quote_pos = np.flatnonzero(data == 34)
    quote_at = np.where(n_quotes > 0, quote_pos[np.maximum(mark[end] - 1, 0)] - begin if len(quote_pos) else -1, -1).astype(np.int32)
    tabs = np.flatnonzero((data == 9) & ~quoted_at(data, begin[full]))
    first = np.searchsorted(tabs, begin)
    n_columns = np.searchsorted(tabs, end) - first + 1
    cols, starts = [], np.full((len(begin), N_READ), -1, dtype=np.int32)
    padded = np.concatenate((tabs, np.zeros(N_READ + 1, dtype=tabs.dtype)))
    for j in range(N_READ):
        valid = n_columns > j
        lo = begin if j == 0 else padded[first + j - 1] + 1
        hi = np.where(n_columns > j + 1, padded[first + j], end)
        cols.append(slices(data, lo, hi, valid))
        starts[:, j] = np.where(valid, lo - begin, -1)
    lists = pa.ListArray.from_arrays(np.arange(0, starts.size + 1, N_READ, dtype=np.int32), pa.array(starts.ravel()))
    kept = [batch.column(c) for c in ("line_id", "file_id", "line_no")]
    arrays = [*kept, pa.array(n_quotes), pa.array(quote_at), pa.array(n_columns.astype(np.int32)), pa.array((end - begin).astype(np.int32)), lists, *cols]
    return pa.RecordBatch.from_arrays(arrays, names=["line_id", "file_id", "line_no", "n_quotes", "quote_at", "n_columns", "end_at", "starts", *NAMES])


def _tokenize_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield tokenize(batch)


#: The record formats of the column checks.
BASES = "[ACGTNacgtn]+"
DECIMAL = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
ALT_FORMS = (
    BASES, r"\.", "<[A-Za-z0-9_:]+>", rf"{BASES}\.", rf"\.{BASES}",
    rf"{BASES}\[[^\[\]]+:[0-9]+\[", rf"{BASES}\][^\[\]]+:[0-9]+\]", rf"\[[^\[\]]+:[0-9]+\[{BASES}", rf"\][^\[\]]+:[0-9]+\]{BASES}",
)
N_COLUMNS, N_COLUMNS_WIDE, WIDE_CALLER = (8, 10), N_READ, "svaba"


def whole(column: Column, form: str) -> Column:
    return column.rlike(rf"^(?:{form})\z")


def position(raw: Column) -> Column:
    """1 to 2^63-1 in digits, else null."""
    value = raw.try_cast("bigint")
    return F.when(whole(raw, "[0-9]+") & (value > 0), value)


def judged_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row per record: the tokenizer's columns, reason (null if loadable) and reason_at, a byte offset in the line."""
    records = lines.select("line_id", "file_id", "line_no", "line").where(F.col("line").isNotNull() & ~F.regexp_replace("line", r"\r\z", "").rlike(r"\A(?:\z|#)"))
    tokens = records.mapInArrow(_tokenize_all, TOKENS)
    callers = files.select("file_id", (F.lower("caller") == WIDE_CALLER).alias("_wide")).where("_wide").distinct()
    tokens = tokens.join(callers, "file_id", "left")
    columns_ok = F.col("n_columns").isin(*N_COLUMNS) | ((F.col("n_columns") == N_COLUMNS_WIDE) & F.coalesce("_wide", F.lit(False)))
    alt_ok = whole(F.col("alt"), "|".join(ALT_FORMS))
    reason = (
        F.when(F.col("n_quotes") % 2 == 1, "quote").when(~columns_ok, "columns").when(position(F.col("pos_raw")).isNull(), "pos")
        .when(~whole(F.col("qual_raw"), rf"\.|{DECIMAL}"), "qual").when(~alt_ok, "alt")
    )
    at = lambda j: F.get("starts", F.lit(j))
    tokens = tokens.withColumn("reason", reason)
    place = F.when(F.col("reason") == "quote", F.col("quote_at")).when(F.col("reason") == "columns", F.col("end_at"))
    place = place.when(F.col("reason") == "pos", at(1)).when(F.col("reason") == "qual", at(5)).when(F.col("reason") == "alt", at(4))
    return tokens.withColumn("reason_at", place)


def refused(lines: DataFrame, files: DataFrame) -> DataFrame:
    return judged_lines(lines, files).where(F.col("reason").isNotNull()).select("line_id", "file_id", "line_no", "reason", "reason_at", "n_columns")


def loaded(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The loadable records, typed; qual '.' is null, and a record of 8 columns has null format and sample.

    samples holds all columns after the format, sample_raw the last of them.
    """
    rows = judged_lines(lines, files).where(F.col("reason").isNull())
    samples = F.when(F.col("sample_1").isNotNull(), F.filter(F.array(*SAMPLES), lambda x: x.isNotNull()))
    return rows.select(
        "line_id", "file_id", "line_no", "chrom", position(F.col("pos_raw")).alias("pos"), "sv_id", "ref_seq", "alt",
        F.col("qual_raw").try_cast("double").alias("qual"), "filter_raw", "info_raw", "format_raw",
        F.coalesce(*reversed(SAMPLES)).alias("sample_raw"), samples.alias("samples"),
    )
