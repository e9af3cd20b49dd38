"""Encoding of a whole corpus: a narrow stage of Arrow batches over the transducer of `bpe`.

Defined results: null, empty texts: an empty list of ids, 0 tokens. Whole texts are encoded, however long; strings that
look like control tokens are ordinary text. Rows with equal texts each get their ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svlattice.llm import bpe


def _shipped(df: DataFrame, vocabulary: str) -> Callable[[], bpe.Encoder]:
    """The encoder for use in workers. The driver reads the file; its bytes, of a fixed size of about a megabyte, go out with the job."""
    data = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    return lambda: bpe.encoder(vocabulary, lambda: data.value)


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """key, ids: the token ids of every text."""
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shipped().packed
        for batch in batches:
            lists = [packed(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) // bpe.ID_BYTES for x in lists], out=offsets[1:])
            flat = np.frombuffer(b"".join(lists), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """key, n_tokens: the number of tokens of every text; the ids aren't kept."""
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shipped().count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, "n_tokens"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_tokens long")


def decoded(df: DataFrame, key: str, ids: str, vocabulary: str) -> DataFrame:
    """key, text: the texts of lists of ids, by streaming decode; a null list gives null."""
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = bpe.Decoder(shipped().transducer.ranks).decode
        for batch in batches:
            texts = pa.array([None if x is None else decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, text string")
