"""Problem 6: every document as ids of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from quire.llm.bpe import DEFAULT_TOKENIZER, Encoder

#: Texts encoded at a time in a worker; bounds what it holds beside the memos.
SLICE = 128
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its memos live as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _ENCODERS[path]


def _sent(df: DataFrame, path: str) -> DataFrame:
    """Send the vocabulary file to the executors, where it may not lie."""
    if os.path.isfile(path):
        df.sparkSession.sparkContext.addFile(path)
    return df


def _slices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    enc = encoder(path)
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield part.column(0), enc.encode(part.column(1).to_pylist())


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, ids array<int>) for every row, without special tokens.

    Null and empty texts give the empty list, blank texts the ids of their
    white space; strings that look like special tokens are ordinary text. A
    null key stays null, repeated rows are encoded each. Other columns, of
    whatever name, are not read. An empty frame gives an empty frame. Only
    (key, text) leave the scan and nothing is shuffled.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _slices(batches, path):
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, out])

    return _sent(df, path).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, `{out}` array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "n_tokens", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, n_tokens int): the length of the list that ``token_ids`` gives, without moving the ids."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _slices(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], type=pa.int32())], names=[key, out])

    return _sent(df, path).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, `{out}` int")
