"""Helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text for which arrays per character, or per text, are made at once.
PIECE_BYTES, SLICE_BYTES = 1 << 20, 4 << 20


def _trim():
    """The C library's call that returns freed memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, that gives freed memory back at its
    end: a Python worker waits for its next task beside the executor's JVM,
    while Arrow and the C library would keep what the last one used."""
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)
    return tidied


def keep_other_columns(df: DataFrame, *new: str) -> list[str]:
    """The columns of ``df`` that do not clash, in any case, with ``new``."""
    taken = {name.lower() for name in new}
    return [c for c in df.columns if c.lower() not in taken]


def column(df: DataFrame, name: str):
    """``name`` of ``df`` as a column, also if the name holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def append_columns(df: DataFrame, inputs: list[str], fields: list[StructField],
                   compute: Callable[[list[pa.Array]], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns ``fields``, which ``compute`` makes from the
    Arrow arrays of ``inputs``.  A column of the same name is replaced."""
    kept = keep_other_columns(df, *[f.name for f in fields])
    hidden = [f"__in{i}" for i in range(len(inputs))]
    frame = df.select(*[column(df, c) for c in kept],
                      *[column(df, c).alias(h) for c, h in zip(inputs, hidden)])
    schema = StructType([df.schema[c] for c in kept] + fields)
    names = [f.name for f in schema.fields]
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = batch.columns
                yield pa.RecordBatch.from_arrays(
                    arrays[:n_kept] + compute(arrays[n_kept:]), names=names)

    return frame.mapInArrow(tidy(run), schema)


def text_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null is an empty text."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a string array of about ``most`` bytes; a longer
    text is a slice of its own."""
    _, offsets = text_view(array)
    at = 0
    while at < len(array):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(array))
        yield array.slice(at, to - at)
        at = to


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def binary_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def doc_rank(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text each byte position lies in (int32), for ascending positions."""
    counts = np.diff(np.searchsorted(positions, offsets))
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), counts)


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
