"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import checkpoint_root


def documents(frame: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that no further column of the input can clash with an output."""
    return frame.select(*[F.col(f"`{c}`") for c in columns])


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, empty for null, without decoding."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, text: int | None = None, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of a batch does not add up in memory: of so many rows at most and, if the
    place of a text column is given, of one text or so many bytes of texts."""
    for batch in batches:
        lengths = np.zeros(batch.num_rows) if text is None else pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, ends[start] - lengths[start] + size, side="right"))
            stop = min(start + rows, max(start + 1, full))
            yield batch.slice(start, stop - start)
            start = stop


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row, by running minima from both ends of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


_RESIDENT: dict = {}


def resident(model: object, name: str = "", make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps of a model between its tasks: `make()`, made once. Workers live on from operator to operator, so
    all that belongs to another model goes first; without `make`, nothing is kept."""
    if _RESIDENT.get("model") != model:
        _RESIDENT.clear()
        gc.collect()
        _give_back()
        _RESIDENT["model"] = model
    if make is not None and name not in _RESIDENT:
        _RESIDENT[name] = make()
    return _RESIDENT.get(name)


def _give_back() -> None:
    """Memory that was freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet below spark.checkpoint.dir and read back.

    Cuts the lineage at data every executor can reach, so that what follows neither repeats the work nor loses it with an
    executor. Unlike checkpoint() the rows stay columnar and compressed.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
