"""Shared small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and the five control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


_FROZEN = False


def give_back() -> None:
    """Return what a Python worker has freed to the system: it lives on for later tasks, and memory that
    it keeps adds to theirs. Data frames hold cycles, so these are collected; what was there at the first
    call (modules above all) is left out of later collections, which makes them cheap."""
    global _FROZEN
    gc.collect()
    if not _FROZEN:
        gc.freeze()
        _FROZEN = True
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: the smallest node reachable from each."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys in sorted arrays; runs of one row are left out."""
    n = len(keys[0])
    if n < 2:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.append(np.flatnonzero(new), n)
    size = np.diff(at)
    return [(int(s), int(s + c)) for s, c in zip(at[:-1], size) if c > 1]


def whole_runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches again, cut so that no run of equal keys lies in two frames. Only the
    run at hand is held back."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        k = rows[key].to_numpy()
        last = (k != k[-1]).any(axis=1)
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if held and (cut or (held[0][key].iloc[0].to_numpy() != k[0]).any()):
            if (held[0][key].iloc[0].to_numpy() == k[0]).all():
                end = int(np.flatnonzero((k != k[0]).any(axis=1))[0]) if (k != k[0]).any() else len(rows)
                held.append(rows.iloc[:end])
                rows, cut = rows.iloc[end:], cut - end
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if cut > 0:
            yield rows.iloc[:cut]
        if len(rows) > max(cut, 0):
            held.append(rows.iloc[max(cut, 0) :])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def squeeze(numbers: np.ndarray, press: zstandard.ZstdCompressor, rising: bool = False) -> bytes:
    """Whole numbers of at least 0 in as few byte planes as the largest needs, compressed; rising ones
    as their differences."""
    x = np.ascontiguousarray(numbers, "<u8")
    if rising and len(x):
        x = np.append(x[:1], np.diff(x))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + press.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unsqueeze(packed: bytes, unpress: zstandard.ZstdDecompressor, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(unpress.decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : packed[0]] = planes.T
    x = out.view("<u8").ravel()
    return np.cumsum(x, dtype="<u8") if rising else x


def table_first(tables: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows of pieces (segment, chunk, ...) after the row of their segment in tables (same columns, chunk
    null), all rows of a segment in one task and in that order: so a task holds one segment's table
    while the pieces pass by, however many there are."""
    named = tables.withColumn("chunk", F.lit(None).cast("long")).select(*[c if c in tables.columns or c == "chunk" else F.lit(None).cast(t).alias(c) for c, t in pieces.dtypes])
    return named.union(pieces).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("chunk"))
