"""Vectors as short codes: product quantisation whose nearest entries are found by annular pruning.

A codebook's entries are sorted by norm. By the triangle inequality an entry can be as near as the best
one known only if its norm differs from the vector's by no more than that distance, so a binary search
gives the interval of entries that are left, and only this annulus is evaluated, its bounds included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import give_back
from rollcall.session import saved

#: Scaled components are held within this bound either way, so that a task's sums fit in a long.
LARGEST = 1 << 40
#: Entries beside a vector's own norm that are looked at first.
SEEDS = 8


def _exact(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as doubles where every sum below stays under 2**53, or else as Python's own."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        return x, entries
    whole = np.frompyfunc(int, 1, 1)
    return whole(x), whole(entries)


def nearest(x: np.ndarray, entries: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest entry (squared Euclidean distance, ties to the lower
    index) and that distance. Both hold whole numbers as doubles; distances are exact."""
    lengths, rings = np.sqrt((x * x).sum(1)), np.sqrt((entries * entries).sum(1))
    order = np.argsort(rings, kind="stable")
    rings = rings[order]
    x, entries = _exact(x, entries)
    entries = entries[order]
    squares, own = (entries * entries).sum(1), (x * x).sum(1)
    best = None
    at = np.searchsorted(rings, lengths)
    for step in range(-SEEDS // 2, SEEDS - SEEDS // 2):
        k = np.clip(at + step, 0, len(rings) - 1)
        far = ((x - entries[k]) ** 2).sum(1)
        best = far if best is None else np.minimum(best, far)
    reach = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (1 + lengths + reach)  # for the roots' rounding; the bounds belong to the annulus
    low, high = np.searchsorted(rings, lengths - reach - slack, "left"), np.searchsorted(rings, lengths + reach + slack, "right")
    index, distance = np.zeros(len(x), np.int64), np.array(best)
    by_length = np.argsort(lengths, kind="stable")
    for s in range(0, len(x), block):
        rows = by_length[s : s + block]
        a, b = int(low[rows].min()), int(high[rows].max())
        far = own[rows, None] - 2 * (x[rows] @ entries[a:b].T) + squares[a:b]
        ring = np.arange(a, b)
        far[(ring < low[rows, None]) | (ring >= high[rows, None])] = np.inf
        distance[rows] = far.min(1)
        index[rows] = np.where(far == distance[rows, None], order[a:b], len(order)).min(1)
    return index, distance


def usable(x: Column) -> Column:
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False))


def _parts(column: pa.Array, parts: int) -> list[np.ndarray]:
    """The consecutive parts of a batch's vectors, which have one length."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.split(x, parts, axis=1)


def _sums(vectors: DataFrame, books: list[np.ndarray], flush: int = 1 << 20) -> DataFrame:
    """(part, entry, n, sums): for each entry the number and componentwise sum of the parts that have
    it as their nearest; each task gives a row for each entry that it used."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        rows_in = 0

        def told() -> Iterator[pa.RecordBatch]:
            for p, (n, s) in enumerate(zip(counts, sums)):
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])
                n[:], s[:] = 0, 0

        for rows in batches:
            for p, x in enumerate(_parts(rows.column(0), len(books)) if len(rows) else []):
                index, _ = nearest(x, books[p])
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                counts[p][used] += np.diff(np.append(first, len(order)))
                sums[p][used] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            rows_in += len(rows)
            if rows_in >= flush:
                yield from told()
                rows_in = 0
        yield from told()
        give_back()

    return vectors.select("x").mapInArrow(each, "part int, entry int, n long, sums array<long>")


def _moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Each entry replaced by the floor of its parts' mean; unused ones stay. Sums of all tasks are added
    by Spark; a row for each entry comes to the driver."""
    width = books[0].shape[1]
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    added = sums.groupBy("part", "entry").agg(wide(F.col("n")).alias("n"), F.array(*[wide(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    out = [b.copy() for b in books]
    for part, entry, n, total in added.collect():
        out[part][entry] = [int(s) // int(n) for s in total]
    return out


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """id, label, code, error, label_error and codebooks_sha256, a row for each vector that is there and
    holds finite components only (zero vectors too).

    Components become floor(scale * x); vectors are cut into `parts` equal consecutive parts with a
    codebook each, which starts as the parts of the `entries` smallest ids. In each of `rounds` rounds
    every part goes to its nearest entry (squared Euclidean distance, ties to the lower index), and
    each entry becomes the componentwise floor of the mean of its parts; unused ones stay. Then parts
    are assigned for good. code is the entries' numbers in hex, two digits or as many as `entries`
    needs; error the sum of squared distances; label_error its sum over equal labels, nulls together;
    codebooks_sha256 that of all final components in order.

    All rows take part in each round: tasks return sums for each entry, so a round shuffles a row for
    each entry and task. The codebooks (`entries` vectors, so bounded by the parameters) come to the
    driver and go to the tasks.

    Rows of one id are ordered by their vectors; null ids come last; fewer vectors than entries make
    smaller codebooks. All codes are for one length: that of the smallest id whose length is a
    multiple of `parts`. Vectors of other lengths, empty ones too, have null code and error, and count in no
    sum. Scaled components beyond 2**40 either way are held at that bound. An error that no long can hold is
    null. Extra columns are not read, whatever their names; an empty table gives no rows.
    """
    read = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")).where(usable(F.col("v")))
    held = lambda v: F.greatest(F.least(F.floor(v.cast("double") * float(scale)).cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    whole = saved(read.select("id", "label", F.transform("v", held).alias("x")), "codes-vectors")
    fitting = whole.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    by_id = [F.asc_nulls_last("id"), F.asc("x")]
    first = fitting.orderBy(*by_id).select(F.size("x")).first()
    dim = first[0] if first else parts
    fitting = fitting.where(F.size("x") == dim)
    start = np.array([r[0] for r in fitting.orderBy(*by_id).limit(entries).select("x").collect()], np.float64).reshape(-1, dim)
    books = np.split(start, parts, axis=1)
    for _ in range(rounds if first else 0):
        books = _moved(books, _sums(fitting, books))
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()
    digits = max(2, len(f"{entries - 1:x}"))
    schema = T.StructType([T.StructField("id", whole.schema["id"].dataType), T.StructField("label", whole.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = len(rows)
            codes, errors = [None] * n, [None] * n
            good = np.flatnonzero(np.asarray(rows.column(2).value_lengths()) == dim) if first else []
            if len(good):
                found = [nearest(x, books[p]) for p, x in enumerate(_parts(rows.column(2).take(pa.array(good)), parts))]
                for k, row in enumerate(good.tolist()):
                    codes[row] = "".join(f"{int(index[k]):0{digits}x}" for index, _ in found)
                    total = sum(int(far[k]) for _, far in found)
                    errors[row] = total if total < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], schema.names)
        give_back()

    coded = saved(whole.mapInArrow(each, schema), "codes-coded")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total)
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return met.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
