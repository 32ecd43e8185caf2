"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import give_back, local_roots, runs, whole_runs
from rollcall.operators.components import connected_components
from rollcall.session import saved, shuffled


def usable(vec: str, label: str):
    """Label and vector are there, all components are finite, and not all are zero."""
    x = F.col(vec)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def pivot_count(n: int, least: int, most: int) -> int:
    """Four times the square root of the number of vectors, between bounds: lists then grow with the
    square root of the table, not with the table."""
    return max(least, min(most, math.isqrt(16 * n)))


#: Bytes that all pivots take together, at most: they come to the driver and go to each task.
PIVOT_BYTES = 64 << 20


def choose_pivots(classes: DataFrame, n_pivots: int, longest: int = 1, most_bytes: int = PIVOT_BYTES) -> dict[int, np.ndarray]:
    """Reference points: of the n_pivots vectors with the smallest hash the distinct ones, as unit rows
    by dimension; fewer, if vectors of `longest` components would take more than most_bytes. They
    come as Arrow arrays, never as Python's own numbers."""
    n_pivots = max(1, min(n_pivots, most_bytes // (8 * max(1, longest))))
    vectors = classes.orderBy(F.xxhash64("vec"), "class").limit(n_pivots).select(F.col("vec").cast("array<double>").alias("vec")).toArrow().column("vec").combine_chunks()
    lengths = np.asarray(vectors.value_lengths())
    return {int(d): _unit(np.unique(np.asarray(vectors.filter(pa.array(lengths == d)).flatten()).reshape(-1, d), axis=0)) for d in np.unique(lengths)}


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is scaled by its largest component first, so that no square underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(classes: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """(class, label, dim, prefix): the numbers of the nearest pivots, nearest first. Without pivots of
    its dimension a vector is described by pivot 0."""
    schema = "class long, label string, dim int, prefix array<int>"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            dims = np.array([len(v) for v in rows["vec"]], np.int32)
            for d in np.unique(dims):
                part = rows[dims == d]
                step = max(1, 4_000_000 // len(pivots.get(d, [0])))
                for k in range(0, len(part), step):
                    some = part.iloc[k : k + step]
                    near = np.zeros((len(some), 1), np.int32)
                    if d in pivots:
                        cosine = _unit(np.stack(some["vec"].to_numpy()).astype(np.float64)) @ pivots[d].T
                        near = np.argsort(-cosine, axis=1, kind="stable")[:, :prefix].astype(np.int32)
                    yield pd.DataFrame({"class": some["class"].array, "label": some["label"].array, "dim": d, "prefix": list(near)})

    return classes.select("class", F.col("label").cast("string").alias("label"), "vec").mapInPandas(each, schema)


KEY = ["label", "dim", "pivot", "lo", "hi"]


def _dealt(posts: DataFrame, block_rows: int) -> DataFrame:
    """Rows of posting lists (class, label, dim, pivot and others), each list dealt out as pairs of
    blocks of about block_rows, so that no list fills a task: each row comes once for each block."""
    counts = posts.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    met = posts.join(shuffled(counts), ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")
    return met.repartition(*KEY).sortWithinPartitions(*KEY)


def _agreeing(prefix: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (one of left, one of right) that share at least `shared` pivots, of which `pivot` is
    the first by number: so a pair counts in one list only."""
    names, at = np.unique(prefix, return_inverse=True)
    held = np.zeros((len(prefix), len(names)), np.float32)
    held[np.repeat(np.arange(len(prefix)), prefix.shape[1]), at.ravel()] = 1
    lower, rest = held[:, names < pivot], held[:, names >= pivot]
    good = rest[left] @ rest[right].T >= min(shared, prefix.shape[1])
    if lower.shape[1]:
        good &= lower[left] @ lower[right].T == 0
    return np.nonzero(good)


def _sides(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that meet each other: a block with itself, or one with another."""
    if lo == hi:
        return np.arange(len(own)), np.arange(len(own))
    return np.flatnonzero(own == lo), np.flatnonzero(own != lo)


def candidates(described: DataFrame, shared: int, block_rows: int) -> DataFrame:
    """(class, label, dim, pivot): the posts of classes that share enough pivots with another of the
    list. Only ids and pivot numbers are moved; a task gives each of its rows once at most, never pairs."""
    posts = described.select("class", "label", "dim", "prefix", F.explode("prefix").alias("pivot"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, KEY):
            prefix, own = rows["prefix"].to_numpy(), rows["own"].to_numpy()
            label, dim, pivot, lo, hi = (rows[c].to_numpy() for c in KEY)
            some = np.zeros(len(rows), bool)
            for s, e in runs(label, dim, pivot, lo, hi):
                left, right = _sides(own[s:e], lo[s], hi[s])
                a, b = _agreeing(np.stack(prefix[s:e]), pivot[s], left, right, shared)
                a, b = left[a], right[b]
                a, b = a[a != b], b[a != b]
                some[s + a] = some[s + b] = True
            yield rows.loc[some, ["class", "label", "dim", "pivot"]]
        give_back()

    return _dealt(posts, block_rows).select("class", *KEY, "own", "prefix").mapInPandas(each, "class long, label string, dim int, pivot int")


def class_links(posts: DataFrame, vectors: DataFrame, cosine: float, shared: int, block_rows: int) -> DataFrame:
    """(class, n_links, root): for each class and posting list in which it has links, the vectors linked
    and a spanning link. posts are candidates; vectors has class, copies, prefix and vec.

    Shared pivots are counted again among the candidates of a list, and the cosine is computed for
    the pairs that agree. A task returns a row for each of its classes at most, never pairs.
    """
    met = posts.distinct().join(shuffled(vectors.select("class", "copies", "prefix", "vec")), "class")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, KEY):
            ids, copies, own = rows["class"].to_numpy(), rows["copies"].to_numpy(), rows["own"].to_numpy()
            label, dim, pivot, lo, hi = (rows[c].to_numpy() for c in KEY)
            prefix, vec = rows["prefix"].to_numpy(), rows["vec"].to_numpy()
            for s, e in runs(label, dim, pivot, lo, hi):
                left, right = _sides(own[s:e], lo[s], hi[s])
                a, b = _agreeing(np.stack(prefix[s:e]), pivot[s], left, right, shared)
                a, b = left[a], right[b]
                if lo[s] == hi[s]:
                    a, b = a[a < b], b[a < b]
                x = _unit(np.stack(vec[s:e]).astype(np.float64))
                good = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 100_000]], x[b[k : k + 100_000]]) >= cosine for k in range(0, len(a), 100_000)] or [np.zeros(0, bool)])
                a, b = a[good], b[good]
                if len(a):
                    n = np.bincount(a, copies[s:e][b], e - s) + np.bincount(b, copies[s:e][a], e - s)
                    root, some = local_roots(e - s, a, b), np.flatnonzero(n)
                    yield pd.DataFrame({"class": ids[s:e][some], "n_links": n[some].astype(np.int64), "root": ids[s:e][root[some]]})
        give_back()

    return _dealt(met, block_rows).select("class", "copies", *KEY, "own", "prefix", "vec").mapInPandas(each, "class long, n_links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, prefix: int = 8, shared: int = 3, least_pivots: int = 128, most_pivots: int = 65_536, block_rows: int = 512) -> DataFrame:
    """One row per vector: id, n_links (other vectors with the same label and a cosine of at least
    `cosine`), component (smallest id reachable by links) and kept.

    Equal vectors of a label are one class with a count, so copies are never paired. Classes are
    indexed by pivot permutation (see describe): all are indexed, lists give those that share enough of
    their `prefix` nearest pivots (see candidates), and only for these are vectors fetched and verified
    in double precision (see class_links). Links are never false; one is missed where fewer than
    `shared` pivots agree. The pivots are a bounded sample (see pivot_count).

    Vectors that are null, zero or not finite, or have no label, link with nothing; vectors of other
    lengths neither. A null id is one of its own and gives no component. Repeated rows, and rows of one
    id with other vectors, count as vectors of their own; equal distances to pivots go by pivot number;
    extra columns are not read, whatever their names; an empty table gives no rows.
    """
    read = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    good = read.where(usable("vec", "label"))
    classes = saved(good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()), "vec-classes")
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    pivots = choose_pivots(classes, pivot_count(n, least_pivots, most_pivots), longest)
    described = saved(describe(classes, pivots, prefix), "vec-prefixes")
    posts = saved(candidates(described, shared, block_rows), "vec-candidates")
    found = saved(class_links(posts, classes.join(shuffled(described.select("class", "prefix")), "class"), cosine, shared, block_rows), "vec-links")
    counted = found.groupBy("class").agg(F.sum("n_links").alias("n"))
    parts = connected_components(found.select(F.col("class").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "class")
    named = classes.drop("vec").join(shuffled(parts), "class", "left").withColumn("root", F.coalesce("component", "class")).drop("component")
    least = saved(named.groupBy("root").agg(F.min("rep").alias("component")), "vec-components")  # so that the join on a large component can be split
    told = named.join(shuffled(least), "root").join(shuffled(counted), "class", "left").select("class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    of_class = classes.select("class", F.col("label").alias("_label"), F.col("vec").alias("_vec")).join(shuffled(told), "class")
    met = read.join(shuffled(of_class), (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left")
    component = F.coalesce("component", "id")
    return met.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
