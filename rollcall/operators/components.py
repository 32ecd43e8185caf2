"""Connected components of an edge list (alternating large-star and small-star steps)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import forget, saved, shuffled

#: Edges, and bytes of them, that a task thins out at a time.
CHUNK, CHUNK_BYTES = 1_000_000, 256_000_000


def _stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes one of its component, the same for all of that, by edges between u and v."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, root[root]):
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return root


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that hold the same nodes together as those given: for each chunk, one from each node to
    one of its component in the chunk. So there are fewer than nodes, however many edges come."""

    def thin(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(kept)
        ends = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks().dictionary_encode()
        codes, nodes = ends.indices.to_numpy(), ends.dictionary
        root = _stars(codes[: len(t)], codes[len(t) :], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch([nodes.take(pa.array(own)), nodes.take(pa.array(root[own]))], ["u", "v"])

    kept, n, size = [], 0, 0
    for b in batches:
        kept.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= CHUNK or size >= CHUNK_BYTES:
            yield thin(kept)
            kept, n, size = [], 0, 0
    if n:
        yield thin(kept)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node
    reachable. Null ends and loops are ignored; an empty edge list gives no rows.

    Each task first thins out the edges that it reads, so that the rounds carry nodes rather than edges.
    Each round rewires every edge towards the smallest neighbour, so a component becomes a star
    after a number of rounds that grows with the logarithm of its size; rounds end when all are stars.
    Minima are combined before the shuffle, and the joins can be split where one node has many edges.
    Only whether a node is left to rewire comes to the driver.
    """
    a, b = F.col(src), F.col(dst)
    ends = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v"))
    now = saved(ends.mapInArrow(_thinned, ends.schema).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _all_stars(now):
            break
        after = saved(_small_star(_large_star(now)), "edges")
        forget(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node but the smallest of its component has one edge, to that one. All edges lead from
    a greater node (u) to a smaller one (v), so it is enough that none leads twice, or leads and is led to."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("led")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("led").alias("led")).where("out > 1 or (out > 0 and led > 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
    return both.where("y > x").join(shuffled(least), "x").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(shuffled(least), "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(least.select("u", F.col("low").alias("v"))).distinct()
