"""SimHash near-duplicate documents, candidates by the pigeonring principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import give_back, local_roots, runs, whole_runs
from rollcall.operators.components import connected_components
from rollcall.session import saved

BITS = 64


def widths(segments: int) -> list[int]:
    """Bits of each segment, as even as possible, wider ones first."""
    return [BITS // segments + (i < BITS % segments) for i in range(segments)]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text; 0 where it has no words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *end[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts, (end[shingle - 1 :] - 1).tolist())), ">u8", len(starts))
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1)
    whole = n - n % 255
    counts = bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp as a signed long. A null text has no words."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fp = np.array([fingerprint(t, shingle) for t in rows[text_col]], np.uint64).view(np.int64)
            yield pd.DataFrame({id_col: rows[id_col].array, "fp": fp})
        give_back()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(each, f"`{id_col}` {kind}, fp long")


def _pairs(left: np.ndarray, right: np.ndarray | None, first: int, segments: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked fingerprints that agree in segment `first`: within left, or between
    left and right. Rows of one side are sorted by the next segment; the other side looks them up
    with at most one bit changed, the longest difference that a chain of two segments may have
    when distance < segments. Longer chains and the full distance are tested on what is left."""
    width = widths(segments)
    low = np.concatenate([np.cumsum(width[::-1])[::-1][1:], [0]]).astype(np.uint64)
    part = lambda x, i: (x >> low[i % segments]) & np.uint64((1 << width[i % segments]) - 1)
    base = left if right is None else right
    order = np.argsort(part(base, first + 1), kind="stable")
    keys, mine = part(base, first + 1)[order], part(left, first + 1)
    found = [np.zeros((2, 0), np.int64)]
    for flip in [0, *(1 << k for k in range(width[(first + 1) % segments]))]:
        at, to = (np.searchsorted(keys, mine ^ np.uint64(flip), side) for side in ("left", "right"))
        done = 0
        total = np.cumsum(to - at)
        while done < len(left):  # in pieces of bounded size
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 4_000_000)))
            count = (to - at)[done:upto]
            a = np.repeat(np.arange(done, upto), count)
            b = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[done:upto], count)]
            done = upto
            keep = a < b if right is None else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            diff, sum_ = left[a] ^ base[b], np.zeros(len(a), np.int64)
            ok = np.ones(len(a), bool)
            for length in range(segments):
                sum_ += np.bitwise_count(part(diff, first + length))
                ok &= sum_ * segments <= (length + 1) * distance
            found.append(np.stack([a[ok], b[ok]]))
    both = np.concatenate(found, axis=1)
    return both[0], both[1]


def fingerprint_links(fps: DataFrame, distance: int = 4, segments: int = 5, block_rows: int = 1024) -> DataFrame:
    """(src, dst) links whose components are those of all pairs of distinct fp (long) at most
    `distance` bits apart.

    Pigeonring: cut 64 bits into `segments` > distance parts on a ring. If two values differ in at
    most `distance` bits, some start exists from which every chain of l parts differs in at most
    l * distance / segments bits. So the first part is equal: it is the bucket. In the bucket the
    second is looked up, longer chains prune, then the full distance is tested.

    A bucket above block_rows (or four times the mean bucket, if more) is dealt out as pairs of
    blocks, so that one crowded value cannot fill a task, and nothing is left out. The bucket
    counts are at most segments * 2**13 rows, which bounds what is broadcast. Every task returns a
    spanning set of its links, never all pairs.
    """
    if not distance < segments:
        raise ValueError("needs more segments than bits of distance")
    width = widths(segments)
    low = [sum(width[i + 1 :]) for i in range(segments)]
    part = [F.shiftrightunsigned("fp", low[i]).bitwiseAND(F.lit((1 << width[i]) - 1)).cast("int") + F.lit(i << max(width)) for i in range(segments)]
    rows = fps.select("fp", F.explode(F.array(*part)).alias("bucket"))
    n = F.col("n")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    mean = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    block = F.least(F.lit(1 << 20), F.greatest(F.lit(block_rows), F.col("all") * 4 / (segments << max(width)))).cast("long")
    counts = counts.crossJoin(F.broadcast(mean)).select("bucket", F.ceil(n / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(F.broadcast(counts), "bucket")
        .select("fp", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("fp", "bucket", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .repartition("bucket", "lo", "hi")
        .sortWithinPartitions("bucket", "lo", "hi")
    )

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["bucket", "lo", "hi"]):
            fp, bucket, own, lo, hi = (rows[c].to_numpy() for c in ("fp", "bucket", "own", "lo", "hi"))
            fp = fp.view(np.uint64)
            for s, e in runs(bucket, lo, hi):
                first, values = int(bucket[s]) >> max(width), fp[s:e]
                if lo[s] == hi[s]:
                    a, b = _pairs(values, None, first, segments, distance)
                else:
                    mine = own[s:e] == lo[s]
                    x, y = np.flatnonzero(mine), np.flatnonzero(~mine)
                    a, b = _pairs(values[x], values[y], first, segments, distance)
                    a, b = x[a], y[b]
                if len(a):
                    root = local_roots(e - s, a, b)
                    moved = np.flatnonzero(root != np.arange(e - s))
                    yield pd.DataFrame({"src": values[moved].view(np.int64), "dst": values[root[moved]].view(np.int64)})
        give_back()

    return dealt.mapInPandas(links, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, segments: int = 5) -> DataFrame:
    """One row per document: id, fp (signed long), component (smallest id reachable by links of at
    most `distance` bits).

    Equal fingerprints are one node, so copies are never paired with each other. A null or empty
    text has fingerprint 0 and links like any other; a repeated row keeps its row; rows with a null
    id link others but get and give no id other than those that are not null (null where the
    component has none). A text of any length gives one fingerprint; a bit that exactly half of the
    shingles set is 0. Extra columns are not read. An empty table gives no rows.
    """
    each = saved(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = saved(each.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), distance, segments))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = saved(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = named.join(least, "root").select("fp", "component")
    return each.join(of_fp, "fp").select(id_col, "fp", "component")
