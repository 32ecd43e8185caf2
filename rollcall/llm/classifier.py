"""Compression classifier: two zstandard dictionaries, one for each label."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import give_back

#: Bytes that are compressed at a time, so that a long text cannot outgrow what the dictionaries tell.
PIECE = 4096
LEVEL = 3


class Model(NamedTuple):
    """Dictionaries of both labels, and the weights of the logistic curve over what sizes tell."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that no fit may see: crc32 of the id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _sizes(good: bytes, bad: bytes, texts: list[str | None]) -> np.ndarray:
    """For each whole text, compressed piece by piece: the normalised difference (bad size - good
    size) / larger size; how far the smaller size falls below the text's (a text that repeats
    itself is as small with either dictionary); its square; and 1."""
    press = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False) for d in (good, bad)]
    out = np.tile([0.0, 0.0, 0.0, 1.0], (len(texts), 1))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        g, b = (sum(len(p.compress(raw[k : k + PIECE])) for k in range(0, len(raw), PIECE)) for p in press)
        if raw:
            fall = min(0.0, np.log(min(g, b) / len(raw)))
            out[i, :3] = (b - g) / max(g, b), fall, fall * fall
    return out


def _dictionary(texts: list[str], size: int) -> bytes:
    """A dictionary of at most size bytes from the pieces of texts; b"" if they are too few."""
    pieces = [raw[k : k + PIECE] for raw in (t.encode() for t in texts) for k in range(0, len(raw), PIECE)]
    if len(pieces) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, pieces)) // 8)), pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Newton's steps for P(y) = 1 / (1 + exp(-x w)), rows of y = 1 weighing `share` in all, with a
    small penalty on all weights but that of the last column, which is 1."""
    scale = np.where((d := x.std(axis=0)) > 0, d, 1.0)
    m, w = x / scale, np.zeros(x.shape[1])
    weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    small = np.array([1e-2] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (weigh * p * (1 - p))[:, None]) + np.diag(small), m.T @ (weigh * (y - p)) - small * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 2000, dictionary_bytes: int = 110_000, sample_bytes: int = 64 << 20) -> Model:
    """Fit on a bounded sample: of each label, the `sample` labelled ids with the smallest hash that
    are not held out, with one text each (the least, where rows share an id), up to sample_bytes in all;
    texts beyond that are left out whole. Half of each trains its dictionary, the other half calibrates the curve, which
    is weighted to the labels' shares in all labelled rows. Only ids, texts and labels are read.

    With no labels at all, or only one kind, the score is 0.5, or nearly the label's share.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, label_col)
    shares = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}
    ranked = [known.where(F.col(label_col) == k).dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(sample) for k in (0, 1)]
    chosen = ranked[0].union(ranked[1])
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col).groupBy(id_col, label_col).agg(F.min("_text").alias("_text"))
    gathered = F.sum(F.octet_length("_text")).over(Window.partitionBy(label_col).orderBy("_order", id_col))
    held = found.withColumn("_order", F.xxhash64(id_col, F.lit(1))).withColumn("_bytes", gathered).where(F.col("_bytes") <= sample_bytes)
    rows = held.select(label_col, "_text", "_order").orderBy("_order", "_text").collect()
    texts = {k: [r[1] for r in rows if r[0] == k] for k in (0, 1)}
    if not texts[0] or not texts[1]:
        share = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
        return Model(b"", b"", (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
    half = {k: (len(v) + 1) // 2 for k, v in texts.items()}
    good, bad = (_dictionary(texts[k][: half[k]], dictionary_bytes) for k in (1, 0))
    rest = {k: v[half[k] :] or v for k, v in texts.items()}
    x = np.concatenate([_sizes(good, bad, rest[k]) for k in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    return Model(good, bad, tuple(_logistic(x, y, shares[1] / (shares[0] + shares[1])).tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """id, score (0 to 1, higher: label 1 likelier) and the columns named in keep, one row per row.

    A null or empty text compresses to nothing either way and gets the curve's value for equal sizes; a long
    one is compressed whole, piece by piece. Null ids and repeated rows keep their rows; equal texts get
    equal scores; other columns are not read, whatever their names; an empty table gives no rows.
    """
    cols = list(dict.fromkeys([id_col, text_col, *keep]))
    out = [c for c in cols if c == id_col or c in keep]
    schema = docs.select(*out).schema.add(score_col, "double")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            z = _sizes(model.good, model.bad, rows[text_col].tolist()) @ np.array(model.weights)
            yield rows[out].assign(**{score_col: 1 / (1 + np.exp(-np.clip(z, -30, 30)))})
        give_back()

    return docs.select(*cols).mapInPandas(each, schema)
