"""Passages that repeat across documents, found through a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import give_back
from rollcall.session import forget, saved

#: Odd multipliers of the two rolling hashes and of the grams.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Words:
    """The words of some documents, one after another, and the hashes of their windows.

    A window is `window` consecutive words of one document. Its anchor is the smallest of the hashes
    of the `gram`-word runs in it, so equal windows have equal anchors, and neighbours mostly share
    theirs. Its key is a pair of independent hashes of its words, of 64 and 32 bits.
    """

    def __init__(self, texts: list[str | None], window: int, gram: int) -> None:
        number: dict[bytes, int] = {}
        self.words = [(t or "").encode().split() for t in texts]
        self.count = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.first = np.cumsum(self.count) - self.count
        total = int(self.count.sum())
        flat = np.fromiter((number.setdefault(w, len(number)) for doc in self.words for w in doc), np.int64, total)
        self._hash = [np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in number), np.uint64, len(number))[flat] if total else np.zeros(0, np.uint64) for seed in (1, 2)]
        left = np.repeat(self.first + self.count, self.count) - np.arange(total)
        self.at = np.flatnonzero(left >= window)  # where windows start
        self.doc = np.repeat(np.arange(len(texts)), self.count)[self.at]
        self.window, self.gram = window, gram

    @staticmethod
    def _rolled(hashes: np.ndarray, length: int, mix: np.uint64) -> np.ndarray:
        n = max(len(hashes) - length + 1, 0)
        out = np.zeros(n, np.uint64)
        for k in range(length):
            out = out * mix + hashes[k : k + n]
        out ^= out >> np.uint64(29)
        out *= MIX[0]
        return out ^ (out >> np.uint64(32))

    def anchors(self) -> np.ndarray:
        grams = self._rolled(self._hash[0], self.gram, MIX[2])
        span = self.window - self.gram + 1
        n = max(len(grams) - span + 1, 0)
        least = grams[:n].copy()
        for k in range(1, span):
            np.minimum(least, grams[k : k + n], out=least)
        return least[self.at].view(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        long, short = (self._rolled(h, self.window, m)[self.at].view(np.int64) for h, m in zip(self._hash, MIX))
        return long, short >> 32


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, call: int = 0) -> DataFrame:
    """(chunk, docs): documents in chunks of about chunk_bytes of text, compressed. Numbers of chunks
    differ between calls."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size, held = call << 48 | TaskContext.get().partitionId() << 24, 0, []

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for x in held:
                    out.write_batch(x)
            held.clear()
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for rows in batches:
            rows = pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1).cast(pa.large_string())], ["id", "text"])
            lengths = pa.compute.fill_null(pa.compute.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for k, n in enumerate(lengths.tolist(), 1):
                size += n
                if size >= chunk_bytes:
                    held.append(rows.slice(start, k - start))
                    yield flush()
                    start, size, chunk = k, 0, chunk + 1
            if start < len(lengths):
                held.append(rows.slice(start))
        if held:
            yield flush()
        give_back()

    import pyarrow.compute  # noqa: F401

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "chunk long, docs binary")


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Ids (0 where null), which are not null, and texts."""
    found = pa.ipc.open_stream(packed).read_all()
    ids = found.column("id").combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), found.column("text").to_pylist()


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints (anchor, chunk, many), newest last.

    A run is a table in the shared folder, dealt and sorted by anchor, so that a new batch meets it
    in a merge join without moving it. `many` marks anchors that several documents of the chunk
    have. When more than fan_in runs have gathered, they are compacted into one. Runs hold a row for
    each anchor and chunk: about a fifth as many as there are words, and few for a frequent passage.
    """

    def __init__(self, buckets: int, fan_in: int = 4, runs: list[DataFrame] | None = None) -> None:
        self.buckets, self.fan_in, self.runs = buckets, fan_in, list(runs or [])

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch as a run; gives the anchors (distinct) that it shares with an older run, or
        that several of its own documents have. Reads nothing but the index."""
        run = self._written(batch)
        own = run.groupBy("anchor").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 or many").select("anchor")
        met = [run.join(old.select("anchor").distinct(), "anchor", "left_semi").select("anchor").distinct() for old in self.runs]
        shared = own
        for x in met:
            shared = shared.union(x)
        shared = saved(shared.distinct(), "shared")
        self.runs.append(run)
        if len(self.runs) > self.fan_in:
            self.compact()
        return shared

    def compact(self) -> None:
        """All runs as one; the old ones are deleted when the new one is complete."""
        old, rows = self.runs, self.runs[0]
        for r in old[1:]:
            rows = rows.union(r)
        self.runs = [self._written(rows)]
        for r in old:
            forget(r)

    def chunks_with(self, anchors: DataFrame) -> DataFrame:
        """(chunk, anchor) of all runs for the given distinct anchors."""
        found = [r.join(anchors, "anchor", "left_semi").select("chunk", "anchor") for r in self.runs]
        out = found[0]
        for x in found[1:]:
            out = out.union(x)
        return out

    def crowded(self, over: int) -> DataFrame:
        """The anchors that more than `over` chunks of some run have."""
        found = [r.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > over).select("anchor") for r in self.runs]
        out = found[0]
        for x in found[1:]:
            out = out.union(x)
        return out.distinct()

    def _written(self, rows: DataFrame) -> DataFrame:
        dealt = rows.select("anchor", "chunk", "many").repartition(self.buckets, "anchor").sortWithinPartitions("anchor")
        return saved(dealt, "run", self.buckets, "anchor")


def fingerprints(chunks: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, chunk, many) of the windows of each chunk."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for chunk, packed in zip(rows.column("chunk").to_pylist(), rows.column("docs").to_pylist()):
                ids, valid, texts = _unpack(packed)
                w = Words([t if v else None for t, v in zip(texts, valid)], window, gram)
                anchor, doc = w.anchors(), w.doc
                if not len(anchor):
                    continue
                new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
                anchor, doc = anchor[new], doc[new]
                order = np.argsort(anchor, kind="stable")  # documents stay in order
                anchor, doc = anchor[order], doc[order]
                at = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                many = doc[at] != doc[np.append(at[1:], len(doc)) - 1]
                for s in range(0, len(at), 100_000):
                    part = anchor[at[s : s + 100_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), chunk)), pa.array(many[s : s + 100_000])], ["anchor", "chunk", "many"])
                del w, anchor, doc, order
        give_back()

    return chunks.mapInArrow(each, "anchor long, chunk long, many boolean")


def _least_by_key(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the number of its distinct key; first window of each; smallest id of each."""
    order = np.lexsort((ids, k2, k1))
    a, b = k1[order], k2[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new], ids[order[new]]


def candidates(anchors: DataFrame, chunks: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, k2, id, chunk, crowded): for each chunk the distinct windows that have a shared anchor (chunk,
    anchor, crowded), with the smallest id of the chunk's documents that have the window. Equal windows
    have equal anchors, so all are crowded or none."""

    def each(key: tuple, shared: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        out = {"k1": [], "k2": [], "id": [], "chunk": [], "crowded": []}
        if len(packed) and len(shared):
            ids, valid, texts = _unpack(packed["docs"].iloc[0])
            w = Words([t if v else None for t, v in zip(texts, valid)], window, gram)
            mine = w.anchors()
            some = np.isin(mine, shared["anchor"].to_numpy())
            full = np.isin(mine[some], shared["anchor"].to_numpy()[shared["crowded"].to_numpy(bool)])
            k1, k2 = (k[some] for k in w.keys())
            _, first, least = _least_by_key(k1, k2, ids[w.doc[some]])
            out = {"k1": k1[first], "k2": k2[first], "id": least, "chunk": np.full(len(least), packed["chunk"].iloc[0]), "crowded": full[first]}
            del w, mine, some
        give_back()
        return pd.DataFrame(out).astype({"k1": "int64", "k2": "int32", "id": "int64", "chunk": "int64", "crowded": "bool"})

    return anchors.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInPandas(each, "k1 long, k2 int, id long, chunk long, crowded boolean")


def _taken(seen: DataFrame, some_crowded: bool) -> DataFrame:
    """(chunk, k1, k2) of the candidates that a document with a smaller id has too. A window is in one row
    per chunk at most. Those that few chunks have meet in one sort; for crowded ones the least id is
    combined before the shuffle and joined back, which Spark can split."""
    few = seen if not some_crowded else seen.where("not crowded")
    out = few.withColumn("least", F.expr("min(id) over (partition by k1, k2)")).where("id > least").select("chunk", "k1", "k2")
    if not some_crowded:
        return out
    many = saved(seen.where("crowded"), "crowded")
    least = many.groupBy("k1", "k2").agg(F.min("id").alias("least"))
    return out.union(many.join(least, ["k1", "k2"]).where("id > least").select("chunk", "k1", "k2"))


def _results(taken: DataFrame, chunks: DataFrame, window: int, gram: int, id_col: str, with_text: bool) -> DataFrame:
    """One row per document, from the windows (chunk, k1, k2) that a document of another chunk with a
    smaller id has."""

    def each(key: tuple, gone: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {id_col: [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if with_text else {})
        if len(packed):
            ids, valid, texts = _unpack(packed["docs"].iloc[0])
            w = Words(texts, window, gram)
            real = valid[w.doc]
            k1, k2 = w.keys()
            k1, k2, own = k1[real], k2[real], ids[w.doc[real]]
            later = _elsewhere(k1, k2, gone["k1"].to_numpy(), gone["k2"].to_numpy())
            twice = np.flatnonzero(_repeated(k1))
            group, _, least = _least_by_key(k1[twice], k2[twice], own[twice])
            later[twice] |= own[twice] > least[group]
            repeated = w.at[real][later]
            edge = np.zeros(int(w.count.sum()) + 1, np.int64)
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + window, -1)
            removed = np.cumsum(edge[:-1]) > 0
            for k, words in enumerate(w.words):
                off = removed[w.first[k] : w.first[k] + w.count[k]]
                text = b" ".join([x for x, o in zip(words, off.tolist()) if not o] if off.any() else words)
                out[id_col].append(int(ids[k]) if valid[k] else None)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(off.sum()))
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out["kept"].append(text.decode())
            del w, k1, k2, edge, removed
        give_back()
        return pd.DataFrame(out | {id_col: pd.array(out[id_col], dtype="Int64")})

    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return taken.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInPandas(each, schema)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out[order[same]] = out[order[same + 1]] = True
    return out


def _elsewhere(k1: np.ndarray, k2: np.ndarray, known1: np.ndarray, known2: np.ndarray) -> np.ndarray:
    """Which pairs (k1, k2) are among the known ones. Both halves are compared as one number, which differs
    for pairs that differ in the second half alone, and the first halves by themselves."""
    if not len(known1):
        return np.zeros(len(k1), bool)
    both = lambda a, b: (a.view(np.uint64) * MIX[2] + b.astype(np.int64).view(np.uint64)).view(np.int64)
    out = np.isin(k1, known1)
    some = np.flatnonzero(out)
    out[some] = np.isin(both(k1[some], k2[some]), both(known1.astype(np.int64), known2))
    return out


class History(NamedTuple):
    """What earlier calls left: their packed documents and the runs of their index, as names of tables of
    the catalogue, so that later sessions find them."""

    chunks: tuple[str, ...] = ()
    runs: tuple[str, ...] = ()
    calls: int = 0


def _name(table: DataFrame) -> str:
    return table.inputFiles()[0].rsplit("/", 2)[1].replace("-", "_")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """remove_new_repeats without earlier documents."""
    return remove_new_repeats(docs, History(), id_col, text_col, **options)[0]


def remove_new_repeats(docs: DataFrame, history: History, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 4, batches: int = 3, fan_in: int = 4, chunk_bytes: int = 6 << 20, crowd: int = 1000, with_text: bool = False) -> tuple[DataFrame, History]:
    """One row per document: id (long), n_words, n_removed, kept_sha256 and, if asked for, kept; and the
    history with these documents added. Words covered by a window whose words also start in a document
    with a smaller id, of docs or of the history, are removed. What earlier calls gave is not changed.

    The documents are indexed in `batches`, each of which meets the runs of those before it, those of
    earlier calls first. What the index finds is verified: only windows with an anchor that several
    documents have are compared, by 96-bit keys, over all batches. Windows of one chunk of documents are
    combined before they are dealt out, so a passage that many documents share has a row for each chunk;
    anchors in more than `crowd` chunks of a run take a way of their own (see _taken). Chunks lie in
    buckets of their number and are not shuffled again, unless there is a history.

    Ids must be integers. A null text has no words; a null id is neither smaller nor larger than others:
    its row stays whole; rows of the same id do not remove each other's words; documents under `window`
    words stay whole; a text of any length is read whole, and one above chunk_bytes is a chunk by itself;
    extra columns are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    new = saved(pack_chunks(docs, id_col, text_col, chunk_bytes, history.calls), "chunks", buckets, "chunk")
    index = FingerprintIndex(buckets, fan_in, [spark.table(t) for t in history.runs])
    shared = None
    for b in range(batches):
        found = index.add(fingerprints(new.where(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == b), window, gram))
        shared = found if shared is None else shared.union(found)
    hits = index.chunks_with(shared.distinct())
    n_chunks = sum(t.count() for t in (new, *map(spark.table, history.chunks)))
    crowded = saved(index.crowded(crowd), "crowded-anchors") if n_chunks > crowd else None
    some_crowded = crowded is not None and not crowded.isEmpty()
    if some_crowded:
        hits = hits.join(crowded.withColumn("crowded", F.lit(True)), "anchor", "left").select("chunk", "anchor", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    else:
        hits = hits.withColumn("crowded", F.lit(False))
    chunks = new
    if history.chunks:  # read as plain files: tables of several calls have to be dealt anew to lie side by side
        folders = [f.rsplit("/", 1)[0] for t in history.chunks for f in spark.table(t).inputFiles()[:1]]
        chunks = spark.read.schema(new.schema).parquet(*folders).union(spark.read.schema(new.schema).parquet(new.inputFiles()[0].rsplit("/", 1)[0]) if new.inputFiles() else new.limit(0))
    taken = _taken(candidates(hits, chunks, window, gram), some_crowded)
    if history.chunks:
        taken = taken.where(F.shiftright("chunk", 48) == history.calls)
    out = _results(saved(taken, "taken"), new.select("chunk", "docs"), window, gram, id_col, with_text)
    names = [_name(t) for t in (new, *index.runs) if t.inputFiles()]
    kept = (names[0],) if new.inputFiles() else ()
    return out, History((*history.chunks, *kept), tuple(names[len(kept) :]), history.calls + 1)
