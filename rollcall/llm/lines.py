"""Lines that many documents share, found by two Bloom filters.

A line's hash goes to the segment of its hash range, where a first filter takes hashes seen once and a
second those seen again. Lines that the second filter does not know occur in one document only and
never leave their chunk; only the text of suspected repeats is shuffled, counted exactly and judged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import give_back, squeeze, table_first, unsqueeze
from rollcall.session import saved

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of a filter for each hash of its segment, and how many of them a hash sets (in one word of 64).
BITS_A_HASH, SET_BITS = 16, 4


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line: A-Z in lower case, no white space at the ends."""
    return [x.strip(BLANK) for x in text.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least `least` code points."""
    if len(key) < least or len(key) >= 4 * least:
        return len(key) >= least
    return key.isascii() or len(key.decode("utf-8", "replace")) >= least


def _hashes(keys: set[bytes], least: int) -> dict[bytes, int]:
    return {k: xxhash.xxh3_64_intdigest(k) for k in keys if long_enough(k, least)}


def _blob(texts: list[bytes], press: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    return squeeze(np.fromiter(map(len, texts), np.int64, len(texts)), press), press.compress(b"".join(texts))


def _texts(sizes: bytes, blob: bytes, unpress: zstandard.ZstdDecompressor) -> list[bytes]:
    ends = np.cumsum(unsqueeze(sizes, unpress)).tolist()
    whole = unpress.decompress(blob)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _chunks(docs: DataFrame, id_col: str, text_col: str, least: int, chunk_bytes: int, segments: int) -> DataFrame:
    """Chunks of documents: one row with the texts (segment is null), and for each segment a row with
    the n hashes of lines that fall into it, once each, and whether two rows of the chunk have them."""
    kind = docs.schema[id_col].dataType
    fields = [("chunk", T.LongType()), ("segment", T.IntegerType()), ("n", T.LongType()), ("hashes", T.BinaryType()), ("again", T.BinaryType()), ("ids", T.ArrayType(kind)), ("sizes", T.BinaryType()), ("texts", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3)
        chunk, size, id_kind = TaskContext.get().partitionId() << 32, 0, pa.int64()
        ids: list = []
        texts: list[bytes] = []
        seen: dict[int, int] = {}

        def rows_of(rows: int, /, **columns: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(id_kind), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * rows), t) for (c, _), t in zip(fields, kinds)], [c for c, _ in fields])

        def flush() -> Iterator[pa.RecordBatch]:
            sizes, blob = _blob(texts, press)
            yield rows_of(1, chunk=[chunk], ids=[ids], sizes=[sizes], texts=[blob])
            values = np.fromiter(seen.keys(), "<u8", len(seen))
            again = np.fromiter(seen.values(), np.int64, len(seen)) > 1
            of = segment_of(values, segments)
            order = np.lexsort((values, of))
            at = np.append(0, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else np.empty(0, np.int64)
            if len(at):
                parts = np.split(order, at[1:])
                packed = [squeeze(values[x], press, rising=True) for x in parts]
                yield rows_of(len(at), chunk=[chunk] * len(at), segment=of[order[at]].tolist(), n=list(map(len, parts)), hashes=packed, again=[np.packbits(again[x]).tobytes() for x in parts])
            ids.clear(), texts.clear(), seen.clear()

        for rows in batches:
            id_kind = rows.column(0).type
            for doc, text in zip(rows.column(0), rows.column(1).cast(pa.binary())):
                raw = text.as_py() or b""
                ids.append(doc.as_py())
                texts.append(raw)
                size += len(raw) + 64
                for v in _hashes(set(keys_of(raw)), least).values():
                    seen[v] = seen.get(v, 0) + 1
                if size >= chunk_bytes:
                    yield from flush()
                    chunk, size = chunk + 1, 0
        if ids:
            yield from flush()
        give_back()

    return docs.select(id_col, text_col).mapInArrow(each, schema)


def segment_of(values: np.ndarray, segments: int) -> np.ndarray:
    return ((values >> np.uint64(24)) % np.uint64(segments)).astype(np.int64)


def _places(values: np.ndarray, segments: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter for each hash, and the bits of it that the hash sets: from other bits of the
    hash than its segment."""
    word = (values >> np.uint64(24)) // np.uint64(segments) % np.uint64(words)
    mask = np.zeros(len(values), np.uint64)
    for k in range(SET_BITS):
        mask |= np.uint64(1) << (values >> np.uint64(6 * k) & np.uint64(63))
    return word.astype(np.int64), mask


def _twice(pieces: DataFrame, segments: int, words: int) -> DataFrame:
    """(segment, filter): the second filter of each segment. Hashes that the first filter knows, or that a
    chunk has seen again by itself, go to the second; all go to the first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        current, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([press.compress(twice.tobytes())], pa.binary())], ["segment", "filter"])

        for rows in batches:
            for segment, packed, flags in zip(*(rows.column(c).to_pylist() for c in ("segment", "hashes", "again"))):
                if segment != current:
                    if current is not None:
                        yield done()
                    current, once, twice = segment, np.zeros(words, np.uint64), np.zeros(words, np.uint64)
                values = unsqueeze(packed, unpress, rising=True)
                at, mask = _places(values, segments, words)
                again = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(values)).astype(bool) | (once[at] & mask == mask)
                np.bitwise_or.at(twice, at[again], mask[again])
                np.bitwise_or.at(once, at, mask)
        if current is not None:
            yield done()
        give_back()

    return pieces.select("segment", "hashes", "again").repartition("segment").sortWithinPartitions("segment").mapInArrow(each, "segment int, filter binary")


def _suspects(pieces: DataFrame, filters: DataFrame, segments: int, words: int) -> DataFrame:
    """(chunk, suspects): the hashes of each chunk that the second filter of their segment knows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        twice = None
        for rows in batches:
            chunks, out = [], []
            for chunk, packed, table in zip(*(rows.column(c).to_pylist() for c in ("chunk", "hashes", "filter"))):
                if chunk is None:
                    twice = np.frombuffer(unpress.decompress(table), np.uint64)
                    continue
                values = unsqueeze(packed, unpress, rising=True)
                at, mask = _places(values, segments, words)
                known = values[twice[at] & mask == mask]
                if len(known):
                    chunks.append(chunk)
                    out.append(squeeze(known, press, rising=True))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], ["chunk", "suspects"])
        give_back()

    met = table_first(filters, pieces.select("segment", "chunk", "hashes", F.lit(None).cast("binary").alias("filter")))
    return met.mapInArrow(each, "chunk long, suspects binary")


def _sightings(texts: DataFrame, suspects: DataFrame, least: int, enough: int) -> DataFrame:
    """(chunk, key, ids): of each suspected key of a chunk the `enough` largest distinct ids that hold it.
    More are of no account: the sum of a key is at least `enough`, or all its ids are here."""
    kind = texts.schema["ids"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("ids", kind)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for rows in batches:
            for k in range(len(rows)):
                chunk, ids, sizes, blob, packed = (rows.column(c)[k].as_py() for c in ("chunk", "ids", "sizes", "texts", "suspects"))
                known = set(np.concatenate([unsqueeze(x, unpress, rising=True) for x in packed]).tolist())
                held: dict[bytes, set] = {}
                for doc, raw in zip(ids, _texts(sizes, blob, unpress)):
                    for key, v in _hashes(set(keys_of(raw)), least).items():
                        if v in known:
                            mine = held.setdefault(key, set())
                            mine.add(doc)
                            if len(mine) > enough:
                                mine.discard(None if None in mine else min(mine))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(held), pa.int64()), pa.array(list(held), pa.binary()), pa.array([list(x) for x in held.values()], rows.column("ids").type)], ["chunk", "key", "ids"])
        give_back()

    by_chunk = suspects.groupBy("chunk").agg(F.collect_list("suspects").alias("suspects"))
    return texts.join(by_chunk, "chunk").select("chunk", "ids", "sizes", "texts", "suspects").mapInArrow(each, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, enough: int = 3, chunk_bytes: int = 8 << 20, segments: int = 256, with_text: bool = False) -> DataFrame:
    """id, n_lines (before), n_dropped, kept_sha256 and, if asked for, kept (the text that stays).

    Texts are split at newlines. A line's key is the line without white space at its ends, A-Z in lower
    case. Keys of at least `least_chars` code points that at least `enough` documents hold lose all their
    lines but those of the largest id; other lines stay as they are.

    The documents are packed in chunks of about chunk_bytes, once. The hashes of their lines are dealt to
    `segments` segments (or the number of shuffle partitions, if more), where two Bloom filters sized by
    the number of hashes are built, and then asked: memory is that of one segment's filters, while
    the pieces pass by. A false alarm of a filter costs a line's way to the exact count and no more, and
    a repeat is never missed. A frequent line comes once from each chunk.

    Rows with one id are one document: their lines count once and share their fate. A null id is a
    document of its own, smaller than all others. A null text is empty, which is one empty line. A line
    that repeats within one document only stays. A text of any length is read whole, in a chunk by
    itself if it is long. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    segments = max(segments, buckets)
    parts = saved(_chunks(docs, id_col, text_col, least_chars, chunk_bytes, segments), "lines-chunks", buckets, "chunk")
    pieces, texts = parts.where("segment is not null"), parts.where("segment is null").select("chunk", "ids", "sizes", "texts")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    words = max(1, -(-total * BITS_A_HASH // (64 * segments)))
    filters = saved(_twice(pieces, segments, words), "lines-filters")
    suspects = _suspects(pieces, filters, segments, words)
    seen = saved(_sightings(texts, suspects, least_chars, enough), "lines-seen")
    holders = seen.select("key", F.explode("ids").alias("id")).distinct()
    repeats = holders.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= enough)
    verdicts = seen.select("chunk", "key").join(repeats.select("key", "last"), "key").groupBy("chunk").agg(F.collect_list(F.struct("key", "last")).alias("verdicts"))
    fields = [("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType())] + [("kept", T.StringType())] * with_text
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for rows in batches:
            for k in range(len(rows)):
                ids, sizes, blob, found = (rows.column(c)[k].as_py() for c in ("ids", "sizes", "texts", "verdicts"))
                last = {x["key"]: x["last"] for x in found or ()}
                out: dict[str, list] = {n: [] for n, _ in fields}
                for doc, raw in zip(ids, _texts(sizes, blob, unpress)):
                    lines = raw.split(b"\n")
                    kept = lines if not last else [x for x, key in zip(lines, keys_of(raw)) if key not in last or last[key] == doc]
                    whole = raw if len(kept) == len(lines) else b"\n".join(kept)
                    out["n_lines"].append(len(lines))
                    out["n_dropped"].append(len(lines) - len(kept))
                    out["kept_sha256"].append(hashlib.sha256(whole).hexdigest())
                    if with_text:
                        out["kept"].append(whole)
                kinds = [pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(out[n], t) for (n, _), t in zip(fields, kinds)]
                if with_text:
                    columns.append(pa.array(out["kept"], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column("ids")[k].values, *columns], schema.names)
        give_back()

    return texts.join(verdicts, "chunk", "left").select("ids", "sizes", "texts", "verdicts").mapInArrow(each, schema)
