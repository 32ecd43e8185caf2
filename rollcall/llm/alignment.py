"""Two tokenizers side by side: which tokens of one overlap which of the other, and how often.

The documents of a batch are laid end to end. One count of A's token ends and one of B's over all byte
offsets show where both cut; running sums of these, taken at the bounds of the documents, give each
document's own numbers.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import give_back, squeeze, table_first, unsqueeze
from rollcall.session import saved


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: how byte-level BPE cuts a text before it merges.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


LONG_BLANK = re.compile(r"\s{1000}")


class ByteTokenizer:
    """Byte-level BPE: ids of a text, and the bytes of each id. Special tokens in a text are plain text.

    Where merges are numbered in their order, and the file cuts texts by the usual pattern, ids are ranks,
    and a rank-based encoder gives the same ids in a quarter of the time. It cannot take long runs of white
    space; these, and other files, go through the library that the files were made for.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab, merges = held["model"]["vocab"], held["model"]["merges"]
        special = {x["content"] for x in held.get("added_tokens", ())}
        alphabet = {c: b for b, c in enumerate(_byte_alphabet())}
        every = vocab | {x["content"]: x["id"] for x in held.get("added_tokens", ())}
        self.bytes = [b""] * (max(every.values()) + 1)
        for piece, k in every.items():
            self.bytes[k] = piece.encode() if piece in special else bytes(alphabet[c] for c in piece)
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        cut = held.get("pre_tokenizer") or {}
        plain = not held.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.ranked = plain and all(vocab.get(m) == 256 + k for k, m in enumerate(joined)) and sorted(vocab[c] for c in alphabet) == list(range(256))
        if self.ranked:
            import tiktoken

            ranks = {self.bytes[k]: k for piece, k in vocab.items() if piece not in special}
            self.model = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.no_truncation()
        model.no_padding()
        model.encode_special_tokens = True
        return model

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.ranked and not LONG_BLANK.search(text):
            return self.model.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """BPE with pieces and byte fallback; adds the leading space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(k) for k in known]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(known, pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones themselves, the
    others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(moved.get(b, b)) for b in range(256)]


@dataclass
class Aligned:
    """Documents side by side: numbers of each, and the links of all in order as (document, A id, B id)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups_sha256: list[str]
    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Aligner:
    def __init__(self, a: ByteTokenizer, b: PieceTokenizer) -> None:
        self.a, self.b = a, b
        self.long = [np.array(list(map(len, t.bytes)), np.int64) for t in (a, b)]
        # how an id is written before another of its group, and as the last one of its side
        self.written = [[np.array([f"{k}{end}" for k in range(len(t.bytes))], object) for end in ends] for t, ends in ((a, ",|"), (b, ",;"))]

    def align(self, texts: list[str | None]) -> Aligned:
        """All documents at once. One whose tokens do not join to its own bytes has none."""
        texts = [t or "" for t in texts]
        some = [k for k, t in enumerate(texts) if t]
        ids = zip(self.a.encode([texts[k] for k in some]), self.b.encode([texts[k] for k in some]))
        held: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for k, (x, y) in zip(some, ids):
            raw = b" " + texts[k].encode()
            if b"".join(map(self.a.bytes.__getitem__, x)) == raw and b"".join(map(self.b.bytes.__getitem__, y)) == raw:
                held[k] = (x, y)
        n_a, n_b = (np.array([len(h[s]) for h in held], np.int64) for s in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(h[s] for h in held), np.int64, n.sum()) for s, n in ((0, n_a), (1, n_b)))
        end_a, end_b = np.cumsum(self.long[0][a]), np.cumsum(self.long[1][b])
        size = int(end_a[-1]) + 1 if len(a) else 1
        in_a, in_b = (np.bincount(e, minlength=size).astype(bool) for e in (end_a, end_b))
        cut = np.flatnonzero(in_a & in_b)  # offsets where a group ends
        ends = np.flatnonzero(in_a | in_b)  # each piece between two of these is one link
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        bound_a = np.append(0, np.cumsum(n_a))
        last = np.append(0, end_a)[bound_a]  # byte offset at which each document ends, 0 first
        n_groups, n_links = (np.diff(np.searchsorted(x, last, "right")) for x in (cut, ends))
        doc = np.repeat(np.arange(len(texts)), n_links)
        return Aligned(n_a, n_b, n_groups, n_links, self._digests(a, b, group_a, group_b, n_a, n_b), doc, a[of_a], b[of_b])

    def _digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """A's tokens of a group stand before B's of the same: each token's place is its own number and the
        number of the other side's before it."""
        out = np.empty(len(a) + len(b), object)
        for side, mine, group, other, before in ((0, a, group_a, group_b, "left"), (1, b, group_b, group_a, "right")):
            ends = np.append(group[1:] != group[:-1], True) if len(group) else np.empty(0, bool)
            shown = np.where(ends, self.written[side][1][mine], self.written[side][0][mine])
            out[np.arange(len(mine)) + np.searchsorted(other, group, before)] = shown
        found, at = [], 0
        for n in (n_a + n_b).tolist():
            found.append(hashlib.sha256("".join(out[at : at + n].tolist())[:-1].encode()).hexdigest() if n else "")
            at += n
        return found


def _blocks(rows: pa.RecordBatch, most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch, up to about `most` characters at a time."""
    ids, texts, size = [], [], 0
    for doc, text in zip(rows.column(0), rows.column(1)):
        ids.append(doc.as_py())
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _segments(pairs: np.ndarray, segments: int) -> np.ndarray:
    """A segment for each pair: by a product with an odd number, whose high bits are mixed."""
    return ((pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)


def _chunks(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str], chunk_links: int, block_chars: int, segments: int) -> DataFrame:
    """Chunks of documents. One row (segment is null) has each document's numbers and its distinct pairs
    as numbers within the chunk, with how often it has them. A row for each segment has the pairs
    that fall into it, the number of the first one, and in how many documents each occurs."""
    kind = docs.schema[id_col].dataType
    many = T.ArrayType(T.LongType())
    fields = [("chunk", T.LongType()), ("segment", T.IntegerType()), ("first", T.LongType()), ("pairs", T.BinaryType()), ("docs", T.BinaryType()), ("ids", T.ArrayType(kind)), ("n_a", many), ("n_b", many), ("n_groups", many), ("n_links", many), ("groups_sha256", T.ArrayType(T.StringType())), ("sizes", T.BinaryType()), ("numbers", T.BinaryType()), ("uses", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(ByteTokenizer(paths[0]), PieceTokenizer(paths[1]))
        press = zstandard.ZstdCompressor(level=3)
        chunk, id_kind = TaskContext.get().partitionId() << 32, pa.int64()
        held: list[tuple] = []

        def rows_of(rows: int, /, **columns: list) -> pa.RecordBatch:
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(id_kind), longs, longs, longs, longs, pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * rows), t) for (c, _), t in zip(fields, kinds)], schema.names)

        def flush() -> Iterator[pa.RecordBatch]:
            sizes, pairs, uses = (np.concatenate([h[k] for h in held]) for k in (6, 7, 8))
            distinct, number = np.unique(pairs, return_inverse=True)
            of = _segments(distinct, segments)
            order = np.argsort(of, kind="stable")  # by segment, then by pair
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            in_docs = np.bincount(number, minlength=len(distinct))[order]
            lists = [[x for h in held for x in h[k]] for k in range(6)]
            named = dict(zip(("ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), ([x] for x in lists)))
            yield rows_of(1, chunk=[chunk], sizes=[squeeze(sizes, press)], numbers=[squeeze(place[number], press)], uses=[squeeze(uses, press)], **named)
            if len(order):
                at = np.append(0, np.flatnonzero(np.diff(of[order])) + 1)
                some, n = np.split(distinct[order], at[1:]), np.split(in_docs, at[1:])
                yield rows_of(len(at), chunk=[chunk] * len(at), segment=of[order][at].tolist(), first=at.tolist(), pairs=[squeeze(x, press, rising=True) for x in some], docs=[squeeze(x, press) for x in n])
            held.clear()

        links = 0
        for rows in batches:
            id_kind = rows.column(0).type
            for ids, texts in _blocks(rows, block_chars):
                x = aligner.align(texts)
                # distinct pairs of each document: the document in the high bits of one key
                bits = max(1, len(texts)).bit_length()
                width = 64 - bits
                if max(len(aligner.a.bytes), len(aligner.b.bytes)) >> width // 2:
                    raise ValueError("the vocabularies are too large to number pairs of a block of documents")
                pair = x.a.astype(np.uint64) << np.uint64(width // 2) | x.b.astype(np.uint64)
                key, uses = np.unique(x.doc.astype(np.uint64) << np.uint64(width) | pair, return_counts=True)
                doc, low = (key >> np.uint64(width)).astype(np.int64), key & np.uint64((1 << width) - 1)
                pair = low >> np.uint64(width // 2) << np.uint64(32) | low & np.uint64((1 << width // 2) - 1)
                held.append((ids, x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), x.n_links.tolist(), x.groups_sha256, np.bincount(doc, minlength=len(ids)), pair, uses))
                links += len(pair)
                if links >= chunk_links:
                    yield from flush()
                    chunk, links = chunk + 1, 0
        if held:
            yield from flush()
        give_back()

    return docs.select(id_col, text_col).mapInArrow(each, schema)


def pair_counts(pieces: DataFrame, fold: int = 1_000_000) -> DataFrame:
    """(segment, a, b, n): in how many documents each pair is linked. A task adds up one segment's pairs
    at a time, folding what has gathered, so it holds the segment's distinct pairs and a bounded rest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        current, gathered, waiting = None, [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in gathered]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, np.concatenate([c for _, c in gathered]))
            return pairs, n

        def told() -> Iterator[pa.RecordBatch]:
            pairs, n = folded()
            for k in range(0, len(pairs), 10_000):
                some = pairs[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), current), pa.int32()), pa.array((some >> np.uint64(32)).astype(np.int64)), pa.array((some & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[k : k + 10_000])], ["segment", "a", "b", "n"])

        for rows in batches:
            for segment, pairs, docs in zip(*(rows.column(c).to_pylist() for c in ("segment", "pairs", "docs"))):
                if segment != current:
                    if current is not None:
                        yield from told()
                    current, gathered, waiting = segment, [], 0
                gathered.append((unsqueeze(pairs, unpress, rising=True), unsqueeze(docs, unpress).astype(np.int64)))
                waiting += len(gathered[-1][0])
                if waiting >= fold + len(gathered[0][0]):
                    gathered, waiting = [folded()], 0
        if current is not None:
            yield from told()
        give_back()

    return pieces.select("segment", "pairs", "docs").repartition("segment").sortWithinPartitions("segment").mapInArrow(each, "segment int, a long, b long, n long")


def _packed(counts: DataFrame) -> DataFrame:
    """(segment, pairs, docs, best): the counts of each segment in one row, whose size is that of the
    segment's distinct pairs; best tells whether the count is the highest of its A id."""
    highest = counts.groupBy("a").agg(F.max("n").alias("_most"))
    judged = counts.join(highest, "a").select("segment", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        current, held = None, []

        def told() -> pa.RecordBatch:
            pairs, n, best = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.argsort(pairs)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([squeeze(pairs[order], press, rising=True)], pa.binary()), pa.array([squeeze(n[order], press)], pa.binary()), pa.array([np.packbits(best[order]).tobytes()], pa.binary())], ["segment", "pairs", "docs", "best"])

        for rows in batches:
            segment = rows.column(0).to_numpy(zero_copy_only=False)
            pairs = rows.column(1).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(32) | rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            n, best = rows.column(3).to_numpy(zero_copy_only=False), rows.column(4).to_numpy(zero_copy_only=False)
            at = np.append(0, np.flatnonzero(np.diff(segment)) + 1).tolist() if len(segment) else []
            for s, e in zip(at, [*at[1:], len(segment)]):
                if segment[s] != current:
                    if held:
                        yield told()
                    current, held = int(segment[s]), []
                held.append((pairs[s:e], n[s:e], best[s:e]))
        if held:
            yield told()
        give_back()

    return judged.repartition("segment").sortWithinPartitions("segment").mapInArrow(each, "segment int, pairs binary, docs binary, best binary")


def _answers(pieces: DataFrame, tables: DataFrame) -> DataFrame:
    """(chunk, first, docs, best): the corpus counts of the pairs of each piece, in the piece's order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        known = n = best = None
        for rows in batches:
            for start in range(0, len(rows), 200):
                out: tuple[list, ...] = ([], [], [], [])
                part = rows.slice(start, 200)
                for chunk, first, pairs, docs, flags in zip(*(part.column(c).to_pylist() for c in ("chunk", "first", "pairs", "docs", "best"))):
                    mine = unsqueeze(pairs, unpress, rising=True)
                    if chunk is None:
                        known, n = mine, unsqueeze(docs, unpress)
                        best = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(known))
                        continue
                    at = np.searchsorted(known, mine)
                    for column, x in zip(out, (chunk, first, squeeze(n[at], press), np.packbits(best[at]).tobytes())):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "first", "docs", "best"])
        give_back()

    met = table_first(tables, pieces.select("segment", "chunk", "first", "pairs", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("best")))
    return met.mapInArrow(each, "chunk long, first long, docs binary, best binary")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str | None = None, b_file: str | None = None, chunk_links: int = 1_000_000, block_chars: int = 1_000_000, segments: int = 256) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row for each row.

    A is a byte-level BPE and reads a space and the text; B a piece BPE, which adds the space. Byte
    offsets where tokens of both end cut a document into groups. Links are the pairs of an A and a B
    token whose bytes overlap; the count of a pair of ids is the number of documents that have it linked.
    n_best are the links whose count no other pair of their A id exceeds, count_sum adds the counts
    over links, groups_sha256 digests the groups as `a1,a2|b1;a3|b2,b3`.

    Documents are tokenized once and kept as chunks of about chunk_links distinct pairs. A chunk's pairs
    are dealt to `segments` segments (or the number of shuffle partitions, if more) by a hash; there they
    are counted over the corpus, and the counts go back to the chunks by number. A frequent pair comes
    once from each chunk. What a task holds is a block of documents, a chunk's pairs or the distinct pairs
    of a segment, whatever the size of the corpus.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens:
    zeros, and an empty groups_sha256. Every row is a document, repeated rows and null ids too; equal counts
    are all best; a text of any length is read whole; other columns are not read, whatever their names;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = (a_file or public_file("byte_bpe_50k.json"), b_file or public_file("piece_bpe_32k.model"))
    parts = saved(_chunks(docs, id_col, text_col, paths, chunk_links, block_chars, max(segments, buckets)), "align-chunks", buckets, "chunk")
    pieces = parts.where("segment is not null").select("segment", "chunk", "first", "pairs", "docs")
    counts = saved(pair_counts(pieces), "align-counts")
    answers = _answers(pieces, saved(_packed(counts), "align-tables"))
    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("first", "docs", "best")).alias("told"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    whole = parts.where("segment is null").select("chunk", "ids", *numbers, "groups_sha256", "sizes", "numbers", "uses")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in [*numbers, "n_best", "count_sum"]], T.StructField("groups_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for rows in batches:
            for k in range(len(rows)):
                found = sorted(rows.column("told")[k].as_py() or [], key=lambda x: x["first"])
                sizes, at, uses = (unsqueeze(rows.column(c)[k].as_py(), unpress).astype(np.int64) for c in ("sizes", "numbers", "uses"))
                each_n = [unsqueeze(x["docs"], unpress).astype(np.int64) for x in found]
                n = np.concatenate(each_n) if found else np.empty(0, np.int64)
                best = np.concatenate([np.unpackbits(np.frombuffer(x["best"], np.uint8), count=len(c)) for x, c in zip(found, each_n)]) if found else np.empty(0, np.int64)
                bound = np.append(0, np.cumsum(sizes))
                sums = [np.diff(np.append(0, np.cumsum(x))[bound]) for x in (best[at] * uses, n[at] * uses)]
                columns = [rows.column(c)[k].values for c in ("ids", *numbers)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in sums], rows.column("groups_sha256")[k].values], schema.names)
        give_back()

    return whole.join(told, "chunk", "left").drop("chunk").mapInArrow(each, schema)
