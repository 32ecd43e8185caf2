"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import give_back
from rollcall.session import saved

#: Fixed values of the vocabulary file: how it cuts words, and its special tokens.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lower(text: str) -> str:
    """Lower case character by character, so without the rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def split_words(text: str | None) -> list[str]:
    """The words of a text in order; special tokens stay as they are."""
    if not text:
        return []
    if "<|" not in text:
        return PIECES.findall(_lower(unicodedata.normalize("NFC", text)))
    out, at = [], 0
    for m in SPECIAL.finditer(text):
        out += PIECES.findall(_lower(unicodedata.normalize("NFC", text[at : m.start()]))) + [m[0]]
        at = m.end()
    return out + PIECES.findall(_lower(unicodedata.normalize("NFC", text[at:])))


def _pack(numbers: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Numbers below 2**32 byte plane by byte plane, which compresses better than one by one."""
    return press.compress(np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes, unpress: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(unpress.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_ids(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Ids as they stand, in two bytes each where the vocabulary allows it: words that end alike end in
    the same ids, which are found again better when they are not split into planes."""
    short = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if short else b"\4") + press.compress(ids.astype("<u2" if short else "<u4").tobytes())


def _unpack_ids(packed: bytes, unpress: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(unpress.decompress(packed[1:]), "<u2" if packed[:1] == b"\2" else "<u4").astype("<u4")


def _split_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_words: int, chunk_docs: int, lists: int) -> DataFrame:
    """Chunks of documents: a row for each document (its words as numbers within the chunk), and up
    to `lists` rows with the distinct words of the chunk by a hash of the word (list). Words are
    numbered list by list, so a list needs only the number of its first word."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("list", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("numbers", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3)
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        ids: list = []
        seqs: list[np.ndarray] = []
        chunk, n_words, kind = TaskContext.get().partitionId() << 32, 0, pa.int64()

        def rows_of(*columns: list | None) -> pa.RecordBatch:
            n = max(len(c) for c in columns if c is not None)
            kinds = (pa.int32(), pa.int32(), pa.binary(), kind, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *(pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds))], schema.names)

        def flush() -> Iterator[pa.RecordBatch]:
            words = sorted(number)
            of = np.fromiter((xxhash.xxh32_intdigest(w) % lists for w in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            rank = np.empty(len(words), "<u4")
            rank[np.fromiter(map(number.__getitem__, words), np.int64, len(words))[order]] = np.arange(len(words))
            yield rows_of(None, None, None, ids, [_pack(rank[x], press) for x in seqs])
            if len(words):
                at = np.append(0, np.flatnonzero(np.diff(of[order])) + 1)
                packed = [press.compress("\n".join([words[k] for k in x.tolist()]).encode("utf-8", "surrogatepass")) for x in np.split(order, at[1:])]
                yield rows_of(of[order[at]].tolist(), at.tolist(), packed, None, None)
            number.clear(), ids.clear(), seqs.clear()

        for rows in batches:
            kind = rows.column(0).type
            for doc, text in zip(rows.column(0), rows.column(1)):
                words = split_words(text.as_py())
                n_words += len(words)
                ids.append(doc.as_py())
                seqs.append(np.fromiter(map(number.__getitem__, words), "<u4", len(words)))
                if n_words >= chunk_words or len(ids) >= chunk_docs:
                    yield from flush()
                    chunk, n_words = chunk + 1, 0
        if ids:
            yield from flush()
        give_back()

    return docs.select(id_col, text_col).mapInArrow(each, schema)


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads keep memory of their own
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


def _encode_lists(uses: DataFrame, path: str) -> DataFrame:
    """(chunk, first, sizes, ids) of (chunk, list, first, words). All rows of a list come together, so
    each distinct word of the corpus is encoded once; a task holds the words of one list, which are as
    many as the distinct words by the number of lists."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, current = _tokenizer(path), {}, None
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, len(whole), 200):
                rows = whole.slice(start, 200)
                sizes, ids = [], []
                for which, packed in zip(rows.column("list").to_pylist(), rows.column("words").to_pylist()):
                    if which != current:
                        known, current = {}, which
                    words = unpress.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
                    fresh = [w for w in words if w not in known]
                    for k in range(0, len(fresh), 1000):
                        part = fresh[k : k + 1000]
                        for w, x in zip(part, model.encode_batch_fast(part, add_special_tokens=False)):
                            known[w] = np.array(x.ids, "<u4")
                    found = list(map(known.__getitem__, words))
                    sizes.append(_pack(np.fromiter(map(len, found), np.int64, len(found)), press))
                    ids.append(_pack_ids(np.concatenate(found), press))
                yield pa.RecordBatch.from_arrays([rows.column("chunk"), rows.column("first"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "first", "sizes", "ids"])
        del model, known
        give_back()

    return uses.repartition("list").sortWithinPartitions("list").mapInArrow(each, "chunk long, first int, sizes binary, ids binary")


def piece_table(spark: SparkSession, vocab: str | None = None) -> DataFrame:
    """(id, piece) of a vocabulary file."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocab or vocabulary()).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pd.DataFrame({"id": np.array(list(found.values()), np.int32), "piece": list(found)}), "id int, piece string")


def _pieces_of_chunks(coded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(chunk, piece_ids, pieces): the distinct ids of each chunk, joined with their pieces. pieces has
    a row for each id of the vocabulary, whose size bounds the broadcast and a chunk's row."""

    def ids_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        unpress = zstandard.ZstdDecompressor()
        seen = np.unique(np.concatenate([np.unique(_unpack_ids(x, unpress)) for x in rows["ids"]]))
        return pd.DataFrame({"chunk": np.full(len(seen), key[0]), "id": seen.astype(np.int32)})

    used = coded.select("chunk", "ids").groupBy("chunk").applyInPandas(ids_of, "chunk long, id int")
    met = used.join(F.broadcast(pieces), "id", "left").groupBy("chunk").agg(F.collect_list(F.struct("id", F.coalesce("piece", F.lit("")).alias("piece"))).alias("p"))
    return met.select("chunk", F.col("p.id").alias("piece_ids"), F.col("p.piece").alias("pieces"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, chunk_words: int = 1_500_000, chunk_docs: int = 20_000, lists: int = 256, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode each document and decode it again: id, n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, ids (array<int>) and decoded.

    Each chunk of about chunk_words words deals its distinct words out to `lists` lists (or the
    number of shuffle partitions, if more) by a hash. The lists meet, so that each distinct word of
    the corpus is encoded once, and its ids go back to the chunks by word number, where documents
    are put together by position. A frequent word comes once from each chunk, not from each use.
    Decoding joins the distinct ids of a chunk with the table of pieces; the pieces go to the chunk
    and are put together by position too. Words are split by Python in Spark's tasks, since Spark has
    no Unicode normalisation.

    A null text is empty (0 tokens, no pieces); a text longer than chunk_words is a chunk by itself;
    repeated rows and null ids keep their rows; the order of rows and ties decide nothing; extra
    columns are not read; an empty table gives no rows.
    """
    path = vocab or vocabulary()
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = saved(_split_chunks(docs, id_col, text_col, chunk_words, chunk_docs, max(lists, buckets)), "bpe-chunks", buckets, "chunk")
    coded = saved(_encode_lists(parts.where("list is not null").select("chunk", "list", "first", "words"), path).repartition(buckets, "chunk"), "bpe-coded", buckets, "chunk")
    of_words = coded.groupBy("chunk").agg(F.collect_list(F.struct("first", "sizes", "ids")).alias("w"))
    of_words = of_words.join(_pieces_of_chunks(coded, piece_table(spark, path)), "chunk", "left").select("chunk", F.col("w.first").alias("firsts"), F.col("w.sizes").alias("sizes"), F.col("w.ids").alias("ids"), "piece_ids", "pieces")
    of_docs = parts.where("list is null").select(F.col("chunk").alias("of_chunk"), id_col, "numbers")
    extra = ", ids array<int>" * with_ids + ", decoded string" * with_text

    def each(key: tuple, words: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        unpress = zstandard.ZstdDecompressor()
        size, flat, piece = np.empty(0, np.int64), np.empty(0, "<u4"), np.empty(0, object)
        if len(words):  # a chunk without words has none
            w = words.iloc[0]
            order = np.argsort(np.asarray(w["firsts"]))
            size = np.concatenate([_unpack(w["sizes"][k], unpress) for k in order]).astype(np.int64)
            flat = np.concatenate([_unpack_ids(w["ids"][k], unpress) for k in order])
            piece = np.full(int(flat.max()) + 1, "", object)
            piece[np.asarray(w["piece_ids"])] = np.asarray(w["pieces"], object)
        first = np.cumsum(size) - size
        named = piece[flat].tolist()
        texts = np.empty(len(size), object)
        texts[:] = [" ".join(named[s : s + n]) for s, n in zip(first.tolist(), size.tolist())]
        del named
        out: dict[str, list] = {id_col: rows[id_col].tolist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {}) | ({"decoded": []} if with_text else {})
        for seq in rows["numbers"]:
            at = _unpack(seq, unpress)
            n = size[at]
            ids = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)]
            decoded = " ".join(texts[at].tolist())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                out["ids"].append(ids.astype(np.int32))
            if with_text:
                out["decoded"].append(decoded)
        del texts, size, flat, first
        give_back()
        return pd.DataFrame(out | {id_col: pd.Series(out[id_col], dtype=object)})

    return of_words.groupBy("chunk").cogroup(of_docs.groupBy("of_chunk")).applyInPandas(each, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
