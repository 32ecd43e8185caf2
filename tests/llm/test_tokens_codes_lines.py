"""Tokenizer alignment, vector codes and line dedup against brute force, with awkward rows."""

import hashlib
import json
import string
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm import alignment, codes, lines, queries

SF = "/root/testdata/sf0.001"
ODD = [
    (-1, None), (-2, ""), (-3, " "), (-4, "a▁b"), (-5, "<|endoftext|> <s> <0x41> é\x00ﬁ \U0001F600"), (-6, "a"), (-6, "a"), (None, "Hello wörld"),
    (-7, "no end " * 30_000), (-8, "\n\n\n"), (-9, "x" * 20 + "\n" + "X" * 20 + "\n" + " \t" + "x" * 20 + "\r"), (-10, "é" * 19 + "\n" + "é" * 20), (-11, "é" * 20),
    (-12, "É" * 20 + "\n" + "é" * 20 + " "), (7000, "x" * 20), (7001, "y\n" + "x" * 20 + "\n"), (7001, "x" * 20), (None, "x" * 20), (7002, "only two docs have this line"), (7003, "only two docs have this line"),
    (7003, "only two docs have this line"),
]


@pytest.fixture(scope="module")
def docs(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = read.union(spark.createDataFrame(ODD, "doc_id long, text string"))
    for name in ("chunk", "segment", "ids", "first", "pairs", "docs", "hashes", "again", "n", "label", "x", "key", "last"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.cache()


# lines


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def _plain_lines(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= 20:
                holders[_key(line)].add(i)
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(holders.get(_key(x), ())) < 3 or max(j for j in holders[_key(x)] if j is not None) == i]
        out.append((str(i), len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes, segments", [(8 << 20, 256), (3_000, 5)])
def test_line_dedup_equals_brute_force(docs, chunk_bytes, segments):
    expected = _plain_lines([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = lines.remove_repeats(docs, chunk_bytes=chunk_bytes, segments=segments, with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in got) == expected
    assert sum(x[2] for x in expected) > 20
    assert lines.remove_repeats(docs.limit(0)).count() == 0


def test_line_hot_in_every_document(spark):
    text = "this very line stands in every document"
    rows = [(k, f"{text}\n{k} is a number that no other document has\n{text.upper()}  ") for k in range(400)]
    hot = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.remove_repeats(hot, chunk_bytes=2_000).collect()}
    assert got == {k: (3, 0 if k == 399 else 2) for k in range(400)}


def test_line_filters_miss_nothing_and_let_few_pass(spark):
    """The second filter knows each hash that two chunks have, and few others."""
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64))
    words = len(values) * lines.BITS_A_HASH // 64
    at, mask = lines._places(values, 1, words)
    once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    half = len(values) // 2
    for part in (slice(0, half), slice(half, None), slice(0, 500)):
        again = once[at[part]] & mask[part] == mask[part]
        np.bitwise_or.at(twice, at[part][again], mask[part][again])
        np.bitwise_or.at(once, at[part], mask[part])
    known = twice[at] & mask == mask
    assert known[:500].all()
    assert known[500:].mean() < 0.02


def test_line_keys():
    assert lines.keys_of(" AÉb \x0b\n\n\tX\r".encode()) == ["aÉb".encode(), b"", b"x"]
    assert [lines.long_enough(("é" * n).encode(), 20) for n in (19, 20, 80)] == [False, True, True]
    assert [lines.long_enough(b"a" * n, 20) for n in (19, 20, 79, 80)] == [False, True, True, True]


# tokens


def _plain_alignment(rows):
    a_side, b_side = alignment.ByteTokenizer(alignment.public_file("byte_bpe_50k.json")), alignment.PieceTokenizer(alignment.public_file("piece_bpe_32k.model"))
    counts, top, per = Counter(), defaultdict(int), []
    for i, text in rows:
        text = text or ""
        a, b = (_LIBRARY.encode(" " + text, add_special_tokens=False).ids, b_side.encode([text])[0]) if text else ([], [])
        raw = (" " + text).encode()
        if not text or b"".join(a_side.bytes[k] for k in a) != raw or b"".join(b_side.bytes[k] for k in b) != raw:
            a, b = [], []
        links, groups, mine_a, mine_b = [], [], [], []
        x = y = 0
        end_a, end_b = (len(a_side.bytes[a[0]]), len(b_side.bytes[b[0]])) if a else (0, 0)
        while x < len(a):
            links.append((a[x], b[y]))
            mine_a += [x] * (x not in mine_a)
            mine_b += [y] * (y not in mine_b)
            if end_a == end_b:
                groups.append(",".join(str(a[k]) for k in mine_a) + "|" + ",".join(str(b[k]) for k in mine_b))
                mine_a, mine_b = [], []
            step_a, step_b = end_a <= end_b, end_b <= end_a
            x, y = x + step_a, y + step_b
            if x < len(a):
                end_a += len(a_side.bytes[a[x]]) * step_a
                end_b += len(b_side.bytes[b[y]]) * step_b
        counts.update(set(links))
        per.append((str(i), len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return sorted((i, n_a, n_b, g, len(ls), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls), h) for i, n_a, n_b, g, ls, h in per)


@pytest.mark.parametrize("chunk_links, block_chars, segments", [(1_000_000, 1_000_000, 256), (300, 2_000, 4)])
def test_alignment_equals_brute_force(docs, chunk_links, block_chars, segments):
    expected = _plain_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = alignment.compare(docs, chunk_links=chunk_links, block_chars=block_chars, segments=segments).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == expected
    assert {r[7] for r in expected if r[0] in ("-1", "-2", "-4")} == {""}
    assert alignment.compare(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(" \t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u3000\u200bab'st1.", max_size=60))
def test_ranked_encoder_equals_the_library_of_the_file(text):
    assert _ALIGNER.a.ranked
    assert _ALIGNER.a.encode([text])[0] == _LIBRARY.encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000 + "x", "\n" * 1_500_000, "^" * 1_000_000, " \t" * 600 + "end", "a" * 300_000])
def test_long_runs_are_encoded(text):
    assert _ALIGNER.a.encode([text])[0] == _LIBRARY.encode(" " + text, add_special_tokens=False).ids


def test_files_without_ranks_go_through_their_library(tmp_path):
    held = json.loads(open(alignment.public_file("byte_bpe_50k.json"), encoding="utf-8").read())
    held["model"]["merges"][5], held["model"]["merges"][6] = held["model"]["merges"][6], held["model"]["merges"][5]
    (tmp_path / "other.json").write_text(json.dumps(held))
    other = alignment.ByteTokenizer(str(tmp_path / "other.json"))
    texts = ["the of and <|endoftext|> é", "a\n b"]
    assert not other.ranked and other.bytes == _ALIGNER.a.bytes
    for text, ids in zip(texts, other.encode(texts)):
        assert b"".join(other.bytes[k] for k in ids) == (" " + text).encode()


def test_alignment_counts_fold_in_blocks(docs):
    """Counts are the same however little is folded at a time."""
    paths = (alignment.public_file("byte_bpe_50k.json"), alignment.public_file("piece_bpe_32k.model"))
    parts = alignment._chunks(docs, "doc_id", "text", paths, 500, 2_000, 3).where("segment is not null").cache()
    one, many = (sorted(map(tuple, alignment.pair_counts(parts, fold).collect())) for fold in (10, 1_000_000))
    assert one == many and len(one) > 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.sampled_from(["", "<|endoftext|>", "▁", "  a  ", "<unk>", "\x00"]), max_size=5))
def test_aligned_batches_equal_documents_one_by_one(texts):
    together = _ALIGNER.align(texts)
    at = 0
    for k, text in enumerate(texts):
        alone = _ALIGNER.align([text])
        n = int(alone.n_links[0])
        assert (together.n_a[k], together.n_b[k], together.n_groups[k], together.n_links[k], together.groups_sha256[k]) == (alone.n_a[0], alone.n_b[0], alone.n_groups[0], n, alone.groups_sha256[0])
        assert together.a[at : at + n].tolist() == alone.a.tolist() and together.b[at : at + n].tolist() == alone.b.tolist()
        at += n


_LIBRARY = Tokenizer.from_file(alignment.public_file("byte_bpe_50k.json"))
_LIBRARY.encode_special_tokens = True
_ALIGNER = alignment.Aligner(alignment.ByteTokenizer(alignment.public_file("byte_bpe_50k.json")), alignment.PieceTokenizer(alignment.public_file("piece_bpe_32k.model")))


# codes


def _plain_codes(rows, entries=256, rounds=4):
    """rows of (id, vector of floats, label), all of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(1024 * float(v))) for v in r[1]] for r in rows]
    width = len(whole[0]) // 4
    parts = [[w[p * width : (p + 1) * width] for w in whole] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def best(x, book):
        return min((sum((u - v) ** 2 for u, v in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for part, book in zip(parts, books):
            of = [best(x, book)[1] for x in part]
            for e in set(of):
                mine = [x for x, k in zip(part, of) if k == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[best(x, book) for x, book in zip(xs, books)] for xs in zip(*parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by_label = Counter()
    for r, f in zip(rows, found):
        by_label[r[2]] += sum(d for d, _ in f)
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[r[2]], digest) for r, f in zip(rows, found))


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 8)], k % 3) for k in range(300)]
    rows += [(300, [0.0] * 8, None), (301, [-0.0] * 8, None), (302, list(rows[5][1]), 1), (302, list(rows[6][1]), 1), (None, list(rows[7][1]), 2), (303, [0.25] * 8, 0), (304, [0.25] * 8, 0), (305, [3e7] * 8, 4), (306, [-1e5] * 4 + [1e5] * 4, 4)]
    bad = [(400, None, 1), (401, [None] + [1.0] * 7, 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 1)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").repartition(7)
    for name in ("id", "x", "code", "error", "entry", "n"):
        vectors = vectors.withColumn(name, F.lit("clash"))
    got = codes.encode(vectors).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == _plain_codes(rows)


def test_vector_codes_of_few_other_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(2, [1.0] * 4, 1), (1, [0.0] * 4, 1), (3, [1.0] * 5, 1), (4, [], 1), (0, [2.0] * 6, None)], kind)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.encode(few).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, 0), 4: (None, None, 0), 0: (None, None, None)}
    odd = codes.encode(few.where("vec_id in (3, 4)")).collect()
    assert [(r.code, r.error, r.label_error) for r in odd] == [(None, None, None)] * 2
    assert codes.encode(few.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 6), st.sampled_from([2, 50, 3_000, 1 << 26, 1 << 39]))
def test_annular_search_equals_all_distances(seed, n_entries, width, most):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-most, most + 1, (n_entries, width)).astype(np.float64)
    x = np.vstack([rng.integers(-most, most + 1, (60, width)), entries[rng.integers(0, n_entries, 20)]]).astype(np.float64)
    index, distance = codes.nearest(x, entries, block=16)
    whole = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)) for e in entries] for row in x]
    assert [int(k) for k in index] == [d.index(min(d)) for d in whole]
    assert [int(d) for d in distance] == [min(d) for d in whole]


# queries


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_line_dedup"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in expected.fetchall())


def test_alignment_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_tokenizer_alignment(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == _plain_alignment(rows)
