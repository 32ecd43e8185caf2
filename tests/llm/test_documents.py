"""Operators on documents against brute force, with awkward rows."""

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from rollcall.llm import bpe, mixing, pii, rules, simhash, substrings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp long, chunk long, base string, terms string, word string"
RUN = " ".join(f"w{i}" for i in range(13))
ODD = [
    (-1, None), (-2, ""), (-3, "   \n \n"), (-4, "x"), (-5, "a b c a b c a b c"), (None, "nobody's text"), (-6, f"x {RUN} y"),
    (-7, f"q {RUN} r"), (-7, f"q {RUN} r"), (5000, f"{RUN} {RUN}"), (5001, RUN.replace("w5 ", "w5\n\t")), (-8, "THE the The   café a<|endoftext|>b ΟΔΟΣ don't 12 ½"),
    (-9, "long " * 60000), (-10, "mail a.b@c.org or +49 (30) 1234567, 10.0.0.256 10.0.0.25 4111-1111 1111 1111"), (-11, "é\U0001F600 a@b.coé 1.2.3.4.5"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Test documents and awkward rows, with columns whose names clash with the operators' own."""
    read = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = read.union(spark.createDataFrame(ODD, "doc_id long, text string"))
    for name in ("fp", "chunk", "base", "terms", "word", "component", "label", "_text", "_key", "n", "list"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_components_equal_brute_force(docs):
    def fingerprint(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    fps = [(i, fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[:k] if (x ^ y).bit_count() <= 4]
    root = components({i for i, _ in fps}, pairs)
    expected = Counter((i, x, root[i]) for i, x in fps)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component) for r in got if r.doc_id is not None) == expected


@pytest.mark.parametrize("block_rows", [4, 1024])
def test_pigeonring_links_lose_nothing_in_crowded_buckets(spark, block_rows):
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 2**63))
    values = {center} | {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 2**63, 100)}
    values = sorted(np.array([v & (2**64 - 1) for v in values], np.uint64).view(np.int64).tolist())
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), block_rows=block_rows).collect()
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(bits(r.src, r.dst) > 0 for r in links)
    exact = [(a, b) for k, a in enumerate(values) for b in values[:k] if bits(a, b) <= 4]
    assert components(values, [(r.src, r.dst) for r in links]) == components(values, exact)


def without_repeats(docs):
    """By brute force: counts of (id, words, removed, digest, kept)."""
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    first = {}
    for i, w in rows:
        for p in range(len(w) - 12) if i is not None else ():
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    expected = Counter()
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    return expected


@pytest.mark.parametrize("chunk_bytes,batches,crowd", [(4000, 6, 2), (6 << 20, 2, 1000)])
def test_repeats_equal_brute_force(docs, chunk_bytes, batches, crowd):
    got = substrings.remove_repeats(docs, chunk_bytes=chunk_bytes, batches=batches, crowd=crowd, with_text=True).collect()
    assert Counter(map(tuple, got)) == without_repeats(docs)


def test_repeats_of_earlier_calls(docs):
    """Documents that come in three calls, by id, are judged as if they came at once; runs are compacted."""
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    history, got = substrings.History(), []
    for low, high in ((-100, 60), (60, 140), (140, 10_000)):
        part = rows.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        out, history = substrings.remove_new_repeats(part, history, chunk_bytes=40_000, batches=2, fan_in=2, with_text=True)
        got += out.collect()
    assert Counter(map(tuple, got)) == without_repeats(rows)
    assert len(history.chunks) == 3 and len(history.runs) <= 2


def test_index_compacts_its_runs(spark):
    index = substrings.FingerprintIndex(4, fan_in=2)
    batch = lambda rows: spark.createDataFrame(rows, "anchor long, chunk long, many boolean")
    found = [{r.anchor for r in index.add(batch([(k, b, False), (100 + b, b, b == 1), (200 + b, b, False)])).collect()} for b, k in enumerate((7, 7, 7, 8))]
    assert found == [set(), {7, 101}, {7}, set()]
    assert len(index.runs) <= 2
    assert {(r.chunk, r.anchor) for r in index.chunks_with(spark.createDataFrame([(7,)], "anchor long")).collect()} == {(0, 7), (1, 7), (2, 7)}


def test_rules_equal_brute_force(docs):
    got = {r.doc_id: r for r in rules.judge(docs.dropDuplicates(["doc_id"])).collect()}
    for doc, text in docs.dropDuplicates(["doc_id"]).select("doc_id", "text").collect():
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {p for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)), doc
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_rules_compile_a_table(docs):
    m = rules.metrics(docs, "doc_id", "text")
    assert m.where(rules.compile_rules(())).count() == docs.count()
    kept = m.where(rules.compile_rules((rules.Rule("n_words", 5, 9), rules.Rule("n_symbols", None, 0))))
    assert kept.count() == m.where("n_words between 5 and 9 and n_symbols = 0").count()


def test_base_spans_equal_the_plain_patterns(docs):
    plain = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(digits):
        return sum(int(c) if k % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for k, c in enumerate(reversed(digits))) % 10 == 0

    def valid(kind, x):
        d = re.sub("[^0-9]", "", x)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    got = pii.find(docs).select("doc_id", pii.written(F.col("base")).alias("base")).collect()
    expected = []
    for doc, text in docs.select("doc_id", "text").collect():
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(plain) for m in re.finditer(p, text or "") if valid(kind, m[0]))
        expected.append((doc, ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)))
    assert Counter(map(tuple, got)) == Counter(expected)


TERM = regex.compile(r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})")


def risky_terms(rows, generalise_at=0.8, remove_at=0.95, prior=2.0):
    """By brute force: for each (text, base spans) the spans (start, end, kind, of) of terms."""
    texts, outside, kinds, values = [], [], [], []
    for text, spans in rows:
        text, cover = text or "", text or ""
        for x in spans:
            cover = cover[: x.start] + "0" * (x.end - x.start) + cover[x.end :]
        texts.append({m[0].lower() for m in TERM.finditer(text)})
        outside.append([(m.start(), m.end(), m[0].lower()) for m in TERM.finditer(cover)])
        kinds.append({x.kind for x in spans})
        values.append({(x.kind, re.sub("[^0-9]", "", x.value) if x.kind in ("card", "phone") else x.value.lower()) for x in spans})
    n, n_t = len(rows), Counter(t for ts in texts for t in ts)
    all_of, both = Counter(), Counter()
    for out, ks, vs in zip(outside, kinds, values):
        protected = list(ks) + list(vs)
        all_of.update(protected)
        both.update((t, e) for t in {w for *_, w in out} for e in protected)

    def told(t, e):
        if all_of[e] < 2 or all_of[e] == n:
            return 0.0
        q = (all_of[e] - 1) / (n - 1)
        return max(0.0, math.log((both[t, e] - 1 + prior * q) / (n_t[t] - 1 + prior) / q) / -math.log(q))

    found = []
    for out, ks, vs in zip(outside, kinds, values):
        mine = []
        for t in {w for *_, w in out} if vs else ():
            d, of = max([(told(t, k), k) for k in ks] + [(told(t, v), v[0]) for v in vs if n_t[t] > 1])
            if d >= generalise_at:
                mine += [(s, e, "term" if d >= remove_at else "general", of) for s, e, w in out if w == t]
        found.append(sorted(mine))
    return found


def test_risky_terms_equal_brute_force(spark, docs):
    """Names beside a value in several documents, beside a kind, in repeated rows, and in copies."""
    filler = lambda i: " ".join(f"f{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}" for k in range(8))
    planted = [(7000 + i, f"Ng wrote {filler(i)} and Zyxwvut Ng called jo@x.org, then NG left {filler(i)}") for i in range(6)]
    planted += [(7100 + i, f"{filler(i)} Qwertz has j{i}@x.org or +49 (30) 1234{i:03d}, Qwertz said") for i in range(12)]
    planted += [(7400 + i, f"the key {filler(i)} yxcvb token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" aAbBcCdDeEfFgG1H2I3J4kKlL in use, {'A1' * 20} {'x1y2' * 200}") for i in range(5)]
    planted += [(7200, "Twice told by Asdfgh to asd@x.org")] * 3 + [(7300 + i, f"nobody {filler(i)} wrote of it") for i in range(40)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string")).withColumn("n", F.lit("clash"))
    found = pii.find(rows).collect()
    texts = {}
    for i, t in rows.select("doc_id", "text").collect():
        texts.setdefault(i, t)
    secret = regex.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])")
    good = lambda v: len(re.findall("[0-9]", v)) >= 4 and len(re.findall("[A-Za-z]", v)) >= 4 and len(set(v)) >= 8
    secrets = [[Row(start=m.start(), end=m.end(), kind="secret", value=m[0]) for m in secret.finditer(texts[r.doc_id] or "") if good(m[0])] for r in found]
    assert [[(s.start, s.end) for s in r.added if s.kind == "secret"] for r in found] == [[(x.start, x.end) for x in mine] for mine in secrets]
    assert all(len(mine) >= 2 for r, mine in zip(found, secrets) if r.doc_id is not None and 7400 <= r.doc_id < 7405)
    spans = [[*r.base, *mine] for r, mine in zip(found, secrets)]
    expected = risky_terms([(texts[r.doc_id], mine) for r, mine in zip(found, spans)])
    got = [sorted((s.start, s.end, s.kind, s.of) for s in r.added if s.kind != "secret") for r in found]
    assert got == expected
    by_id = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.added} for r in found}
    assert {"Ng", "NG", "Zyxwvut"} <= by_id[7000] and "Qwertz" in by_id[7100] and "Asdfgh" in by_id[7200] and not by_id[7300]
    clean = Counter(r.text for r in pii.sanitise(rows).collect())
    for r, marks, terms in zip(found, spans, expected):
        out, at, text = [], 0, texts[r.doc_id]
        named = [(x.start, list(pii.PATTERNS).index(x.kind), x.end, f"[{x.kind.upper()}]") for x in marks]
        for s, _, e, label in sorted(named + [(s, 99, e, "" if kind == "term" else f"[{of.upper()} TERM]") for s, e, kind, of in terms]):
            out += [text[at:s], label] if s >= at else []
            at = max(at, e)
        clean[text if text is None else "".join(out) + text[at:]] -= 1
    assert not any(clean.values())


def test_sanitise_keeps_columns_and_takes_long_texts(spark):
    long = "".join(f"a{i}@x.org, é " if i % 3 else f"word{chr(97 + i % 26)} 10.0.0.{i % 300} " for i in range(130_000))
    rows = spark.createDataFrame([(1, long), (2, None), (None, "b@y.org")], "doc_id long, text string").withColumn("base", F.lit("clash"))
    started = time.time()
    clean = pii.sanitise(rows)
    out = {r.doc_id: r for r in clean.collect()}
    assert time.time() - started < 120  # 2 MB with 130,000 spans
    plain = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", long)
    plain = re.sub(r"[0-9]+(\.[0-9]+){3}", lambda m: "[IP]" if all(int(x) < 256 for x in m[0].split(".")) else m[0], plain)
    assert out[1].text == plain and out[2].text is None and out[None].text == "[EMAIL]" and out[1].base == "clash"
    assert clean.columns == rows.columns and pii.sanitise(rows.limit(0)).count() == 0


def test_bpe_equals_the_tokenizer(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.vocabulary())
    got = bpe.round_trip(docs, chunk_words=500, with_text=True).collect()
    expected = Counter()
    for doc, text in docs.select("doc_id", "text").collect():
        ids = model.encode(text or "", add_special_tokens=False).ids
        back = model.decode(ids, skip_special_tokens=False)
        expected[(doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in got) == expected


def test_pieces_come_by_id(spark):
    pieces = {r.id: r.piece for r in bpe.piece_table(spark).collect()}
    rows = spark.createDataFrame([(1, "hello world"), (2, "zzyzx"), (3, "")], "doc_id long, text string")
    back = {r.doc_id: r for r in bpe.round_trip(rows, with_ids=True, with_text=True).collect()}
    assert all(r.decoded == " ".join(pieces[i] for i in r.ids) for r in back.values())
    assert back[3].decoded == "" and back[2].decoded.replace(" ", "").replace("</w>", "") == "zzyzx"


def test_mixing_meets_its_targets(spark):
    docs = spark.createDataFrame([(i, "a b c d e", "big" if i % 4 else f"s{i % 3}", None if i % 7 == 0 else "en") for i in range(4000)], "doc_id long, text string, source string, lang string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    want = {"source": {"big": 0.4, "s0": 0.2, "s1": 0.2, "s2": 0.2}}
    rows = mixing.sample(docs, dims, targets=want, budget=0.3, sweeps=20)
    share = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum(F.col("probability") * F.col("n_tokens")).alias("t")).collect()}
    total = sum(share.values())
    assert all(abs(share[k] / total - v) < 0.01 for k, v in want["source"].items())
    kept = rows.where("selected").groupBy("source").count().collect()
    assert all(abs(r["count"] * 5 - share[r["source"]]) < 6 * share[r["source"]] ** 0.5 + 30 for r in kept)
    assert rows.count() == 4000 and mixing.sample(docs.limit(0), dims).count() == 0


def test_mixing_with_targets_that_cannot_be_met(spark):
    rows = [(i, "x y z", "ab"[i % 2], f"l{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    out = mixing.sample(docs, dims, targets={"source": {"a": 1.0, "gone": 1.0}}).collect()
    assert all(r.selected == (r.source == "a") or r.source == "a" for r in out)
    assert {r.probability for r in out if r.source == "b"} == {0.0}


def test_mixing_with_targets_of_nothing(spark):
    docs = spark.createDataFrame([(1, "x y", "a"), (2, "z", "b"), (3, "", "a"), (4, "", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.probability, r.selected) for r in mixing.sample(docs, {"source": F.col("source")}, targets={"source": {"a": 0.0, "b": 0.0}}).collect()}
    assert got == {1: (0.0, False), 2: (0.0, False), 3: (0.0, False), 4: (1.0, True)}


def test_secrets_of_any_length_are_found(spark):
    lengths = [24, 504, 512, 513, 5_000, 300_000]
    rows = [(n, "the key is " + ("aB3dE5fG7hJ9kL2mN4pQ6rS8t" * (n // 25 + 1))[:n] + " and no more") for n in lengths]
    got = {r.doc_id: [(s.start, s.end) for s in r.added if s.kind == pii.SECRET] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: [(11, 11 + n)] for n in lengths}


def test_mixing_tells_what_the_budget_keeps_it_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of("text")}
    cells = mixing.described(docs, dims).groupBy("dim_source", "dim_lang", "dim_topic").agg(F.sum("n_tokens").alias("n"))
    wanted = mixing.wanted_shares(cells, {k: f"dim_{k}" for k in dims}, 0.7)
    worst = {}
    for budget in (0.8, 0.05):
        told = mixing.residuals(mixing.sample(docs, dims, budget=budget), wanted).collect()
        for d in wanted:
            assert abs(sum(r.got for r in told if r.dim == d) - 1) < 1e-6 and abs(sum(r.target for r in told if r.dim == d) - 1) < 1e-6
        worst[budget] = max(abs(r.residual) for r in told)
    assert worst[0.05] < 1e-3 < worst[0.8]


def test_mixing_few_cells_takes_few_jobs(spark, monkeypatch):
    rows = [(i, "a b c " * (1 + i % 5), "xyz"[i * i % 3], f"l{i * 7 % 11 % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")

    def mixed(group):
        spark.sparkContext.setJobGroup(group, group)
        got = mixing.sample(docs, {"source": F.col("source"), "lang": F.col("lang")}).select("doc_id", "probability", "selected").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return sorted(got), jobs

    few, jobs = mixed("few-cells")
    monkeypatch.setattr(mixing, "CELLS_A_TASK", 2)
    dealt, more = mixed("many-cells")
    assert few == dealt and len(few) == 400
    assert jobs <= 45 < more, (jobs, more)


def test_mixing_keeps_rows_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x", "b"), (3, "x", "b")], "doc_id long, text string, n string")
    rows = mixing.sample(docs.drop("n").withColumn("n", F.lit(1)).withColumn("source", F.lit("s")), {"source": F.col("source")}).collect()
    assert len(rows) == 5 and all(r.selected for r in rows if not r.text)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert rules.judge(none).count() == 0
    assert pii.find(none).count() == 0
    assert bpe.round_trip(none).count() == 0
