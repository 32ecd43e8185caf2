"""The pipeline against a plain version of its stages on a small fixture."""

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_documents import risky_terms

import corpus_pipeline
from rollcall.llm import bpe, classifier, mixing

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


def base_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for k, c in enumerate(reversed(d))) % 10 == 0
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
        ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,512}+(?![A-Za-z0-9+/_-])", lambda x: len(digits(x)) >= 4 and len(re.sub("[^A-Za-z]", "", x)) >= 4 and len(set(x)) >= 8),
    ]
    return [Span(m.start(), m.end(), kind, m[0]) for kind, p, good in tests for m in re.finditer(p, text) if good(m[0])]


def masked(texts):
    """Base spans by kind; terms that give a kind or value away (see risky_terms) by [KIND TERM], or gone."""
    rank = ["email", "ip", "card", "phone", "secret"]
    spans = [base_spans(t) for t in texts]
    done = []
    for text, base, terms in zip(texts, spans, risky_terms(list(zip(texts, spans)))):
        marks = [(x.start, rank.index(x.kind), x.end, f"[{x.kind.upper()}]") for x in base]
        marks += [(s, len(rank), e, "" if kind == "term" else f"[{of.upper()} TERM]") for s, e, kind, of in terms]
        out, at = "", 0
        for s, _, e, label in sorted(marks):
            if s >= at:
                out += text[at:s] + label
            at = max(at, e)
        done.append(out + text[at:])
    return done


def raked(rows, power=0.7, budget=0.8, sweeps=20):
    """Selected rows (doc_id, text, source, lang)."""
    def topic(t):
        return next((name for name, mark in mixing.TOPICS if mark in t), "prose")

    keys = [(r[2], r[3], topic(r[1])) for r in rows]
    tokens = np.array([len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows], float)
    cells = sorted(set(keys))
    at = {c: k for k, c in enumerate(cells)}
    n = np.bincount([at[k] for k in keys], tokens, len(cells))
    share = n / n.sum()
    w = share.copy()
    for _ in range(sweeps):
        for d in range(3):
            names = sorted({c[d] for c in cells})
            of = np.array([names.index(c[d]) for c in cells])
            m = np.bincount(of, n, len(names)) ** power
            have = np.bincount(of, w, len(names))
            w = w * (m / m.sum() / have)[of]
        w = np.minimum(w, share / budget)
    p = np.floor(np.minimum(1, budget * w / share) * 1e6 + 0.5) / 1e6
    u = [int(hashlib.md5(f"42:{r[0]}".encode()).hexdigest()[:12], 16) / 2**48 for r in rows]
    return [r for r, k, x in zip(rows, keys, u) if x < p[at[k]]]


def test_pipeline_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in classifier.score(docs, model).where("score >= 0.3").collect()}
    rows = sorted((r.doc_id, r.text, r.source, r.lang) for r in docs.collect() if r.doc_id in kept)
    fps, root = [fingerprint(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    rows = [(r[0], text, *r[2:]) for r, text in zip(rows, masked([r[1] for r in rows]))]
    expected = {}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    for r in raked(rows):
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids
        expected[r[0]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, k):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "x y z", "en", "s", 5), (3, "clean words of a text " * 20, "en", "s", 440), (3, "clean words of a text " * 20, "en", "s", 440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("_id", "component", "score", "selected", "n_tokens", "_key", "base", "chance")})
    for d in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[k][1](spark, d, SF)
        assert out.count() <= d.count()
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == d.columns
