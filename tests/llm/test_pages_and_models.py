"""WARC, HTML, the classifier and vectors."""

import hashlib
import math
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rollcall.llm import classifier, embeddings, html, queries, warc
from rollcall.operators import components

SF = "/root/testdata/sf0.01"


def test_warc_round_trip(spark):
    same = "y" * 150
    rows = [(10, None, same), (9, "http://a/ b\r\nX: 1", same), (11, "u", None), (12, "u", ""), (13, "u", "short"), (14, "u", "short"), (15, "u", same), (16, "u", "é\r\n\r\n" * 50), (17, "u", "z" * 3_000_000), (None, "u", same), (15, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("name", F.lit("clash"))
    for size in (1, 1 << 20):
        got = warc.read_segments(warc.write_segments(pages, segment_bytes=size)).collect()
        assert len(got) == len(rows) and all(r.intact for r in got)
        for r in got:
            key = r.record_id.rpartition(":")[2]
            raw = next((h or "").encode() for i, _, h in rows if str(i if i is not None else "null") == key)
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            if raw == same.encode() and key not in ("9", "null"):
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", "urn:page:9", None)
            else:
                assert (r.record_type, r.refers_to, r.payload) == ("response", None, raw)
    assert warc.write_segments(pages.limit(0)).count() == 0


def test_warc_damage_is_seen():
    one, two = warc.record("response", "urn:page:1", "u", b"abc" * 50), warc.record("response", "urn:page:2", "u", b"xyz" * 50)
    assert [r.intact for r in warc.read_records(one + two)] == [True, True]
    assert [r.intact for r in warc.read_records(one + two[:-20])] == [True, False]
    assert not all(r.intact for r in warc.read_records(one[:60] + bytes([one[60] ^ 1]) + one[61:]))
    assert list(warc.read_records(b"")) == []


def test_warc_reads_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.record("response", "urn:page:1", "u", b"abc"))
    rows = warc.read_segments(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.record_id, bytes(r.payload)) for r in rows] == [("urn:page:1", b"abc")]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(warc.record("response", f"urn:page:{k}", "u", b"x" * 300_000) for k in range(50)))
    paths = spark.createDataFrame([(str(tmp_path / "b.warc.gz"),), (None,), ((tmp_path / "a.warc.gz").as_uri(),)], "path string")
    for with_payload in (True, False):
        rows = warc.read_files(paths, with_payload=with_payload).collect()
        assert len(rows) == 51 and all(r.intact for r in rows) and sum(r.payload_bytes for r in rows) == 15_000_003


def test_warc_query_takes_odd_rows(spark, tmp_path):
    rows = [(None, "u", "n" * 200), (None, "u", "n" * 200), (1, None, None), (2, "u", "n" * 200), (3, "u", "é" * 2_000_000), (3, "u", "é" * 2_000_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op2_warc_round_trip(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (0, 200, "response", 0), (0, 200, "response", 0), (1, 0, "response", 0), (2, 200, "response", 0), (3, 4_000_000, "response", 0), (3, 4_000_000, "response", 0)
    ]
    assert all(r.intact for r in got)


PAGE = """<html><head><title>T &amp; x</title><script>var a="</p>";</script></head><body>
<header><p>Site name, with a slogan, and more of it here</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many cookies, and very many more cookies than that.</p></div>
<article><h1>Head&shy;line</h1><p>First paragraph, which is <b>long</b>&nbsp;enough,\n with   commas.<p>Second &lt;one&gt; is short<br>too.
<form><input value=x><button>Send</button></form><ul><li>item one<li>item two</ul>
<div class="ad">Buy this, and that, and everything else that we sell here.</div><script>if (a < b) {}</script></article>
<section id="comments"><p>Great article, thank you, I have read it twice, really.</p></section>
<aside><p>Related, other, further, things that are not part of it at all.</p></aside><footer>(c) 2026, all rights</footer></body></html>"""


def test_main_text_of_an_article():
    assert html.main_text(PAGE) == "Head\xadline\n\nFirst paragraph, which is long enough, with commas.\n\nSecond <one> is short too.\n\nitem one\n\nitem two"


def test_main_text_without_article_element():
    page = "<body><div class=menu><a href=a>One</a> <a href=b>Two</a></div><div id=page><div><p>Text that matters, quite long, with commas.</p><p>More of that text, also long, also with commas.</p></div><div class=sidebar><p>Not this, never this, however long it may be.</p></div></div>"
    assert html.main_text(page) == "Text that matters, quite long, with commas.\n\nMore of that text, also long, also with commas."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a &lt;b&gt; &amp c", "a <b> & c"), ("<p", "<p"), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"), ("<article><p>x<!-- y --> z</p><style>p{}</style></article>", "x z")])
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


LONG = "This is a paragraph of text, quite long, with commas in it. "


@pytest.mark.parametrize(
    "page,text",
    [
        ("İ" * 30 + f"<script>x()</script><p>{LONG}</p>", "İ" * 30 + "\n\n" + LONG.strip()),
        (f'<body><form id="aspnetForm"><div><p>{LONG * 3}</p></div><input value=x></form></body>', (LONG * 3).strip()),
        (f'<body><div class="entry-header"><h1>Title</h1></div><p>{LONG * 3}</p><p>{LONG}</p></body>', f"Title\n\n{(LONG * 3).strip()}\n\n{LONG.strip()}"),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p></article><form><p>Write a comment, please, here</p></form><div class="comments"><p>{LONG * 9}</p></div>', LONG.strip()),
        (f'<div class="widget"><div><p>{LONG * 2}</p></div></div>', (LONG * 2).strip()),
    ],
)
def test_main_text_keeps_what_is_the_articles_own(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("bad", ["<a ", '<a x="', "<a '\">", "<div>" * 4 + "</section>" * 3, "<b><div></div>text", "<!--", "<", "<form>", "<p><li>x", "</b>", "<table><td>"])
def test_broken_pages_take_time_in_proportion(bad):
    started = time.time()
    html.main_text(bad * (1_000_000 // len(bad)))
    assert time.time() - started < 8


TEXT = "A paragraph of some length, with commas, that is the text of the page."
READER = "A reader says something that is long, with commas, so that it would count."


@pytest.mark.parametrize("depth", [1, 8, 9, 50, 3000])
def test_text_inside_many_marked_elements_is_kept(depth):
    for mark in ('<div class="widget">', '<div id="sidebar">', "<form>"):
        page = mark * depth + f"<p>{TEXT}</p>" + "</div></form>" * depth
        assert html.main_text(page) == TEXT


def test_of_marked_elements_the_one_with_most_text_is_kept():
    page = f'<div class="menu">short</div><div class="widget"><div class="promo"><p>{TEXT}</p></div><div class="ad">tiny</div></div>'
    assert html.main_text(page) == TEXT


@pytest.mark.parametrize("comments", [1, 3, 6, 40])
def test_comments_of_readers_are_left_out_however_many(comments):
    post = '<div class="post">' + f"<p>{TEXT}</p>" * 3 + "</div>"
    marked = "".join(f'<article class="comment"><p>{READER}</p></article>' for _ in range(comments))
    plain = "".join(f"<article><p>{READER}</p></article>" for _ in range(comments))
    wanted = "\n\n".join([TEXT] * 3)
    for tail in (f'<div id="comments">{marked}</div>', marked, f'<section class="comment-list">{plain}</section>', f'<div id="disqus_thread">{plain}</div>'):
        assert html.main_text(f"<body>{post}{tail}</body>") == wanted
    assert html.main_text(f'<body class="has-comments"><article><h1>T</h1><p>{TEXT}</p><div class="comments">{marked}</div></article></body>') == f"T\n\n{TEXT}"
    # a wrapper that holds the title is the page, whatever its class says
    assert html.main_text(f'<div class="post with-comments"><h1>T</h1><p>{TEXT}</p></div>') == f"T\n\n{TEXT}"


@pytest.mark.parametrize("broken", ["", "<a title='x>z</a> "])
def test_quotes_count_after_a_broken_one(broken):
    """A ">" in quotes ends no tag, also where a quote before never closes."""
    page = f'<p>{broken}</p><div class="ad" data-x="1 > 0"><p>{READER}</p></div><p>{TEXT}</p>'
    assert html.main_text(page).endswith(TEXT) and READER not in html.main_text(page) and '0"' not in html.main_text(page)


def test_tag_ends_equal_a_plain_scan():
    rng = np.random.default_rng(11)

    def plain(source, at):
        first, quote = at, None
        while at < len(source):
            c = source[at]
            at += 1
            if quote:
                quote = None if c == quote else quote
            elif c == ">":
                return at
            elif c in "\"'":
                quote = c
        return source.find(">", first) + 1

    for _ in range(400):
        source = "".join(rng.choice(list("<a>\"' x"), rng.integers(1, 60)))
        ends = html._TagEnds(source)
        for at in rng.integers(0, len(source), 10).tolist():
            assert ends.find(at) == plain(source, at)


def test_urls_of_any_length_go_round(spark):
    url = "http://a/" + "x" * 2_500_000
    pages = spark.createDataFrame([(1, url, "y" * 200), (2, url, "y" * 200), (3, "u", "z")], "page_id long, url string, html string")
    got = {r.record_id: r for r in warc.read_segments(warc.write_segments(pages)).collect()}
    assert {k: (r.payload_bytes, r.record_type, r.intact) for k, r in got.items()} == {"urn:page:1": (200, "response", True), "urn:page:2": (200, "revisit", True), "urn:page:3": (1, "response", True)}
    made = warc.record("response", "urn:page:1", url, b"p")
    assert next(iter(warc.read_records(made))).fields["warc-target-uri"] == url


def test_classifier_takes_a_bounded_sample(spark):
    """One text for each labelled id, however many rows share it, and no more bytes than told."""
    docs = spark.range(100_000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(" of many words in a text ")).alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    seen = []
    plain = classifier._dictionary

    def counted(texts, size):
        seen.append(texts)
        return plain(texts, size)

    classifier._dictionary = counted
    try:
        classifier.fit(docs, labels)
        assert sum(map(len, seen)) <= 40 and all(len(set(t)) == len(t) for t in seen)
        seen.clear()
        classifier.fit(docs, labels, sample_bytes=200)
        assert sum(len(x) for t in seen for x in t) <= 2 * 200
    finally:
        classifier._dictionary = plain


def test_pivots_are_bounded_by_bytes(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=1024)], 1) for k in range(60)]
    classes = spark.createDataFrame(rows, "class long, vec array<double>, label int")
    found = embeddings.choose_pivots(classes, 50, 1024, most_bytes=20 * 8 * 1024)
    assert {d: x.shape for d, x in found.items()} == {1024: (20, 1024)}
    assert np.allclose(np.linalg.norm(found[1024], axis=1), 1)
    mixed = classes.limit(5).union(spark.createDataFrame([(99, [1.0, 2.0], 1)], "class long, vec array<double>, label int"))
    assert sorted(embeddings.choose_pivots(mixed, 50, 1024)) == [2, 1024]
    assert embeddings.choose_pivots(classes.limit(0), 50) == {}


def plain_main_text(tree):
    """The definition of the score, on a tree of (tag, children) and paragraphs (tag, text, linked characters)."""
    flat = []

    def walk(node, up):
        me = len(flat)
        flat.append((node, up))
        for child in node[1] if isinstance(node[1], list) else ():
            walk(child, me)

    walk(("html", [tree]), 0)
    under = lambda k, top: k == top or (k > 0 and under(flat[k][1], top))
    points, score = [0.0] * len(flat), []
    for (node, up) in flat:
        if isinstance(node[1], str) and len(node[1]) >= 25 and node[0] == "p":
            k = up
            for share in (1, 1 / 2, 1 / 6, 1 / 9):
                points[k] += share * (1 + node[1].count(",") + min(len(node[1]) // 100, 3))
                if k == 0:
                    break
                k = flat[k][1]
    size = [[sum(len(n[1]) for j, (n, _) in enumerate(flat) if isinstance(n[1], str) and under(j, k)), sum(n[2] for j, (n, _) in enumerate(flat) if isinstance(n[1], str) and under(j, k))] for k in range(len(flat))]
    score = [p * (1 - links / max(chars, 1)) for p, (chars, links) in zip(points, size)]
    best = max(range(len(flat)), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        best = 1
    kept = {best}
    if flat[best][0][0] not in ("body", "html"):
        for k, (node, up) in enumerate(flat):
            if k and up == flat[best][1]:
                chars, links = size[k]
                short = node[0] == "p" and chars > 0 and (links == 0 or chars > 80 and links / chars < 0.25)
                if score[k] >= max(10, score[best] / 5) or node[0] == "h2" or short:
                    kept.add(k)
    return "\n\n".join(n[1] for j, (n, _) in enumerate(flat) if isinstance(n[1], str) and any(under(j, k) for k in kept))


def test_main_text_equals_the_plain_score_on_pages_without_article():
    rng = np.random.default_rng(8)

    def grown(depth):
        if depth and rng.random() < 0.55:
            return ("div", [grown(depth - 1) for _ in range(rng.integers(1, 5))])
        text = " ".join("word" + "," * int(rng.random() < 0.2) for _ in range(rng.integers(1, 60)))
        return ("h2", text, 0) if rng.random() < 0.1 else ("p", text, int(rng.random() < 0.3) * (len(text) // int(rng.integers(1, 5))))

    def marked(node):
        if isinstance(node[1], list):
            return f"<{node[0]}>{''.join(map(marked, node[1]))}</{node[0]}>"
        linked = node[1][: node[2]].rstrip()
        return f"<{node[0]}>" + (f"<a href=x>{linked}</a>" if linked else "") + f"{node[1][len(linked):]}</{node[0]}>"

    def measured(node):  # links count without the space that ends them
        return (node[0], [measured(x) for x in node[1]]) if isinstance(node[1], list) else (node[0], node[1], len(node[1][: node[2]].strip()))

    for _ in range(300):
        tree = ("body", [grown(3) for _ in range(rng.integers(1, 6))])
        assert html.main_text(marked(tree)) == plain_main_text(measured(tree))


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert html.extract(pages.limit(0)).count() == 0
    rows = html.extract(pages).collect()
    assert sorted(r.n_chars for r in rows)[0] == 0 and len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows)


def test_classifier_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs, model).join(labels, "doc_id").where(classifier.held_out()).select("quality", "score").toPandas()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.85
    assert (good >= 0.3).mean() > 0.95 and (bad >= 0.3).mean() < 0.3
    held = labels.where(classifier.held_out())
    flipped = labels.join(held.select("doc_id").withColumn("h", F.lit(1)), "doc_id", "left").select("doc_id", F.when(F.col("h") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    assert classifier.fit(docs, flipped) == model


def test_scores_equal_the_plain_formula(spark):
    """Whole texts, piece by piece: the sizes with each dictionary, what they tell, and the curve."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = classifier.fit(docs, labels)
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "long text, " * 40_000), (-2, ""), (-3, None)], "doc_id long, text string")).withColumns({c: F.lit("clash") for c in ("good", "weights")})
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    for r in classifier.score(rows, model).collect():
        raw, sizes = texts[r.doc_id], {}
        for name, words in (("good", model.good), ("bad", model.bad)):
            press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(press.compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096))
        told = [0.0, 0.0, 0.0, 1.0]
        if raw:
            fall = min(0.0, math.log(min(sizes.values()) / len(raw)))
            told = [(sizes["bad"] - sizes["good"]) / max(sizes.values()), fall, fall**2, 1.0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(told, model.weights)))))), abs=1e-9)
    assert classifier.score(rows.limit(0), model).count() == 0


def test_classifier_on_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string").withColumn("score", F.lit(1))
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(scale=0.05, size=16)).astype("float32").tolist(), int(i % 2)) for i in range(400)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(30)] + [(-1, None, 1), (-2, [0.0] * 16, 1), (-3, [1.0] * 16, None), (-4, [float("nan")] * 16, 1), (-5, [1.0, 2.0], 1), (-6, [2.0, 4.0], 1), (-7, [1.0, None], 1), (-8, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("dim", F.lit(2))
    for block_rows in (16, 1024):
        got = {r.vec_id: (r.n_links, r.component) for r in embeddings.near_duplicates(table, block_rows=block_rows).collect()}
        good = [(i, np.array(v, float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
        links, up = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, (i, x, k) in enumerate(good):
            for j, y, m in good[:a]:
                if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(i), root(j)
                    up[max(p, q)] = min(p, q)
        found, exact = sum(n for n, _ in got.values()), sum(links.values())
        assert all(got[i][0] <= links[i] for i in links) and found >= 0.9 * exact
        assert all(got[i] == (0, i) for i in (-1, -2, -3, -4, -7, -8)) and got[-5] == (1, -6) == (got[-6][0], got[-6][1])
        if found == exact:
            assert all(got[i][1] == root(i) for i in links)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_vectors_are_found_at_the_values_of_the_query(spark):
    """Recall by brute force on planted pairs just above the bound, and how many pairs are verified."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    c = rng.uniform(0.9801, 0.995, size=(3000, 1))
    y = c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([x, y]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert np.mean([got[k + 3000].component == k and got[k].n_links == 1 for k in range(3000)]) >= 0.95
    assert sum(r.n_links for r in got.values()) <= 6000
    classes = table.select(F.col("vec_id").alias("class"), F.col("embedding").alias("vec"), "label")
    described = embeddings.describe(classes, embeddings.choose_pivots(classes, embeddings.pivot_count(6000, 128, 65_536)), 8)
    posts = embeddings.candidates(described, 3, 1024).distinct()
    assert posts.count() < 4 * 6000  # of 8 * 6000 posts


def test_vectors_with_repeated_ids_and_tiny_values(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [1e-200] * 2, 2), (4, [2e-200] * 2, 2), (None, [1.0, 0.0], 3), (5, [1.0, 0.001], 3)]
    got = sorted((r.vec_id or 0, r.n_links, r.component, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(0, 1, 5, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True)]


def test_vectors_never_pass_whole_through_the_driver(spark, monkeypatch):
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (embeddings, components):
        monkeypatch.setattr(module, "saved", lambda df, name, keep=module.saved: (plans.append(plan(df)), keep(df, name))[1])
    plans.append(plan(embeddings.near_duplicates(spark.read.parquet(f"{SF}/embeddings.parquet"))))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
