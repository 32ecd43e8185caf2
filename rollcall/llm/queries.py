"""The queries of this package, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import alignment, bpe, classifier, codes, embeddings, html, lines, mixing, pii, rules, simhash, substrings, warc
from rollcall.llm.common import table
from rollcall.session import saved


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return rows.withColumnRenamed("component", "component_id")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = saved(warc.write_segments(table(spark, sf_dir, "pages", "page_id", "url", "html")), "warc")
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    rows = warc.read_segments(archives, with_payload=False)
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return classifier.score(docs, model).select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *[_of_kind(k) for k in pii.KINDS], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(pii.all_spans(F.col("base"), F.col("added"))).alias("spans"), F.size(F.filter("added", lambda x: x["kind"] == pii.SECRET)).cast("long").alias("n_secret"), F.size(F.filter("added", lambda x: x["kind"] != pii.SECRET)).cast("long").alias("n_term"))


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def mix_dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of("text")}


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return mixing.sample(docs, mix_dimensions()).select("doc_id", "source", "lang", F.col("dim_topic").alias("topic"), "n_tokens", "probability", "selected")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.compare(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")).drop("label")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to,
  true AS intact
FROM f
"""


def _op5_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
    ratio = {
        "mean_word_length": "word_chars / n_words",
        "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END",
        "stop_word_ratio": "n_stops / n_words",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "bullet_line_ratio": "CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END",
        "alpha_word_ratio": "n_alpha / n_words",
    }
    tests = [f"{ratio[r.metric]} {sign} {bound}" for r in rules.RULES for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullets,
        len(list_filter(w, lambda x: x IN ({stops}))) AS n_stops,
        len(regexp_extract_all(t, '[\\x20\\x09-\\x0D][^\\x20\\x09-\\x0D\\p{{L}}]*\\p{{L}}')) AS n_alpha
      FROM s LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {rules.BASE_WORDS} OR 100 * n_repeat_words > {rules.BASE_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {" AND ".join(tests)} END AS kept
FROM b
"""


def _op9_sql(power: float = 0.7, budget: float = 0.8, sweeps: int = 20, seed: int = 42) -> str:
    topic = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in mixing.TOPICS)
    none, dims = mixing.NONE, ("source", "lang", "topic")
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, CASE {topic} ELSE 'prose' END AS topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)",
        f"e AS MATERIALIZED (SELECT *, coalesce(source, '{none}') AS d_source, coalesce(lang, '{none}') AS d_lang, topic AS d_topic FROM d)",
        "c AS MATERIALIZED (SELECT d_source, d_lang, d_topic, sum(n_tokens)::DOUBLE AS n FROM e GROUP BY ALL HAVING sum(n_tokens) > 0)",
        *[f"t_{x} AS MATERIALIZED (SELECT d_{x}, pow(m, {power}) / sum(pow(m, {power})) OVER () AS target FROM (SELECT d_{x}, sum(n) AS m FROM c GROUP BY ALL))" for x in dims],
        "w0 AS MATERIALIZED (SELECT d_source, d_lang, d_topic, n / (SELECT sum(n) FROM c) AS share, n / (SELECT sum(n) FROM c) AS w FROM c)",
    ]
    last = "w0"
    for k in range(sweeps):
        for x in dims:
            ctes.append(f"w{k}_{x} AS MATERIALIZED (SELECT d_source, d_lang, d_topic, share, w * target / sum(w) OVER (PARTITION BY d_{x}) AS w FROM {last} JOIN t_{x} USING (d_{x}))")
            last = f"w{k}_{x}"
        ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT d_source, d_lang, d_topic, share, least(w, share / {budget}) AS w FROM {last})")
        last = f"w{k + 1}"
    ctes.append(f"p AS (SELECT e.*, floor(coalesce(least(1.0, {budget} * w / share), 1.0) * 1e6 + 0.5) / 1e6 AS probability FROM e LEFT JOIN {last} USING (d_source, d_lang, d_topic))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, n_tokens, probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '{none}')), 1, 12))::BIGINT / 281474976710656.0 < probability AS selected
FROM p"""


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """A table of parts and of codebooks for each round; every part meets its codebook's entries."""
    ctes = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM k, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v QUALIFY e < {entries})",
    ]
    square = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT vec_id, v.p, e, {square} AS d FROM v JOIN b{r} b USING (p)) GROUP BY ALL)")
        if r < rounds:
            ctes.append(f"s{r} AS MATERIALIZED (SELECT p, e, i, floor_div AS c FROM (SELECT p, m.e AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM a{r} JOIN v USING (vec_id, p), unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL))")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT p, e, list(c::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY ALL) n USING (p, e))")
    return "WITH " + ",\n".join(ctes) + f""",
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


OP13_SQL = """
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(k.doc_id = r.last, true) AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_round_trip": OP2_SQL, "op5_quality_rules": _op5_sql(), "op9_source_mixing": _op9_sql(), "op12_vector_codes": _op12_sql(), "op13_line_dedup": OP13_SQL}
