"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import WORD


class Rule(NamedTuple):
    """A text passes if low <= metric <= high; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by from at or an not have which but he his they we you a i "
    "der die und das ist von den mit dem im ein eine nicht auf sich auch es an für zu als "
    "le la les de des et est un une que qui dans pour pas sur au avec du ou ce il elle en "
    "el los las del y se por con para una no lo su más como pero al"
).split()

#: Fixed values of the base verdict.
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50

#: The rules of the verdict, after the base ones.
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("alpha_word_ratio", 0.5, None),
)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more. Each window is a long: its hash, with
    the low bits (as many as the number of words needs) replaced by its position. Sorted, equal
    windows stand side by side; the full hashes of neighbours are then compared."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("_w")))) - 1
    at = lambda key: F.get("_h", key.bitwiseAND(F.col("_mask")).cast("int"))
    same = lambda x, y: (y.isNotNull()) & (x.bitwiseAND(F.bitwise_not("_mask")) == y.bitwiseAND(F.bitwise_not("_mask"))) & (at(x) == at(y))
    return mask, same


def metrics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with the base counts and the metrics that rules may name. Native
    expressions only, in projections over one scan: nothing is shuffled.

    Within one text, a 64-bit hash stands for a window of three words.
    """
    mask, same = _repeat_words()
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("_w")
    d = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    d = d.select("*", _split(F.col("_t")).alias("_w"), F.array_remove(F.split("_t", "\n", -1), "").alias("_l"))
    d = d.select("*", F.filter("_l", lambda x: x.rlike(WORD)).alias("_lines"), mask.alias("_mask"))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    d = d.select("*", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    d = d.select("*", F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")))).alias("_s"))
    twice = F.filter("_s", lambda x, i: same(x, F.get("_s", i + 1)) | same(x, F.get("_s", i - 1)))
    d = d.select("*", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("_mask")))).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    letters = F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", ""))
    stops = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    d = d.select(
        F.col("_id").alias(id_col),
        n.cast("long").alias("n_words"),
        letters.cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]"))).alias("_bullets"),
        F.size(F.filter("_w", lambda w: w.isin(*sorted(set(STOP_WORDS))))).alias("_stops"),
        F.regexp_count("_t", F.lit(r"[\x20\x09-\x0D][^\x20\x09-\x0D\p{L}]*\p{L}")).alias("_alpha"),
    )
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return d.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("_stops", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
        ratio("_bullets", "_n_lines").alias("bullet_line_ratio"),
        ratio("_alpha", "n_words").alias("alpha_word_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The rules as one boolean column; no rules keep everything."""
    keep = F.lit(True)
    for r in rules:
        if r.low is not None:
            keep &= F.col(r.metric) >= F.lit(r.low)
        if r.high is not None:
            keep &= F.col(r.metric) <= F.lit(r.high)
    return keep


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the base counts, base_failed and kept.

    base_failed: fewer than BASE_WORDS words, or more than BASE_REPEAT_PERCENT per cent of them in
    repeated 3-word windows. kept: not base_failed, and the threshold table passes. A null text has
    no words, so it is not kept; a text of any length is read whole, in time that grows with it but for the
    sorting of its windows; a metric that equals a bound passes; null ids and repeated rows keep their
    rows; extra columns are not read, whatever their names; an empty table gives no rows.
    """
    m = metrics(docs, id_col, text_col)
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    return m.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & compile_rules(rules)).alias("kept"),
    )
