"""Personal data: spans by pattern, and terms that give a protected entity away.

The second part follows information-theoretic sanitisation: how much of an entity's information a
term carries is estimated from how often both occur together in the corpus, as the ratio of their
pointwise mutual information to the entity's own information. DataFrame functions only.

Spans of one text are worked on in blocks, so that time grows with the length of a text and not with
its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import unused
from rollcall.session import saved

#: The kinds in the order in which they are listed, with patterns that find the same
#: leftmost matches as the contract's. Possessive repeats and the look-behind only keep the search
#: from trying again inside a run of characters in which it must fail.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Beside these, keys and tokens: a run of 24 or more characters as they are made of, that holds letters and
#: digits in numbers (see _valid). It is protected like the others, but no base kind.
SECRET = "secret"
PATTERNS = KINDS | {SECRET: r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A term: a whole run of letters, beside which no digit stands.
TERM = r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"
#: Elements of an array that are folded, or cut from a text, at a time.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_blocks(items: Column, each: Callable[[Column], Column]) -> Column:
    """each of every block of an array, in order."""
    n = F.size(items)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: each(F.slice(items, k, F.lit(BLOCK))))


def before(numbers: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints the sum (or maximum, by add) of those before it, 0 at first.
    Each block is folded by itself, then the blocks' results are folded, since a fold copies the
    array that it builds."""

    def fold(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda s, x: F.struct(add(s["at"], x).cast("int").alias("at"), F.array_append(s["out"], s["at"]).alias("out")))

    def joined(blocks: Column) -> Column:
        base = fold(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(blocks, base, lambda b, o: F.transform(b["out"], lambda x: add(o, x).cast("int"))))

    return let(numbers, lambda v: let(_in_blocks(v, fold), joined))


def located(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost and non-overlapping: array of (start, end, value) with
    code-point offsets, zero-based, end exclusive. What lies between matches gives the offsets."""

    def placed(pairs: Column) -> Column:
        ends = before(F.transform(pairs, lambda p: p["gap"] + F.length(p["value"])), lambda x, y: x + y)
        return F.zip_with(pairs, ends, lambda p, e: F.struct((e + p["gap"]).alias("start"), (e + p["gap"] + F.length(p["value"])).alias("end"), p["value"].alias("value")))

    def paired(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return let(F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap"))), placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


def cut(text: Column, ranges: Column) -> Column:
    """The texts of ranges (from, to) that are in order and do not overlap. A block's stretch is cut out
    first and its ranges from there, since a substring is found by walking from the start."""

    def block(part: Column) -> Column:
        first = F.element_at(part, 1)["from"]
        stretch = F.struct(first.alias("at"), F.substring(text, first + 1, F.element_at(part, -1)["to"] - first).alias("text"))
        return let(stretch, lambda c: F.transform(part, lambda r: F.substring(c["text"], r["from"] - c["at"] + 1, r["to"] - r["from"])))

    return let(ranges, lambda r: F.flatten(_in_blocks(r, lambda part: let(part, block))))


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with each span (sorted by start) replaced by by(span, at), where `at` is the end of what
    was replaced before it, 0 at first."""

    def told(reach: Column) -> Column:
        pairs = F.zip_with(spans, reach, lambda x, at: F.struct(x.alias("x"), at.alias("at")))
        return let(pairs, joined)

    def joined(pairs: Column) -> Column:
        gaps = F.transform(pairs, lambda p: F.struct(p["at"].alias("from"), F.greatest(p["at"], p["x"]["start"]).alias("to")))
        last = F.element_at(pairs, -1)
        rest = F.substring(text, F.greatest(last["at"], last["x"]["end"]) + 1, F.length(text))
        pieces = F.zip_with(cut(text, gaps), pairs, lambda g, p: F.concat(g, by(p["x"], p["at"])))
        return F.concat(F.array_join(pieces, ""), rest)

    done = let(before(F.transform(spans, lambda x: x["end"]), F.greatest), told)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == SECRET:
        letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        return (n >= 4) & (letters >= 4) & (F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0)))) >= 8)
    return F.lit(True)


def pattern_spans(text: Column) -> Column:
    """array of (start, rank, end, kind, value) of all PATTERNS, by start, then kind as listed."""
    quick = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+"), SECRET: text.rlike("[A-Za-z0-9+/_-]{24}")}
    each = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        named = _named(located(text, pattern), rank, kind)
        each.append(F.when(quick[kind], named).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")))
    return F.array_sort(F.concat(*each))


def _named(found: Column, rank: int, kind: str) -> Column:
    good = F.filter(found, lambda x: _valid(kind, x["value"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _outside(text: Column, spans: Column) -> Column:
    """The text with each span overwritten by zeros, every other character in its place. No part of a
    word that touches a span is then taken for a term."""
    return replaced(text, spans, lambda x, at: F.repeat(F.lit("0"), F.greatest(F.lit(0), x["end"] - F.greatest(at, x["start"]))))


def _terms(text: str) -> Column:
    """The distinct terms of a column, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def disclosure(met: Column, term: Column, entity: Column, total: Column, prior: float) -> Column:
    """The share of an entity's information that a term gives away in one document, judged by the
    others: with one document taken from each count, p = (met - 1) / (term - 1), drawn towards the
    entity's own share q = (entity - 1) / (total - 1) as by `prior` documents, and ln(p / q) / ln(1 / q).
    1 means that the term is as good as the entity, 0 that it tells nothing. 0 where no other document
    has the entity, or all have it."""
    q = (entity - 1) / (total - 1)
    p = (met - 1 + prior * q) / (term - 1 + prior)
    known = (entity > 1) & (entity < total) & (met > 0)
    return F.when(known, F.greatest(F.lit(0.0), F.log(p / q) / -F.log(q))).otherwise(0.0)


def _risks(read: DataFrame, holders: DataFrame, generalise_at: float, remove_at: float, prior: float) -> DataFrame:
    """(_at, terms): for rows of holders (_at, base, entities, outside) that have such terms, their spans
    (start, rank, end, kind, of): kind "general" or "term", of: the kind of what the term gives away. read
    has the texts of all documents (_text)."""
    kinds = list(PATTERNS)
    has = lambda k: F.exists("base", lambda x: x["kind"] == k)
    total = read.agg(F.count("*").alias("n"))
    of_kind = holders.agg(*[F.count_if(has(k)).alias(f"all_{k}") for k in kinds])
    held = holders.select("_at", F.explode("entities").alias("entity"))
    of_entity = held.groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e > 1")
    again = saved(held.join(of_entity, "entity").groupBy("_at").agg(F.collect_list(F.struct("entity", "n_e")).alias("again"), F.max("n_e").alias("most")), "pii-again")
    most = again.agg(F.coalesce(F.max("most"), F.lit(0)).alias("top"))

    near = holders.select("_at", F.explode(_terms("outside")).alias("term"), *[has(k).alias(f"has_{k}") for k in kinds])
    of_term = read.select(F.explode(_terms("_text")).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    beside = near.groupBy("term").agg(*[F.count_if(f"has_{k}").alias(f"n_{k}") for k in kinds])
    n, n_t = F.col("n"), F.col("n_t")
    by_kind = {k: disclosure(F.col(f"n_{k}"), n_t, F.col(f"all_{k}"), n, prior) for k in kinds}
    # a pair that cannot reach the bound even if it met as often as it could is left out; over all entities
    # of up to `most` documents, those that are met wherever the term stands disclose most
    reach = lambda n_e: (n_t > 1) & (disclosure(F.least(n_e, n_t), n_t, n_e, n, prior) >= generalise_at)
    some = lambda most: reach(F.least(most, n_t))
    told = beside.join(of_term, "term").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(of_kind)).crossJoin(F.broadcast(most))
    told = told.select("term", "n_t", "n", *[d.alias(f"d_{k}") for k, d in by_kind.items()], some(F.col("top")).alias("paired"))
    told = told.where(" or ".join(["paired", *[f"d_{k} >= {generalise_at}" for k in kinds]]))
    worst = F.greatest(*[F.struct(F.when(F.col(f"has_{k}"), F.col(f"d_{k}")).otherwise(0.0).alias("d"), F.lit(k).alias("of")) for k in kinds])
    met = saved(near.join(told, "term").select("_at", "term", "n_t", "n", "paired", worst.alias("worst")), "pii-met")

    pairs = met.where("paired").join(again, "_at").where(some(F.col("most"))).select("_at", "term", "n_t", "n", F.explode("again").alias("e")).select("_at", "term", "n_t", "n", "e.entity", "e.n_e").where(reach(F.col("n_e")))
    pairs = saved(pairs, "pii-pairs")
    both = pairs.groupBy("term", "entity", "n_t", "n_e", "n").agg(F.count("*").alias("n_te"))
    risky = both.select("term", "entity", disclosure(F.col("n_te"), n_t, F.col("n_e"), n, prior).alias("d")).where(F.col("d") >= generalise_at)
    by_value = pairs.join(risky, ["term", "entity"]).select("_at", "term", F.struct("d", F.substring_index("entity", ":", 1).alias("of")).alias("worst"))
    found = met.where(F.col("worst.d") >= generalise_at).select("_at", "term", "worst").union(by_value).groupBy("_at", "term").agg(F.max("worst").alias("worst"))
    kind = F.when(F.col("worst.d") >= remove_at, F.lit("term")).otherwise(F.lit("general"))
    risks = saved(found.select("_at", "term", kind.alias("kind"), F.col("worst.of").alias("of")), "pii-risks")

    words = holders.join(risks.select("_at").distinct(), "_at", "left_semi").select("_at", F.explode(located(F.col("outside"), TERM)).alias("t"))
    spots = words.select("_at", F.lower("t.value").alias("term"), "t.start", "t.end").join(risks, ["_at", "term"])
    return spots.groupBy("_at").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(PATTERNS)).alias("rank"), "end", "kind", "of"))).alias("terms"))


#: The type of the spans of terms, for rows that have none.
NO_TERMS = "array<struct<start:int,rank:int,end:int,kind:string,of:string>>"


def _spotted(read: DataFrame, *keep: str) -> DataFrame:
    """Rows (_text and those of keep) with _at (a number of the row), base and, where base is not empty,
    entities and outside."""
    some = F.size("base") > 0
    base = read.select(*keep, "_text", pattern_spans(F.col("_text")).alias("base"))
    return base.select(F.monotonically_increasing_id().alias("_at"), *keep, "base", F.when(some, F.array_distinct(F.transform("base", _entity))).alias("entities"), F.when(some, _outside(F.col("_text"), F.col("base"))).alias("outside"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = 0.8, remove_at: float = 0.95, prior: float = 2.0) -> DataFrame:
    """One row per document: id, base (spans of KINDS) and added (other spans: secrets, kind "secret", and
    terms, kind "general" or "term", of: the kind of entity that the term gives away).

    Entities are protected by kind and by value: a kind is met where a document has a base span of it, a
    value where it has that span's value. A term (lower case) meets them in a document if both stand in
    it, the term outside of all spans, however far apart. Terms are judged by `disclosure` over counts of
    all documents: those that have the term anywhere, the kind or the value, and both. There is no
    least number of documents: `prior` makes few of them weigh little, and a document is no evidence for
    itself, so a value in one document only is given away by none. Terms are generalised from
    generalise_at on, and removed from remove_at on, at every place in the documents where they meet
    what they give away.

    Only counts of terms, and the terms of documents with an entity, are shuffled; texts are not. A null
    text is empty; texts of any length are read whole, in time that grows with their length; null ids
    and repeated rows keep their rows, and every row counts as a document; spans with equal starts stand
    in the order of PATTERNS, terms last; extra columns are not read; an empty table gives no rows.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = saved(_spotted(read, "_id"), "pii-found")
    risky = _risks(read, found.where("entities is not null"), generalise_at, remove_at, prior).withColumnRenamed("_at", "_of")
    out = found.join(risky, F.col("_at") == F.col("_of"), "left")
    is_base = F.filter("base", lambda x: x["kind"] != SECRET)
    return out.select(F.col("_id").alias(id_col), is_base.alias("base"), all_spans(F.filter("base", lambda x: x["kind"] == SECRET), F.coalesce("terms", F.array().cast(NO_TERMS))).alias("added"))


def all_spans(base: Column, terms: Column) -> Column:
    """Spans by pattern and spans of terms (start, rank, end, kind, of) as one array, by start, then kind as
    listed, terms last."""
    bare = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(None).cast("string").alias("of")))
    return F.array_sort(F.concat(bare, terms))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced: those by pattern by [KIND], general terms by the broader [KIND TERM] of
    the kind that they give away, removed terms by nothing. Spans that overlap are replaced as one."""
    name = F.upper
    label = lambda x: F.when(x["kind"] == "term", "").when(x["kind"] == "general", F.concat(F.lit("["), name(x["of"]), F.lit(" TERM]"))).otherwise(F.concat(F.lit("["), name(x["kind"]), F.lit("]")))
    return replaced(text, spans, lambda x, at: F.when(x["start"] >= at, label(x)).otherwise(""))


def sanitise(docs: DataFrame, text_col: str = "text", generalise_at: float = 0.8, remove_at: float = 0.95, prior: float = 2.0) -> DataFrame:
    """docs with the text masked as find() says, all other columns as they are. Null texts stay null.
    Documents without a span by pattern pass through; spans of terms are joined to the others, by row."""
    row, of, base, terms = (unused(docs, f"pii_{c}") for c in ("row", "of", "base", "terms"))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    spotted = docs.withColumn(base, pattern_spans(whole))
    clean = spotted.where(F.size(base) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    held = saved(spotted.where(F.size(base) > 0).withColumn(row, F.monotonically_increasing_id()), "pii-held")
    holders = held.select(F.col(row).alias("_at"), F.col(base).alias("base"), F.array_distinct(F.transform(F.col(base), _entity)).alias("entities"), _outside(whole, F.col(base)).alias("outside"))
    risky = _risks(docs.select(whole.alias("_text")), saved(holders, "pii-holders"), generalise_at, remove_at, prior).select(F.col("_at").alias(of), F.col("terms").alias(terms))
    met = held.join(risky, F.col(row) == F.col(of), "left")
    done = let(all_spans(F.col(base), F.coalesce(F.col(terms), F.array().cast(NO_TERMS))), lambda x: masked(F.col(text_col), x))
    return clean.union(met.select(*[done.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]))
