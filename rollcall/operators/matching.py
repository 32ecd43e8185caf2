"""Matching names without guessing: by rare tokens and by sound, then likeness, then the ambiguity gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.session import saved


def keyed(rows: DataFrame, name: str) -> DataFrame:
    """rows with name_key, phonetic and tokens; rows without a key are left out."""
    normal = rows.withColumn("_normal", N.normalise(F.col(name)))
    keys = normal.select(*rows.columns, N.name_key(F.col("_normal")).alias("name_key"), N.tokens(F.col("_normal")).alias("tokens")).where("name_key <> ''")
    return keys.withColumn("phonetic", N.phonetic_key("name_key"))


def similar_tokens(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): tokens (column t) of either side that are similar, or equal. They meet by keys of which
    similar tokens share one, so no two tokens are compared that could not be."""
    left = asked.select(F.col("t").alias("a"), F.explode(N.token_blocks_udf("t")).alias("block"))
    right = known.select(F.col("t").alias("b"), F.explode(N.token_blocks_udf("t")).alias("block"))
    met = left.join(right, "block").select("a", "b").distinct()
    return met.where(N.jaro_winkler_udf("a", "b") >= N.SIMILAR)


def _postings(keys: DataFrame) -> DataFrame:
    """(name_key, n, t): each token of each key once, with the number of the key's tokens."""
    return keys.select("name_key", F.size("tokens").alias("n"), F.explode(F.array_distinct("tokens")).alias("t"))


def subset_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(q_key, c_key): keys (name_key, tokens) of which one is contained in the other. All tokens of the
    shorter must be in the longer, so it is enough to look under its rarest token, on either side."""
    mine, theirs = _postings(asked), _postings(known)
    rare = theirs.groupBy("t").agg(F.count("*").alias("df"))

    def rarest(postings: DataFrame) -> DataFrame:
        """One posting of each key of two tokens or more: that of its token that fewest known keys have."""
        met = postings.where("n >= 2").join(rare, "t", "left")
        return met.groupBy("name_key").agg(F.min_by("t", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("t"))).alias("t"))

    q, c = F.col("name_key").alias("q_key"), F.col("name_key").alias("c_key")
    by_short = rarest(mine).select("t", q).join(theirs.select("t", c), "t")
    by_long = mine.select("t", q).join(rarest(theirs).select("t", c), "t")
    pairs = by_short.union(by_long).select("q_key", "c_key").distinct()
    return pairs.where((F.col("q_key") != F.col("c_key")) & N.contained(F.col("q_key"), F.col("c_key")))


def alike_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(q_key, c_key): keys of as many tokens, two or more, that share one and of which each token is
    similar to one of the other. Each token needs a similar one, so a key is looked up under the token
    whose similar ones stand in the fewest keys of that many tokens; a key with a token that has none
    is not looked up. A frequent token is chosen only by names made of frequent ones."""
    mine, theirs = _postings(asked).where("n >= 2"), saved(_postings(known).where("n >= 2"), "names-postings")
    similar = saved(similar_tokens(mine.select("t").distinct(), theirs.select("t").distinct()), "names-similar")
    size = similar.join(theirs.groupBy("t", "n").agg(F.count("*").alias("df")).withColumnRenamed("t", "b"), "b").groupBy("a", "n").agg(F.sum("df").alias("w"))
    chosen = mine.withColumnRenamed("t", "a").join(size, ["a", "n"], "left").groupBy("name_key", "n").agg(F.min(F.struct(F.coalesce("w", F.lit(0)).alias("w"), F.col("a"))).alias("x"))
    probes = chosen.where("x.w > 0").select(F.col("name_key").alias("q_key"), "n", F.col("x.a").alias("a")).join(similar, "a")
    pairs = probes.join(theirs.select("n", F.col("t").alias("b"), F.col("name_key").alias("c_key")), ["n", "b"]).select("q_key", "c_key").distinct()
    a, b = F.col("q_key"), F.col("c_key")
    open_ = pairs.where((a != b) & F.arrays_overlap(N.words_of(a), N.words_of(b)) & ~N.contained(a, b))
    return open_.where(N.relation(a, b) == N.FUZZY)


def match(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, outcome, payload, confidence): matched only if all candidates at the best relation are one
    payload; high for an exact match, probable for others; ambiguous or no_match otherwise. queries:
    query_id, query; corpus: payload, display.

    Candidates are names with the same key, the same sound, or a token in common. Names are compared key
    by key, and a key's payloads are one only if the least is the greatest, so nothing grows with the
    people of one name. Only the best relation counts, so a key is looked up under a weaker one only if it
    has no stronger: names that the corpus has are never compared with others. Names of one sound are
    all alike, so they are told by their bounds and never paired; the others meet by their rarest tokens.
    """
    asked, known = keyed(queries, "query"), keyed(corpus, "display")
    kept = saved(known.groupBy("name_key", "tokens", "phonetic").agg(F.min("payload").alias("lo"), F.max("payload").alias("hi")), "names-known")
    of_query = saved(asked.select("query_id", "name_key", "tokens", "phonetic"), "names-asked")
    keys = of_query.select("name_key", "tokens", "phonetic").distinct()
    bounds = kept.select(F.col("name_key").alias("c_key"), "lo", "hi")
    told = lambda rows, relation: rows.groupBy("q_key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("q_key", F.lit(relation).alias("relation"), "lo", "hi")
    exact = told(keys.select(F.col("name_key").alias("q_key")).join(bounds, F.col("q_key") == F.col("c_key")), N.EXACT)
    other = saved(keys.join(kept.select("name_key"), "name_key", "left_anti"), "names-other")
    subset = saved(told(subset_pairs(other, kept).join(bounds, "c_key"), N.SUBSET), "names-subset")
    unlike = saved(other.join(subset.select(F.col("q_key").alias("name_key")), "name_key", "left_anti"), "names-unlike")
    of_sound = kept.groupBy("phonetic").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sound = unlike.select(F.col("name_key").alias("q_key"), "phonetic").join(of_sound, "phonetic").select("q_key", "lo", "hi")
    alike = alike_pairs(unlike, kept).join(bounds, "c_key").select("q_key", "lo", "hi")
    best = exact.union(subset).union(told(sound.union(alike), N.FUZZY))
    found = queries.select("query_id").join(of_query.select("query_id", F.col("name_key").alias("q_key")).join(best, "q_key"), "query_id", "left")
    outcome = F.when(F.col("lo").isNull(), "no_match").when(F.col("lo") != F.col("hi"), "ambiguous").otherwise("matched")
    one = outcome == "matched"
    return found.select("query_id", outcome.alias("outcome"), F.when(one, F.col("lo")).alias("payload"), F.when(one, F.when(F.col("relation") == N.EXACT, 2).otherwise(1)).otherwise(0).alias("confidence"))


def student_index(links: DataFrame, spellings: DataFrame) -> DataFrame:
    """(payload, display): every spelling of a name with each primary identifier that bears it. links:
    neo_id, name_key (see identity.resolve); spellings: name_key, display."""
    return spellings.select("name_key", "display").join(links.where("name_key is not null").select("neo_id", "name_key"), "name_key").select(F.col("neo_id").alias("payload"), "display")


def search(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, outcome, neo_id, confidence): found, ambiguous or not_found, for names typed in full or
    nearly. An ambiguous name gives no identifier."""
    told = {"matched": "found", "ambiguous": "ambiguous", "no_match": "not_found"}
    found = match(queries, index)
    outcome = F.element_at(F.create_map(*[F.lit(x) for pair in told.items() for x in pair]), F.col("outcome"))
    return found.select("query_id", outcome.alias("outcome"), F.col("payload").alias("neo_id"), "confidence")
