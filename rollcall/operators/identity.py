"""The identity graph: edges, components, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions import values as V
from rollcall.operators.components import connected_components
from rollcall.session import saved

#: edges: a_kind, a_value, b_kind, b_value, confidence (0 to 3), source, seq.
EDGE_KEY = ["a_kind", "a_value", "b_kind", "b_value", "source"]


def harvest(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Edges of parsed rows (neo_id, reg_no, name, seq): a pair of identifiers in one row is verified, a
    name beside an identifier high, once for each identifier."""
    src = F.col("source") if source is None else F.lit(source)
    key = N.name_key(N.normalise(F.col("name")))
    node = lambda kind, value: (F.lit(kind), value)

    def edge(a, b, confidence, need):
        return rows.where(need).select(a[0].alias("a_kind"), a[1].alias("a_value"), b[0].alias("b_kind"), b[1].alias("b_value"), F.lit(confidence).alias("confidence"), src.alias("source"), "seq")

    neo, reg = F.col("neo_id"), F.col("reg_no")
    named = rows.where("name is not null")
    both = edge(node(V.NEO, neo), node(V.REG, reg), 3, neo.isNotNull() & reg.isNotNull())
    with_key = named.withColumn("_key", key).where("_key <> ''")

    def name_edge(kind, value):
        return with_key.where(value.isNotNull()).select(F.lit(kind).alias("a_kind"), value.alias("a_value"), F.lit("name").alias("b_kind"), F.col("_key").alias("b_value"), F.lit(2).alias("confidence"), src.alias("source"), "seq")

    return both.union(name_edge(V.NEO, neo)).union(name_edge(V.REG, reg))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """First write wins per directed pair and source; confidence is not part of the key."""
    keep = F.min_by(F.struct("confidence", "seq"), "seq")
    return edges.groupBy(*EDGE_KEY).agg(keep.alias("x")).select(*EDGE_KEY, "x.confidence", "x.seq")


def spellings(rows: DataFrame) -> DataFrame:
    """(name_key, display): the first spelling of each key."""
    key = N.name_key(N.normalise(F.col("name")))
    return rows.where("name is not null").withColumn("name_key", key).where("name_key <> ''").groupBy("name_key").agg(F.min_by("name", "seq").alias("display"))


def node_of(kind: str, value: str):
    return F.concat_ws(":", F.col(kind), F.col(value))


def components(edges: DataFrame) -> DataFrame:
    """(node, component, confidence, n_regs, conflicted) of identifiers. Names never join components;
    unresolved edges are left out. A component is as good as its weakest edge, repeated ones included;
    one that only names touch is verified. Two secondary identifiers make a conflict."""
    live = edges.where("confidence > 0")
    ids = live.where("a_kind <> 'name' and b_kind <> 'name'").select(node_of("a_kind", "a_value").alias("src"), node_of("b_kind", "b_value").alias("dst"), "confidence")
    ends = live.select(node_of("a_kind", "a_value").alias("node"), F.col("a_kind").alias("kind")).union(live.select(node_of("b_kind", "b_value").alias("node"), F.col("b_kind").alias("kind"))).where("kind <> 'name'").distinct()
    found = connected_components(ids)
    rows = ends.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("src").agg(F.min("confidence").alias("confidence"))  # before the join: a node has many edges
    weakest = least.join(found.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.min("confidence").alias("confidence"))
    regs = rows.groupBy("component").agg(F.count_if(F.col("kind") == V.REG).alias("n_regs"))
    out = rows.join(regs, "component").join(weakest, "component", "left")
    return out.select("node", "kind", "component", F.coalesce("confidence", F.lit(3)).alias("confidence"), "n_regs", (F.col("n_regs") > 1).alias("conflicted"))


def node_names(edges: DataFrame) -> DataFrame:
    """(node, name_key, confidence): the best claim of each name for each identifier."""
    named = edges.where("confidence > 0 and (a_kind = 'name') <> (b_kind = 'name')")
    a_is_name = F.col("a_kind") == "name"
    rows = named.select(F.when(a_is_name, node_of("b_kind", "b_value")).otherwise(node_of("a_kind", "a_value")).alias("node"), F.when(a_is_name, F.col("a_value")).otherwise(F.col("b_value")).alias("name_key"), "confidence")
    return rows.groupBy("node", "name_key").agg(F.max("confidence").alias("confidence"))


def component_names(comps: DataFrame, names: DataFrame) -> DataFrame:
    """(component, name_key, confidence): best claim over the component's identifiers, no better than the
    component itself."""
    met = names.join(comps.select("node", "component", F.col("confidence").alias("own")), "node")
    return met.groupBy("component", "name_key").agg(F.least(F.max("confidence"), F.min("own")).alias("confidence"))


def best_names(comps: DataFrame, names: DataFrame) -> DataFrame:
    """(component, name_key): the strongest name good enough to name a person, the greatest key on a tie;
    none for conflicts."""
    sound = comps.where("not conflicted").select("component").distinct()
    good = component_names(comps, names).where(V.can_name(F.col("confidence"))).join(sound, "component", "left_semi")
    return good.groupBy("component").agg(F.max_by("name_key", F.struct("confidence", "name_key")).alias("name_key"))


def resolve(edges: DataFrame) -> DataFrame:
    """(component, neo_id, reg_no, name_key, confidence) per primary identifier of sound components, all at
    the component's confidence."""
    comps = saved(components(edges).where("not conflicted"), "identities")
    value = F.substring_index("node", ":", -1)
    neo = comps.where(F.col("kind") == V.NEO).select("component", value.alias("neo_id"), "confidence")
    reg = comps.where(F.col("kind") == V.REG).select("component", value.alias("reg_no"))
    names = best_names(comps, node_names(edges))
    return neo.join(reg, "component", "left").join(names, "component", "left").select("component", "neo_id", "reg_no", "name_key", "confidence")


def edges_by_source(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count("*").alias("edges"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: components, names and conflicts."""
    comps = components(edges)
    n = comps.agg(F.count_distinct("component").alias("components"), F.count_distinct(F.when(F.col("conflicted"), F.col("component"))).alias("conflicts"))
    return n.crossJoin(F.broadcast(node_names(edges).agg(F.count_distinct("name_key").alias("names"))))


def ingest_academics(rows: DataFrame, cohort: str | None = None):
    """Three projections of academic rows (reg_no, name, cgpa, branch, source, seq): academics (newest known
    value of each column wins), edges to names, and baseline rows without identifiers (all of them)."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    year = V.admission_year(F.col("reg_no"))
    academics = rows.groupBy("reg_no").agg(last("cgpa"), last("branch"), F.min_by("source", "seq").alias("source")).withColumn("cohort", year)
    edges = harvest(rows.withColumn("neo_id", F.lit(None).cast("string")))
    baseline = rows.select(F.coalesce(F.lit(cohort), year).alias("cohort"), "cgpa", "branch")
    return academics, edges, baseline


def link_by_name(queries: DataFrame, corpus: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(payload, matched, confidence): query rows (payload, name, confidence) that one person of the corpus
    answers; the link is as good as the weaker of match and claim. Payloads of resolved (neo_id), whose
    link comes from something stronger, are not asked for, nor are claims too weak to count."""
    found = _asked(queries, corpus, resolved).where("outcome = 'matched' and link > 0")
    return found.select(F.col("query_id").alias("payload"), F.col("payload").alias("matched"), F.col("link").alias("confidence"))


def name_link_report(queries: DataFrame, corpus: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """One row: exact, approximate, ambiguous and unmatched names of link_by_name."""
    x = _asked(queries, corpus, resolved)
    matched = F.col("outcome") == "matched"
    return x.agg(
        F.count_if(matched & (F.col("link") == 2)).alias("exact"), F.count_if(matched & (F.col("link") == 1)).alias("approximate"),
        F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous"), F.count_if(F.col("outcome") == "no_match").alias("unmatched"),
    )


def _asked(queries: DataFrame, corpus: DataFrame, resolved: DataFrame | None) -> DataFrame:
    from rollcall.operators.matching import match

    open_ = queries.where(V.can_aggregate(F.col("confidence")))
    if resolved is not None:
        open_ = open_.join(resolved.select(F.col("neo_id").alias("payload")).distinct(), "payload", "left_anti")
    found = match(open_.select(F.col("payload").alias("query_id"), F.col("name").alias("query")), corpus)
    claims = open_.select(F.col("payload").alias("query_id"), F.col("confidence").alias("claim"))
    return found.join(claims, "query_id").withColumn("link", F.least("confidence", "claim"))


def harvest_report(edges: DataFrame) -> DataFrame:
    """One row: links between identifiers and links to names among harvested edges."""
    named = (F.col("a_kind") == "name") | (F.col("b_kind") == "name")
    return edges.agg(F.count_if(~named).alias("verified_links"), F.count_if(named).alias("named_links"))
