"""Whole jobs: cells or pasted text to stored tables, reference sheets, and the answer for each list."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import naming
from rollcall.functions import values as V
from rollcall.operators import analytics, identity, ingest, rounds, store, verdicts
from rollcall.session import saved


class Imported(NamedTuple):
    """What to append after an import, and the files that were refused or known."""

    drives: DataFrame
    members: DataFrame
    origins: DataFrame
    edges: DataFrame
    spellings: DataFrame
    skipped: DataFrame


def file_name(file_id: Column) -> Column:
    return F.regexp_extract(file_id, r"([^/]*)$", 1)


def import_lists(cells: DataFrame, stored: DataFrame, first_id: int, now: Column) -> Imported:
    """Lists from cells (see ingest), against stored drives (content_hash). A file is refused where no
    column of identifiers can be elected, and known where its content is stored already or came
    earlier in this import; its lines still give origins. Ids count from first_id by file name."""
    layout = ingest.elect(ingest.column_stats(cells))
    layout = saved(layout, "layout")
    parsed = saved(ingest.extract(cells, layout), "parsed")
    files = ingest.files(parsed).where("shape <> 'unrecognised'").withColumn("seq", F.col("file_id"))
    titles = ingest.titles(cells, layout).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sheet_idx", "row", "title"))).alias("t")).select("file_id", F.transform("t", lambda x: x["title"]).alias("titles"))
    sheets = cells.select("file_id", "sheet_idx", "sheet").distinct().groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sheet_idx", "sheet"))), lambda x: x["sheet"]).alias("sheets"))
    fresh = store.unseen(files, stored)
    named = store.numbered(fresh, "file_id", first_id).withColumnRenamed("number", "drive_id").join(titles, "file_id", "left").join(sheets, "file_id", "left").withColumn("i", naming.infer(file_name(F.col("file_id")), F.col("titles"), F.col("sheets")))
    named = saved(named.drop("titles", "sheets"), "named")
    drives = named.select("drive_id", F.col("i.company").alias("company"), F.col("i.date").alias("drive_date"), now.alias("imported_at"), file_name(F.col("file_id")).alias("filename"), "content_hash", "shape", "primary_key", F.col("student_count").cast("long").alias("total_students"), F.col("i.round").alias("round_label"), F.lit(None).cast("long").alias("parent_drive_id"))
    ids = named.select("file_id", "drive_id")
    members = saved(ingest.members(parsed).join(ids, "file_id").select("drive_id", "kind", "value"), "members")
    origins = ingest.origins(parsed, layout, cells).join(ids, "file_id").drop("file_id")
    rows = parsed.withColumn("seq", F.struct("file_id", "sheet_idx", "row")).withColumn("source", file_name(F.col("file_id")))
    skipped = cells.select("file_id").distinct().join(ids, "file_id", "left_anti")
    edges = saved(identity.dedup_edges(identity.harvest(rows)), "harvest")
    return Imported(drives, members, origins, edges, identity.spellings(rows), skipped)


def import_pasted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pasted texts (file_id, text) as files and members; identifiers in them are never linked or named."""
    rows = ingest.pasted_rows(texts)
    one = rows.select("file_id", F.when(F.col("kind") == V.NEO, F.col("value")).alias("neo_id"), F.when(F.col("kind") == V.REG, F.col("value")).alias("reg_no"))
    return ingest.files(one).join(ingest.pasted_titles(texts), "file_id", "left"), ingest.members(one)


def route_reference(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(academic rows, cells of other files): files with any grade are reference sheets."""
    rows = ingest.academic_rows(cells)
    graded = rows.where("cgpa is not null").select("file_id").distinct()
    return rows.join(graded, "file_id", "left_semi"), cells.join(graded, "file_id", "left_anti")


def outcomes(subjects: DataFrame, drives: DataFrame, members: DataFrame, edges: DataFrame, academics: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts with company and round label, analyses): the answer for every subject and list."""
    linked = saved(rounds.link_rounds(drives, members).select("drive_id", "company", "parent_drive_id", "round_label"), "linked")
    told = verdicts.membership(subjects, drives, members).join(linked.select("drive_id", "company"), "drive_id").join(rounds.round_labels(linked), "drive_id", "left")
    known = identity.resolve(edges).where("reg_no is not null").select("neo_id", "reg_no", "confidence")
    return told, analytics.analyse(members, known, academics, baseline)


def build_pack(edges: DataFrame, academics: DataFrame, spellings: DataFrame) -> dict[str, DataFrame]:
    """Tables of reference data to ship: sound identity links, claims of names, grades, and spellings of names
    in use."""
    links = saved(identity.resolve(edges), "pack-links")
    named = identity.node_names(edges).select(F.substring_index("node", ":", -1).alias("identifier"), "name_key", V.confidence_label(F.col("confidence")).alias("confidence"))
    return {
        "edges": links.where("reg_no is not null").select("neo_id", "reg_no", V.confidence_label(F.col("confidence")).alias("confidence")),
        "name_edges": named,
        "names": spellings.join(named.select("name_key").distinct(), "name_key", "left_semi"),
        "academics": academics.select("reg_no", V.sane_cgpa(F.col("cgpa")).alias("cgpa"), "branch"),
    }


class Reference(NamedTuple):
    """A pack's tables, how names were linked, and which files went into it."""

    pack: dict[str, DataFrame]
    report: DataFrame
    sources: DataFrame


def build_reference(cells: DataFrame, cohort: str | None = None) -> Reference:
    """A pack from a folder of sheets (cells): sheets with grades give academic records and names of secondary
    identifiers, the others, where an identifier was found, links and names of primary ones. Those that no
    row links are then linked by name, through the ambiguity gate; an ambiguous name links nobody."""
    graded, rest = route_reference(cells)
    graded = saved(graded.withColumn("source", file_name(F.col("file_id"))).withColumn("seq", F.struct("file_id", F.lit(0).alias("sheet_idx"), "row")), "pack-graded")
    academics, of_sheets, baseline = identity.ingest_academics(graded, cohort)
    layout = saved(ingest.elect(ingest.column_stats(rest)), "pack-layout")
    parsed = saved(ingest.extract(rest, layout), "pack-parsed")
    usable = ingest.files(parsed).where("shape <> 'unrecognised'").select("file_id")
    rows = parsed.join(usable, "file_id", "left_semi").withColumn("seq", F.struct("file_id", "sheet_idx", "row")).withColumn("source", file_name(F.col("file_id")))
    both = saved(identity.dedup_edges(of_sheets.unionByName(identity.harvest(rows))), "pack-edges")
    spelt = identity.spellings(graded.select("name", "seq").unionByName(rows.select("name", "seq")))
    first = identity.resolve(both).where("reg_no is not null").select("neo_id")
    claims = identity.node_names(both).withColumn("kind", F.substring_index("node", ":", 1)).withColumn("payload", F.substring_index("node", ":", -1))
    asked = claims.where(F.col("kind") == V.NEO).groupBy("payload").agg(F.max_by(F.struct("name_key", "confidence"), F.struct("confidence", "name_key")).alias("x")).select("payload", F.col("x.name_key").alias("name"), "x.confidence")
    corpus = claims.where(F.col("kind") == V.REG).select("payload", F.col("name_key").alias("display"))
    found = saved(identity.link_by_name(asked, corpus, first), "pack-bridge")
    bridge = found.select(F.lit(V.NEO).alias("a_kind"), F.col("payload").alias("a_value"), F.lit(V.REG).alias("b_kind"), F.col("matched").alias("b_value"), F.lit("names").alias("source"), "confidence")
    every = saved(both.select(*identity.EDGE_KEY, "confidence").unionByName(bridge), "pack-all")
    pack = build_pack(every, academics, spelt) | {"baseline": baseline}
    sources = graded.select("file_id", F.lit("academics").alias("kind")).union(usable.select("file_id", F.lit("list"))).distinct()
    return Reference(pack, identity.name_link_report(asked, corpus, first), sources)
