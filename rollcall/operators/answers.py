"""What is told about a list: the list of lists, one list in full, small views; and jobs that run once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import naming
from rollcall.operators import rounds
from rollcall.operators.identity import EDGE_KEY
from rollcall.session import shuffled


def list_drives(drives: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(subject_id, drive_id, company, imported_at, status, reason, round): every list with a subject's
    verdict, and its place among linked rounds or else the stage that its file names. Newest first is
    drives_order()."""
    labels = rounds.round_labels(drives)
    told = drives.select("drive_id", "company", "imported_at", "round_label").join(labels, "drive_id", "left").withColumn("round", F.coalesce("label", "round_label"))
    return verdicts.join(told, "drive_id").select("subject_id", "drive_id", "company", "imported_at", "status", "reason", "round")


def drives_order() -> list:
    return [F.desc("imported_at"), F.desc("drive_id")]


def drive_outcomes(verdicts: DataFrame, circles: DataFrame, analyses: DataFrame, evidence: DataFrame, progressions: DataFrame) -> DataFrame:
    """(subject_id, drive_id, status, reason, circle, sufficient, cutoff, threshold, row, excerpt, steps,
    next_pending): everything that is told to a subject about a list, from the five tables that say it.
    What holds for a list alone is joined by list, the rest by subject and list; nothing is paired anew."""
    of_list = circles.select("drive_id", F.col("members").alias("circle")).join(analyses.select("drive_id", "sufficient", F.col("kind").alias("cutoff"), "threshold"), "drive_id", "full")
    out = verdicts.select("subject_id", "drive_id", "status", "reason").join(of_list, "drive_id", "left")
    out = out.join(shuffled(evidence.select("subject_id", "drive_id", "row", "excerpt")), ["subject_id", "drive_id"], "left")
    return out.join(shuffled(progressions.select("subject_id", "drive_id", "steps", "next_pending")), ["subject_id", "drive_id"], "left")


def lookup_people(hits: DataFrame, drives: DataFrame, links: DataFrame) -> DataFrame:
    """(query, drive_id, company, label, confidence): the lists that a typed identifier stands on, under the
    name it is known by. hits: query, drive_id; links: value, label, confidence."""
    known = links.select(F.col("value").alias("query"), "label", "confidence")
    met = hits.join(drives.select("drive_id", "company"), "drive_id").join(known, "query", "left")
    return met.select("query", "drive_id", "company", F.concat_ws(" — ", F.coalesce("label", "query"), "company").alias("label"), F.coalesce("confidence", F.lit(0)).alias("confidence"))


def backfill_origins(drives: DataFrame, members: DataFrame, origins: DataFrame, subjects: DataFrame, found: DataFrame) -> DataFrame:
    """Rows to append to origins: those of found (drive_id, kind, value, sheet, row and others) for lists that
    list one of the subjects (kind, value) but know no place for them. found comes from the files read
    again (see store.original_files)."""
    listed = members.join(subjects.select("kind", "value").distinct(), ["kind", "value"], "left_semi").join(drives.select("drive_id", F.col("primary_key").alias("kind")), ["drive_id", "kind"], "left_semi")
    placed = origins.select("drive_id", "kind", "value").distinct()
    lacking = listed.join(placed, ["drive_id", "kind", "value"], "left_anti").select("drive_id").distinct()
    keys = ["drive_id", "kind", "value", "sheet", "row"]
    return found.join(lacking, "drive_id", "left_semi").join(origins.select(*keys), keys, "left_anti")


#: Names under which jobs that run once are noted as done.
NAMES_UPGRADED, ROUNDS_LINKED, SEEDED = "names_upgraded_v1", "rounds_linked_v2", "reference_pack_version"


def _done(meta: DataFrame, name: str) -> bool:
    return not meta.where(F.col("key") == name).isEmpty()


def upgrade_names(drives: DataFrame, meta: DataFrame) -> DataFrame:
    """Drives that still carry the older name of their file get the newer one, and those without a round the
    one that the file names; as they are where meta (key, value) notes that this was done."""
    if _done(meta, NAMES_UPGRADED):
        return drives
    none = F.array().cast("array<string>")
    rows = drives.withColumn("_i", naming.infer(F.col("filename"), none, none))
    company = F.when(F.col("company") == naming.legacy_name(F.col("filename")), F.col("_i.company")).otherwise(F.col("company"))
    return rows.withColumns({"company": company, "round_label": F.coalesce("round_label", "_i.round")}).select(*drives.columns)


def link_existing_rounds(drives: DataFrame, members: DataFrame, meta: DataFrame) -> DataFrame:
    """Drives imported before rounds were linked get their parents, by the rule of an import; once only, so
    that links taken apart stay apart."""
    return drives if _done(meta, ROUNDS_LINKED) else rounds.link_rounds(drives, members).select(*drives.columns)


def seed(meta: DataFrame, pack_version: int, pack: dict[str, DataFrame], tables: dict[str, DataFrame], cohort: str = "23") -> dict[str, DataFrame] | None:
    """What to append to each table for a pack of reference data (edges: neo_id, reg_no, confidence;
    names: name_key, display; academics: reg_no, cgpa, branch; baseline: cgpa, branch), or None where meta
    notes this version or a later one. The baseline has no identifiers and takes the given cohort."""
    known = meta.where(F.col("key") == SEEDED).select(F.max(F.col("value").try_cast("int"))).first()[0]
    if known is not None and known >= pack_version:
        return None
    source = F.lit("bundled")
    edges = pack["edges"].select(F.lit("neo_id").alias("a_kind"), F.col("neo_id").alias("a_value"), F.lit("reg_no").alias("b_kind"), F.col("reg_no").alias("b_value"), "confidence", source.alias("source"))
    edges = edges.where("a_value is not null and b_value is not null")
    # the identifiers of a link have no order of arrival: the stronger claim comes first
    edges = edges.groupBy(*EDGE_KEY).agg(F.max("confidence").alias("confidence")).join(tables["edges"].select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti")
    names = pack["names"].groupBy("name_key").agg(F.min("display").alias("display")).join(tables["spellings"].select("name_key").distinct(), "name_key", "left_anti")
    academics = pack["academics"].where("reg_no is not null").withColumn("source", source)
    baseline = pack["baseline"].select(F.lit(cohort).alias("cohort"), "cgpa", "branch")
    noted = meta.sparkSession.createDataFrame([(SEEDED, str(pack_version))], "key string, value string")
    return {"edges": edges, "spellings": names, "academics": academics, "baseline": baseline, "meta": noted}


def seed_report(batch: dict[str, DataFrame] | None) -> dict[str, int | bool]:
    """students, academics and already_seeded of what seed() gave."""
    if batch is None:
        return {"students": 0, "academics": 0, "already_seeded": True}
    return {"students": batch["edges"].count(), "academics": batch["academics"].count(), "already_seeded": False}


def cards(verdicts: DataFrame, drives: DataFrame, circles: DataFrame, friends: int = 4, recent: int = 4) -> DataFrame:
    """(subject_id, newest, status, members, recent): the newest list, the first people of its circle, and the
    latest lists with their verdicts, for a small view. Lists are cut to the latest before the join."""
    latest = drives.orderBy(*drives_order()).limit(recent).select("drive_id", "company", "imported_at")
    told = verdicts.join(F.broadcast(latest), "drive_id").join(circles.select("drive_id", "members"), "drive_id", "left")
    rows = told.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("imported_at", "drive_id", "company", "status", "members")), asc=False).alias("d"))
    first = F.col("d")[0]
    line = F.array_join(F.transform("d", lambda x: F.concat_ws("=", x["company"], x["status"])), ";")
    return rows.select("subject_id", first["drive_id"].alias("newest"), first["status"].alias("status"), F.array_join(F.slice(F.split(first["members"], ";"), 1, friends), ";").alias("members"), line.alias("recent"))


def write_snapshot(document: DataFrame, folder: str, name: str = "snapshot.json") -> str:
    """Writes one document (a row) as a text file and moves it over the old one in one step, so that readers
    see the old or the new one, never none and never half of it. The folder is one that Spark's file systems
    know. Tables that change together have versions (see rollcall.operators.versions)."""
    spark = document.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    part, target = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.tmp"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    document.coalesce(1).write.mode("overwrite").text(part.toString())
    fs = target.getFileSystem(conf)
    made = [s.getPath() for s in fs.listStatus(part) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    if len(made) != 1:
        raise ValueError("a snapshot is one document")
    kinds = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = jvm.java.lang.reflect.Array.newInstance(kinds, 1)
    jvm.java.lang.reflect.Array.set(over, 0, next(k for k in kinds.getEnumConstants() if k.toString() == "OVERWRITE"))
    target = fs.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(made[0], target, over)
    fs.delete(part, True)
    return target.toString()


def wipe(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without rows."""
    return {k: t.limit(0) for k, t in tables.items()}


def set_meta(meta: DataFrame, key: str, value: str | None) -> DataFrame:
    """meta (key, value) with one entry set, or cleared where value is None."""
    rest = meta.where(F.col("key") != key)
    return rest if value is None else rest.unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))

