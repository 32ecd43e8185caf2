"""Writes as set operations: what a table holds after a batch of changes. Each function takes the table
and the batch and returns the new rows or the new table; writing is left to the caller (append for
inserts, a new table version for rewrites)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import values as V
from rollcall.operators.components import connected_components
from rollcall.operators.identity import EDGE_KEY
from rollcall.session import saved


def unseen(batch: DataFrame, drives: DataFrame) -> DataFrame:
    """New lists: the first of each content hash in the batch (by seq) that no stored drive has."""
    first = batch.groupBy("content_hash").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "content_hash"]), "seq").alias("x"))
    return first.join(drives.select("content_hash"), "content_hash", "left_anti").select("content_hash", "x.*").select(*batch.columns)


def numbered(rows: DataFrame, key: str, first: int) -> DataFrame:
    """rows with number: first, first + 1 and so on in the order of key, which no two rows share. Rows are
    dealt out by ranges of key and counted part by part; only the parts' counts meet."""
    parts = saved(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min(key).alias("_low"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parts.join(before, "_part").withColumn("number", (F.col("_before") + place + (first - 1)).cast("long")).drop("_part", "_before")


def first_sighting(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first in the given order."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*").select(*batch.columns)


def add_new(table: DataFrame, batch: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Insert or ignore: the rows of the batch to append."""
    return first_sighting(batch, keys, order).join(table.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)


def add_edges(table: DataFrame, batch: DataFrame) -> DataFrame:
    return add_new(table, batch, EDGE_KEY)


def upsert_academics(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after the batch: newest known grade and branch, first source and cohort."""
    both = table.select("reg_no", "cgpa", "branch", "cohort", "source", "seq").union(batch.select("reg_no", "cgpa", "branch", "cohort", "source", "seq"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return both.groupBy("reg_no").agg(newest("cgpa"), newest("branch"), F.min_by("cohort", "seq").alias("cohort"), F.min_by("source", "seq").alias("source"), F.max("seq").alias("seq"))


def save_profile(current: DataFrame, new: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Profiles after an edit: one for each value of keys, or the only one where no keys are given. A first
    profile is taken as it comes. The cohort follows the secondary identifier where it is not given. The
    grade's time is null without a grade, and moves only if the grade changed."""
    old = current.select(*keys, F.struct("cgpa", F.col("cgpa_updated_at").alias("at")).alias("_old"))
    met = new.join(old, list(keys), "left") if keys else new.join(F.broadcast(old.limit(1)), F.lit(True), "left")
    moved = F.when(F.col("cgpa").isNull(), None).when(F.col("cgpa") == F.col("_old.cgpa"), F.col("_old.at")).otherwise(F.col("now"))
    return met.select(*keys, "neo_id", "reg_no", "display_name", F.coalesce("cohort", V.admission_year(F.col("reg_no"))).alias("cohort"), "cgpa", moved.alias("cgpa_updated_at"))


FRIEND = ["label", "neo_id", "reg_no", "group_tag"]


def add_friends(friends: DataFrame, batch: DataFrame) -> DataFrame:
    """Friends after a batch (seq, label, neo_id, reg_no, group_tag), taken row by row in the order of seq: a row
    that shares an identifier with a friend, also one that came earlier in the batch, gives that friend its
    label and tag (null too) and the identifiers that it has; others are new, numbered after the greatest
    id by seq. A row that meets two friends changes the one with the lower id, and an identifier that
    the other bears stays there.

    Rows that identifiers connect are worked on together, in order, by one task; it holds the friends of
    one such group at a time. Friends whom the batch does not touch are not looked at.
    """
    node = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(kind), c))
    ends = [node("n", "neo_id").alias("src"), node("r", "reg_no").alias("dst")]
    asked = saved(batch.select(F.col("seq").cast("long").alias("seq"), *FRIEND, *ends), "friends-batch")
    names = asked.select(F.explode(F.array_compact(F.array("src", "dst"))).alias("_name")).distinct()
    held = friends.select(F.col("friend_id").cast("long").alias("friend_id"), *FRIEND, *ends)
    touched = held.select("friend_id", F.explode(F.array_compact(F.array("src", "dst"))).alias("_name")).join(names, "_name", "left_semi").select("friend_id").distinct()
    met = saved(held.join(touched, "friend_id", "left_semi"), "friends-met")
    parts = connected_components(asked.select("src", "dst").union(met.select("src", "dst"))).select(F.col("node").alias("_node"), "component")
    none = F.lit(None).cast("long")
    rows = met.select("friend_id", none.alias("seq"), *FRIEND, "src", "dst").union(asked.select(none.alias("friend_id"), "seq", *FRIEND, "src", "dst"))
    rows = rows.withColumn("_node", F.coalesce("src", "dst", F.concat(F.lit("s"), F.col("seq").cast("string"))))
    grouped = rows.join(parts, "_node", "left").select(F.coalesce("component", "_node").alias("part"), "friend_id", "seq", *FRIEND)
    top = friends.agg(F.coalesce(F.max("friend_id"), F.lit(0)).cast("long")).first()[0]
    schema = "friend_id long, label string, neo_id string, reg_no string, group_tag string"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, known = None, {}
        for some in batches:
            out: list = []
            for row in some.astype(object).where(some.notna(), None).itertuples(index=False):
                if row.part != part:
                    out += ([k, *f] for k, f in known.items())
                    part, known = row.part, {}
                _take(known, row, top)
            yield pd.DataFrame(out, columns=["friend_id", *FRIEND])
        yield pd.DataFrame([[k, *f] for k, f in known.items()], columns=["friend_id", *FRIEND])

    dealt = grouped.repartition("part").sortWithinPartitions("part", F.asc_nulls_first("seq"), "friend_id")
    return friends.join(touched, "friend_id", "left_anti").select("friend_id", *FRIEND).unionByName(dealt.mapInPandas(each, schema))


def _take(known: dict[int, list], row, top: int) -> None:
    """One row of a group of add_friends: a friend as it was, or a row of the batch."""
    if row.seq is None:
        known[int(row.friend_id)] = [row.label, row.neo_id, row.reg_no, row.group_tag]
        return
    hits = sorted(k for k, f in known.items() if row.neo_id and f[1] == row.neo_id or row.reg_no and f[2] == row.reg_no)
    if not hits:
        known[top + int(row.seq)] = [row.label, row.neo_id, row.reg_no, row.group_tag]
        return
    others = [known[k] for k in hits[1:]]
    friend = known[hits[0]]
    neo = row.neo_id if row.neo_id and all(f[1] != row.neo_id for f in others) else friend[1]
    reg = row.reg_no if row.reg_no and all(f[2] != row.reg_no for f in others) else friend[2]
    known[hits[0]] = [row.label, neo, reg, row.group_tag]


def delete_drives(drives: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without the drives in gone (drive_id): their members and origins go, their children lose the parent."""
    ids = gone.select("drive_id").distinct()
    left = drives.join(ids, "drive_id", "left_anti")
    parents = ids.select(F.col("drive_id").alias("parent_drive_id"), F.lit(True).alias("_gone"))
    left = left.join(parents, "parent_drive_id", "left").withColumn("parent_drive_id", F.when(F.col("_gone").isNull(), F.col("parent_drive_id"))).drop("_gone")
    return left.select(*drives.columns), {k: t.join(ids, "drive_id", "left_anti") for k, t in children.items()}


def set_column(table: DataFrame, key: str, changes: DataFrame, column: str) -> DataFrame:
    """Point updates: rename, round label, parent, meta. changes: key, column (null clears)."""
    new = changes.select(key, F.struct(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.when(F.col("_new").isNotNull(), F.col(f"_new.{column}")).otherwise(F.col(column))).select(*table.columns)


def snapshot(drives: DataFrame, members: DataFrame, origins: DataFrame) -> DataFrame:
    """(drive_id, drive, members, origins): drives as nested rows, without parent and time."""
    keep = [c for c in drives.columns if c not in ("drive_id", "parent_drive_id", "imported_at")]
    m = members.groupBy("drive_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value"))).alias("members"))
    o = origins.groupBy("drive_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "sheet", "row"))).alias("origins"))
    return drives.select("drive_id", F.struct(*keep).alias("drive")).join(m, "drive_id", "left").join(o, "drive_id", "left")


def restore(snapshots: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drives, members and origins of snapshots: the time is now, and the link to a parent is lost."""
    drives = snapshots.select("drive_id", "drive.*", now.alias("imported_at"), F.lit(None).cast("long").alias("parent_drive_id"))
    return drives, snapshots.select("drive_id", F.explode("members").alias("x")).select("drive_id", "x.*"), snapshots.select("drive_id", F.explode("origins").alias("x")).select("drive_id", "x.*")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    parts = [t.agg(F.lit(k).alias("name"), F.count("*").alias("rows")) for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def recent(files: DataFrame, now, imported: DataFrame, hours: int = 1, top: int = 2) -> DataFrame:
    """Files (path, filename, modified) of the last hours, newest first, with a flag if imported."""
    known = imported.select("filename").distinct().withColumn("imported", F.lit(True))
    new = files.where(F.col("modified") >= now - F.expr(f"INTERVAL {hours} HOURS")).orderBy(F.desc("modified"), "path").limit(top)
    return new.join(known, "filename", "left").select("path", "filename", "modified", F.coalesce("imported", F.lit(False)).alias("imported"))


def original_files(drives: DataFrame, files: DataFrame) -> DataFrame:
    """(drive_id, path): stored drives whose file is found again by name (or its decoded form) and hash."""
    name = F.explode(F.array_distinct(F.array(F.col("filename"), F.replace("filename", F.lit("%20"), F.lit(" ")))))
    wanted = drives.select("drive_id", "content_hash", name.alias("filename"))
    return wanted.join(files, ["content_hash", "filename"]).groupBy("drive_id").agg(F.min("path").alias("path"))
