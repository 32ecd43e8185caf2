"""Membership in three values: in, not in, or cannot tell and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import values as V
from rollcall.session import saved, shuffled

IN, OUT, UNKNOWN = "shortlisted", "not_shortlisted", "undetermined"


def with_verdict(pairs: DataFrame) -> DataFrame:
    """pairs has shape, primary_key, neo_id, reg_no (of the subject) and found (a member row was met).
    Adds status, reason and file_key. Absence counts only where the list is keyed by an identifier
    that the subject has."""
    key = F.when(F.col("primary_key").isin(V.NEO, V.REG), F.col("primary_key"))
    held = F.when(key == V.NEO, V.neo_id(F.col("neo_id"))).when(key == V.REG, V.reg_no(F.col("reg_no")))
    reason = (
        F.when((F.col("shape") == "unrecognised") | key.isNull(), "file_not_understood")
        .when(F.col("neo_id").isNull() & F.col("reg_no").isNull(), "no_identity_configured")
        .when(held.isNull(), "key_kind_not_configured")
    )
    status = F.when(reason.isNotNull(), UNKNOWN).when(F.coalesce("found", F.lit(False)), IN).otherwise(OUT)
    return pairs.withColumns({"status": status, "reason": reason, "file_key": F.when(reason == "key_kind_not_configured", key)})


def membership(subjects: DataFrame, drives: DataFrame, members: DataFrame) -> DataFrame:
    """(subject_id, drive_id, status, reason, file_key) for every subject and drive.

    The answer has a row for each pair, so the pairs are made, but last: subjects meet the lists that have
    their identifiers first, as an array, so that what is shuffled is subjects and members, not pairs.
    """
    none = F.concat(F.lit("\x00"), F.col("subject_id").cast("string"))  # meets nothing, and no two of them lie together
    held = subjects.select("subject_id", "neo_id", "reg_no", F.coalesce(V.neo_id(F.col("neo_id")), none).alias("_neo"), F.coalesce(V.reg_no(F.col("reg_no")), none).alias("_reg"))
    for kind, key, on in ((V.NEO, "_neo", "_on_neo"), (V.REG, "_reg", "_on_reg")):
        on_lists = members.where((F.col("kind") == kind) & F.col("value").isNotNull()).groupBy(F.col("value").alias(key)).agg(F.array_sort(F.collect_set("drive_id")).alias(on))
        held = held.join(shuffled(on_lists), key, "left")
    lists = saved(drives.select("drive_id", "shape", "primary_key"), "lists")  # so that Spark sees which side is the small one
    pairs = held.crossJoin(lists)
    on = F.when(F.col("primary_key") == V.NEO, F.col("_on_neo")).when(F.col("primary_key") == V.REG, F.col("_on_reg"))
    return with_verdict(pairs.withColumn("found", F.array_contains(on, F.col("drive_id")))).select("subject_id", "drive_id", "status", "reason", "file_key")


def _keys(subjects: DataFrame) -> DataFrame:
    """subjects with neo and reg: their identifiers where they have the form of one."""
    return subjects.withColumns({"neo": V.neo_id(F.col("neo_id")), "reg": V.reg_no(F.col("reg_no")), "known": F.col("neo_id").isNotNull() | F.col("reg_no").isNotNull()})


def _asked(drives: DataFrame) -> DataFrame:
    """(drive_id, asks): the kind of identifier that a drive is keyed by, or none where it is not understood."""
    read = (F.col("shape") != "unrecognised") & F.col("primary_key").isin(V.NEO, V.REG)
    return drives.select("drive_id", F.when(F.coalesce(read, F.lit(False)), F.col("primary_key")).otherwise("none").alias("asks"))


def _hits(keyed: DataFrame, drives: DataFrame, members: DataFrame) -> DataFrame:
    """(subject_id, drive_id) of subjects that are listed, by an equi-join on kind and value."""
    held = keyed.select("subject_id", F.explode(F.create_map(F.lit(V.NEO), "neo", F.lit(V.REG), "reg")).alias("asks", "value")).where("value is not null")
    listed = members.select("drive_id", F.col("kind").alias("asks"), "value").join(_asked(drives), ["drive_id", "asks"], "left_semi")
    return held.join(shuffled(listed), ["asks", "value"]).select("subject_id", "drive_id").distinct()


def season(subjects: DataFrame, drives: DataFrame, members: DataFrame) -> DataFrame:
    """Drives of each subject by verdict. Only those that list a subject are met one by one; drives that
    tell nothing about them are counted by the kind of their key, and the rest do not list them."""
    keyed = _keys(subjects.select("subject_id", "neo_id", "reg_no"))
    n = _asked(drives).agg(F.count("*").alias("n"), F.count_if(F.col("asks") == V.NEO).alias("n_neo"), F.count_if(F.col("asks") == V.REG).alias("n_reg"))
    hits = _hits(keyed, drives, members).groupBy("subject_id").agg(F.count("*").alias("hits"))
    met = keyed.select("subject_id", "neo", "reg").crossJoin(F.broadcast(n)).join(hits, "subject_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    clear = F.when(F.col("neo").isNotNull(), F.col("n_neo")).otherwise(0) + F.when(F.col("reg").isNotNull(), F.col("n_reg")).otherwise(0)
    return met.select("subject_id", F.col("hits").alias("shortlisted"), (clear - F.col("hits")).alias("not_shortlisted"), (F.col("n") - clear).alias("undetermined"))


def circle(subjects: DataFrame, drives: DataFrame, members: DataFrame, top: int = 6) -> DataFrame:
    """For each drive the counts over all tracked people (subjects with label), and the labels of the
    first `top` in order of verdict, then label.

    People who are listed come from the equi-join. Of the others a drive can show only the first `top` by
    label that cannot be told (the same for all drives of a kind) and the first 2 * top that could be
    listed, as fewer than `top` of these are where they are needed; so people never meet all drives.
    """
    keyed = _keys(subjects.select("subject_id", "neo_id", "reg_no", "label"))
    held = {V.NEO: F.col("neo").isNotNull(), V.REG: F.col("reg").isNotNull(), "none": F.lit(False)}
    flat = keyed.select("subject_id", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("asks"), has.alias("clear")) for k, has in held.items()])).alias("k")).select("subject_id", "label", "k.*")
    of_kind = flat.groupBy("asks").agg(F.count("*").alias("total"), F.count_if("clear").alias("clear_n"))
    asked = _asked(drives)
    hits = _hits(keyed, drives, members)
    listed = hits.groupBy("drive_id").agg(F.count("*").alias("shortlisted"))
    counts = asked.join(of_kind, "asks").join(listed, "drive_id", "left").withColumn("shortlisted", F.coalesce("shortlisted", F.lit(0)))
    counts = counts.select("drive_id", "total", "shortlisted", (F.col("clear_n") - F.col("shortlisted")).alias("not_shortlisted"), (F.col("total") - F.col("clear_n")).alias("undetermined"))

    label = [F.lower("label"), F.col("label"), F.col("subject_id")]

    def first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
        """The first n of each key; of each of 64 parts first, so that no task sorts a whole key."""
        part = F.pmod(F.xxhash64("subject_id"), F.lit(64))
        some = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))).where(F.col("k") <= n)
        return some.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= n)

    best = first(flat, ["asks", "clear"], label, 2 * top).drop("k")
    people = keyed.select("subject_id", "label")
    mine = first(hits.join(shuffled(people), "subject_id"), ["drive_id"], label, top).select("drive_id", "subject_id", "label", F.lit(0).alias("rank"), F.lit(IN).alias("status"))
    rest = asked.join(best, "asks").join(shuffled(hits), ["drive_id", "subject_id"], "left_anti")
    rest = rest.select("drive_id", "subject_id", "label", F.when(F.col("clear"), 2).otherwise(1).alias("rank"), F.when(F.col("clear"), OUT).otherwise(UNKNOWN).alias("status"))
    shown = first(mine.union(rest), ["drive_id"], [F.col("rank"), *label], top)
    named = shown.groupBy("drive_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label", "status"))), lambda x: F.concat_ws("=", x["label"], x["status"])), ";").alias("members"))
    return counts.join(named, "drive_id", "left")


def lookup(queries: DataFrame, drives: DataFrame, members: DataFrame) -> DataFrame:
    """(query, drive_id): drives keyed by the kind of the typed identifier that contain it."""
    raw = F.col("query")
    typed = queries.select("query", V.identifier_kind(raw).alias("kind"), F.coalesce(V.neo_id(raw), V.reg_no(raw)).alias("value")).where("kind is not null")
    keyed = drives.select("drive_id", F.col("primary_key").alias("kind"))
    return typed.join(members, ["kind", "value"]).join(keyed, ["drive_id", "kind"], "left_semi").select("query", "drive_id").distinct()


def sightings(subjects: DataFrame, drives: DataFrame, origins: DataFrame, each_side: int = 2) -> DataFrame:
    """(subject_id, drive_id, row, excerpt): where subjects stand in lists, by an equi-join on the kind of the
    list's key and the value, and the lines around: the nearest `each_side` rows below and above by row
    number in the same sheet, strictly, so others on the own line are left out."""
    held = subjects.select("subject_id", F.explode(F.create_map(F.lit(V.NEO), V.neo_id(F.col("neo_id")), F.lit(V.REG), V.reg_no(F.col("reg_no")))).alias("kind", "value")).where("value is not null")
    keyed = origins.select("drive_id", "kind", "value", "sheet", "row").join(drives.select("drive_id", F.col("primary_key").alias("kind")), ["drive_id", "kind"], "left_semi")
    at = held.join(shuffled(keyed), ["kind", "value"])
    lines = _around(at.select("drive_id", "kind", "sheet", "row", "value").distinct(), origins, each_side)
    text = lines.groupBy("drive_id", "kind", F.col("at_value").alias("value")).agg(F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("lines"))), lambda x: F.concat_ws(":", x["row"], x["value"])), ";").alias("excerpt"))
    return at.join(shuffled(text), ["drive_id", "kind", "value"]).select("subject_id", "drive_id", "row", "excerpt")


def evidence(subjects: DataFrame, drives: DataFrame, origins: DataFrame, each_side: int = 2) -> DataFrame:
    """(subject_id, drive_id, key, yours, listed, row, excerpt) for every subject and drive: what the list asks
    for, and where the subject stands in it (see sightings), if so."""
    yours = F.when(F.col("primary_key") == V.NEO, V.neo_id(F.col("neo_id"))).when(F.col("primary_key") == V.REG, V.reg_no(F.col("reg_no")))
    lists = saved(drives.select("drive_id", "primary_key", "total_students"), "lists")
    pairs = subjects.crossJoin(lists).select("subject_id", "drive_id", F.col("primary_key").alias("key"), yours.alias("yours"), F.col("total_students").alias("listed"))
    return pairs.join(shuffled(sightings(subjects, drives, origins, each_side)), ["subject_id", "drive_id"], "left").select("subject_id", "drive_id", "key", "yours", "listed", "row", "excerpt")


def excerpt_around(points: DataFrame, origins: DataFrame, each_side: int = 2) -> DataFrame:
    """(drive_id, kind, sheet, at_row, at_value, row, value): each point with the `each_side` nearest
    lines before and after it."""
    return _around(points, origins, each_side).select("drive_id", "kind", "sheet", "at_row", "at_value", F.explode("lines").alias("x")).select("drive_id", "kind", "sheet", "at_row", "at_value", "x.row", "x.value")


def _around(points: DataFrame, origins: DataFrame, each_side: int) -> DataFrame:
    """(drive_id, kind, sheet, at_row, at_value, lines): the lines of excerpt_around, as an array. Neighbours come from the order of rows within the sheet, so no pairs of
    lines are made: lines of one row share a rank, and a point reads the ranks beside its own."""
    sheet = ["drive_id", "kind", "sheet"]
    # rows with several lines are folded, so the lines beside are found behind all of the own row
    folded = origins.groupBy(*sheet, "row").agg(F.array_sort(F.collect_list("value")).alias("same"))
    v = Window.partitionBy(*sheet).orderBy("row")

    def side(shift, forward: bool):
        rows = F.array_compact(F.array(*[shift(F.struct("row", "same"), k).over(v) for k in range(1, each_side + 1)]))
        flat = F.flatten(F.transform(rows, lambda r: F.transform(r["same"] if forward else F.reverse(r["same"]), lambda x: F.struct(r["row"].alias("row"), x.alias("value")))))
        return F.slice(flat, 1, each_side)

    around = folded.select(*sheet, F.col("row").alias("at_row"), F.concat(side(F.lag, False), side(F.lead, True)).alias("beside"))
    hit = points.select(*sheet, F.col("row").alias("at_row"), F.col("value").alias("at_value")).join(shuffled(around), [*sheet, "at_row"])
    own = F.array(F.struct(F.col("at_row").alias("row"), F.col("at_value").alias("value")))
    return hit.select(*sheet, "at_row", "at_value", F.concat("beside", own).alias("lines"))
