"""Successive rounds of a list: overlap, links, labels, progress, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.naming import UNNAMED, company_key
from rollcall.functions.values import NEO, REG
from rollcall.session import forget, saved, shuffled

OVERLAP = 0.6


def overlaps(drives: DataFrame, members: DataFrame) -> DataFrame:
    """(drive_id, earlier_id, share): for each drive and each earlier one of the same company, how much
    of the new list the earlier one has; by primary identifiers, by secondary ones only where either
    list has no primary ones. drives: drive_id, company, imported_at.

    Shared members come from one equi-join of members on (company, kind, value), counted per pair of
    drives before the shuffle, not from a comparison of lists.
    """
    keyed = saved(drives.select("drive_id", "imported_at", company_key(F.col("company")).alias("ck")), "companies")
    listed = members.select("drive_id", "kind", "value").distinct()
    sizes = listed.groupBy("drive_id").agg(F.count_if(F.col("kind") == NEO).alias("n_neo"), F.count_if(F.col("kind") == REG).alias("n_reg"))
    new = keyed.join(sizes, "drive_id", "left").na.fill(0, ["n_neo", "n_reg"])
    old = new.select(F.col("drive_id").alias("earlier_id"), F.col("imported_at").alias("earlier_at"), "ck", F.col("n_neo").alias("o_neo"), F.col("n_reg").alias("o_reg"))
    before = (F.col("earlier_at") < F.col("imported_at")) | ((F.col("earlier_at") == F.col("imported_at")) & (F.col("earlier_id") < F.col("drive_id")))
    pairs = new.join(old, "ck").where(before)
    of_company = listed.join(keyed, "drive_id")
    later = (F.col("a.imported_at") > F.col("b.imported_at")) | ((F.col("a.imported_at") == F.col("b.imported_at")) & (F.col("a.drive_id") > F.col("b.drive_id")))
    both = of_company.alias("a").join(shuffled(of_company).alias("b"), (F.col("a.ck") == F.col("b.ck")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.value") == F.col("b.value")) & later)
    common = both.groupBy(F.col("a.drive_id").alias("drive_id"), F.col("b.drive_id").alias("earlier_id")).agg(F.count_if(F.col("a.kind") == NEO).alias("c_neo"), F.count_if(F.col("a.kind") == REG).alias("c_reg"))
    met = pairs.join(common, ["drive_id", "earlier_id"], "left").na.fill(0, ["c_neo", "c_reg"])
    share = lambda c, n, o: F.when((F.col(n) > 0) & (F.col(o) > 0), F.col(c) / F.col(n))
    return met.select("drive_id", "earlier_id", "ck", "earlier_at", F.coalesce(share("c_neo", "n_neo", "o_neo"), share("c_reg", "n_reg", "o_reg")).alias("share"))


def link_rounds(drives: DataFrame, members: DataFrame, least: float = OVERLAP) -> DataFrame:
    """drives with parent_drive_id: as it was where set, else the newest earlier drive of the company
    that has at least `least` of the list. Unnamed drives are not linked."""
    fit = overlaps(drives, members).where((F.col("share") >= least) & (F.col("ck") != company_key(F.lit(UNNAMED))))
    best = fit.groupBy("drive_id").agg(F.max_by("earlier_id", F.struct("earlier_at", "earlier_id")).alias("_found"))
    return drives.join(best, "drive_id", "left").withColumn("parent_drive_id", F.coalesce("parent_drive_id", "_found")).drop("_found")


def _chains(pointers: DataFrame) -> DataFrame:
    """(way, drive_id, path, looped): each drive and those that its pointer, the pointer of that, and so on
    lead to. pointers: way, drive_id, next; ways do not meet. A path stops before a repeat (looped), or
    where the next drive is not in the table.

    Paths are doubled: each round appends to a path the path of the drive that it has come to, so rounds
    grow with the logarithm of the longest chain. Each is written to the shared folder; only whether a
    path is left to grow comes to the driver.
    """
    now = saved(pointers.select("way", "drive_id", F.array("drive_id").alias("path"), F.col("next").alias("cur"), F.lit(False).alias("looped")), "chains")
    while not now.where("cur is not null").isEmpty():
        on = now.select("way", F.col("drive_id").alias("cur"), F.col("path").alias("_more"), F.col("cur").alias("_next"), F.col("looped").alias("_looped"), F.lit(True).alias("_known"))
        met = now.join(on, ["way", "cur"], "left")
        meets = F.coalesce(F.arrays_overlap("path", "_more"), F.lit(False))
        first = F.array_min(F.filter(F.transform("_more", lambda x, k: F.when(F.array_contains("path", x), k)), lambda k: k.isNotNull()))
        grown = F.when(meets, F.concat("path", F.slice("_more", F.lit(1), first))).when(F.col("_known"), F.concat("path", "_more")).otherwise(F.col("path"))
        after = saved(met.select("way", "drive_id", grown.alias("path"), F.when(~meets, F.col("_next")).alias("cur"), (F.col("looped") | meets | F.coalesce("_looped", F.lit(False))).alias("looped")), "chains")
        forget(now)
        now = after
    return now.drop("cur")


def _ancestors(drives: DataFrame) -> DataFrame:
    """(drive_id, path): the drive and its ancestors, nearest first."""
    return _chains(drives.select(F.lit("up").alias("way"), "drive_id", F.col("parent_drive_id").alias("next"))).select("drive_id", "path")


def round_labels(drives: DataFrame) -> DataFrame:
    """(drive_id, label) of drives in a chain: the list's own word, else R and its position. Chains are
    walked to their end; a cycle stops where it would repeat."""
    drives = saved(drives.select("drive_id", "parent_drive_id", "round_label"), "drives")
    return _labels(drives, _ancestors(drives))


def _labels(drives: DataFrame, ancestors: DataFrame) -> DataFrame:
    depth = ancestors.select("drive_id", (F.size("path") - 1).alias("depth"))
    parents = drives.where("parent_drive_id is not null").select(F.col("parent_drive_id").alias("drive_id")).distinct().withColumn("has_child", F.lit(True))
    rows = drives.select("drive_id", "round_label").join(depth, "drive_id").join(parents, "drive_id", "left")
    return rows.where((F.col("depth") > 0) | F.col("has_child")).select("drive_id", F.coalesce("round_label", F.concat(F.lit("R"), (F.col("depth") + 1).cast("string"))).alias("label"))


def _walked(rings: DataFrame, child: DataFrame) -> DataFrame:
    """(drive_id, path) of drives whose parents form a ring: step by step to the newest child that is not on
    the path. Only these few, which no sound import makes, go this way, with a round for each step."""
    now = saved(rings.withColumn("cur", F.col("drive_id")), "rings")
    while not now.where("cur is not null").isEmpty():
        met = now.join(child, F.col("cur") == F.col("_of"), "left")
        fresh = F.try_element_at(F.filter("kids", lambda k: ~F.array_contains("path", k["drive_id"])), F.lit(-1))["drive_id"]
        after = saved(met.withColumn("_n", fresh).select("drive_id", F.when(F.col("_n").isNotNull(), F.concat("path", F.array("_n"))).otherwise(F.col("path")).alias("path"), F.col("_n").alias("cur")), "rings")
        forget(now)
        now = after
    return now.select("drive_id", "path")


def progression(drives: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(subject_id, drive_id, steps, next_pending) for each drive in a chain: its ancestors, itself and
    its newest child's line, each "label=status"; pending if the last is in and not Final."""
    drives = saved(drives.select("drive_id", "imported_at", "parent_drive_id", "round_label"), "drives")
    child = drives.where("parent_drive_id is not null").groupBy(F.col("parent_drive_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("imported_at", "drive_id"))).alias("kids"))
    newest = drives.join(child.select(F.col("_of").alias("drive_id"), F.element_at("kids", -1)["drive_id"].alias("next")), "drive_id", "left")
    chains = _chains(drives.select(F.lit("up").alias("way"), "drive_id", F.col("parent_drive_id").alias("next")).union(newest.select(F.lit("down"), "drive_id", "next")))
    ancestors = chains.where("way = 'up'").select("drive_id", "path")
    down = chains.where("way = 'down'").select("drive_id", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("_down"), "looped")
    both = ancestors.select("drive_id", F.reverse("path").alias("path")).join(down, "drive_id")
    crossed = F.col("looped") | F.arrays_overlap("path", "_down")
    now = both.where(~crossed).select("drive_id", F.concat("path", "_down").alias("path"))
    rings = both.where(crossed).select("drive_id", "path")
    if not rings.isEmpty():
        now = now.union(_walked(rings, child))
    # the lists of one line of rounds have one path, which is told once for all of them
    paths = saved(now.where(F.size("path") >= 2).withColumn("line", F.min("drive_id").over(Window.partitionBy("path"))), "paths")
    steps = paths.where("line = drive_id").select("line", F.posexplode("path").alias("at", "step_id"))
    named = saved(steps.join(_labels(drives, ancestors).withColumnRenamed("drive_id", "step_id"), "step_id", "left"), "steps")
    told = named.join(verdicts.select("subject_id", F.col("drive_id").alias("step_id"), "status"), "step_id")
    rows = told.groupBy("subject_id", "line").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("label", F.lit("")).alias("label"), "status"))).alias("s"))
    last = F.element_at("s", -1)
    lines = rows.select("subject_id", "line", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["label"], x["status"])), ">").alias("steps"), ((last["status"] == "shortlisted") & (last["label"] != "Final")).alias("next_pending"))
    return lines.join(paths.select("line", "drive_id"), "line").select("subject_id", "drive_id", "steps", "next_pending")


def compare_rounds(pairs: DataFrame, members: DataFrame, key: str = NEO) -> DataFrame:
    """(from_id, to_id, value, change): advanced, dropped or added, by primary identifiers unless `key`
    says otherwise. pairs: from_id, to_id."""
    listed = members.where(F.col("kind") == key).select("drive_id", "value").distinct()
    a = pairs.join(listed.withColumnRenamed("drive_id", "from_id"), "from_id").select("from_id", "to_id", "value", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = pairs.join(listed.withColumnRenamed("drive_id", "to_id"), "to_id").select("from_id", "to_id", "value", F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = a.union(b).groupBy("from_id", "to_id", "value").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select("from_id", "to_id", "value", F.when(F.col("a") * F.col("b") == 1, "advanced").when(F.col("a") == 1, "dropped").otherwise("added").alias("change"))


def friends_in(changes: DataFrame, friends: DataFrame) -> DataFrame:
    """The changes of tracked people (value)."""
    return changes.join(friends.select("value"), "value", "left_semi")


def neighbours(drives: DataFrame) -> DataFrame:
    """(drive_id, before_id, after_id) within a company by import time."""
    w = Window.partitionBy(company_key(F.col("company"))).orderBy("imported_at", "drive_id")
    return drives.select("drive_id", F.lag("drive_id").over(w).alias("before_id"), F.lead("drive_id").over(w).alias("after_id"))
