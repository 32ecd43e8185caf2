"""Cohort statistics: distributions, floors, branch lift, and the gate before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import values as V
from rollcall.session import saved, shuffled

#: Thresholds a list may be cut at, and what makes one a signal.
LADDER = (9.5, 9.0, 8.5, 8.0, 7.5, 7.0)
MIN_BATCH_BELOW, SOFT_SHIFT = 0.10, 0.15
#: The wording of the verdicts, the parts around their figures.
SAID = {
    "hard_cutoff": ("Looks like a CGPA cutoff around ", ", lowest found ", ". An estimate, not an official cutoff."),
    "soft_preference": ("Looks like a preference, not a hard cutoff: median ", ", lowest found ", "."),
    "no_cgpa_filter": "No CGPA filter detected. It looks like the batch as a whole.",
    "as_batch": ("Branch mix looks like the batch, led by ", "."),
    "over": (" is over-represented against the batch.", " are over-represented against the batch."),
}
QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75}


def value_counts(rows: DataFrame, keys: list[str], value: str = "cgpa") -> DataFrame:
    """(keys, value, n, before): how often each value occurs, and how many lie below it. Grades have few
    distinct values, so all ranks come from this small table and no group is sorted whole."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("before", F.sum("n").over(w) - F.col("n"))


def distribution(rows: DataFrame, keys: list[str], value: str = "cgpa") -> DataFrame:
    """(keys, n, min, max, mean, std_dev, p5, p25, median, p75). A percentile q is the sorted value at
    position min(floor(n q), n - 1); the deviation divides by n. Groups without values have no row."""
    counts = value_counts(rows, keys, value)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    at = lambda q: F.least(F.floor(F.col("total") * q), F.col("total") - 1)
    x, n = F.col(value), F.col("n")
    met = counts.join(total, keys)
    first = met.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x * n).alias("_s"),
        *[F.max(F.when((F.col("before") <= at(q)) & (at(q) < F.col("before") + n), x)).alias(k) for k, q in QUANTILES.items()],
    )
    mean = first.withColumn("mean", F.col("_s") / F.col("count")).drop("_s")
    spread = counts.join(mean.select(*keys, "mean", "count"), keys).groupBy(*keys).agg(F.sqrt(F.sum(n * F.pow(x - F.col("mean"), F.lit(2.0))) / F.max("count")).alias("std_dev"))
    return mean.join(spread, keys).withColumnRenamed("count", "n").select(*keys, "n", "min", "max", "mean", "std_dev", *QUANTILES)


def bucket(x: Column) -> Column:
    """0 to 15: quarter steps from 6 to 10, what lies outside goes to the ends."""
    return F.greatest(F.lit(0), F.least(F.lit(15), F.floor((x - 6.0) / 0.25))).cast("int")


def histogram(rows: DataFrame, keys: list[str], value: str = "cgpa") -> DataFrame:
    """(keys, bucket, lower, upper, count): all 16 buckets of every group that has values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))
    spine = counted.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(15))))
    b = F.col("bucket")
    return spine.join(counted, [*keys, "bucket"], "left").select(*keys, "bucket", (6.0 + b * 0.25).alias("lower"), (6.25 + b * 0.25).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def trimmed(histograms: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """Without empty buckets at either end, but for `pad` of them."""
    full = F.when(F.col("count") > 0, F.col("bucket"))
    ends = histograms.groupBy(*keys).agg(F.min(full).alias("_lo"), F.max(full).alias("_hi"))
    return histograms.join(ends, keys).where(F.col("bucket").between(F.col("_lo") - pad, F.col("_hi") + pad)).drop("_lo", "_hi")


def share_below(x: Column, threshold: float, slack: float = 0.0) -> Column:
    """Aggregate: the share of values below a threshold."""
    return F.coalesce(F.avg(F.when(x < F.lit(threshold) - F.lit(slack), 1.0).otherwise(0.0)), F.lit(0.0))


def percentile_rank(subjects: DataFrame, rows: DataFrame, keys: list[str], value: str = "cgpa") -> DataFrame:
    """subjects (subject_id, cgpa; null grades give no row) × groups: the share of the group's values
    strictly below the own one. Grades meet the table of value counts in one running sum."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    mine = subjects.where("cgpa is not null").select("subject_id", F.col("cgpa").alias("_own"))
    # each grade asked for is laid among the counts, before its equals: the sum so far is what lies below
    asked = mine.select("_own").distinct().crossJoin(total.select(*keys)).select(*keys, F.col("_own").alias("_x"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("_side"))
    laid = asked.union(counts.select(*keys, F.col(value).alias("_x"), "n", F.lit(1).alias("_side")))
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = laid.withColumn("_below", so_far).where("_side = 0").join(total, keys).select(*keys, F.col("_x").alias("_own"), (F.col("_below") / F.col("total")).alias("share_below"))
    return mine.join(ranked, "_own").select("subject_id", *keys, F.col("_own").alias("cgpa"), "share_below")


def floor_of(rows: DataFrame, keys: list[str], value: str = "cgpa", share: float = 0.05) -> DataFrame:
    """(keys, floor): the smallest value up to which at least `share` of the group lies."""
    counts = value_counts(rows, keys, value)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    met = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))
    return met.where((F.col("before") + F.col("n")) / F.col("total") >= share).groupBy(*keys).agg(F.min(value).alias("floor"))


def ladder(rows: DataFrame, baseline: DataFrame, value: str = "cgpa") -> DataFrame:
    """(drive_id, threshold, share_below_shortlist, share_below_batch, is_signal), one pass over each
    side: the shares of all thresholds are conditional averages."""
    x = F.col(value)
    ours = rows.where(x.isNotNull()).groupBy("drive_id").agg(F.count("*").alias("n"), *[share_below(x, t, 1e-9).alias(f"l{k}") for k, t in enumerate(LADDER)])
    theirs = baseline.where(x.isNotNull()).agg(*[share_below(x, t).alias(f"b{k}") for k, t in enumerate(LADDER)])
    steps = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"l{k}").alias("l"), F.col(f"b{k}").alias("b")) for k, t in enumerate(LADDER)])
    flat = ours.crossJoin(F.broadcast(theirs)).select("drive_id", "n", F.explode(steps).alias("s"))
    signal = (F.col("s.l") <= V.tolerance(F.col("n"))) & (F.col("s.b") >= MIN_BATCH_BELOW)
    return flat.select("drive_id", F.col("s.t").alias("threshold"), F.col("s.l").alias("share_below_shortlist"), F.col("s.b").alias("share_below_batch"), signal.alias("is_signal"))


def _told(which: str, *figures: Column) -> Column:
    """The wording of SAID with its figures between the parts."""
    parts = SAID[which]
    return F.concat(*[x for part, figure in zip(parts, figures) for x in (F.lit(part), figure)], F.lit(parts[-1]))


def cutoff(rows: DataFrame, baseline: DataFrame, value: str = "cgpa", dist: DataFrame | None = None) -> DataFrame:
    """(drive_id, kind, threshold, observed_floor, statement): a hard floor at the highest signal, else a
    preference if the list's 5th percentile lies well above the batch's floor, else no filter. dist is the
    distribution of rows, where it is known already."""
    best = ladder(rows, baseline, value).groupBy("drive_id").agg(F.max(F.when(F.col("is_signal"), F.col("threshold"))).alias("t"))
    dist = (distribution(rows, ["drive_id"], value) if dist is None else dist).select("drive_id", "min", "median", "p5")
    batch = floor_of(baseline, [], value).agg(F.max("floor").alias("batch"))
    met = dist.join(best, "drive_id").crossJoin(F.broadcast(batch))
    kind = F.when(F.col("t").isNotNull(), "hard_cutoff").when(F.col("p5") - F.col("batch") >= SOFT_SHIFT, "soft_preference").otherwise("no_cgpa_filter")
    low = F.format_string("%.2f", F.col("min"))
    said = (
        F.when(kind == "hard_cutoff", _told("hard_cutoff", F.format_string("%.1f", F.col("t")), low))
        .when(kind == "soft_preference", _told("soft_preference", F.format_string("%.2f", F.col("median")), low))
        .otherwise(SAID["no_cgpa_filter"])
    )
    return met.select("drive_id", kind.alias("kind"), F.col("t").alias("threshold"), F.when(kind != "no_cgpa_filter", F.col("min")).alias("observed_floor"), said.alias("statement"))


def branch_lift(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """(drive_id, branch, count, share, baseline_share, lift) by canonical label. A null branch of a
    list is Unknown; null branches of the baseline are left out."""
    label = V.branch_label(F.col("branch"))
    ours = rows.groupBy("drive_id", label.alias("branch")).agg(F.count("*").alias("count"))
    total = ours.groupBy("drive_id").agg(F.sum("count").alias("n"))
    theirs = baseline.where("branch is not null").groupBy(label.alias("branch")).agg(F.count("*").alias("b"))
    all_b = theirs.agg(F.sum("b").alias("nb"))
    met = ours.join(total, "drive_id").join(theirs, "branch", "left").crossJoin(F.broadcast(all_b))
    base = F.when(F.col("nb").isNotNull(), F.coalesce("b", F.lit(0)) / F.col("nb"))
    share = F.col("count") / F.col("n")
    return met.select("drive_id", "branch", "count", share.alias("share"), base.alias("baseline_share"), F.when(base > 0, share / base).alias("lift"))


def over_represented(lifts: DataFrame) -> DataFrame:
    """(drive_id, over_represented, statement): branches twice as common as in the batch with three people
    or more, strongest first."""
    strong = (F.col("lift") >= 2.0) & (F.col("count") >= 3)
    found = F.collect_list(F.when(strong, F.struct((-F.col("lift")).alias("l"), "branch")))
    rows = lifts.groupBy("drive_id").agg(F.transform(F.array_sort(found), lambda x: x["branch"]).alias("over"), F.min_by("branch", F.struct(-F.col("count"), F.col("branch"))).alias("top"))
    joined = F.array_join("over", " and ")
    said = F.when(F.size("over") == 0, _told("as_batch", F.col("top"))).otherwise(F.concat(joined, F.when(F.size("over") == 1, SAID["over"][0]).otherwise(SAID["over"][1])))
    return rows.select("drive_id", joined.alias("over_represented"), said.alias("statement"))


def resolved_regs(members: DataFrame, neo_to_reg: DataFrame) -> DataFrame:
    """(drive_id, reg_no): secondary identifiers listed, and those that listed primary ones lead to (only
    links good enough to aggregate)."""
    good = neo_to_reg.where(V.can_aggregate(F.col("confidence"))).select(F.col("neo_id").alias("value"), "reg_no")
    led = members.where(F.col("kind") == V.NEO).join(shuffled(good), "value").select("drive_id", "reg_no")
    return led.union(members.where(F.col("kind") == V.REG).select("drive_id", F.col("value").alias("reg_no"))).distinct()


def totals(members: DataFrame) -> DataFrame:
    """(drive_id, total_students): the larger of the two identifier sets."""
    per = members.select("drive_id", "kind", "value").distinct().groupBy("drive_id").agg(F.count_if(F.col("kind") == V.NEO).alias("a"), F.count_if(F.col("kind") == V.REG).alias("b"))
    return per.select("drive_id", F.greatest("a", "b").alias("total_students"))


def matched(members: DataFrame, neo_to_reg: DataFrame, academics: DataFrame) -> DataFrame:
    """(drive_id, reg_no, cgpa, branch) of members whose grade is known and sane."""
    facts = academics.select("reg_no", V.sane_cgpa(F.col("cgpa")).alias("cgpa"), "branch").where("cgpa is not null")
    return resolved_regs(members, neo_to_reg).join(shuffled(facts), "reg_no")


def gate(members: DataFrame, found: DataFrame) -> DataFrame:
    """(drive_id, matched, total, coverage, sufficient) for every drive with members."""
    n = found.groupBy("drive_id").agg(F.count("*").alias("matched"))
    rows = totals(members).join(n, "drive_id", "left").select("drive_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.col("total_students").alias("total"))
    return rows.withColumns({"coverage": V.coverage(F.col("matched"), F.col("total")), "sufficient": V.sufficient(F.col("matched"), F.col("total"))})


def analyse(members: DataFrame, neo_to_reg: DataFrame, academics: DataFrame, baseline: DataFrame, cohort: str | None = None) -> DataFrame:
    """One row per drive: the gate, and, only where the sample suffices, the distribution, the cutoff and
    the branches. Drives that fail the gate are left out before the statistics, then joined again. The
    baseline is that of the cohort, or all of it where the cohort has no grades."""
    found = saved(matched(members, neo_to_reg, academics), "matched")
    gated = gate(members, found)
    rows = found.join(gated.where("sufficient").select("drive_id"), "drive_id", "left_semi")
    if cohort is not None:
        has = baseline.where((F.col("cohort") == cohort) & F.col("cgpa").isNotNull()).agg((F.count("*") > 0).alias("_has"))
        baseline = baseline.crossJoin(F.broadcast(has)).where((F.col("cohort") == cohort) | ~F.col("_has")).drop("_has")
    known = saved(distribution(rows, ["drive_id"]), "distribution")
    dist = known.drop("n", "min", "max")
    cut = cutoff(rows, baseline, dist=known).withColumnRenamed("statement", "cutoff_statement")
    branches = over_represented(branch_lift(rows, baseline)).withColumnRenamed("statement", "branch_statement")
    return gated.join(dist, "drive_id", "left").join(cut, "drive_id", "left").join(branches, "drive_id", "left")
