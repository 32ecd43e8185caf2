"""Documents made from results: exports, group summaries, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import values as V


def export_rows(drives: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """(drive_id, identifier, name, status): each member of the drive's kind, named where known. names: value,
    name. Rows have no order until they are written (see export_order and write_csv)."""
    listed = members.join(drives.select("drive_id", F.coalesce("primary_key", F.lit(V.NEO)).alias("kind")), ["drive_id", "kind"]).join(names, "value", "left")
    status = F.when(F.col("name").isNotNull(), "Identified").otherwise("Not identified")
    return listed.select("drive_id", F.col("value").alias("identifier"), "name", status.alias("status"))


def export_order() -> list[Column]:
    return [F.col("name").isNull(), F.lower("name"), F.col("identifier")]


def csv_lines(rows: DataFrame, identifier_title: str = "Neo ID") -> DataFrame:
    """(drive_id, part, line): the CSV of each drive: a heading (part 0, after a byte-order mark) and a
    line per row. Lines end in CR LF when written; order by part, then the export order."""
    head = rows.select("drive_id").distinct().select("drive_id", F.lit(0).alias("part"), F.lit(f"﻿{identifier_title},Name,Status").alias("line"))
    line = F.concat_ws(",", V.csv_field(F.col("identifier")), V.csv_field(F.coalesce("name", F.lit(""))), V.csv_field(F.col("status")))
    return head.union(rows.select("drive_id", F.lit(1).alias("part"), line.alias("line")))


def write_csv(rows: DataFrame, folder: str, identifier_title: str = "Neo ID") -> None:
    """The CSV of each drive under folder/drive_id=…: the heading, then named members by name and identifier,
    then the others by identifier, in lines that end in CR LF. Parts of a drive are cut by ranges of
    that order and numbered in it, so a list of any size is written by many tasks."""
    order = [F.col("drive_id"), F.col("part"), *export_order()]
    line = F.concat_ws(",", V.csv_field(F.col("identifier")), V.csv_field(F.coalesce("name", F.lit(""))), V.csv_field(F.col("status")))
    body = rows.select("drive_id", F.lit(1).alias("part"), "identifier", "name", line.alias("line"))
    none = F.lit(None).cast("string")
    head = csv_lines(rows, identifier_title).where("part = 0").select("drive_id", "part", none.alias("identifier"), none.alias("name"), "line")
    dealt = head.union(body).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("drive_id", "line").write.mode("overwrite").partitionBy("drive_id").option("lineSep", "\r\n").text(folder)


def summaries(drives: DataFrame, labels: DataFrame, findings: DataFrame) -> DataFrame:
    """(drive_id, text): the message for a group: title, count, the round before, and, where the sample
    suffices, what it took. findings: drive_id, sufficient, kind, threshold, over_represented."""
    lab = drives.select("drive_id", "total_students", "round_label").join(labels, "drive_id", "left").select("drive_id", F.col("total_students").alias("n"), F.coalesce("label", "round_label").alias("label"))
    before = lab.select(F.col("drive_id").alias("parent_drive_id"), F.col("n").alias("p_n"), F.col("label").alias("p_label"))
    d = drives.join(lab.select("drive_id", "label"), "drive_id").join(before, "parent_drive_id", "left").join(findings, "drive_id", "left")
    title = F.concat(F.lit("*"), F.trim(F.replace("company", F.lit("*"), F.lit(""))), F.lit("*"), F.coalesce(F.concat(F.lit(" · "), "label"), F.lit("")))
    count = F.concat(V.thousands(F.col("total_students")), F.lit(" shortlisted"), F.coalesce(F.concat(F.lit(" · "), V.day(F.col("drive_date"))), F.lit("")))
    prior = F.when(F.col("p_n").isNotNull(), F.concat(F.lit("From "), V.thousands(F.col("p_n")), F.coalesce(F.concat(F.lit(" in "), "p_label"), F.lit(" in the round before"))))
    cut = (
        F.when(F.col("kind") == "hard_cutoff", F.concat(F.lit("CGPA cutoff ≈ "), F.format_string("%.1f", F.col("threshold")), F.lit(" _(estimate)_")))
        .when(F.col("kind") == "soft_preference", "CGPA skews high, no hard cutoff _(estimate)_")
        .when(F.col("kind") == "no_cgpa_filter", "No CGPA cutoff seen")
    )
    more = F.when(F.col("over_represented") != "", F.concat(F.lit("More "), "over_represented", F.lit(" than the batch")))
    ok = F.coalesce("sufficient", F.lit(False))
    found = F.array_compact(F.array(F.when(ok, cut), F.when(ok, more)))
    body = F.concat(F.array_compact(F.array(title, count, prior)), F.when(F.size(found) > 0, F.concat(F.array(F.lit("")), found)).otherwise(F.array().cast("array<string>")))
    return d.select("drive_id", F.array_join(body, "\n").alias("text"))


def preview(status: Column, reason: Column, file_key: Column) -> Column:
    """struct(status, reason) as documents write a verdict."""
    why = F.when(reason == "key_kind_not_configured", F.when(file_key == V.REG, "needs_reg_no").otherwise("needs_neo_id")).otherwise(reason)
    return F.struct(status.alias("status"), why.alias("reason"))


def glance(snapshot_status: Column, n_drives: Column, activity: Column, verdict: Column) -> Column:
    """What a small view shows first."""
    return F.when(activity != "idle", activity).when(n_drives == 0, "empty").when(snapshot_status == "stale", "stale").otherwise(verdict)


def activity(kind: Column, at: Column, now: Column) -> Column:
    """importing for 3 minutes, failed for 24 hours, else idle."""
    fresh = lambda span: now < at + F.expr(f"INTERVAL {span}")
    return F.when((kind == "importing") & fresh("3 MINUTES"), "importing").when((kind == "failed") & fresh("24 HOURS"), "failed").otherwise("idle")


def leads(at: Column, now: Column, hours: int = 12) -> Column:
    """Whether the newest result still leads."""
    return now < at + F.expr(f"INTERVAL {hours} HOURS")


def timeline(now: Column, leads_until: Column, until: Column, midnights: int = 8) -> Column:
    """Sorted distinct moments at which a view changes: now, ends that lie ahead, the next midnights."""
    day = F.date_trunc("day", now)
    ahead = F.filter(F.array(leads_until, until), lambda x: x.isNotNull() & (x > now))
    nights = F.sequence(day + F.expr("INTERVAL 1 DAY"), day + F.expr(f"INTERVAL {midnights} DAYS"), F.expr("INTERVAL 1 DAY"))
    return F.array_sort(F.array_distinct(F.concat(F.array(now), ahead, nights)))


def snapshots(drives: DataFrame, verdicts: DataFrame, seasons: DataFrame, analyses: DataFrame, top: int = 24, academics_known: bool = True) -> DataFrame:
    """(subject_id, document): JSON with schema 1, the season's counts and the newest drives with verdict
    and analysis. The drives are cut to the newest `top` before anything is joined."""
    newest = drives.orderBy(F.desc("imported_at"), F.desc("drive_id")).limit(top)
    ready = F.lit(academics_known) & F.coalesce("sufficient", F.lit(False))
    status = F.when(F.lit(not academics_known), F.lit("not_set_up")).when(ready, "ready").otherwise("insufficient")
    a = analyses.select("drive_id", F.struct(status.alias("status"), F.coalesce("matched", F.lit(0)).alias("matched"), F.when(ready, F.col("kind")).alias("cutoff"), F.when(ready, F.col("threshold")).alias("threshold")).alias("analysis"))
    one = newest.join(a, "drive_id", "left").join(verdicts, "drive_id")
    view = F.struct("imported_at", "drive_id", "company", preview(F.col("status"), F.col("reason"), F.col("file_key")).alias("verdict"), "analysis")
    per = one.groupBy("subject_id").agg(F.sort_array(F.collect_list(view), asc=False).alias("drives")).join(seasons, "subject_id")
    doc = F.to_json(F.struct(F.lit(1).alias("schema"), F.struct("shortlisted", "not_shortlisted", "undetermined").alias("season"), F.transform("drives", lambda d: F.struct(d["drive_id"].alias("drive_id"), d["company"].alias("company"), d["verdict"].alias("verdict"), d["analysis"].alias("analysis"))).alias("drives")))
    return per.select("subject_id", doc.alias("document"))


def read_snapshots(documents: DataFrame) -> DataFrame:
    """documents (document) with state: missing, stale (another schema, or no whole JSON) or current."""
    schema = F.try_variant_get(F.try_parse_json(F.col("document")), "$.schema", "int")
    return documents.withColumn("state", F.when(F.col("document").isNull(), "missing").when(schema == 1, "current").otherwise("stale"))


#: What a verdict, and a finding about a cutoff, in a document may say.
STATUSES = ("shortlisted", "not_shortlisted", "undetermined")
CUTOFFS = ("hard_cutoff", "soft_preference", "no_cgpa_filter")


def _tag(value: Column, known: tuple[str, ...]) -> Column:
    """A tag that is among the known ones; another, as a later version may write, is unknown and no answer."""
    return F.when(value.isin(*known), value).when(value.isNotNull(), "unknown")


def snapshot_verdicts(documents: DataFrame) -> DataFrame:
    """(drive_id, company, status, reason, analysis, cutoff, threshold) of the drives in current documents
    (document), which are read as they stand, without a schema: fields that are missing or of another
    type are null and leave the others as they are, and further fields do not matter. A missing status
    is unknown; analysis is ready, insufficient or not_set_up."""
    read = read_snapshots(documents).where("state = 'current'")
    d = read.select(F.explode(F.try_variant_get(F.try_parse_json(F.col("document")), "$.drives", "array<variant>")).alias("d"))
    get = lambda path, kind="string": F.try_variant_get(F.col("d"), path, kind)
    return d.select(
        get("$.drive_id", "long").alias("drive_id"), get("$.company").alias("company"),
        F.coalesce(_tag(get("$.verdict.status"), STATUSES), F.lit("unknown")).alias("status"), get("$.verdict.reason").alias("reason"),
        _tag(get("$.analysis.status"), ("ready", "insufficient", "not_set_up")).alias("analysis"), _tag(get("$.analysis.cutoff"), CUTOFFS).alias("cutoff"), get("$.analysis.threshold", "double").alias("threshold"),
    )


def _mixed(left: Column, right: Column, n_left: int, n_right: int, key: str, tweak: Column, back: bool) -> Column:
    """struct(left, right): a permutation of the pairs below n_left and n_right, by four rounds in which a
    keyed hash of one side is added to the other; back undoes it."""

    def stirred(mine: Column, other: Column, n: int, k: int) -> Column:
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(k)), tweak, other.cast("string")), 256)
        add = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(n))
        return F.pmod(mine - add if back else mine + add, F.lit(n)).cast("long")

    def step(k: int):
        if k % 2:
            return lambda p: F.struct(p["l"].alias("l"), stirred(p["r"], p["l"], n_right, k).alias("r"))
        return lambda p: F.struct(stirred(p["l"], p["r"], n_left, k).alias("l"), p["r"].alias("r"))

    pair = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for k in reversed(range(4)) if back else range(4):
        pair = _let(pair, step(k))
    return pair


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _to_number(letters: list[Column]) -> Column:
    out = F.lit(0)
    for x in letters:
        out = out * 26 + (F.ascii(x) - 65)
    return out


def _to_letters(number: Column, n: int) -> list[Column]:
    return [F.char(F.lit(65) + F.pmod(F.floor(number / 26**k), F.lit(26))) for k in reversed(range(n))]


def shaped_alias(value: Column, key: str, back: bool = False) -> Column:
    """Another identifier of the same shape, null for what is no identifier: four letters and four digits in
    turn for a primary one; the same admission year, and as many digits, for a secondary one. For one key
    no two identifiers share an alias, whichever others there are, and back gives the identifier again."""
    neo, reg = V.neo_id(value), V.reg_no(value)
    at = lambda x, k, n=1: F.substring(x, k, n)
    digits = lambda x, n: F.lpad(x.cast("string"), n, "0")
    p = _mixed(_to_number([at(neo, k) for k in (1, 3, 5, 7)]), F.concat(*[at(neo, k) for k in (2, 4, 6, 8)]), 26**4, 10**4, key, F.lit("neo"), back)
    as_neo = _let(p, lambda x: F.concat(*[c for k, letter in enumerate(_to_letters(x["l"], 4), 1) for c in (letter, at(digits(x["r"], 4), k))]))
    out = F.when(neo.isNotNull(), as_neo)

    def as_reg(n: int) -> Column:
        year = at(reg, 1, 2)
        q = _mixed(_to_number([at(reg, k) for k in (3, 4, 5)]), at(reg, 6, n), 26**3, 10**n, key, F.concat(year, F.lit(f"/{n}")), back)
        return _let(q, lambda x: F.concat(year, *_to_letters(x["l"], 3), digits(x["r"], n)))

    for n in (4, 5, 6):
        out = F.when(reg.isNotNull() & (F.length(reg) == 5 + n), as_reg(n)).otherwise(out)
    return out


def pseudonyms(identifiers: DataFrame, key: str) -> DataFrame:
    """(value, alias): stable for a key, equal for equal values, never shared by two values, and the same
    whatever else is in the table: identifiers keep their shape (see shaped_alias), other values become
    the hex digits of a keyed hash."""
    rows = identifiers.select("value").distinct()
    h = F.sha2(F.concat(F.lit(key), F.lit("\x1f"), F.col("value")), 256)
    return rows.select("value", F.coalesce(shaped_alias(F.col("value"), key), h).alias("alias"))


def leaks(made: DataFrame, real: DataFrame) -> DataFrame:
    """Values that stand in both."""
    return made.select("value").intersect(real.select("value"))
