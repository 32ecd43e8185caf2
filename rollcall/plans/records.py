"""Registered queries over records: reference sheets, pastes, jobs that run once, files, exports, texts for
display. Names, numbers and times come from the tables; the SQL reads the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions import naming
from rollcall.functions import values as V
from rollcall.operators import analytics as A
from rollcall.operators import answers as B
from rollcall.operators import documents as D
from rollcall.operators import identity as I
from rollcall.operators import ingest as G
from rollcall.operators import rounds as R
from rollcall.operators import store as S
from rollcall.operators import verdicts as W
from rollcall.plans import importing
from rollcall.plans import relations as T
from rollcall.plans.catalogue import _baseline, _pairs, _verdicts, query
from rollcall.plans.people import _PEOPLE, people
from rollcall.sources import sheets

# --- reference sheets and pastes ------------------------------------------------------------------


def _reference(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as three sheets with grades, some of them out of range or no number."""
    k = F.col("subject_id")
    p = T.population(spark, sf).withColumn("file_id", F.concat(F.lit("grades "), (k % 3).cast("string")))
    grade = F.when(k % 7 > 0, F.col("cgpa").cast("string")).otherwise("n/a")
    rows = p.select("file_id", (F.floor(k / 3) + 1).cast("int").alias("row"), F.posexplode(F.array("reg_no", F.translate("label", "#0123456789", " abcdefghij"), grade, "branch")).alias("col", "text"))
    heads = p.select("file_id").distinct().select("file_id", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, ("Registration Number", "Name", "CGPA", "Branch")))).alias("col", "text"))
    return heads.union(rows).select("file_id", F.lit(0).alias("sheet_idx"), F.lit("Sheet1").alias("sheet"), "row", "col", "text")


_GRADED = """
, grd AS (SELECT 'grades ' || (subject_id % 3) AS file_id, (subject_id // 3 + 1)::INT AS row, reg_no, translate(label, '#0123456789', ' abcdefghij') AS name, CASE WHEN subject_id % 7 > 0 AND cgpa BETWEEN 4 AND 10 THEN cgpa END AS cgpa, branch FROM pop)"""


@query(_GRADED + " SELECT * FROM grd")
def academic_rows(spark, sf):
    return G.academic_rows(_reference(spark, sf))


@query(_GRADED + """ SELECT file_id, 'reference' AS kind, count(*)::BIGINT AS n FROM grd GROUP BY 1
UNION ALL SELECT branch || ' list', 'list', 4 * count(*) + 4 FROM pop GROUP BY branch""")
def reference_routing(spark, sf):
    """Sheets with grades and lists without, read together: the rows of the first, the cells of the others."""
    lists = T.cells(spark, sf).withColumn("file_id", F.concat("file_id", F.lit(" list")))
    rows, rest = importing.route_reference(_reference(spark, sf).union(lists))
    told = rows.select("file_id", F.lit("reference").alias("kind")).union(rest.select("file_id", F.lit("list")))
    return told.groupBy("file_id", "kind").agg(F.count("*").alias("n"))


_PASTED = """
, pst AS (SELECT conv_id * 1000 + turn AS file_id, text, text || chr(10) || CASE WHEN turn % 3 > 0 THEN lower(neo_id) || ', ' ELSE '' END || CASE WHEN turn % 4 > 1 THEN reg_no ELSE '' END || chr(10) || '-' AS pasted, turn % 3 > 0 AS neo, turn % 4 > 1 AS reg
  FROM conversations JOIN pop ON subject_id = 1 + conv_id % 100)"""


def _pasted(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations with identifiers of customers under them."""
    c, p = T.read(spark, sf, "conversations"), T.population(spark, sf).select("subject_id", "neo_id", "reg_no")
    met = c.join(p, F.col("subject_id") == 1 + F.col("conv_id") % 100)
    neo = F.when(F.col("turn") % 3 > 0, F.concat(F.lower("neo_id"), F.lit(", "))).otherwise("")
    reg = F.when(F.col("turn") % 4 > 1, F.col("reg_no")).otherwise("")
    return met.select((F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"), F.concat("text", F.lit("\n"), neo, reg, F.lit("\n-")).alias("text"))


@query(_PASTED + """ SELECT file_id, neo::INT AS n_neo, reg::INT AS n_reg, CASE WHEN neo THEN 'neo_id_only' ELSE 'reg_no_only' END AS shape, CASE WHEN neo THEN 'neo_id' ELSE 'reg_no' END AS primary_key, 1 AS student_count,
  sha256(CASE WHEN neo THEN neo_id || chr(31) ELSE '' END || chr(30) || CASE WHEN reg THEN reg_no || chr(31) ELSE '' END) AS content_hash
FROM pst JOIN pop ON subject_id = 1 + (file_id // 1000) % 100 WHERE text IS NOT NULL AND (neo OR reg)""")
def pasted_lists(spark, sf):
    files, _ = importing.import_pasted(_pasted(spark, sf))
    return files.select("file_id", "n_neo", "n_reg", "shape", "primary_key", "student_count", "content_hash")


@query(_PASTED + " SELECT file_id, CASE WHEN strlen(pasted) > 300 THEN 'too_large' ELSE 'no_identifiers' END AS error FROM pst WHERE strlen(pasted) > 300 OR NOT (neo OR reg) AND text IS NOT NULL OR text IS NULL")
def pasted_errors(spark, sf):
    return G.pasted_errors(_pasted(spark, sf), most=300)


@query("SELECT '2' || (o_custkey % 10) || 'BCE' || lpad(o_custkey::VARCHAR, 6, '0') AS reg_no, arg_max(o_totalprice / 100000, o_orderkey) FILTER (o_totalprice > 100000) AS cgpa, arg_max(o_orderstatus, o_orderkey) AS branch, arg_min(o_orderpriority, o_orderkey) AS source, '2' || (o_custkey % 10) AS cohort FROM orders GROUP BY o_custkey", base=False)
def academics_ingested(spark, sf):
    o = T.read(spark, sf, "orders")
    rows = o.select(T.reg_of(F.col("o_custkey")).alias("reg_no"), F.lit(None).cast("string").alias("name"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") / 100000).alias("cgpa"), F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("seq"))
    return I.ingest_academics(rows)[0].select("reg_no", "cgpa", "branch", "source", "cohort")


@query("SELECT '2' || (o_custkey % 10) AS cohort, o_orderstatus AS branch, count(*)::BIGINT AS rows FROM orders GROUP BY 1, 2", base=False)
def baseline_ingested(spark, sf):
    """The anonymous side of the same import: every row counts, and none has an identifier."""
    o = T.read(spark, sf, "orders")
    rows = o.select(T.reg_of(F.col("o_custkey")).alias("reg_no"), F.lit(None).cast("string").alias("name"), F.col("o_totalprice").alias("cgpa"), F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("seq"))
    return I.ingest_academics(rows)[2].groupBy("cohort", "branch").agg(F.count("*").alias("rows"))


# --- links by name --------------------------------------------------------------------------------

_ASKED = _PEOPLE + """
, crp AS (SELECT name, count(DISTINCT reg) AS n, min(reg) AS reg FROM (SELECT name, '2' || (seq % 10) || 'BCE' || lpad(seq::VARCHAR, 6, '0') AS reg FROM ppl) GROUP BY name),
ask AS (SELECT seq AS payload, CASE WHEN seq % 11 = 0 THEN '12345' ELSE name END AS name, (seq % 3)::INT AS claim FROM ppl),
fnd AS (SELECT payload, CASE WHEN n IS NULL THEN 'no_match' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, reg, least(2, claim) AS link FROM ask LEFT JOIN crp USING (name) WHERE claim >= 1)"""


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """People as rows with a name and a claim, some with none that anyone bears; all people as the corpus."""
    p = people(spark, sf).select("seq", "name")
    k = F.col("seq")
    asked = p.select(k.alias("payload"), F.when(k % 11 == 0, "12345").otherwise(F.col("name")).alias("name"), (k % 3).cast("int").alias("confidence"))
    return asked, p.select(T.reg_of(k).alias("payload"), F.col("name").alias("display"))


@query(_ASKED + " SELECT payload, reg AS matched, link::INT AS confidence FROM fnd WHERE outcome = 'matched'")
def names_linked(spark, sf):
    return I.link_by_name(*_asked(spark, sf))


@query(_ASKED + " SELECT count_if(outcome = 'matched' AND link = 2)::BIGINT AS exact, count_if(outcome = 'matched' AND link = 1)::BIGINT AS approximate, count_if(outcome = 'ambiguous')::BIGINT AS ambiguous, count_if(outcome = 'no_match')::BIGINT AS unmatched FROM fnd")
def name_link_report(spark, sf):
    return I.name_link_report(*_asked(spark, sf))


# --- jobs that run once ---------------------------------------------------------------------------

_FILED = """
WITH fil AS (SELECT p_partkey AS drive_id, lower(string_split(p_name, ' ')[1]) || 'corp' AS word, p_partkey % 3 AS k FROM part),
old AS (SELECT drive_id, word, k, word || CASE k WHEN 0 THEN '_shortlist.xlsx' WHEN 1 THEN '_test_list_1-9-26.csv' ELSE '%20round%202.xlsx' END AS filename FROM fil)"""


def _filed(spark: SparkSession, sf: str) -> DataFrame:
    """A list for each part, with a file named after it, and the older name of that file or one given by hand."""
    k = F.col("p_partkey") % 3
    word = F.concat(F.lower(F.get(F.split("p_name", " "), F.lit(0))), F.lit("corp"))
    name = F.concat(word, F.when(k == 0, "_shortlist.xlsx").when(k == 1, "_test_list_1-9-26.csv").otherwise("%20round%202.xlsx"))
    d = T.read(spark, sf, "part").select(F.col("p_partkey").alias("drive_id"), name.alias("filename"))
    given = F.when(F.col("drive_id") % 5 == 0, F.lit("By hand")).otherwise(naming.legacy_name(F.col("filename")))
    return d.select("drive_id", "filename", given.alias("company"), F.when(F.col("drive_id") % 7 == 0, "HR").alias("round_label"))


@query(_FILED + """ SELECT drive_id, CASE WHEN drive_id % 5 = 0 THEN 'By hand' ELSE upper(left(word, 1)) || substr(word, 2) END AS company,
  CASE WHEN drive_id % 7 = 0 THEN 'HR' WHEN k = 1 THEN 'Test' WHEN k = 2 THEN 'R2' END AS round_label FROM old""", base=False)
def names_upgraded(spark, sf):
    meta = spark.createDataFrame([], "key string, value string")
    return B.upgrade_names(_filed(spark, sf), meta).select("drive_id", "company", "round_label")


@query("SELECT p_partkey AS drive_id, CASE WHEN p_partkey % 4 = 0 THEN '/old/' || p_name ELSE '/new/' || replace(p_name, ' ', '%20') END AS path FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 3 > 0", base=False)
def original_files(spark, sf):
    """Lists whose names hold %20; their files lie under the decoded name, or the encoded one, or not at all,
    and those of every third have other contents by now."""
    p, k = T.read(spark, sf, "part"), F.col("p_partkey")
    encoded = F.replace("p_name", F.lit(" "), F.lit("%20"))
    digest = F.md5(k.cast("string"))
    drives = p.select(k.alias("drive_id"), digest.alias("content_hash"), encoded.alias("filename"))
    there = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, encoded).otherwise("elsewhere")
    files = p.select(F.when(k % 3 > 0, digest).otherwise("changed").alias("content_hash"), there.alias("filename"), F.concat(F.when(k % 4 == 0, "/old/").otherwise("/new/"), there).alias("path"))
    return S.original_files(drives, files)


@query("""SELECT o.drive_id, o.kind, o.value, o.sheet, o.row FROM org o WHERE o.drive_id % 2 = 1 AND o.drive_id IN
  (SELECT m.drive_id FROM mem m JOIN subj s ON s.subject_id % 5 = 0 AND m.value = CASE WHEN m.kind = 'reg_no' THEN s.reg_no ELSE s.neo_id END)""")
def origins_backfilled(spark, sf):
    """Every second list has lost its places; those that list one of the tracked people get them back."""
    o, s = T.origins(spark, sf), T.subjects(spark, sf).where("subject_id % 5 = 0")
    tracked = s.select(F.lit(V.NEO).alias("kind"), F.col("neo_id").alias("value")).union(s.select(F.lit(V.REG), "reg_no")).where("value is not null")
    return B.backfill_origins(T.drives(spark, sf), T.members(spark, sf), o.where("drive_id % 2 = 0"), tracked, o)


@query("""SELECT 'neo_id' AS a_kind, neo_id AS a_value, 'reg_no' AS b_kind, reg_no AS b_value, (subject_id % 4)::INT AS confidence, 'bundled' AS source FROM pop WHERE subject_id % 3 > 0""")
def pack_seeded(spark, sf):
    """Links of a pack beside those that are stored already."""
    p, k = T.population(spark, sf), F.col("subject_id")
    pack = {
        "edges": p.select("neo_id", "reg_no", (k % 4).cast("int").alias("confidence")).union(p.select("neo_id", F.lit(None).cast("string"), F.lit(3))),
        "names": p.select(F.col("label").alias("name_key"), F.col("label").alias("display")), "academics": p.select("reg_no", "cgpa", "branch"), "baseline": p.select("cgpa", "branch"),
    }
    stored = p.where(k % 3 == 0).select(F.lit("neo_id").alias("a_kind"), F.col("neo_id").alias("a_value"), F.lit("reg_no").alias("b_kind"), F.col("reg_no").alias("b_value"), F.lit("bundled").alias("source"))
    tables = {"edges": stored, "spellings": p.limit(0).select(F.col("label").alias("name_key"))}
    out = B.seed(spark.createDataFrame([], "key string, value string"), 1, pack, tables)
    return out["edges"].select("a_kind", "a_value", "b_kind", "b_value", F.col("confidence").cast("int").alias("confidence"), "source")


# --- files and orders -----------------------------------------------------------------------------


@query("""SELECT event_id, NOT regexp_matches(n, '^(\\.|~\\$)') AND regexp_matches(lower(n), '\\.(xlsx|xls|xlsm|csv|ods|tsv|txt)$') AS candidate
FROM (SELECT event_id, ['.', '~$', '', '', ''][1 + event_id % 5] || event_type || ['.csv', '.XLSX', '.pdf', '.ods', '.xlsm.part', ''][1 + event_id % 6] AS n FROM events)""", base=False)
def sheet_candidates(spark, sf):
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % n).cast("int"))
    path = F.concat(F.lit("/in/"), pick(["."] + ["~$"] + [""] * 3, 5), F.col("event_type"), pick([".csv", ".XLSX", ".pdf", ".ods", ".xlsm.part", ""], 6))
    return T.read(spark, sf, "events").select("event_id", sheets.is_candidate(path).alias("candidate"))


@query("""SELECT 'f' || event_id || '.csv' AS path, 'f' || event_id || '.csv' AS filename, ts AS modified, event_id % 2 = 0 AS imported
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS ORDER BY ts DESC, 'f' || event_id || '.csv' LIMIT 5""", base=False)
def recent_files(spark, sf):
    """The five newest files of the last day, and whether they were imported."""
    e = T.read(spark, sf, "events")
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".csv"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return S.recent(e.select(name.alias("path"), name.alias("filename"), F.col("ts").alias("modified")), now, e.where("event_id % 2 = 0").select(name.alias("filename")), hours=24, top=5)


@query("SELECT drive_id, company, row_number() OVER (ORDER BY imported_at DESC, drive_id DESC)::BIGINT AS place FROM drv")
def drives_newest_first(spark, sf):
    """The order of the list of lists: their places, dealt out by ranges."""
    d = T.drives(spark, sf)
    key = F.struct((-F.datediff("imported_at", F.lit("2000-01-01"))).alias("at"), (-F.col("drive_id")).alias("id"))
    return S.numbered(d.withColumn("_key", key), "_key", 1).select("drive_id", "company", F.col("number").alias("place"))


_NAMED = """
, exp AS (SELECT drive_id, value AS identifier, CASE WHEN c % 3 > 0 THEN label END AS name FROM mem JOIN pop ON subject_id = c)"""


def _export(spark: SparkSession, sf: str) -> DataFrame:
    p = T.population(spark, sf).where("subject_id % 3 > 0")
    names = p.select(F.col("neo_id").alias("value"), F.col("label").alias("name")).union(p.select("reg_no", "label"))
    return D.export_rows(T.drives(spark, sf), T.members(spark, sf), names)


@query(_NAMED + " SELECT drive_id, identifier, row_number() OVER (PARTITION BY drive_id ORDER BY name IS NULL, lower(name), identifier)::INT AS place FROM exp")
def export_order(spark, sf):
    from pyspark.sql import Window

    return _export(spark, sf).select("drive_id", "identifier", F.row_number().over(Window.partitionBy("drive_id").orderBy(*D.export_order())).alias("place"))


@query(_NAMED + """ SELECT drive_id, 1 AS part, identifier || ',' || coalesce(name, '') || ',' || CASE WHEN name IS NULL THEN 'Not identified' ELSE 'Identified' END AS line FROM exp
UNION ALL SELECT DISTINCT drive_id, 0, chr(65279) || 'Neo ID,Name,Status' FROM exp""")
def export_csv(spark, sf):
    return D.csv_lines(_export(spark, sf))


@query("""
, prs AS (SELECT a.drive_id AS from_id, b.drive_id AS to_id FROM drv a JOIN drv b ON a.company = b.company AND a.imported_at < b.imported_at),
x AS (SELECT from_id, to_id, value, 1 AS a, 0 AS b FROM prs JOIN mem ON drive_id = from_id WHERE kind = 'neo_id' UNION ALL SELECT from_id, to_id, value, 0, 1 FROM prs JOIN mem ON drive_id = to_id WHERE kind = 'neo_id')
SELECT from_id, to_id, value, CASE WHEN max(a) * max(b) = 1 THEN 'advanced' WHEN max(a) = 1 THEN 'dropped' ELSE 'added' END AS change
FROM x WHERE value IN (SELECT neo_id FROM subj WHERE subject_id % 4 = 1) GROUP BY 1, 2, 3""")
def friends_between_rounds(spark, sf):
    friends = T.subjects(spark, sf).where("subject_id % 4 = 1 and neo_id is not null").select(F.col("neo_id").alias("value"))
    return R.friends_in(R.compare_rounds(_pairs(spark, sf), T.members(spark, sf)), friends)


# --- texts for display ----------------------------------------------------------------------------


@query("""SELECT subject_id, CASE WHEN subject_id % 4 >= 2 AND subject_id % 3 > 0 THEN label WHEN neo_id IS NOT NULL THEN neo_id WHEN reg_no IS NOT NULL THEN reg_no ELSE 'Unknown student' END AS shown FROM subj""")
def display_labels(spark, sf):
    name = F.when(F.col("subject_id") % 3 > 0, F.col("label"))
    return T.subjects(spark, sf).select("subject_id", V.display_label(F.col("subject_id") % 4, name, F.col("neo_id"), F.col("reg_no")).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp,
  CASE WHEN n <= 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n < 7 THEN n || ' days ago' ELSE strftime(ts, '%-d %b') END AS shown
FROM (SELECT *, date_diff('day', ts::DATE, (max(ts) OVER ())::DATE) AS n FROM events)""", base=False)
def event_stamps(spark, sf):
    """Moments as documents write them, and as days before the last one."""
    e = T.read(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stamp = V.rfc3339(F.when(F.col("event_id") % 3 == 0, F.replace(plain, F.lit(" "), F.lit("T"))).otherwise(plain))
    return e.crossJoin(F.broadcast(last)).select("event_id", stamp.alias("stamp"), V.relative_day(F.col("ts"), F.col("last")).alias("shown"))


@query("SELECT subject_id, CASE WHEN c_acctbal / 10000 >= 0.4 THEN 'good' WHEN c_acctbal / 10000 >= 0.15 THEN 'partial' ELSE 'thin' END AS tier FROM pop")
def coverage_tiers(spark, sf):
    return T.population(spark, sf).select("subject_id", V.coverage_tier(F.col("c_acctbal") / 10000).alias("tier"))


@query("""WITH s AS (SELECT p_partkey, p_brand || CASE p_partkey % 4 WHEN 0 THEN ': ' WHEN 1 THEN '/[x] ' WHEN 2 THEN '?*' ELSE ' ' END || p_name AS n FROM part)
SELECT p_partkey, trim(left(trim(regexp_replace(n, '[\\[\\]:*?/\\\\]', ' ', 'g')), 31)) AS sheet,
  left(trim(replace(regexp_extract(n, '([^/\\\\]*)$', 1), ':', '')), 200) AS file,
  CASE WHEN p_partkey % 2 = 0 THEN p_name || '.CSV' ELSE p_name || '.csv' END AS path FROM s JOIN part USING (p_partkey)""", base=False)
def safe_names(spark, sf):
    """Worksheet and file names made from parts' names with characters that neither may have."""
    k = F.col("p_partkey")
    raw = F.concat("p_brand", F.when(k % 4 == 0, ": ").when(k % 4 == 1, "/[x] ").when(k % 4 == 2, "?*").otherwise(" "), F.col("p_name"))
    path = F.concat("p_name", F.when(k % 2 == 0, ".CSV").when(k % 3 == 0, ".xlsx").otherwise(""))
    return T.read(spark, sf, "part").select("p_partkey", V.sheet_name(raw).alias("sheet"), V.safe_filename(raw).alias("file"), V.with_extension(path, "csv").alias("path"))


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)
SELECT p_partkey, left(w[1], 1) || CASE WHEN p_partkey % 3 = 0 THEN ' q' ELSE '' END AS initials, p_partkey % 3 > 0 OR len(list_filter(w[2:], lambda x: starts_with(x, 'q'))) > 0 OR starts_with(w[1], 'q') AS compatible FROM w""", base=False)
def initials_fit(spark, sf):
    """The first letter of a name as an initial, and for every third another one, against the whole name."""
    short = F.concat(F.lower(F.substring("p_name", 1, 1)), F.when(F.col("p_partkey") % 3 == 0, " q").otherwise(""))
    normal = N.normalise(F.concat(short, F.lit(" "), F.get(F.split("p_name", " "), F.lit(1))))
    rows = T.read(spark, sf, "part").select("p_partkey", normal.alias("n"), N.normalise(F.col("p_name")).alias("whole"))
    return rows.select("p_partkey", F.array_join(N.initials(F.col("n")), " ").alias("initials"), N.initials_compatible(N.initials(F.col("n")), N.tokens(F.col("whole"))).alias("compatible"))


# --- documents ------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 12 HOURS END AS leads, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 30 HOURS WHEN event_id % 3 = 1 THEN ts - INTERVAL 1 HOUR END AS until FROM events)
SELECT event_id, array_to_string(list_transform(list_sort(list_distinct(list_concat([ts], list_filter([leads, until], lambda x: x > ts), list_transform(range(1, 9), lambda k: date_trunc('day', ts) + to_days(k::INT))))), lambda x: strftime(x, '%Y-%m-%d %H:%M:%S')), ';') AS moments FROM e""", base=False)
def view_timeline(spark, sf):
    e, k = T.read(spark, sf, "events"), F.col("event_id")
    leads = F.when(k % 2 == 0, F.col("ts") + F.expr("INTERVAL 12 HOURS"))
    until = F.when(k % 3 == 0, F.col("ts") + F.expr("INTERVAL 30 HOURS")).when(k % 3 == 1, F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    moments = D.timeline(F.col("ts"), leads, until)
    return e.select("event_id", F.array_join(F.transform(moments, lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")), ";").alias("moments"))


@query("""SELECT subject_id, drive_id, status, CASE WHEN reason = 'key_kind_not_configured' THEN CASE WHEN file_key = 'reg_no' THEN 'needs_reg_no' ELSE 'needs_neo_id' END ELSE reason END AS reason FROM ver""")
def verdict_previews(spark, sf):
    shown = D.preview(F.col("status"), F.col("reason"), F.col("file_key"))
    return _verdicts(spark, sf).select("subject_id", "drive_id", shown.alias("v")).select("subject_id", "drive_id", "v.status", "v.reason")


@query("""SELECT drive_id, company, status, CASE WHEN reason = 'key_kind_not_configured' THEN CASE WHEN file_key = 'reg_no' THEN 'needs_reg_no' ELSE 'needs_neo_id' END ELSE reason END AS reason, count(*)::BIGINT AS n
FROM ver JOIN drv USING (drive_id) GROUP BY ALL""")
def snapshots_read_back(spark, sf):
    """Every person's document, written as JSON and read again: the verdicts that stand in all of them."""
    return D.snapshot_verdicts(_documents(spark, sf)).groupBy("drive_id", "company", "status", "reason").agg(F.count("*").alias("n"))


@query("""SELECT subject_id, CASE WHEN subject_id % 5 = 0 THEN 'missing' WHEN subject_id % 5 < 3 THEN 'stale' ELSE 'current' END AS state FROM pop""")
def snapshot_states(spark, sf):
    """Documents of which some are missing, of a later schema or cut off."""
    k = F.col("subject_id")
    cut = F.when(k % 5 == 1, F.replace("document", F.lit('"schema":1'), F.lit('"schema":2'))).when(k % 5 == 2, F.substring("document", 1, 5)).when(k % 5 > 2, F.col("document"))
    return D.read_snapshots(_documents(spark, sf).withColumn("document", cut)).select("subject_id", "state")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    subjects, drives, members = T.subjects(spark, sf), T.drives(spark, sf), T.members(spark, sf)
    analyses = A.analyse(members, T.neo_to_reg(spark, sf), T.population(spark, sf).select("reg_no", "cgpa", "branch"), _baseline(spark, sf))
    return D.snapshots(drives, _verdicts(spark, sf), W.season(subjects, drives, members), analyses)


@query("SELECT DISTINCT p_name AS value FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_name FROM part WHERE p_partkey % 3 = 0", base=False)
def names_leaked(spark, sf):
    """Names of one half of the parts that stand among every third as well."""
    p = T.read(spark, sf, "part")
    return D.leaks(p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("value")), p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("value")))


@query("""SELECT subject_id, kind, value, value AS back, true AS shaped FROM (SELECT subject_id, unnest(['neo_id', 'reg_no']) AS kind, unnest([neo_id, reg_no]) AS value FROM pop)""")
def pseudonyms_undone(spark, sf):
    """Identifiers under another name and back: all are told apart, and keep their shape and year."""
    ids = T.population(spark, sf).select("subject_id", F.explode(F.create_map(F.lit(V.NEO), "neo_id", F.lit(V.REG), "reg_no")).alias("kind", "value"))
    made = D.pseudonyms(ids, "a key")
    shaped = (V.identifier_kind(F.col("alias")) == F.col("kind")) & (F.length("alias") == F.length("value")) & ((F.col("kind") == V.NEO) | (V.admission_year(F.col("alias")) == V.admission_year(F.col("value"))))
    return ids.join(made, "value").select("subject_id", "kind", "value", D.shaped_alias(F.col("alias"), "a key", back=True).alias("back"), shaped.alias("shaped"))


@query("""SELECT count(DISTINCT v)::BIGINT AS made, 0::BIGINT AS shared, 0::BIGINT AS leaked FROM (SELECT neo_id AS v FROM pop UNION ALL SELECT reg_no FROM pop UNION ALL SELECT label FROM pop)""")
def pseudonyms_apart(spark, sf):
    """How many aliases there are, how many values share one, and how many stand in the data as they are."""
    p = T.population(spark, sf)
    ids = p.select(F.col("neo_id").alias("value")).union(p.select("reg_no")).union(p.select("label"))
    made = D.pseudonyms(ids, "a key")
    shared = made.groupBy("alias").agg(F.count("*").alias("n")).agg(F.count("*").alias("made"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("shared"))
    same = made.where(F.col("value") == F.col("alias")).agg(F.count("*").alias("leaked"))
    return shared.crossJoin(F.broadcast(same))
