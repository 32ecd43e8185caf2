"""Registered queries over people: the identity graph, name search, imports, writes, whole answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import values as V
from rollcall.operators import answers as B
from rollcall.operators import identity as I
from rollcall.operators import matching as M
from rollcall.operators import rounds as R
from rollcall.operators import store as S
from rollcall.operators import verdicts as W
from rollcall.plans import importing
from rollcall.plans import relations as T
from rollcall.plans.catalogue import _CHAIN, _CUT, _DIST, _GATE, _LADDER, _OVER, _baseline, _verdicts, components_sql, query
from rollcall.session import saved

# --- the identity graph ---------------------------------------------------------------------------

#: People with names of two words. Three of four share a name with their neighbours.
_PEOPLE = """
, ppl AS MATERIALIZED (SELECT p.subject_id AS seq, s.neo_id, s.reg_no, p.branch AS source,
    translate(lpad((m // 50)::VARCHAR, 6, '0'), '0123456789', 'abcdefghij') || ' ' || translate((1000 + m % 50)::VARCHAR, '0123456789', 'abcdefghij') AS name
  FROM (SELECT *, CASE WHEN subject_id % 4 = 0 THEN subject_id ELSE subject_id - subject_id % 4 + 1 END AS m FROM pop) p JOIN subj s USING (subject_id)),
hrv AS MATERIALIZED (SELECT 'neo_id' AS a_kind, neo_id AS a_value, 'reg_no' AS b_kind, reg_no AS b_value, 3 AS confidence, source, seq FROM ppl WHERE neo_id IS NOT NULL AND reg_no IS NOT NULL
  UNION ALL SELECT 'neo_id', neo_id, 'name', name, 2, source, seq FROM ppl WHERE neo_id IS NOT NULL
  UNION ALL SELECT 'reg_no', reg_no, 'name', name, 2, source, seq FROM ppl WHERE reg_no IS NOT NULL)"""
#: Their links, weaker ones from another source, and a second number for every tenth, which is a conflict.
_LINKS = _PEOPLE + """
, ide AS MATERIALIZED (SELECT * FROM hrv
  UNION ALL SELECT 'neo_id', neo_id, 'reg_no', reg_no, (subject_id % 4)::INT, 'roster', subject_id FROM pop
  UNION ALL SELECT 'neo_id', neo_id, 'reg_no', '2' || ((subject_id + 1) % 10) || 'BCE' || lpad((subject_id + 1)::VARCHAR, 6, '0'), 3, 'clash', subject_id FROM pop WHERE subject_id % 10 = 0)
""" + components_sql("ide") + """,
nod AS MATERIALIZED (SELECT DISTINCT a_kind || ':' || a_value AS node FROM ide WHERE confidence > 0 UNION SELECT b_kind || ':' || b_value FROM ide WHERE confidence > 0 AND b_kind <> 'name'),
com AS MATERIALIZED (SELECT node, coalesce(component, node) AS component FROM nod LEFT JOIN cmp USING (node)),
fit AS MATERIALIZED (SELECT component, coalesce(any_value(cmi.confidence), 3)::INT AS confidence, count_if(node LIKE 'reg_no:%') > 1 AS conflicted FROM com LEFT JOIN cmi USING (component) GROUP BY component),
nam AS MATERIALIZED (SELECT a_kind || ':' || a_value AS node, b_value AS name_key, max(confidence)::INT AS confidence FROM ide WHERE b_kind = 'name' GROUP BY 1, 2),
bst AS MATERIALIZED (SELECT component, arg_max(name_key, confidence || name_key) AS name_key FROM (SELECT component, name_key, least(max(nam.confidence), any_value(fit.confidence)) AS confidence
  FROM nam JOIN com USING (node) JOIN fit USING (component) WHERE NOT conflicted GROUP BY 1, 2) WHERE confidence >= 2 GROUP BY component),
res AS MATERIALIZED (SELECT n.component, substr(n.node, 8) AS neo_id, substr(r.node, 8) AS reg_no, name_key, fit.confidence
  FROM com n JOIN fit USING (component) LEFT JOIN (SELECT * FROM com WHERE node LIKE 'reg_no:%') r ON r.component = n.component LEFT JOIN bst ON bst.component = n.component
  WHERE n.node LIKE 'neo_id:%' AND NOT conflicted)"""


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed rows (seq, neo_id, reg_no, source, name)."""
    k = F.col("subject_id")
    m = F.when(k % 4 == 0, k).otherwise(k - k % 4 + 1)
    word = lambda x: F.translate(x.cast("string"), "0123456789", "abcdefghij")
    name = F.concat_ws(" ", word(F.lpad(F.floor(m / 50).cast("string"), 6, "0")), word(1000 + m % 50))
    held = T.subjects(spark, sf).select("subject_id", "neo_id", "reg_no")
    return T.population(spark, sf).select("subject_id", F.col("branch").alias("source"), name.alias("name")).join(held, "subject_id").withColumnRenamed("subject_id", "seq")


def links(spark: SparkSession, sf: str) -> DataFrame:
    p = T.population(spark, sf)
    k = F.col("subject_id")

    def pairs(reg, confidence, source: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(V.NEO).alias("a_kind"), F.col("neo_id").alias("a_value"), F.lit(V.REG).alias("b_kind"), reg.alias("b_value"), confidence.cast("int").alias("confidence"), F.lit(source).alias("source"), k.alias("seq"))

    return I.harvest(people(spark, sf)).union(pairs(F.col("reg_no"), k % 4, "roster", p)).union(pairs(T.reg_of(k + 1), F.lit(3), "clash", p.where(k % 10 == 0)))


@query(_PEOPLE + " SELECT * FROM hrv")
def harvest_edges(spark, sf):
    return I.harvest(people(spark, sf))


@query(_PEOPLE + " SELECT count_if(b_kind <> 'name')::BIGINT AS verified_links, count_if(b_kind = 'name')::BIGINT AS named_links FROM hrv")
def harvest_report(spark, sf):
    return I.harvest_report(I.harvest(people(spark, sf)))


@query(_PEOPLE + " SELECT name AS name_key, arg_min(name, seq) AS display FROM ppl GROUP BY name")
def spellings(spark, sf):
    return I.spellings(people(spark, sf))


@query(_LINKS + " SELECT node, component, fit.confidence, conflicted FROM com JOIN fit USING (component)")
def identity_components(spark, sf):
    return I.components(links(spark, sf)).select("node", "component", "confidence", "conflicted")


@query(_LINKS + " SELECT component, name_key FROM bst")
def component_best_names(spark, sf):
    e = links(spark, sf)
    return I.best_names(I.components(e), I.node_names(e))


@query(_LINKS + " SELECT * FROM res")
def resolve_identities(spark, sf):
    return I.resolve(links(spark, sf))


@query(_LINKS + " SELECT (SELECT count(DISTINCT component) FROM com)::BIGINT AS components, (SELECT count(*) FROM fit WHERE conflicted)::BIGINT AS conflicts, (SELECT count(DISTINCT name_key) FROM nam)::BIGINT AS names")
def identity_stats(spark, sf):
    return I.stats(links(spark, sf))


@query(_LINKS + """
, idx AS (SELECT res.neo_id, res.name_key FROM res WHERE name_key IS NOT NULL),
ask AS (SELECT seq AS query_id, name FROM ppl WHERE seq % 100 < 2 AND name IN (SELECT name_key FROM idx))
SELECT query_id, CASE WHEN count(DISTINCT neo_id) > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN count(DISTINCT neo_id) = 1 THEN min(neo_id) END AS neo_id, CASE WHEN count(DISTINCT neo_id) = 1 THEN 2 ELSE 0 END AS confidence
FROM ask JOIN idx ON name_key = name GROUP BY query_id""")
def student_search(spark, sf):
    """Names of every hundredth person and the next one, of those that anyone bears, against all."""
    p, known = people(spark, sf), I.resolve(links(spark, sf))
    index = saved(M.student_index(known, I.spellings(p)), "index")
    asked = p.where("seq % 100 < 2").join(index.select(F.col("display").alias("name")).distinct(), "name", "left_semi")
    return M.search(asked.select(F.col("seq").alias("query_id"), F.col("name").alias("query")), index)


@query()
def name_search(spark, sf):
    """Names of every hundredth part, with a letter changed, against all parts: exact, alike and ambiguous
    answers (against brute force in the tests)."""
    p = T.read(spark, sf, "part").select("p_partkey", "p_name")
    asked = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 200 == 0, F.regexp_replace("p_name", "e", "a")).otherwise(F.col("p_name")).alias("query"))
    return M.match(asked, p.select(F.col("p_partkey").cast("string").alias("payload"), F.col("p_name").alias("display")))


# --- validation -----------------------------------------------------------------------------------

_TYPED = """
, typ AS (SELECT subject_id, CASE subject_id % 5 WHEN 0 THEN ' ' || lower(neo_id) WHEN 1 THEN neo_id || '9' WHEN 2 THEN '  ' ELSE neo_id END AS neo, CASE subject_id % 3 WHEN 0 THEN 'x' || reg_no WHEN 1 THEN NULL ELSE reg_no END AS reg,
  CASE WHEN subject_id % 7 = 0 THEN 11.5 ELSE cgpa END AS grade FROM pop),
chk AS (SELECT *, regexp_full_match(upper(trim(neo)), '([A-Z][0-9]){4}') AS n_ok, coalesce(regexp_full_match(upper(trim(reg)), '[0-9]{2}[A-Z]{3}[0-9]{4,6}'), false) AS r_ok FROM typ)"""


@query(_TYPED + """ SELECT subject_id, CASE WHEN trim(neo) <> '' AND NOT n_ok THEN 'bad_neo_id' WHEN grade IS NOT NULL AND NOT grade BETWEEN 4 AND 10 THEN 'bad_cgpa' WHEN trim(coalesce(reg, '')) <> '' AND NOT r_ok THEN 'bad_reg_no' END AS profile_error,
  CASE WHEN NOT n_ok AND NOT r_ok THEN 'no_identifier' END AS friend_error, CASE WHEN NOT n_ok THEN 'bad_identifier' END AS lookup_error FROM chk""")
def validation_errors(spark, sf):
    p, k = T.population(spark, sf), F.col("subject_id")
    neo = F.when(k % 5 == 0, F.concat(F.lit(" "), F.lower("neo_id"))).when(k % 5 == 1, F.concat("neo_id", F.lit("9"))).when(k % 5 == 2, "  ").otherwise(F.col("neo_id"))
    reg = F.when(k % 3 == 0, F.concat(F.lit("x"), "reg_no")).when(k % 3 == 2, F.col("reg_no"))
    grade = F.when(k % 7 == 0, 11.5).otherwise(F.col("cgpa"))
    return p.select("subject_id", V.profile_error(neo, reg, grade).alias("profile_error"), V.friend_error(neo, reg).alias("friend_error"), V.lookup_error(neo).alias("lookup_error"))


@query("""SELECT conv_id, turn, coalesce(regexp_matches(text, '(^|[^A-Za-z0-9])([A-Za-z][0-9]){4}($|[^A-Za-z0-9])') OR regexp_matches(text, '(^|[^A-Za-z0-9])[0-9]{2}[A-Za-z]{3}[0-9]{4}($|[^A-Za-z0-9])'), false) AS might_list
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || chr(10) || 'a1B2c3D4' || CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE ',' END ELSE text || ' 24ABC1234' || CASE WHEN conv_id % 2 = 0 THEN '5' ELSE '' END END AS text FROM conversations)""", base=False)
def paste_gate(spark, sf):
    even, odd = F.when(F.col("conv_id") % 3 == 0, "x").otherwise(","), F.when(F.col("conv_id") % 2 == 0, "5").otherwise("")
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\na1B2c3D4"), even)).otherwise(F.concat("text", F.lit(" 24ABC1234"), odd))
    return T.read(spark, sf, "conversations").select("conv_id", "turn", V.might_be_list(text).alias("might_list"))


# --- imports and writes ---------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY branch) + 6 AS drive_id, branch AS company, branch AS filename, 'linked' AS shape, 'neo_id' AS primary_key, count(*)::BIGINT AS total_students FROM pop GROUP BY branch")
def import_drives(spark, sf):
    stored = spark.createDataFrame([], "content_hash string")
    got = importing.import_lists(T.cells(spark, sf), stored, 7, F.lit("2026-09-01"))
    return got.drives.select("drive_id", "company", "filename", "shape", "primary_key", "total_students")


@query("""SELECT d.drive_id, v.kind, count(*)::BIGINT AS members FROM (SELECT branch, row_number() OVER (ORDER BY branch) + 6 AS drive_id FROM pop GROUP BY branch) d JOIN pop USING (branch), (SELECT unnest(['neo_id', 'reg_no']) AS kind) v GROUP BY ALL""")
def import_members(spark, sf):
    got = importing.import_lists(T.cells(spark, sf), spark.createDataFrame([], "content_hash string"), 7, F.lit("2026-09-01"))
    return got.members.groupBy("drive_id", "kind").agg(F.count("*").alias("members"))


@query("""SELECT CASE WHEN subject_id % 2 = 0 THEN subject_id ELSE (SELECT max(subject_id) FROM pop WHERE subject_id % 2 = 0) + subject_id END AS friend_id,
  CASE WHEN subject_id % 9 = 0 THEN 'again ' || subject_id WHEN subject_id % 3 = 0 THEN 'new ' || subject_id ELSE label END AS label, neo_id,
  CASE WHEN subject_id % 3 = 0 THEN reg_no END AS reg_no, CASE WHEN subject_id % 9 = 0 THEN 'h' WHEN subject_id % 3 <> 0 THEN 'g' END AS group_tag
FROM pop WHERE subject_id % 2 = 0 OR subject_id % 3 = 0""")
def friends_upsert(spark, sf):
    """Every third person comes again: those already there by an identifier are changed, others added. Every
    ninth comes a second time in the same batch, by the other identifier only."""
    p, k = T.population(spark, sf), F.col("subject_id")
    none = F.lit(None).cast("string")
    there = p.where(k % 2 == 0).select(k.alias("friend_id"), "label", "neo_id", none.alias("reg_no"), F.lit("g").alias("group_tag"))
    batch = p.where(k % 3 == 0).select(k.alias("seq"), F.concat(F.lit("new "), k.cast("string")).alias("label"), "neo_id", "reg_no", none.alias("group_tag"))
    again = p.where(k % 9 == 0).select((k + (1 << 40)).alias("seq"), F.concat(F.lit("again "), k.cast("string")).alias("label"), none.alias("neo_id"), "reg_no", F.lit("h").alias("group_tag"))
    return S.add_friends(there, batch.union(again))


@query("""SELECT subject_id, neo_id, reg_no, label AS display_name, '2' || (subject_id % 10) AS cohort, CASE WHEN subject_id % 4 <> 0 THEN cgpa END AS cgpa,
  CASE WHEN subject_id % 4 = 0 OR cgpa IS NULL THEN NULL WHEN subject_id % 3 > 0 AND subject_id % 5 > 0 THEN '2026-01-01' ELSE '2026-09-01' END AS cgpa_updated_at FROM pop""")
def profile_upsert(spark, sf):
    """Every third profile is a first one, every fourth loses its grade, every fifth had another one."""
    p, k = T.population(spark, sf), F.col("subject_id")
    there = p.where(k % 3 > 0).select("subject_id", F.when(k % 5 == 0, F.col("cgpa") + 1).otherwise(F.col("cgpa")).alias("cgpa"), F.lit("2026-01-01").alias("cgpa_updated_at"))
    new = p.select("subject_id", "neo_id", "reg_no", F.col("label").alias("display_name"), F.lit(None).cast("string").alias("cohort"), F.when(k % 4 != 0, F.col("cgpa")).alias("cgpa"), F.lit("2026-09-01").alias("now"))
    return S.save_profile(there, new, ("subject_id",))


@query("""SELECT drive_id, company, shape, primary_key, total_students, round_label, '2027-01-01' AS imported_at, (SELECT count(*) FROM mem m WHERE m.drive_id = drv.drive_id)::BIGINT AS members, (SELECT count(*) FROM org o WHERE o.drive_id = drv.drive_id)::BIGINT AS origins FROM drv""")
def snapshot_restore(spark, sf):
    kept = S.snapshot(T.drives(spark, sf), T.members(spark, sf), T.origins(spark, sf))
    d, m, o = S.restore(kept, F.lit("2027-01-01"))
    count = lambda t, name: t.groupBy("drive_id").agg(F.count("*").alias(name))
    return d.join(count(m, "members"), "drive_id", "left").join(count(o, "origins"), "drive_id", "left").select("drive_id", "company", "shape", "primary_key", "total_students", "round_label", "imported_at", "members", "origins")


@query(_OVER + """ SELECT l.drive_id, CASE WHEN l.parent_drive_id % 3 > 0 THEN l.parent_drive_id END AS parent_drive_id, (SELECT count(*) FROM mem m WHERE m.drive_id = l.drive_id)::BIGINT AS members FROM lnk l WHERE l.drive_id % 3 > 0""")
def drives_delete(spark, sf):
    linked = R.link_rounds(T.drives(spark, sf), T.members(spark, sf))
    left, rest = S.delete_drives(linked, {"members": T.members(spark, sf)}, linked.where("drive_id % 3 = 0"))
    return left.join(rest["members"].groupBy("drive_id").agg(F.count("*").alias("members")), "drive_id", "left").select("drive_id", "parent_drive_id", "members")


# --- whole answers --------------------------------------------------------------------------------

_EXCERPT = """
, wdw AS (SELECT p.drive_id, p.value AS at_value, o.row, o.value,
    row_number() OVER (PARTITION BY p.drive_id, p.value, o.row < p.row ORDER BY CASE WHEN o.row < p.row THEN -o.row ELSE o.row END, CASE WHEN o.row > p.row THEN o.value END, CASE WHEN o.row < p.row THEN o.value END DESC) AS k
    FROM org p JOIN org o ON o.drive_id = p.drive_id AND o.row <> p.row AND o.row BETWEEN p.row - 60 AND p.row + 60),
exc AS MATERIALIZED (SELECT drive_id, at_value, string_agg(row || ':' || value, ';' ORDER BY row, value) AS excerpt
  FROM (SELECT drive_id, at_value, row, value FROM wdw WHERE k <= 2 UNION ALL SELECT drive_id, value, row, value FROM org) GROUP BY 1, 2),
evi AS MATERIALIZED (SELECT subject_id, d.drive_id, primary_key AS key, CASE WHEN primary_key = 'reg_no' THEN reg_no ELSE neo_id END AS yours, total_students AS listed, org.row, excerpt
  FROM subj, drv d LEFT JOIN org ON org.drive_id = d.drive_id AND org.value = CASE WHEN primary_key = 'reg_no' THEN reg_no ELSE neo_id END
  LEFT JOIN exc ON exc.drive_id = d.drive_id AND exc.at_value = org.value)"""
_CIRCLE = """
, rnk AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY CASE status WHEN 'shortlisted' THEN 0 WHEN 'undetermined' THEN 1 ELSE 2 END, lower(label), label, subject_id) AS k FROM ver),
cir AS MATERIALIZED (SELECT drive_id, string_agg(label || '=' || status, ';' ORDER BY k) AS members FROM rnk WHERE k <= 6 GROUP BY drive_id)"""
_STEPS = """
, dn AS (SELECT drive_id, list_reverse(path) AS path, drive_id AS cur FROM anc
  UNION ALL SELECT d.drive_id, list_append(d.path, k.kid), k.kid FROM dn d JOIN (SELECT parent_drive_id, max_by(drive_id, imported_at || lpad(drive_id::VARCHAR, 9, '0')) AS kid FROM lnk WHERE parent_drive_id IS NOT NULL GROUP BY 1) k ON k.parent_drive_id = d.cur WHERE NOT list_contains(d.path, k.kid)),
pth AS (SELECT drive_id, max_by(path, len(path)) AS path FROM dn GROUP BY 1),
stp AS (SELECT drive_id, unnest(path) AS step_id, generate_subscripts(path, 1) AS pos FROM pth WHERE len(path) >= 2),
prg AS MATERIALIZED (SELECT v.subject_id, stp.drive_id, string_agg(coalesce(lab.label, '') || '=' || v.status, '>' ORDER BY pos) AS steps,
  max_by(v.status, pos) = 'shortlisted' AND max_by(coalesce(lab.label, ''), pos) <> 'Final' AS next_pending
  FROM stp JOIN ver v ON v.drive_id = stp.step_id LEFT JOIN lab ON lab.drive_id = stp.step_id GROUP BY 1, 2)"""


def _evidence(spark, sf):
    return W.evidence(T.subjects(spark, sf).select("subject_id", "neo_id", "reg_no"), T.drives(spark, sf), T.origins(spark, sf))


@query(_EXCERPT + " SELECT * FROM evi")
def evidence(spark, sf):
    return _evidence(spark, sf)


@query(_OVER + _CHAIN + " SELECT v.subject_id, v.drive_id, l.company, l.imported_at, v.status, v.reason, coalesce(lab.label, l.round_label) AS round FROM ver v JOIN lnk l USING (drive_id) LEFT JOIN lab USING (drive_id)")
def drives_list(spark, sf):
    return B.list_drives(R.link_rounds(T.drives(spark, sf), T.members(spark, sf)), _verdicts(spark, sf))


@query(_OVER + _CHAIN + _STEPS + _CIRCLE + _EXCERPT + _DIST + _LADDER + _CUT + _GATE + """
SELECT v.subject_id, v.drive_id, v.status, v.reason, cir.members AS circle, gat.sufficient, CASE WHEN gat.sufficient THEN cut.kind END AS cutoff, CASE WHEN gat.sufficient THEN cut.threshold END AS threshold, evi.row, evi.excerpt, prg.steps, prg.next_pending
FROM ver v LEFT JOIN cir USING (drive_id) LEFT JOIN gat USING (drive_id) LEFT JOIN cut USING (drive_id) LEFT JOIN evi ON evi.subject_id = v.subject_id AND evi.drive_id = v.drive_id LEFT JOIN prg ON prg.subject_id = v.subject_id AND prg.drive_id = v.drive_id""")
def drive_outcome(spark, sf):
    from rollcall.operators import analytics as A

    subjects, drives, members = T.subjects(spark, sf), T.drives(spark, sf), T.members(spark, sf)
    verdicts = saved(_verdicts(spark, sf), "verdicts")
    analyses = A.analyse(members, T.neo_to_reg(spark, sf), T.population(spark, sf).select("reg_no", "cgpa", "branch"), _baseline(spark, sf))
    linked = R.link_rounds(drives, members)
    seen = W.sightings(subjects.select("subject_id", "neo_id", "reg_no"), drives, T.origins(spark, sf))
    return B.drive_outcomes(verdicts, W.circle(subjects, drives, members), analyses, seen, R.progression(linked, verdicts))


@query(_CIRCLE + """
, lat AS (SELECT * FROM drv ORDER BY imported_at DESC, drive_id DESC LIMIT 4),
lst4 AS (SELECT v.subject_id, v.status, v.drive_id, lat.company, lat.imported_at FROM ver v JOIN lat USING (drive_id))
SELECT subject_id, arg_max(drive_id, imported_at || lpad(drive_id::VARCHAR, 9, '0')) AS newest, arg_max(status, imported_at || lpad(drive_id::VARCHAR, 9, '0')) AS status,
  array_to_string(string_split(arg_max(cir.members, imported_at || lpad(drive_id::VARCHAR, 9, '0')), ';')[1:4], ';') AS members, string_agg(company || '=' || status, ';' ORDER BY imported_at DESC, drive_id DESC) AS recent
FROM lst4 JOIN cir USING (drive_id) GROUP BY subject_id""")
def card_data(spark, sf):
    drives = T.drives(spark, sf)
    return B.cards(_verdicts(spark, sf), drives, W.circle(T.subjects(spark, sf), drives, T.members(spark, sf)))
