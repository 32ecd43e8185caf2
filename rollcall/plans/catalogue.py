"""The registered queries over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions import naming
from rollcall.functions import values as V
from rollcall.operators import analytics as A
from rollcall.operators import documents as D
from rollcall.operators import identity as I
from rollcall.operators import ingest as G
from rollcall.operators import matching as M
from rollcall.operators import rounds as R
from rollcall.operators import store as S
from rollcall.operators import verdicts as W
from rollcall.plans import relations as T
from rollcall.plans.relations import BASE_SQL
from rollcall.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    """Registers a query; sql follows the shared relations unless base is false, and starts with its own
    common table expressions (a leading comma) or with SELECT."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"WITH RECURSIVE {BASE_SQL.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if base else sql
        return f

    return keep


def rounded(c: str):
    """Six decimals, the same way in both engines."""
    return (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)


def _r(expression: str, name: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6 AS {name}"


# --- verdicts -------------------------------------------------------------------------------------


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return W.membership(T.subjects(spark, sf), T.drives(spark, sf), T.members(spark, sf))


@query("SELECT subject_id, drive_id, status, reason, file_key FROM ver")
def membership_verdict(spark, sf):
    return _verdicts(spark, sf)


@query("SELECT subject_id, count_if(status = 'shortlisted')::BIGINT AS shortlisted, count_if(status = 'not_shortlisted')::BIGINT AS not_shortlisted, count_if(status = 'undetermined')::BIGINT AS undetermined FROM ver GROUP BY subject_id")
def season_tally(spark, sf):
    return W.season(T.subjects(spark, sf), T.drives(spark, sf), T.members(spark, sf))


@query("""
, r AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY CASE status WHEN 'shortlisted' THEN 0 WHEN 'undetermined' THEN 1 ELSE 2 END, lower(label), label, subject_id) AS k FROM ver)
SELECT drive_id, count(*)::BIGINT AS total, count_if(status = 'shortlisted')::BIGINT AS shortlisted, count_if(status = 'not_shortlisted')::BIGINT AS not_shortlisted, count_if(status = 'undetermined')::BIGINT AS undetermined,
  string_agg(CASE WHEN k <= 6 THEN label || '=' || status END, ';' ORDER BY k) AS members FROM r GROUP BY drive_id""")
def circle_top6(spark, sf):
    return W.circle(T.subjects(spark, sf), T.drives(spark, sf), T.members(spark, sf))


@query("SELECT v AS query, drive_id FROM (SELECT neo_id AS v FROM pop UNION ALL SELECT reg_no FROM pop) q JOIN mem ON mem.value = q.v")
def lookup_drives(spark, sf):
    p = T.population(spark, sf)
    typed = p.select(F.concat(F.lit(" "), F.lower("neo_id")).alias("query")).union(p.select("reg_no"))
    return W.lookup(typed, T.drives(spark, sf), T.members(spark, sf)).select(F.upper(F.trim("query")).alias("query"), "drive_id")


@query("""
, w AS (SELECT p.drive_id, p.kind, p.row AS at_row, p.value AS at_value, o.row, o.value,
    row_number() OVER (PARTITION BY p.drive_id, p.value, o.row < p.row ORDER BY CASE WHEN o.row < p.row THEN -o.row ELSE o.row END, CASE WHEN o.row > p.row THEN o.value END, CASE WHEN o.row < p.row THEN o.value END DESC) AS k
    FROM org p JOIN org o ON o.drive_id = p.drive_id AND o.row <> p.row AND o.row BETWEEN p.row - 60 AND p.row + 60)
SELECT drive_id, kind, at_row, at_value, row, value FROM w WHERE k <= 2 UNION ALL SELECT drive_id, kind, row, value, row, value FROM org""")
def excerpt_around(spark, sf):
    o = T.origins(spark, sf)
    return W.excerpt_around(o, o).select("drive_id", "kind", "at_row", "at_value", "row", "value")


# --- rounds ---------------------------------------------------------------------------------------

_OVER = """
, sz AS (SELECT drive_id, count_if(kind = 'neo_id') AS nn, count_if(kind = 'reg_no') AS nr FROM mem GROUP BY 1),
com AS (SELECT a.drive_id, b.drive_id AS earlier_id, count_if(a.kind = 'neo_id') AS cn, count_if(a.kind = 'reg_no') AS cr
  FROM mem a JOIN lst la ON la.drive_id = a.drive_id AND la.c = a.c JOIN mem b ON a.kind = b.kind AND a.value = b.value JOIN lst lb ON lb.drive_id = b.drive_id AND lb.c = b.c WHERE la.company = lb.company GROUP BY 1, 2),
ovl AS (SELECT n.drive_id, o.drive_id AS earlier_id, o.imported_at AS earlier_at,
  coalesce(CASE WHEN sn.nn > 0 AND so.nn > 0 THEN coalesce(cn, 0) / sn.nn END, CASE WHEN sn.nr > 0 AND so.nr > 0 THEN coalesce(cr, 0) / sn.nr END) AS share
  FROM drv n JOIN drv o ON n.company = o.company AND (o.imported_at, o.drive_id) < (n.imported_at, n.drive_id)
  JOIN sz sn ON sn.drive_id = n.drive_id JOIN sz so ON so.drive_id = o.drive_id LEFT JOIN com ON com.drive_id = n.drive_id AND com.earlier_id = o.drive_id),
lnk AS MATERIALIZED (SELECT d.drive_id, d.imported_at, d.round_label, d.total_students, d.company, max_by(o.earlier_id, o.earlier_at || lpad(o.earlier_id::VARCHAR, 9, '0')) AS parent_drive_id
  FROM drv d LEFT JOIN ovl o ON o.drive_id = d.drive_id AND share >= 0.6 GROUP BY ALL)"""
_CHAIN = """
, dep AS (SELECT drive_id, parent_drive_id AS cur, [drive_id] AS path FROM lnk
  UNION ALL SELECT dep.drive_id, l.parent_drive_id, list_append(path, l.drive_id) FROM dep JOIN lnk l ON l.drive_id = dep.cur WHERE NOT list_contains(path, l.drive_id)),
anc AS MATERIALIZED (SELECT drive_id, max_by(path, len(path)) AS path FROM dep GROUP BY 1),
lab AS MATERIALIZED (SELECT drive_id, coalesce(round_label, 'R' || len(path)) AS label FROM anc JOIN lnk USING (drive_id)
  WHERE len(path) > 1 OR drive_id IN (SELECT parent_drive_id FROM lnk WHERE parent_drive_id IS NOT NULL))"""


def _linked(spark, sf):
    return R.link_rounds(T.drives(spark, sf), T.members(spark, sf))


@query(_OVER + " SELECT drive_id, earlier_id, share FROM ovl")
def round_overlap(spark, sf):
    return R.overlaps(T.drives(spark, sf), T.members(spark, sf)).select("drive_id", "earlier_id", "share")


@query(_OVER + " SELECT drive_id, parent_drive_id FROM lnk")
def round_link(spark, sf):
    return _linked(spark, sf).select("drive_id", "parent_drive_id")


@query(_OVER + _CHAIN + " SELECT drive_id, label FROM lab")
def round_labels(spark, sf):
    return R.round_labels(_linked(spark, sf))


@query(_OVER + _CHAIN + """
, dn AS (SELECT drive_id, list_reverse(path) AS path, drive_id AS cur FROM anc
  UNION ALL SELECT d.drive_id, list_append(d.path, k.kid), k.kid FROM dn d JOIN (SELECT parent_drive_id, max_by(drive_id, imported_at || lpad(drive_id::VARCHAR, 9, '0')) AS kid FROM lnk WHERE parent_drive_id IS NOT NULL GROUP BY 1) k ON k.parent_drive_id = d.cur WHERE NOT list_contains(d.path, k.kid)),
pth AS (SELECT drive_id, max_by(path, len(path)) AS path FROM dn GROUP BY 1),
st AS (SELECT drive_id, unnest(path) AS step_id, generate_subscripts(path, 1) AS pos FROM pth WHERE len(path) >= 2)
SELECT v.subject_id, st.drive_id, string_agg(coalesce(lab.label, '') || '=' || v.status, '>' ORDER BY pos) AS steps,
  max_by(v.status, pos) = 'shortlisted' AND max_by(coalesce(lab.label, ''), pos) <> 'Final' AS next_pending
FROM st JOIN ver v ON v.drive_id = st.step_id LEFT JOIN lab ON lab.drive_id = st.step_id GROUP BY 1, 2""")
def progression(spark, sf):
    return R.progression(_linked(spark, sf), _verdicts(spark, sf))


def _pairs(spark, sf):
    d = T.drives(spark, sf)
    return d.select(F.col("drive_id").alias("from_id"), "company", F.col("imported_at").alias("a")).join(d.select(F.col("drive_id").alias("to_id"), "company", F.col("imported_at").alias("b")), "company").where("a < b").select("from_id", "to_id")


@query("""
, prs AS (SELECT a.drive_id AS from_id, b.drive_id AS to_id FROM drv a JOIN drv b ON a.company = b.company AND a.imported_at < b.imported_at),
x AS (SELECT from_id, to_id, value, 1 AS a, 0 AS b FROM prs JOIN mem ON drive_id = from_id WHERE kind = 'neo_id' UNION ALL SELECT from_id, to_id, value, 0, 1 FROM prs JOIN mem ON drive_id = to_id WHERE kind = 'neo_id')
SELECT from_id, to_id, value, CASE WHEN max(a) * max(b) = 1 THEN 'advanced' WHEN max(a) = 1 THEN 'dropped' ELSE 'added' END AS change FROM x GROUP BY 1, 2, 3""")
def round_diff(spark, sf):
    return R.compare_rounds(_pairs(spark, sf), T.members(spark, sf))


@query("SELECT drive_id, lag(drive_id) OVER w AS before_id, lead(drive_id) OVER w AS after_id FROM drv WINDOW w AS (PARTITION BY company ORDER BY imported_at, drive_id)")
def round_neighbours(spark, sf):
    return R.neighbours(T.drives(spark, sf))


# --- analytics ------------------------------------------------------------------------------------

_HARD, _SOFT = A.SAID["hard_cutoff"], A.SAID["soft_preference"]
_DIST = """
, srt AS MATERIALIZED (SELECT drive_id, cgpa, row_number() OVER (PARTITION BY drive_id ORDER BY cgpa) - 1 AS k, count(*) OVER (PARTITION BY drive_id) AS n FROM mat),
dst AS MATERIALIZED (SELECT drive_id, max(n)::BIGINT AS n, min(cgpa) AS min, max(cgpa) AS max, avg(cgpa) AS mean, stddev_pop(cgpa) AS std_dev,
  max(cgpa) FILTER (k = least(floor(n * 0.05), n - 1)) AS p5, max(cgpa) FILTER (k = least(floor(n * 0.25), n - 1)) AS p25,
  max(cgpa) FILTER (k = least(floor(n * 0.5), n - 1)) AS median, max(cgpa) FILTER (k = least(floor(n * 0.75), n - 1)) AS p75 FROM srt GROUP BY drive_id)"""
_LADDER = """
, ldr AS (SELECT unnest([9.5, 9.0, 8.5, 8.0, 7.5, 7.0])::DOUBLE AS threshold),
lad AS MATERIALIZED (SELECT drive_id, threshold, count_if(mat.cgpa < threshold - 1e-9) / count(*) AS share_below_shortlist, any_value(b) AS share_below_batch,
  count_if(mat.cgpa < threshold - 1e-9) / count(*) <= greatest(0.01::DOUBLE, least(0.06::DOUBLE, 1.5::DOUBLE / count(*))) AND any_value(b) >= 0.10 AS is_signal
  FROM mat, (SELECT threshold, (SELECT count_if(cgpa < threshold) / count(cgpa) FROM bas) AS b FROM ldr) GROUP BY drive_id, threshold)"""
_CUT = """
, flr AS (SELECT min(cgpa) AS batch FROM (SELECT cgpa, row_number() OVER (ORDER BY cgpa) / count(*) OVER () AS r FROM bas WHERE cgpa IS NOT NULL) WHERE r >= 0.05),
cut AS MATERIALIZED (SELECT dst.*, t AS threshold, CASE WHEN t IS NOT NULL THEN 'hard_cutoff' WHEN p5 - batch >= 0.15 THEN 'soft_preference' ELSE 'no_cgpa_filter' END AS kind
  FROM dst JOIN (SELECT drive_id, max(threshold) FILTER (is_signal) AS t FROM lad GROUP BY 1) USING (drive_id), flr)"""
_LIFT = """
, lft AS MATERIALIZED (SELECT drive_id, branch, count, count / n AS share, coalesce(b, 0) / nb AS baseline_share, CASE WHEN b > 0 THEN (count / n) / (b / nb) END AS lift
  FROM (SELECT drive_id, bl AS branch, count(*)::BIGINT AS count, sum(count(*)) OVER (PARTITION BY drive_id)::BIGINT AS n FROM (SELECT *, CASE WHEN contains(lower(branch), 'mech') THEN 'MECH' ELSE 'Other' END AS bl FROM mat) GROUP BY 1, 2)
  LEFT JOIN (SELECT CASE WHEN contains(lower(branch), 'mech') THEN 'MECH' ELSE 'Other' END AS branch, count(*)::BIGINT AS b FROM bas GROUP BY 1) USING (branch), (SELECT count(*) AS nb FROM bas))"""


def _matched(spark, sf):
    p = T.population(spark, sf).select("reg_no", "cgpa", "branch")
    return A.matched(T.members(spark, sf), T.neo_to_reg(spark, sf), p)


def _baseline(spark, sf):
    return T.population(spark, sf).select("cohort", V.sane_cgpa(F.col("cgpa")).alias("cgpa"), "branch")


@query(_DIST + f" SELECT drive_id, n, min, max, {_r('mean', 'mean')}, {_r('std_dev', 'std_dev')}, p5, p25, median, p75 FROM dst")
def cgpa_distribution(spark, sf):
    return A.distribution(_matched(spark, sf), ["drive_id"]).select("drive_id", "n", "min", "max", rounded("mean"), rounded("std_dev"), "p5", "p25", "median", "p75")


@query("""
, h AS (SELECT drive_id, greatest(0, least(15, floor((cgpa - 6.0) / 0.25)))::INT AS bucket, count(*)::BIGINT AS n FROM mat GROUP BY 1, 2), d AS (SELECT DISTINCT drive_id FROM mat)
SELECT drive_id, b AS bucket, 6.0::DOUBLE + b * 0.25::DOUBLE AS lower, 6.25::DOUBLE + b * 0.25::DOUBLE AS upper, coalesce(n, 0)::BIGINT AS count FROM d CROSS JOIN (SELECT unnest(range(16))::INT AS b) LEFT JOIN h USING (drive_id) WHERE h.bucket = b OR h.bucket IS NULL""".replace("LEFT JOIN h USING (drive_id) WHERE h.bucket = b OR h.bucket IS NULL", "LEFT JOIN h ON h.drive_id = d.drive_id AND h.bucket = b").replace("SELECT drive_id, b AS bucket", "SELECT d.drive_id, b AS bucket"))
def histogram16(spark, sf):
    return A.histogram(_matched(spark, sf), ["drive_id"])


@query("""
, h AS (SELECT drive_id, greatest(0, least(15, floor((cgpa - 6.0) / 0.25)))::INT AS bucket, count(*)::BIGINT AS n FROM mat GROUP BY 1, 2)
SELECT e.drive_id, b AS bucket, coalesce(n, 0)::BIGINT AS count FROM (SELECT drive_id, unnest(range(min(bucket), max(bucket) + 1))::INT AS b FROM h GROUP BY 1) e LEFT JOIN h ON h.drive_id = e.drive_id AND h.bucket = e.b""")
def histogram_trimmed(spark, sf):
    return A.trimmed(A.histogram(_matched(spark, sf), ["drive_id"]), ["drive_id"]).select("drive_id", "bucket", "count")


@query(_LADDER + " SELECT * FROM lad")
def cutoff_ladder(spark, sf):
    return A.ladder(_matched(spark, sf), _baseline(spark, sf))


@query(_DIST + _LADDER + _CUT + """ SELECT drive_id, kind, threshold, CASE WHEN kind <> 'no_cgpa_filter' THEN min END AS observed_floor,
""" + f"""CASE kind WHEN 'hard_cutoff' THEN '{_HARD[0]}' || printf('%.1f', threshold) || '{_HARD[1]}' || printf('%.2f', min) || '{_HARD[2]}'
  WHEN 'soft_preference' THEN '{_SOFT[0]}' || printf('%.2f', median) || '{_SOFT[1]}' || printf('%.2f', min) || '{_SOFT[2]}' ELSE '{A.SAID["no_cgpa_filter"]}' END AS statement FROM cut""")
def cutoff_verdict(spark, sf):
    return A.cutoff(_matched(spark, sf), _baseline(spark, sf))


@query("SELECT cohort, min(cgpa) AS floor FROM (SELECT cohort, cgpa, row_number() OVER (PARTITION BY cohort ORDER BY cgpa) / count(*) OVER (PARTITION BY cohort) AS r FROM bas WHERE cgpa IS NOT NULL) WHERE r >= 0.05 GROUP BY cohort")
def batch_floor(spark, sf):
    return A.floor_of(_baseline(spark, sf), ["cohort"])


@query(", g AS (SELECT cohort, s.subject_id, s.cgpa, count_if(b.cgpa < s.cgpa) / count(*) AS share_below FROM subj s, bas b WHERE s.cgpa IS NOT NULL AND b.cgpa IS NOT NULL GROUP BY ALL) SELECT * FROM g")
def percentile_rank(spark, sf):
    return A.percentile_rank(T.subjects(spark, sf), _baseline(spark, sf), ["cohort"])


@query(_LIFT + " SELECT * FROM lft")
def branch_lift(spark, sf):
    return A.branch_lift(_matched(spark, sf), _baseline(spark, sf))


@query(_LIFT + """ SELECT drive_id, coalesce(string_agg(branch, ' and ' ORDER BY lift DESC, branch) FILTER (lift >= 2 AND count >= 3), '') AS over_represented,
""" + f"""  CASE count_if(lift >= 2 AND count >= 3) WHEN 0 THEN '{A.SAID["as_batch"][0]}' || first(branch ORDER BY count DESC, branch) || '{A.SAID["as_batch"][1]}' WHEN 1 THEN string_agg(branch, ' and ' ORDER BY lift DESC, branch) FILTER (lift >= 2 AND count >= 3) || '{A.SAID["over"][0]}'
  ELSE string_agg(branch, ' and ' ORDER BY lift DESC, branch) FILTER (lift >= 2 AND count >= 3) || '{A.SAID["over"][1]}' END AS statement FROM lft GROUP BY drive_id""")
def branch_over(spark, sf):
    return A.over_represented(A.branch_lift(_matched(spark, sf), _baseline(spark, sf)))


_GATE = """
, gat AS MATERIALIZED (SELECT drive_id, coalesce(m, 0)::BIGINT AS matched, total_students AS total, coalesce(m, 0) / total_students AS coverage, coalesce(m, 0) >= 20 AND coalesce(m, 0) / total_students >= 0.08 AS sufficient
  FROM drv LEFT JOIN (SELECT drive_id, count(*) AS m FROM mat GROUP BY 1) USING (drive_id))"""


@query(_GATE + " SELECT * FROM gat")
def sample_gate(spark, sf):
    return A.gate(T.members(spark, sf), _matched(spark, sf))


@query(_DIST + _LADDER + _CUT + _GATE + f" SELECT drive_id, matched, total, coverage, sufficient, {_r('CASE WHEN sufficient THEN mean END', 'mean')}, CASE WHEN sufficient THEN median END AS median, CASE WHEN sufficient THEN kind END AS kind, CASE WHEN sufficient THEN threshold END AS threshold FROM gat LEFT JOIN cut USING (drive_id)")
def drive_analysis(spark, sf):
    p = T.population(spark, sf).select("reg_no", "cgpa", "branch")
    a = A.analyse(T.members(spark, sf), T.neo_to_reg(spark, sf), p, _baseline(spark, sf))
    return a.select("drive_id", "matched", "total", "coverage", "sufficient", rounded("mean"), "median", "kind", "threshold")


# --- identity -------------------------------------------------------------------------------------


#: Steps of components_sql. They reach across this graph, in which any two parts are a few suppliers
#: apart; the tests hold the components of other graphs against a union-find.
_STEPS = 8


def components_sql(edges: str) -> str:
    """Common table expressions with the components (cmp), their weakest edge (cmi) and their secondary
    identifiers (cmr): each node takes the smallest label beside it, step by step."""
    step = "st{k} AS MATERIALIZED (SELECT node, least(any_value(st{j}.low), min(o.low)) AS low FROM st{j} JOIN sym ON sym.s = node JOIN (SELECT node AS n, low FROM st{j}) o ON o.n = sym.d GROUP BY node)"
    return (
        f", liv AS MATERIALIZED (SELECT a_kind || ':' || a_value AS s, b_kind || ':' || b_value AS d, confidence FROM {edges} WHERE confidence > 0 AND a_kind <> 'name' AND b_kind <> 'name'),\n"
        "sym AS MATERIALIZED (SELECT s, d FROM liv UNION SELECT d, s FROM liv),\nst0 AS MATERIALIZED (SELECT s AS node, s AS low FROM sym GROUP BY 1),\n"
        + ",\n".join(step.format(k=k + 1, j=k) for k in range(_STEPS))
        + f""",
cmp AS MATERIALIZED (SELECT node, low AS component FROM st{_STEPS}),
cmi AS MATERIALIZED (SELECT component, min(confidence)::INT AS confidence FROM liv JOIN cmp ON cmp.node = liv.s GROUP BY 1),
cmr AS MATERIALIZED (SELECT component, count_if(node LIKE 'reg_no:%')::BIGINT AS n_regs FROM cmp GROUP BY 1)"""
    )


_COMP = components_sql("edg")


@query(_COMP + " SELECT node, component FROM cmp")
def components(spark, sf):
    return I.components(T.edges(spark, sf)).select("node", "component")


@query(_COMP + " SELECT component, n_regs, n_regs > 1 AS conflicted FROM cmr")
def component_conflicts(spark, sf):
    return I.components(T.edges(spark, sf)).select("component", "n_regs", "conflicted").distinct()


@query(_COMP + " SELECT component, confidence FROM cmi")
def weakest_link(spark, sf):
    return I.components(T.edges(spark, sf)).select("component", "confidence").distinct()


@query("SELECT a_kind, a_value, b_kind, b_value, source, arg_min(confidence, seq)::INT AS confidence, min(seq) AS seq FROM edg GROUP BY ALL")
def edge_dedup(spark, sf):
    return I.dedup_edges(T.edges(spark, sf))


@query("SELECT source, count(*)::BIGINT AS edges FROM edg GROUP BY source")
def edges_by_source(spark, sf):
    return I.edges_by_source(T.edges(spark, sf))


_NAMES = "list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')), ' '), lambda t: strlen(t) > 1)"


@query(f"SELECT p_partkey AS id, array_to_string(list_sort({_NAMES}), ' ') AS name_key, len({_NAMES})::INT AS n_tokens FROM part", base=False)
def name_keys(spark, sf):
    n = N.normalise(F.col("p_name"))
    return T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.name_key(n).alias("name_key"), F.size(N.tokens(n)).alias("n_tokens"))


@query(f"WITH k AS (SELECT p_partkey, array_to_string(list_sort({_NAMES}), ' ') AS name_key FROM part) SELECT name_key, count(*)::BIGINT AS n, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM k WHERE name_key <> '' GROUP BY 1", base=False)
def name_exact_match(spark, sf):
    k = M.keyed(T.read(spark, sf, "part").select("p_partkey", "p_name"), "p_name")
    return k.groupBy("name_key").agg(F.count("*").alias("n")).withColumn("outcome", F.when(F.col("n") > 1, "ambiguous").otherwise("matched"))


@query(f"WITH k AS (SELECT DISTINCT array_to_string(list_sort({_NAMES}), ' ') AS k FROM part), t AS (SELECT DISTINCT unnest(string_split(k, ' ')) AS t FROM k) SELECT a.t AS a, b.t AS b, floor(jaro_winkler_similarity(a.t, b.t) * 1e6 + 0.5) / 1e6 AS similarity FROM t a JOIN t b ON a.t < b.t AND left(a.t, 1) = left(b.t, 1)", base=False)
def token_similarity(spark, sf):
    k = M.keyed(T.read(spark, sf, "part").select("p_name"), "p_name")
    t = k.select(F.explode("tokens").alias("t")).distinct().withColumn("f", F.substring("t", 1, 1))
    pairs = t.withColumnRenamed("t", "a").join(t.withColumnRenamed("t", "b"), "f").where("a < b")
    return pairs.select("a", "b", N.jaro_winkler_udf("a", "b").alias("similarity")).select("a", "b", rounded("similarity"))


# --- ingest ---------------------------------------------------------------------------------------

_CELLS = """
, cel AS MATERIALIZED (SELECT branch AS file_id, (subject_id + 1)::INT AS row, unnest([0, 1, 2, 3]) AS col, unnest([neo_id, translate(label, '#0123456789', ' abcdefghij'), branch, reg_no]) AS text FROM pop
  UNION ALL SELECT DISTINCT branch, 0, unnest([0, 1, 2, 3]), unnest(['Neo ID', 'Student Name', 'Branch', 'Reg No']) FROM pop)"""


@query(_CELLS + """ SELECT file_id, 0 AS sheet_idx, col, count(*)::BIGINT AS filled, count_if(col = 0 AND row > 0)::BIGINT AS neo, count_if(col = 3 AND row > 0)::BIGINT AS reg,
  count_if((col = 1 AND row > 0 AND strlen(text) <= 60) OR (col = 2 AND row > 0) OR (row = 0 AND col IN (0, 3)))::BIGINT AS name, count(DISTINCT text)::BIGINT AS distinct FROM cel GROUP BY file_id, col""")
def column_stats(spark, sf):
    return G.column_stats(T.cells(spark, sf))


@query(_CELLS + " SELECT DISTINCT file_id, 0 AS neo_col, 3 AS reg_col, 1 AS name_col FROM cel")
def column_election(spark, sf):
    return G.elect(G.column_stats(T.cells(spark, sf))).select("file_id", "neo_col", "reg_col", "name_col")


def _parsed(spark, sf):
    c = T.cells(spark, sf)
    return G.extract(c, G.elect(G.column_stats(c)))


@query("""SELECT branch AS file_id, count(*)::INT AS n_neo, count(*)::INT AS n_reg, count(*)::BIGINT AS n_linked, 'linked' AS shape, 'neo_id' AS primary_key, count(*)::INT AS student_count,
  sha256(string_agg(neo_id || chr(31), '' ORDER BY neo_id) || chr(30) || string_agg(reg_no || chr(31), '' ORDER BY reg_no)) AS content_hash FROM pop GROUP BY branch""")
def file_shape_and_hash(spark, sf):
    return G.files(_parsed(spark, sf))


@query("SELECT branch AS file_id, 'neo_id' AS kind, neo_id AS value FROM pop UNION ALL SELECT branch, 'reg_no', reg_no FROM pop")
def file_members(spark, sf):
    return G.members(_parsed(spark, sf))


@query("SELECT branch AS file_id, 'neo_id' AS kind, neo_id AS value, (subject_id + 2)::INT AS row, 'A' AS \"column\", 'Neo ID' AS header FROM pop UNION ALL SELECT branch, 'reg_no', reg_no, (subject_id + 2)::INT, 'D', 'Reg No' FROM pop")
def member_origins(spark, sf):
    c = T.cells(spark, sf)
    layout = G.elect(G.column_stats(c))
    return G.origins(G.extract(c, layout), layout, c).drop("sheet_idx")


@query("""SELECT conv_id, turn, w.k::BIGINT AS words, coalesce(w.n, 0)::BIGINT AS ids FROM (SELECT conv_id, turn, (SELECT struct_pack(k := count(*), n := count_if(regexp_full_match(upper(x), '([A-Z][0-9]){4}') OR regexp_full_match(upper(x), '[0-9]{2}[A-Z]{3}[0-9]{4,6}'))) FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS x)) AS w FROM conversations)""", base=False)
def id_extract(spark, sf):
    t = T.read(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)).alias("w"))
    return t.select("conv_id", "turn", F.size("w").cast("long").alias("words"), F.size(F.filter("w", lambda x: V.identifier_kind(x).isNotNull())).cast("long").alias("ids"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
u AS (SELECT doc_id, k, left(trim(t), 120) AS t FROM l WHERE length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= 3 AND NOT list_bool_or(list_transform(list_append(regexp_extract_all(t, '[A-Za-z0-9]+'), ''), lambda x: regexp_full_match(upper(x), '([A-Z][0-9]){4}') OR regexp_full_match(upper(x), '[0-9]{2}[A-Z]{3}[0-9]{4,6}'))))
SELECT doc_id, count(*)::BIGINT AS unread_lines, array_to_string((list(t ORDER BY k))[1:3], '|') AS titles FROM u GROUP BY doc_id""", base=False)
def line_titles(spark, sf):
    t = G.pasted_titles(T.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return t.select("doc_id", "unread_lines", F.array_join("titles", "|").alias("titles"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d-%-m-%Y') AS date FROM orders", base=False)
def date_in(spark, sf):
    o = T.read(spark, sf, "orders")
    return o.select("o_orderkey", naming.date_in(F.concat(F.lit("list 20_42_02 of "), F.date_format("o_orderdate", "d-M-yyyy"), F.lit(" final"))).alias("date"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d %b') AS day FROM orders", base=False)
def day_of(spark, sf):
    return T.read(spark, sf, "orders").select("o_orderkey", V.day(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("SELECT n_nationkey, upper(left(n_name, 1)) || lower(substr(regexp_extract(n_name, '^[A-Za-z]+'), 2)) AS company FROM nation", base=False)
def company_in(spark, sf):
    return T.read(spark, sf, "nation").select("n_nationkey", naming.company_in(F.concat(F.col("n_name"), F.lit("_SHORTLIST (2) 01-10-2026"))).alias("company"))


# --- writes ---------------------------------------------------------------------------------------


@query("SELECT o_custkey AS reg, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS first_order FROM orders GROUP BY 1", base=False)
def first_sighting(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_custkey").alias("reg"), F.col("o_orderkey").alias("first_order"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return S.first_sighting(o, ["reg"], "seq").select("reg", "first_order")


@query("SELECT o_custkey AS reg_no, arg_max(o_totalprice, o_orderkey) FILTER (o_totalprice > 100000) AS cgpa, arg_max(o_orderstatus, o_orderkey) AS branch, arg_min(o_orderpriority, o_orderkey) AS source FROM orders GROUP BY 1", base=False)
def academic_upsert(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_custkey").alias("reg_no"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("cgpa"), F.col("o_orderstatus").alias("branch"), F.lit("23").alias("cohort"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("seq"))
    early = F.expr("seq % 2 = 0")
    return S.upsert_academics(o.where(early), o.where(~early)).select("reg_no", "cgpa", "branch", "source")


@query("SELECT n_regionkey AS name_key, arg_min(n_name, n_nationkey) AS display FROM nation GROUP BY 1", base=False)
def spelling_first(spark, sf):
    n = T.read(spark, sf, "nation").select(F.col("n_regionkey").alias("name_key"), F.col("n_name").alias("display"), F.col("n_nationkey").alias("seq"))
    return S.first_sighting(n, ["name_key"], "seq").select("name_key", "display")


@query("SELECT o_custkey::VARCHAR AS content_hash, min(o_orderkey) AS seq FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1", base=False)
def unseen_drives(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("content_hash"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return S.unseen(o.select("content_hash", "seq"), o.where("o_orderstatus = 'F'")).select("content_hash", "seq")


@query("SELECT 'drives' AS name, count(*)::BIGINT AS rows FROM drv UNION ALL SELECT 'members', count(*) FROM mem UNION ALL SELECT 'edges', count(*) FROM edg")
def inventory(spark, sf):
    return S.inventory({"drives": T.drives(spark, sf), "members": T.members(spark, sf), "edges": T.edges(spark, sf)})


# --- documents ------------------------------------------------------------------------------------


@query("SELECT drive_id, value AS identifier, CASE WHEN c % 3 > 0 THEN label END AS name, CASE WHEN c % 3 > 0 THEN 'Identified' ELSE 'Not identified' END AS status FROM mem JOIN pop ON subject_id = c")
def export_rows(spark, sf):
    return D.export_rows(T.drives(spark, sf), T.members(spark, sf), _names(spark, sf))


def _names(spark, sf):
    p = T.population(spark, sf).where("subject_id % 3 > 0")
    return p.select(F.col("neo_id").alias("value"), F.col("label").alias("name")).union(p.select("reg_no", "label"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(f, '[",]') THEN '"' || replace(f, '"', '""') || '"' ELSE f END AS field FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '''=' ELSE '' END || c_name || CASE WHEN c_custkey % 5 = 0 THEN ',"x"' ELSE '' END AS f FROM customer)""", base=False)
def csv_field(spark, sf):
    k = F.col("c_custkey")
    raw = F.concat(F.when(k % 2 == 0, "=").otherwise(""), F.col("c_name"), F.when(k % 5 == 0, ',"x"').otherwise(""))
    return T.read(spark, sf, "customer").select("c_custkey", V.csv_field(raw).alias("field"))


@query(_OVER + _CHAIN + _DIST + _LADDER + _CUT + _GATE + """
SELECT l.drive_id, '*' || l.company || '*' || coalesce(' · ' || lab.label, '') || chr(10) || format('{:,}', l.total_students) || ' shortlisted'
  || coalesce(chr(10) || 'From ' || format('{:,}', p.total_students) || ' in ' || pl.label, '')
  || CASE WHEN sufficient THEN chr(10) || chr(10) || CASE kind WHEN 'hard_cutoff' THEN 'CGPA cutoff ≈ ' || printf('%.1f', threshold) || ' _(estimate)_' WHEN 'soft_preference' THEN 'CGPA skews high, no hard cutoff _(estimate)_' ELSE 'No CGPA cutoff seen' END ELSE '' END AS text
FROM lnk l LEFT JOIN lab ON lab.drive_id = l.drive_id LEFT JOIN lnk p ON p.drive_id = l.parent_drive_id LEFT JOIN lab pl ON pl.drive_id = p.drive_id LEFT JOIN gat ON gat.drive_id = l.drive_id LEFT JOIN cut ON cut.drive_id = l.drive_id""")
def group_chat(spark, sf):
    d = _linked(spark, sf).withColumn("drive_date", F.lit(None).cast("string"))
    p = T.population(spark, sf).select("reg_no", "cgpa", "branch")
    a = A.analyse(T.members(spark, sf), T.neo_to_reg(spark, sf), p, _baseline(spark, sf)).select("drive_id", "sufficient", "kind", "threshold", "over_represented")
    return D.summaries(d, R.round_labels(d), a)


@query()
def snapshot_json(spark, sf):
    p = T.population(spark, sf).select("reg_no", "cgpa", "branch")
    a = A.analyse(T.members(spark, sf), T.neo_to_reg(spark, sf), p, _baseline(spark, sf))
    v = _verdicts(spark, sf)
    return D.snapshots(T.drives(spark, sf), v, W.season(T.subjects(spark, sf), T.drives(spark, sf), T.members(spark, sf)), a)


# --- events ---------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM g)
SELECT user_id, burst, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS n FROM s GROUP BY 1, 2""", base=False)
def debounce_sessions(spark, sf):
    return watch.bursts(T.read(spark, sf, "events").select("user_id", "ts"), ["user_id"], quiet_ms=3_600_000)


@query("""WITH s AS (SELECT user_id, event_type, event_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS same FROM events)
SELECT user_id, event_type, min(event_id) AS ready_at FROM s WHERE same GROUP BY 1, 2""", base=False)
def settle(spark, sf):
    return watch.settled(T.read(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", ("event_type",), "event_id")


@query("SELECT event_id, max(ts) OVER () < ts + INTERVAL 12 HOURS AS leads, CASE WHEN event_type = 'click' AND max(ts) OVER () < ts + INTERVAL 3 MINUTES THEN 'importing' WHEN event_type = 'view' AND max(ts) OVER () < ts + INTERVAL 24 HOURS THEN 'failed' ELSE 'idle' END AS activity FROM events", base=False)
def leads_until(spark, sf):
    e = T.read(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    kind = F.when(F.col("event_type") == "click", "importing").when(F.col("event_type") == "view", "failed").otherwise("none")
    return e.crossJoin(F.broadcast(now)).select("event_id", D.leads(F.col("ts"), F.col("now")).alias("leads"), D.activity(kind, F.col("ts"), F.col("now")).alias("activity"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 2", base=False)
def newest_k(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return T.read(spark, sf, "events").select("user_id", "event_id", "ts", F.row_number().over(w).alias("k")).where("k <= 2").drop("k")


from rollcall.plans import people as _people, records as _records, samples as _samples  # noqa: E402, F401  (register their queries)
