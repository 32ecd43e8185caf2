"""The engine's relations made from the test tables: people are customers, lists are order priorities by
price tier, edges are part-supplier pairs. BASE_SQL makes the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = (0.0, 150000.0, 300000.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neo_of(key: Column) -> Column:
    d = F.lpad(key.cast("string"), 8, "0")
    digit = lambda k: F.substring(d, k, 1)
    return F.concat(*[F.translate(digit(k), "0123456789", "ABCDEFGHIJ") if k % 2 else digit(k) for k in range(1, 9)])


def reg_of(key: Column) -> Column:
    return F.concat(F.lit("2"), (key % 10).cast("string"), F.lit("BCE"), F.lpad(key.cast("string"), 6, "0"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("subject_id"), neo_of(k).alias("neo_id"), reg_of(k).alias("reg_no"), (F.floor("c_acctbal") / F.lit(1000.0)).alias("cgpa"), F.col("c_mktsegment").alias("branch"), F.col("c_nationkey").cast("string").alias("cohort"), F.col("c_name").alias("label"), "c_acctbal")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = population(spark, sf_dir)
    return p.select("subject_id", F.when(F.col("c_acctbal") >= 0, F.col("neo_id")).alias("neo_id"), F.when(F.col("branch") != "BUILDING", F.col("reg_no")).alias("reg_no"), "label", F.when(F.col("cgpa").between(4, 10), F.col("cgpa")).alias("cgpa"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drive_id, p, tier, company, c): who stands on which list. The dearest order of a priority says which
    tiers a person reaches, so orders are grouped before rows are made for each tier."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("dearest"))
    reached = sum((F.when(F.col("dearest") >= t, 1).otherwise(0) for t in TIERS[1:]), F.when(F.col("dearest") >= TIERS[0], 1).otherwise(0))
    tier = F.explode(F.slice(F.array(*[F.lit(k) for k in range(len(TIERS))]), F.lit(1), reached))
    p = F.substring("o_orderpriority", 1, 1).cast("long")
    return o.select(p.alias("p"), tier.alias("tier"), F.col("o_orderpriority").alias("company"), F.col("o_custkey").alias("c")).select((F.col("p") * 3 + F.col("tier")).alias("drive_id"), "p", "tier", "company", "c")


def _key(p: Column) -> Column:
    return F.when(p == 5, "reg_no").otherwise("neo_id")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = listed(spark, sf_dir)
    return m.select("drive_id", _key(F.col("p")).alias("kind"), F.when(F.col("p") == 5, reg_of(F.col("c"))).otherwise(neo_of(F.col("c"))).alias("value"))


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listed(spark, sf_dir).groupBy("drive_id", "p", "tier", "company").agg(F.count("*").alias("total_students"))
    shape = F.when((F.col("p") == 4) & (F.col("tier") == 2), "unrecognised").when(F.col("p") == 5, "reg_no_only").otherwise("neo_id_only")
    label = F.when((F.col("p") == 2) & (F.col("tier") == 2), "Final")
    return d.select("drive_id", "company", F.concat(F.lit("2026-09-0"), (F.col("tier") + 1).cast("string")).alias("imported_at"), shape.alias("shape"), _key(F.col("p")).alias("primary_key"), "total_students", label.alias("round_label"), F.lit(None).cast("long").alias("parent_drive_id"))


def neo_to_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population(spark, sf_dir).select("neo_id", "reg_no", (F.col("subject_id") % 4).cast("int").alias("confidence"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-supplier pairs of all lines: parts are primary, suppliers secondary."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.lit("neo_id").alias("a_kind"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("a_value"), F.lit("reg_no").alias("b_kind"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("b_value"), (F.col("l_linenumber") % 4).cast("int").alias("confidence"), F.col("l_returnflag").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheets: one file per segment, columns id, name, segment, number; a heading on top."""
    p = population(spark, sf_dir)
    rows = p.select(F.col("branch").alias("file_id"), (F.col("subject_id") + 1).cast("int").alias("row"), F.posexplode(F.array("neo_id", F.translate("label", "#0123456789", " abcdefghij"), "branch", "reg_no")).alias("col", "text"))
    heads = p.select(F.col("branch").alias("file_id")).distinct().select("file_id", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, ("Neo ID", "Student Name", "Branch", "Reg No")))).alias("col", "text"))
    return heads.union(rows).select("file_id", F.lit(0).alias("sheet_idx"), F.lit("Sheet1").alias("sheet"), "row", "col", "text")


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where members stand: line by customer number, a few to a line."""
    m = listed(spark, sf_dir)
    return m.select("drive_id", _key(F.col("p")).alias("kind"), F.when(F.col("p") == 5, reg_of(F.col("c"))).otherwise(neo_of(F.col("c"))).alias("value"), F.lit("Sheet1").alias("sheet"), F.floor(F.col("c") / 2).cast("long").alias("row"))


_NEO = " || ".join(f"translate(substr(l, {k}, 1), '0123456789', 'ABCDEFGHIJ')" if k % 2 else f"substr(l, {k}, 1)" for k in range(1, 9))
BASE_SQL = f"""
pop AS MATERIALIZED (SELECT c_custkey AS subject_id, {_NEO} AS neo_id, '2' || (c_custkey % 10) || 'BCE' || lpad(c_custkey::VARCHAR, 6, '0') AS reg_no,
  floor(c_acctbal) / 1000.0::DOUBLE AS cgpa, c_mktsegment AS branch, c_nationkey::VARCHAR AS cohort, c_name AS label, c_acctbal
  FROM (SELECT *, lpad(c_custkey::VARCHAR, 8, '0') AS l FROM customer)),
subj AS MATERIALIZED (SELECT subject_id, CASE WHEN c_acctbal >= 0 THEN neo_id END AS neo_id, CASE WHEN branch <> 'BUILDING' THEN reg_no END AS reg_no, label,
  CASE WHEN cgpa BETWEEN 4 AND 10 THEN cgpa END AS cgpa FROM pop),
tiers AS (SELECT unnest([0, 1, 2]) AS tier, unnest([0.0, 150000.0, 300000.0]) AS lim),
lst AS MATERIALIZED (SELECT DISTINCT left(o_orderpriority, 1)::BIGINT * 3 + tier AS drive_id, left(o_orderpriority, 1)::BIGINT AS p, tier, o_orderpriority AS company, o_custkey AS c
  FROM orders JOIN tiers ON o_totalprice >= lim),
mem AS MATERIALIZED (SELECT drive_id, CASE WHEN p = 5 THEN 'reg_no' ELSE 'neo_id' END AS kind, CASE WHEN p = 5 THEN reg_no ELSE neo_id END AS value, c FROM lst JOIN pop ON c = subject_id),
drv AS MATERIALIZED (SELECT drive_id, company, '2026-09-0' || (tier + 1) AS imported_at,
  CASE WHEN p = 4 AND tier = 2 THEN 'unrecognised' WHEN p = 5 THEN 'reg_no_only' ELSE 'neo_id_only' END AS shape,
  CASE WHEN p = 5 THEN 'reg_no' ELSE 'neo_id' END AS primary_key, CASE WHEN p = 2 AND tier = 2 THEN 'Final' END AS round_label, p, tier, count(*)::BIGINT AS total_students
  FROM lst GROUP BY ALL),
n2r AS (SELECT neo_id, reg_no, (subject_id % 4)::INT AS confidence FROM pop),
org AS MATERIALIZED (SELECT drive_id, kind, value, 'Sheet1' AS sheet, (c // 2)::BIGINT AS row FROM mem),
edg AS MATERIALIZED (SELECT 'neo_id' AS a_kind, 'P' || l_partkey AS a_value, 'reg_no' AS b_kind, 'S' || l_suppkey AS b_value, (l_linenumber % 4)::INT AS confidence,
  l_returnflag AS source, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
ver AS MATERIALIZED (SELECT s.subject_id, d.drive_id,
  CASE WHEN reason IS NOT NULL THEN 'undetermined' WHEN m.value IS NOT NULL THEN 'shortlisted' ELSE 'not_shortlisted' END AS status, reason,
  CASE WHEN reason = 'key_kind_not_configured' THEN s.primary_key END AS file_key, s.label
  FROM (SELECT *, CASE WHEN shape = 'unrecognised' THEN 'file_not_understood' WHEN neo_id IS NULL AND reg_no IS NULL THEN 'no_identity_configured'
      WHEN (CASE WHEN primary_key = 'reg_no' THEN reg_no ELSE neo_id END) IS NULL THEN 'key_kind_not_configured' END AS reason,
      CASE WHEN primary_key = 'reg_no' THEN reg_no ELSE neo_id END AS v FROM subj, drv) s
  JOIN drv d USING (drive_id) LEFT JOIN mem m ON m.drive_id = s.drive_id AND m.value = s.v),
mat AS MATERIALIZED (SELECT drive_id, reg_no, cgpa, branch FROM (
    SELECT drive_id, n2r.reg_no FROM mem JOIN n2r ON mem.value = n2r.neo_id WHERE kind = 'neo_id' AND confidence >= 1
    UNION SELECT drive_id, value FROM mem WHERE kind = 'reg_no') JOIN pop USING (reg_no) WHERE cgpa BETWEEN 4 AND 10),
bas AS MATERIALIZED (SELECT cohort, CASE WHEN cgpa BETWEEN 4 AND 10 THEN cgpa END AS cgpa, branch FROM pop)
"""
