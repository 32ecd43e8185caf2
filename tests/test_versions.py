"""Tables that change together."""

import pytest
from pyspark.sql import functions as F

from rollcall.operators import answers, versions


def held(spark, folder, version=None):
    return {k: sorted(tuple(r) for r in t.collect()) for k, t in versions.read(spark, folder, version).items()}


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "store")
    one = lambda *rows: spark.createDataFrame(list(rows), "id long, name string")
    assert versions.current(spark, folder) == 0 and versions.read(spark, folder) == {}
    assert versions.publish(spark, folder, {"people": one((1, "a")), "lists": one((7, "x"))}) == 1
    first = {"people": [(1, "a")], "lists": [(7, "x")]}
    assert held(spark, folder) == first
    reader = versions.read(spark, folder)
    # a failure in either table leaves the old version, whichever was written before
    bad = one((2, "b")).withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    for changed in ({"people": one((2, "b")), "lists": bad}, {"lists": bad, "people": one((2, "b"))}):
        with pytest.raises(Exception):
            versions.publish(spark, folder, changed)
        assert held(spark, folder) == first and versions.current(spark, folder) == 1
    # a table may be made from itself; others stay without being written again
    grown = reader["people"].unionByName(one((2, "b")))
    assert versions.publish(spark, folder, {"people": grown}) == 2
    assert held(spark, folder) == {"people": [(1, "a"), (2, "b")], "lists": [(7, "x")]}
    assert sorted(tuple(r) for r in reader["people"].collect()) == [(1, "a")]  # who read the first version keeps it
    assert held(spark, folder, 1) == first


def test_half_a_manifest_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "store")
    table = spark.createDataFrame([(1,)], "id long")
    versions.publish(spark, folder, {"t": table})
    cut = tmp_path / "store" / versions.MANIFESTS / f"{2:012d}.json"
    cut.write_text('{"t": {"path"')
    assert versions.current(spark, folder) == 1 and held(spark, folder) == {"t": [(1,)]}
    assert versions.publish(spark, folder, {"t": table.withColumn("id", F.col("id") + 1)}) == 3
    assert held(spark, folder) == {"t": [(2,)]}


def test_of_two_writers_one_is_refused(spark, tmp_path):
    folder = str(tmp_path / "store")
    table = spark.createDataFrame([(1,)], "id long")
    base = versions.publish(spark, folder, {"t": table})
    versions.publish(spark, folder, {"t": table.withColumn("id", F.lit(5).cast("long"))}, base=base)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, {"t": table}, base=base)
    assert held(spark, folder) == {"t": [(5,)]}


def test_clean_keeps_what_is_named(spark, tmp_path):
    folder = str(tmp_path / "store")
    for k in range(4):
        versions.publish(spark, folder, {"t": spark.createDataFrame([(k,)], "id long")} | ({"u": spark.createDataFrame([(9,)], "id long")} if not k else {}))
    with pytest.raises(Exception):
        versions.publish(spark, folder, {"t": spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))})
    assert versions.clean(spark, folder, keep=2) >= 2
    assert held(spark, folder) == {"t": [(3,)], "u": [(9,)]} and held(spark, folder, 3) == {"t": [(2,)], "u": [(9,)]}
    with pytest.raises(ValueError):
        versions.read(spark, folder, 1)
    assert versions.publish(spark, folder, {}, dropped=("u",)) == 5 and held(spark, folder) == {"t": [(3,)]}


def test_snapshot_replaces_the_old_one(spark, tmp_path):
    doc = lambda text: spark.createDataFrame([(text,)], "document string")
    for text in ('{"a":1}', '{"a":2}'):
        path = answers.write_snapshot(doc(text), str(tmp_path))
    assert path.endswith("snapshot.json") and (tmp_path / "snapshot.json").read_text() == '{"a":2}\n'
    with pytest.raises(ValueError):
        answers.write_snapshot(doc("x").union(doc("y")).repartition(2).limit(0), str(tmp_path))
    assert (tmp_path / "snapshot.json").read_text() == '{"a":2}\n'
