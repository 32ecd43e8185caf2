"""Streams: settled files, folders, bursts."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rollcall.streaming import stateful, watch


def test_settled_table(spark):
    rows = [("a", 1, 10, 1), ("a", 1, 20, 2), ("a", 1, 20, 3), ("a", 1, 20, 4), ("b", 1, 5, 1), ("b", 2, 5, 2)]
    got = watch.settled(spark.createDataFrame(rows, "path string, modified long, size long, seen long")).collect()
    assert [(r.path, r.ready_at) for r in got] == [("a", 3)]


def _put(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f".{name}").rename(folder / name)
    time.sleep(0.05)


SIGHTING = "path string, modified timestamp, size long, seen long"


def _sightings(spark, folder):
    return spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).json(str(folder))


def _until(query, table, n, seconds=90):
    end = time.time() + seconds
    while time.time() < end and (query.exception() is None) and SparkSession.active().table(table).count() < n:
        time.sleep(0.2)
    assert query.exception() is None


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.ready(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_settled_stream_and_restart(rocks, tmp_path):
    spark, folder, out = rocks, tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    t = "2026-01-01 00:00:00"
    put = lambda k, *rows: _put(folder, f"{k}.json", [{"path": p, "modified": t, "size": s, "seen": k} for p, s in rows])

    def run(n):
        q = stateful.settled(_sightings(spark, folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        end = time.time() + 90
        while time.time() < end and q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) < n:
            time.sleep(0.2)
        time.sleep(0.5)
        q.stop()
        assert q.exception() is None
        return sorted((r.path, r.size) for r in spark.read.schema("path string, modified timestamp, size long").parquet(str(out)).collect())

    for k, rows in enumerate([[("a", 10), ("b", 5)], [("a", 20), ("b", 5)], [("b", 5)]]):
        put(k, *rows)
    assert run(5) == [("b", 5)]
    put(3, ("a", 20), ("b", 5))  # goes on where it was: a has been seen with this size before the restart
    assert run(2) == [("a", 20), ("b", 5)]
    put(4, ("a", 20), ("b", 5))
    assert run(2) == [("a", 20), ("b", 5)]


def test_settled_state_ends(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "in"
    folder.mkdir()
    put = lambda k: _put(folder, f"{k}.json", [{"path": "a", "modified": "2026-01-01 00:00:00", "size": 1, "seen": k + n} for n in (0, 1)])
    q = stateful.settled(_sightings(spark, folder), keep_ms=3_000).writeStream.format("memory").queryName("ending").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        put(0)
        _until(q, "ending", 1)
        assert spark.table("ending").count() == 1
        time.sleep(5)  # nobody sees it: what is known of it ends
        put(2)
        _until(q, "ending", 2)
        assert spark.table("ending").count() == 2
    finally:
        q.stop()


def test_publisher_speaks_without_further_input(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "in"
    folder.mkdir()
    at = lambda ms: (dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=ms)).isoformat()
    rows = [("a", "changed", None, 0), ("a", "changed", None, 10), ("a", "changed", None, 20), ("b", "import_started", "x.xlsx", 0), ("c", "import_started", "y.xlsx", 0), ("c", "import_ended", None, 5), ("d", "import_failed", "z.xlsx", 1)]
    _put(folder, "0.json", [{"key": k, "signal": s, "file": f, "at": at(ms)} for k, s, f, ms in rows])
    signals = spark.readStream.schema("key string, signal string, file string, at timestamp").json(str(folder))
    q = stateful.publications(signals, quiet_ms=300, importing_ms=4_000, failed_ms=8_000).writeStream.format("memory").queryName("published").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        _until(q, "published", 6)
        got = [(r.key, r.changes, r.activity, r.file) for r in spark.table("published").orderBy("key", "moment").collect()]
        assert got == [("a", 3, "idle", None), ("b", 1, "importing", "x.xlsx"), ("b", 0, "idle", None), ("c", 2, "idle", None), ("d", 1, "failed", "z.xlsx"), ("d", 0, "idle", None)]
        moments = {r.key: r.span for r in spark.sql("select key, cast(max(moment) as double) - cast(min(moment) as double) as span from published group by key").collect()}
        assert moments["b"] == pytest.approx(3.7, abs=0.01) and moments["d"] == pytest.approx(7.7, abs=0.01)
    finally:
        q.stop()


def test_folder_is_imported_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "x.csv").write_text("A1B2C3D4,B1B2C3D4")

    def run():
        q = watch.import_once(watch.watch_folder(spark, str(folder), "2020-01-01T00:00:00"), lambda cells, n: cells.write.mode("append").parquet(out), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()

    run()
    run()
    assert spark.read.parquet(out).where(F.col("text").isNotNull()).count() == 2


def test_bursts(spark):
    at = lambda ms: dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("k", at(0)), ("k", at(100)), ("k", at(250)), ("k", at(500))]
    got = watch.bursts(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"]).orderBy("burst").collect()
    assert [r.n for r in got] == [3, 1]
