"""Folders and changes as streams: settled files, imports once, changes gathered, activity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.sources.sheets import cells_of, is_candidate

POLL, QUIET_MS = "4 seconds", 150


def watch_folder(spark: SparkSession, folder: str, since: str) -> DataFrame:
    """A stream of the spreadsheets that appear in a folder from a time on: path, content, modified."""
    found = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,xls,ods,csv}")
    found = found.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return found.where(is_candidate(F.col("path")) & (F.col("modificationTime") >= F.lit(since).cast("timestamp"))).select("path", F.col("modificationTime").alias("modified"), "content")


def import_once(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands the cells of each batch of files to sink; with sink's anti-join on the
    content hash, a list is imported once."""

    def each(batch: DataFrame, number: int) -> None:
        sink(cells_of(batch), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=POLL).start()


def settled(sightings: DataFrame, key: str = "path", state: tuple[str, ...] = ("modified", "size"), order: str = "seen") -> DataFrame:
    """A table of sightings (as a stream: rollcall.streaming.stateful): the first sighting of each (path,
    modified) whose time and size equal those of the sighting before."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lit(True)
    for c in state:
        same = same & (F.col(c) == F.lag(c).over(w))
    return sightings.withColumn("_same", same).where("_same").groupBy(key, state[0]).agg(F.min(order).alias("ready_at"))


def bursts(changes: DataFrame, keys: list[str], at: str = "ts", quiet_ms: int = QUIET_MS) -> DataFrame:
    """(keys, burst, started, ended, n): changes less than quiet_ms apart are one rebuild."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) <= F.lag(at).over(w) + F.expr(f"INTERVAL '{quiet_ms / 1000:.3f}' SECOND"), 0).otherwise(1)
    numbered = changes.withColumn("_new", new).withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "burst").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def burst_stream(changes: DataFrame, keys: list[str], at: str = "ts", quiet_ms: int = QUIET_MS, late: str = "10 seconds") -> DataFrame:
    """The same over a stream, by session windows."""
    return changes.withWatermark(at, late).groupBy(*keys, F.session_window(at, f"{quiet_ms} milliseconds").alias("w")).agg(F.count("*").alias("n")).select(*keys, "w.start", "w.end", "n")
