"""Several tables that change together: data first, then a manifest that says which files each table is.

A version is complete when its manifest is. Readers take the latest complete one and keep its files until
they are done, whatever is written meanwhile; a write that fails leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS, DATA, END = "manifests", "data", "\n--end--\n"


class Conflict(RuntimeError):
    """Someone else published the version that was to be written."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifest(spark: SparkSession, folder: str, version: int) -> dict | None:
    """What a version holds, or None where it is missing or only half written."""
    fs, where = _fs(spark, f"{folder}/{MANIFESTS}/{version:012d}.json")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text[: -len(END)]) if text.endswith(END) else None


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, where = _fs(spark, f"{folder}/{MANIFESTS}")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, folder: str) -> int:
    """The latest complete version; 0 where there is none."""
    return next((k for k in reversed(_numbers(spark, folder)) if _manifest(spark, folder, k) is not None), 0)


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the latest unless told otherwise; none where there is no version."""
    number = current(spark, folder) if version is None else version
    held = _manifest(spark, folder, number) if number else {}
    if held is None:
        raise ValueError(f"version {number} is not there")
    return {name: spark.read.schema(StructType.fromJson(x["schema"])).parquet(f"{folder}/{x['path']}") for name, x in held.items()}


def publish(spark: SparkSession, folder: str, changed: dict[str, DataFrame], dropped: tuple[str, ...] = (), base: int | None = None) -> int:
    """Writes the changed tables, then the manifest of a new version in which they replace those of the same
    names; other tables stay as they are, without being written. Returns the version's number. Tables are
    written side by side with what readers read, so a table may be made from its own last version.

    base is the version that the changes were made from (the latest, if not told). Where another one has
    been published since, nothing changes and Conflict is raised. A manifest is created only if its name
    is free, and counts only once its end is written.
    """
    latest = current(spark, folder)
    base = latest if base is None else base
    if base != latest:
        raise Conflict(f"version {latest} was published after {base}")
    held = {k: v for k, v in ((_manifest(spark, folder, latest) if latest else {}) or {}).items() if k not in dropped}
    for name, table in changed.items():
        path = f"{DATA}/{name}-{uuid.uuid4().hex}"
        table.write.option("compression", "zstd").parquet(f"{folder}/{path}")
        held[name] = {"path": path, "schema": table.schema.jsonValue()}
    number = max(_numbers(spark, folder), default=0) + 1
    fs, where = _fs(spark, f"{folder}/{MANIFESTS}/{number:012d}.json")
    try:
        out = fs.create(where, False)
    except Exception as e:
        raise Conflict(f"version {number} was published meanwhile") from e
    try:
        out.write(bytearray((json.dumps(held, sort_keys=True) + END).encode()))
    finally:
        out.close()
    return number


def clean(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes what the last `keep` complete versions do not name: older manifests, their files, and files of
    writes that failed. Not while a write is going on. Returns how many tables went."""
    complete = [k for k in _numbers(spark, folder) if _manifest(spark, folder, k) is not None][-keep:]
    named = {x["path"] for k in complete for x in _manifest(spark, folder, k).values()}
    for k in _numbers(spark, folder):
        if k not in complete:
            fs, where = _fs(spark, f"{folder}/{MANIFESTS}/{k:012d}.json")
            fs.delete(where, False)
    fs, where = _fs(spark, f"{folder}/{DATA}")
    gone = [s.getPath() for s in fs.listStatus(where) if f"{DATA}/{s.getPath().getName()}" not in named] if fs.exists(where) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
