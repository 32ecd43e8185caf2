"""Session, shared folder and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rollcall")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a local session
    gets a temporary one; on a cluster that is an error, as executors would write where no other looks."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        known = tempfile.mkdtemp(prefix="rollcall-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def saved(df: DataFrame, name: str, buckets: int = 0, key: str = "") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives
    lost executors, and later readers do not compute it anew. With buckets, rows lie by the hash of
    key, so that what joins or groups by key need not shuffle them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    out = df.write.option("compression", "zstd")
    if not buckets:
        out.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    out.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(_table(path))
    return spark.table(_table(path))


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join on equal keys with another large table: both are shuffled and merged. Otherwise Spark may
    send df whole through the driver, as it judges tables by the size of their files, and packed columns take up
    to a hundred times as much in memory."""
    return df.hint("merge")


#: Paths of the tables that saved() made and nobody has dropped, oldest first.
_MADE: list[str] = []


def _table(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def _drop(spark: SparkSession, path: str) -> None:
    """Files and catalogue entry, if it has one, of a table made by saved()."""
    spark.sql(f"DROP TABLE IF EXISTS `{_table(path)}`")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        made = [p for p in _MADE if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]]
        for path in made:
            _drop(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops, at the end of the block, every table that saved() made in it, but for those given to the
    function that the block gets. What a block returns unwritten must not read dropped ones."""
    known, kept = set(_MADE), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles())
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _MADE if p not in known and p.rsplit("/", 1)[1] not in kept]:
            _drop(spark, path)
