"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def session(cores: int | str = "*", app: str = "fernweh", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir. Only a local session, whose executors are the driver, may go without and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"fernweh-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(named)
    return named


def filesystem(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted by `release`, or when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the tables this application has written to cut lineage; frames that read them can't be used any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    return len(paths)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cuts lineage by a table in the shared folder; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Gives a Python stage at least one task per core when the scan has fewer; large scans stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


def scatter(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by keys over as many tasks as shuffles have. Unlike the exchanges of joins and aggregates these aren't merged by size, which small rows that cost much Python would suffer from; a distinct or a join by the keys that follows needs no other."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


SMALL = 1_000_000  # keys that may be broadcast


def keep_keys(df: DataFrame, keys: DataFrame, on: str, bound: int = SMALL) -> DataFrame:
    """Rows whose key is among the keys (one column, materialized). Up to `bound` keys are broadcast, so that the rows aren't shuffled; more meet them by a shuffled semi-join."""
    few = keys.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application, so that clusters need no installation."""
    import shutil

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="fernweh-"), "fernweh-package")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
