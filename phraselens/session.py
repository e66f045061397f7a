"""Session helpers: recommended settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "phraselens") -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Smaller adaptive partitions: a partition of texts grows about fiftyfold when its n-grams are formed."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32kb")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16mb")
    # A Python worker's memory must not follow the length of the texts.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from spark.checkpoint.dir.

    Only a local-mode session may fall back to a temporary folder, because there driver and
    executors are one process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="phraselens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run, so that a retried or parallel run never meets old files."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scope: ContextVar[list | None] = ContextVar("tables of the scope", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder.

    For results that several later steps read: lineage ends here, a lost executor costs no
    recomputation, and Spark knows the size when it plans the joins.
    """
    path = run_dir(df.sparkSession, name)
    if _scope.get() is not None:
        _scope.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables `written` inside are deleted at the end; for work whose result is stored before the scope ends."""
    before = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            delete(spark, path)
        _scope.reset(before)


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system Spark can write to; nothing if there is none."""
    files, place = _located(spark, path)
    files.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    files, place = _located(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    files, place = _located(spark, f"{path}/_SUCCESS")
    return files.exists(place)
