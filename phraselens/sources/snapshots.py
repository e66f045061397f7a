"""Stage outputs as Parquet snapshots with a manifest table.

A snapshot is written to a new folder and becomes visible by one appended manifest row that holds its
row count and the digest of the parameters. Readers take the newest manifest whose data is still
complete and fall back to older ones; a stage whose snapshot exists is not computed again.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from phraselens.schemas import MANIFEST

LOG = logging.getLogger(__name__)

# What a reader meets when a snapshot's files are gone or damaged. Anything else is raised.
GONE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "FileNotFoundException", "is not a Parquet file")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifest table of `root`, made empty where there is none."""
    path = f"{root}/manifests"
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def write_snapshot(df: DataFrame, root: str, stage: str, digest: str) -> DataFrame:
    """Write a snapshot; its rows are counted while they are written."""
    spark = df.sparkSession
    path = f"{root}/{stage}/{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    row = (stage, digest, path, written.get["rows"])
    (spark.createDataFrame([row], "stage string, digest string, path string, rows long")
     .withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifests"))
    return spark.read.schema(df.schema).parquet(path)


def read_snapshot(spark: SparkSession, root: str, stage: str, digest: str | None = None) -> DataFrame | None:
    """The newest complete snapshot of a stage, or None."""
    wanted = F.col("stage") == stage
    if digest is not None:
        wanted = wanted & (F.col("digest") == digest)
    for m in _manifests(spark, root).where(wanted).orderBy(F.desc("written_at")).toLocalIterator():
        try:
            data = spark.read.parquet(m["path"])
            if data.count() == m["rows"]:
                return data
            reason = "rows are missing"
        except (PySparkException, Py4JJavaError) as error:
            reason = str(error).split("\n", 1)[0]
            if not any(sign in str(error) for sign in GONE):
                raise
        LOG.warning("snapshot %s of %s passed over: %s", m["path"], stage, reason)
    return None


def stage(spark: SparkSession, root: str, name: str, digest: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's snapshot for these parameters, computed only if there is none."""
    found = read_snapshot(spark, root, name, digest)
    return found if found is not None else write_snapshot(build(), root, name, digest)
