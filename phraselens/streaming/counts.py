"""Resumable phrase counting over a stream of labelled texts.

Every micro-batch writes its counts to a folder of its own (level 0). When MERGE folders of a level are full, they are summed
into one folder of the next level, so that after n batches some MERGE * log(n) folders are left. What was merged is removed
only once a later batch runs: then the batch that merged it is committed and will not be replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from phraselens.operators.phrases import phrase_counts
from phraselens.operators.progress import Progress
from phraselens.session import complete, delete, folders, temporary_tables

MERGE = 16
MEASURES = ("total_frequency", "hate_count", "non_hate_count")
COUNTS = "phrase string, total_frequency long, hate_count long, non_hate_count long"
PROGRESS = "batch_id long, texts long, missing_texts long, texts_without_phrases long, phrases long"


def _folder(out: str, level: int, part: int) -> str:
    return f"{out}/level-{level}/part-{part}"


def _summed(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.schema(COUNTS).parquet(*paths) if paths else spark.createDataFrame([], COUNTS)
    return rows.groupBy("phrase").agg(*[F.sum(c).alias(c) for c in MEASURES])


def _merge_levels(spark: SparkSession, out: str, batch_id: int, merge: int) -> None:
    """Sum the levels that this batch fills, and remove what earlier batches have summed."""
    level, span = 0, merge
    while batch_id + 1 >= span:
        group, left = divmod(batch_id + 1, span)
        if not left:
            parts = [_folder(out, level, p) for p in range((group - 1) * merge, group * merge)]
            # After a lost checkpoint, parts that were removed are in the sum that replaced them.
            if all(complete(spark, p) for p in parts):
                _summed(spark, parts).write.mode("overwrite").parquet(_folder(out, level + 1, group - 1))
        elif left == 1 and complete(spark, _folder(out, level + 1, group - 1)):
            for p in range((group - 1) * merge, group * merge):
                delete(spark, _folder(out, level, p))
        level, span = level + 1, span * merge


def count_phrases(stream: DataFrame, out: str, checkpoint: str, prepare=lambda batch: batch,
                  available_now: bool = True, merge: int = MERGE) -> StreamingQuery:
    """Write the phrase counts of every micro-batch, and its counters beside them.

    A batch replayed after a failure overwrites its folder, so nothing is counted twice and nothing is
    lost. `prepare` turns a batch into doc_id, text, label (for instance by joining a label table). `merge` must not change
    during the life of an output folder.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, progress = batch.sparkSession, Progress()
        with temporary_tables(spark):
            phrase_counts(prepare(batch), progress=progress).write.mode("overwrite").parquet(_folder(out, 0, batch_id))
            row = {"batch_id": batch_id, **progress.counters()}
            spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/batch={batch_id}")
            _merge_levels(spark, out, batch_id, merge)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _numbered(names: list[str], lead: str) -> list[int]:
    return sorted(int(n.removeprefix(lead)) for n in names if n.startswith(lead))


def current_folders(spark: SparkSession, out: str, merge: int = MERGE) -> list[str]:
    """The folders that together hold every batch once: the highest complete sums, then what they do not cover."""
    found, covered = [], []
    for level in reversed(_numbered(folders(spark, out), "level-")):
        span = merge ** level
        for part in _numbered(folders(spark, f"{out}/level-{level}"), "part-"):
            path = _folder(out, level, part)
            if not any(first <= part * span < end for first, end in covered) and complete(spark, path):
                found.append(path)
                covered.append((part * span, (part + 1) * span))
    return found


def total_counts(spark: SparkSession, out: str, merge: int = MERGE) -> DataFrame:
    """Counts over all batches so far."""
    return _summed(spark, current_folders(spark, out, merge))


def batch_progress(spark: SparkSession, out: str) -> DataFrame:
    """The counters of every micro-batch."""
    return spark.read.schema(PROGRESS).parquet(f"{out}/progress")
