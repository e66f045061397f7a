"""Explained verdicts for texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from phraselens.config import INFER, Settings
from phraselens.plans.inference import explain, prepared
from phraselens.session import temporary_tables


def explain_stream(stream: DataFrame, index: DataFrame, embedder, out: str, checkpoint: str,
                   id_col: str = "doc_id", text_col: str = "text", available_now: bool = True, settings: Settings = Settings()) -> StreamingQuery:
    """Classify each micro-batch against the fixed index, made ready once; a replayed batch overwrites its folder."""
    index = prepared(index, settings)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(batch.sparkSession):
            explain(batch, index, embedder, id_col, text_col, INFER, settings).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
