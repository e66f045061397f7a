"""Labelled corpora: reading, label normalisation and class codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from phraselens.operators.order import counted_before
from phraselens.schemas import CSV_CORPUS

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """text,label files; quoted texts may hold commas, quotes and line breaks.

    A file with line breaks inside quotes cannot be split, so a large corpus should come as many files.
    """
    return spark.read.options(**CSV_OPTIONS, multiLine=True).schema(CSV_CORPUS).csv(path)


def write_csv(corpus: DataFrame, path: str) -> None:
    corpus.select("text", "label").write.options(**CSV_OPTIONS).csv(path)


def with_row_ids(df: DataFrame) -> DataFrame:
    """Ids for rows that have none. Write the result once: a second evaluation may number differently."""
    return df.withColumn("doc_id", F.monotonically_increasing_id())


def normalise_labels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): label 1 is positive, every other number negative (0).

    Rows without a text or without a numeric label are rejected with a reason.
    """
    number = F.col("label").cast("string").try_cast("double").try_cast("int")
    reason = F.when(F.col("text").isNull(), "missing text").when(number.isNull(), "invalid label")
    checked = df.withColumn("reason", reason)
    accepted = (checked.where(F.col("reason").isNull()).drop("reason")
                .withColumn("label", F.when(number == 1, 1).otherwise(0)))
    return accepted, checked.where(F.col("reason").isNotNull())


def labelled_corpus(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label from a document table and a label table; rejected_rows has what is left out."""
    return _checked(documents, labels, label)[0]


def rejected_rows(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The joined rows that labelled_corpus leaves out, with the reason."""
    return _checked(documents, labels, label)[1]


def _checked(documents: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    joined = documents.select("doc_id", "text").join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")
    return normalise_labels(joined)


def label_codes(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels with class codes 0, 1, ... in label order and their names; there may be any number of labels."""
    distinct = df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return counted_before(distinct, "label", F.lit(1)).select("label", F.col("before").cast("int").alias("code"), F.col("label").cast("string").alias("name"))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the class code of every row; Spark broadcasts the codes if they are few."""
    codes = label_codes(df, label).select(F.col("label").alias(label), "code", "name")
    return df.join(codes, label, "left")
