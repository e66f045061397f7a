"""A training corpus from raw documents: five stages, each a table of the documents that the stage before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents: doc_id, text, lang, source, n_chars, whatever else came along included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phraselens.llm import bpe, common, decontaminate, language, line_dedup, minhash, queries
from phraselens.session import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be determined (no letter in the text) go; a missing lang is filled in.

    The model is learned from the labelled documents outside the held-out fold. Without any label nothing can be told,
    and only texts without a letter go.
    """
    common.settings(spark)
    return language.keep_determined(docs, queries.remainder(3) == 1)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document of which no line is left goes too. n_chars follows the text."""
    common.settings(spark)
    found = line_dedup.dedup_lines(docs).where((F.col("lines_removed") == 0) | (F.trim("text") != ""))
    return found.select(*[F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
                          if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    common.settings(spark)
    gone = written(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "pipeline-copies")
    return docs.join(common.small(gone), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id: the text decides."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    found = decontaminate.find_leaks(docs, benchmark).where("contaminated").select("text_hash").distinct()
    gone = common.small(written(found, "pipeline-leaks"))
    return docs.join(gone, F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("text_hash"), "left_anti").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit numbers), n_tokens, ids_sha256, decoded_sha256 of every text that is left."""
    common.settings(spark)
    return bpe.round_trip(docs, queries.tokenizer_path(), keep_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", tokenise),
]

# SQL can express neither the language model nor byte-pair merges: tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
