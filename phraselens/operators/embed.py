"""Embedders: interchangeable ways to turn texts or phrases into vectors.

An embedder adds an `embedding` column to a DataFrame row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phraselens.config import EMBEDDING_DIM
from phraselens.functions import text as ft
from phraselens.functions.vectors import vector_to_array
from phraselens.functions.words import custom_stop_words


def phrase_id(phrase: Column) -> Column:
    """Stable key of a phrase, the same in every run and engine."""
    return F.md5(phrase.cast("binary"))


class HashedEmbedder:
    """Word counts hashed to `dim` dimensions; needs no model and no pass over the data.

    A word counts towards the first 24 bits of its MD5, modulo the width.

    Entries are whole numbers, so inner products and squared norms are exact and cosines are equal
    in every engine. It matches words, not meaning: use FunctionEmbedder for a trained encoder.
    """

    def __init__(self, dim: int = EMBEDDING_DIM, stop_words=None):
        self.dim = dim
        self.stop_words = custom_stop_words() if stop_words is None else list(stop_words)

    def fingerprint(self) -> str:
        """What the vectors depend on, for the digest of stored stages."""
        return repr((type(self).__name__, self.dim, self.stop_words))

    def embed(self, df: DataFrame, text_col: str) -> DataFrame:
        dim, stop, names = self.dim, list(self.stop_words), df.columns
        schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

        def count(batches):
            words = pa.array(stop, pa.string())
            for batch in batches:
                tokens = pc.fill_null(batch["_tokens"], pa.scalar([], pa.list_(pa.string())))
                coded = tokens.flatten().dictionary_encode()
                # Each different word of a batch is hashed once; the last bucket takes what does not count.
                buckets = np.array([int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dim for w in coded.dictionary.to_pylist()] + [dim])
                buckets[:-1][pc.is_in(coded.dictionary, value_set=words).to_numpy(zero_copy_only=False)] = dim
                row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy())
                cells = np.bincount(row * (dim + 1) + buckets[coded.indices.to_numpy()], minlength=len(tokens) * (dim + 1))
                counts = cells.reshape(len(tokens), dim + 1)[:, :dim].astype(np.float64)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dim), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], vectors], [*names, "embedding"])

        return df.withColumn("_tokens", ft.tokens(F.col(text_col))).mapInArrow(count, schema)


class ModelEmbedder:
    """A fitted Spark ML pipeline that ends in a vector column (HashingTF, IDF, Word2Vec, ...)."""

    def __init__(self, model: PipelineModel, input_col: str, output_col: str):
        self.model, self.input_col, self.output_col = model, input_col, output_col

    def fingerprint(self) -> str:
        """The stages' parameters and uids: a pipeline fitted anew has other uids."""
        return repr([(type(s).__name__, s.uid, sorted((p.name, str(v)) for p, v in s.extractParamMap().items())) for s in self.model.stages])

    def embed(self, df: DataFrame, text_col: str) -> DataFrame:
        tokenised = df.withColumn(self.input_col, ft.tokens(F.col(text_col)))
        out = self.model.transform(tokenised).withColumn("embedding", vector_to_array(self.output_col))
        return out.select(*df.columns, "embedding")


def encode_with_retry(encode: Callable[[list[str]], np.ndarray], texts: list[str]) -> np.ndarray:
    """Encode; on failure halve the batch, and raise only when a single text fails."""
    try:
        return np.asarray(encode(texts), dtype=np.float32)
    except Exception:
        if len(texts) <= 1:
            raise
        half = len(texts) // 2
        return np.concatenate([encode_with_retry(encode, texts[:half]), encode_with_retry(encode, texts[half:])])


def encode_or_report(encode: Callable[[list[str]], np.ndarray], texts: list[str]) -> tuple[list, list]:
    """Vectors and errors, one of each per text: a failing batch is halved down to the texts that fail, which have an error."""
    try:
        return list(np.asarray(encode(texts), dtype=np.float32)), [None] * len(texts)
    except Exception as error:
        if len(texts) <= 1:
            return [None] * len(texts), [f"{type(error).__name__}: {error}"] * len(texts)
        half = len(texts) // 2
        left, right = encode_or_report(encode, texts[:half]), encode_or_report(encode, texts[half:])
        return left[0] + right[0], left[1] + right[1]


class FunctionEmbedder:
    """Any Python encoder: `load()` runs once per task and returns list-of-texts -> matrix.

    Vectors are L2-normalised. Rows stream through in Arrow batches. With keep_errors a text that the encoder fails on has
    no embedding but its error in the column `error` (see failed_rows); without, it fails the job.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 64, keep_errors: bool = False):
        self.load, self.batch_size, self.keep_errors = load, batch_size, keep_errors

    def fingerprint(self) -> str:
        """The loader's pickled code and what it closes over."""
        return hashlib.md5(cloudpickle.dumps(self.load)).hexdigest()

    def embed(self, df: DataFrame, text_col: str) -> DataFrame:
        load, size, keep = self.load, self.batch_size, self.keep_errors
        added = [T.StructField("embedding", T.ArrayType(T.FloatType()))] + [T.StructField("error", T.StringType())] * keep
        schema = T.StructType([*df.schema.fields, *added])

        def unit(vector):
            length = np.linalg.norm(vector)
            return vector / length if length > 0 else np.zeros_like(vector)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = load()
            for pdf in batches:
                for start in range(0, len(pdf), size):
                    part = pdf.iloc[start:start + size]
                    texts = part[text_col].fillna("").tolist()
                    vectors, errors = encode_or_report(encode, texts) if keep else (list(encode_with_retry(encode, texts)), None)
                    part = part.assign(embedding=[None if v is None else unit(v) for v in vectors])
                    yield part.assign(error=errors) if keep else part

        return df.mapInPandas(run, schema)


def failed_rows(rows: DataFrame, id_col: str, stage: str) -> DataFrame:
    """(id, stage, error) of the rows that a stage which keeps errors failed on."""
    return rows.where(F.col("error").isNotNull()).select(F.col(id_col).alias("id"), F.lit(stage).alias("stage"), "error")
