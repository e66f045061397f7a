"""Fixed schemas of the tables that stages exchange."""

from pyspark.sql import types as T

CSV_CORPUS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

PHRASE_REPORT = T.StructType([
    T.StructField("phrase", T.StringType()),
    T.StructField("total_frequency", T.LongType()),
    T.StructField("hate_count", T.LongType()),
    T.StructField("non_hate_count", T.LongType()),
    T.StructField("hate_ratio", T.DoubleType()),
    T.StructField("hate_indicator", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("written_at", T.TimestampType()),
])
