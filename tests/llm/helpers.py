from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, texts, sources=None, ids=None):
    """Documents from texts; ids count from 0."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["a"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]
