"""Helpers shared by the text operators: shared scratch tables and text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space, as the text contracts define it, and its complement.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, set here only where the session has none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation. ``options``: the writer's."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int,
                    id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled documents, drawn by a hash of the id: the training bound of a classifier.

    The drawn label rows are broadcast: their number is the bound itself.
    """
    picked = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & keep)
              .groupBy(id_col).agg(F.max(label).alias("y"))
              .orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows)
              .select(F.col(id_col).alias("_id"), F.col("y").cast("int").alias("y")))
    return docs.join(F.broadcast(picked), docs[id_col] == picked["_id"]).drop("_id")


CARRIED = "carried_columns"


def carry(docs: DataFrame, named: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``named`` packed into one, and the way back: no name of theirs can clash with an operator's own.

    The way back returns the columns of ``docs`` in their order.
    """
    rest = [c for c in docs.columns if c not in named]
    if not rest:
        return docs, lambda out: out.select(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in named],
                         F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias(CARRIED))
    return packed, lambda out: out.select(*[F.col(f"`{c}`") if c in named else F.col(CARRIED)[f"c{rest.index(c)}"].alias(c) for c in docs.columns])
