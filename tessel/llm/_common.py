"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space that the operators know.
WS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them again.

    That cuts the lineage, and a lost executor costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one, ``row``: whatever their names, they can't clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``row`` again, some of them with new values."""
    return df.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text: other columns, whatever their names, can't clash with what an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def utf8(text: Column) -> Column:
    """The bytes of a text as they are stored; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; F.lower would also change other letters."""
    return F.translate(text, UPPER, UPPER.lower())


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for joins back to a row: the id with null as lowest, and two hashes of the text.

    Rows alike in both are the same row to every operator here.
    """
    return F.struct(
        F.coalesce(doc_id, F.lit(-(2**63))).alias("id"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )
