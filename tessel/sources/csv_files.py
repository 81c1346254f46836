"""CSV in, with sanitised headers and inferred types, and CSV out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ID, LABEL
from ..functions.values import inferred_type, to_boolean, to_number


def header_names(names: list[str | None]) -> list[str]:
    """Names that columns can have: trimmed, white space as _, a letter or _ first, blanks numbered, none twice."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        n = re.sub(r"\s+", "_", (n or "").replace("\0", "").strip()) or f"column_{i}"
        n = n if re.match(r"[A-Za-z_]", n) else "_" + n
        base, k = n, 2
        while n in out:
            n, k = f"{base}_{k}", k + 1
        out.append(n)
    return out


def infer(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns become numbers or booleans where all of their values are; one pass tells which."""
    return infer_all(df, columns)[0]


def infer_all(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, set[str]]:
    """As ``infer``, with the columns whose values are all datetimes; these stay texts."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df, set()
    kinds = df.agg(*[F.collect_set(inferred_type(F.col(f"`{c}`"))).alias(c) for c in columns]).first()
    for c in columns:
        if kinds[c] == ["number"]:
            df = df.withColumn(c, to_number(F.col(f"`{c}`")))
        elif kinds[c] == ["boolean"]:
            df = df.withColumn(c, to_boolean(F.col(f"`{c}`")))
    return df, {c for c in columns if kinds[c] == ["datetime"]}


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', escape: str = '"', suggest_types: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV file; rows without any value are left out. Values with line breaks need ``multi_line``, which reads a file in one task."""
    raw = spark.read.options(header=header, sep=delimiter, quote=quote, escape=escape, multiLine=multi_line, inferSchema=False).csv(path)
    df = raw.toDF(*header_names(raw.columns if header else [None] * len(raw.columns)))
    df = df.dropna("all")
    return infer(df) if suggest_types else df


def export_frame(df: DataFrame) -> DataFrame:
    """Ids and labels first, then the rest by name; nulls as empty texts."""
    rest = sorted(c for c in df.columns if not c.startswith("__"))
    lists = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    shown = [c for c in (ID, LABEL) if c in df.columns] + rest
    return df.select(*[F.coalesce(F.to_json(c) if c in lists else F.col(c).cast("string"), F.lit("")).alias(c) for c in shown])


def client_csv(df: DataFrame) -> DataFrame:
    """A result as users see it: without system columns, each value as text."""
    return export_frame(df.select(*[c for c in df.columns if not c.startswith("__")]))


def write_csv(df: DataFrame, path: str) -> None:
    export_frame(df).write.option("header", True).option("escape", '"').csv(path)
