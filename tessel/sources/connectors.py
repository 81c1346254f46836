"""Rows of external tables and collections on their way to records; changes arrive as streams (see streaming)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("postgres", "mongodb")


def jdbc_snapshot(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table through JDBC, read in parallel where a numeric column and its bounds are known."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def camel(name: str) -> str:
    head, *rest = [w for w in re.split(r"[_\s-]+", name) if w]
    return head[0].lower() + head[1:] + "".join(w[:1].upper() + w[1:] for w in rest)


def singular(name: str) -> str:
    if name.endswith("ies"):
        return name[:-3] + "y"
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name


def entity_label(table: str, labels: dict[str, str] | None = None, singularize: bool = True) -> str:
    """The label of a table: from a map, or its name, in the singular, in capitals."""
    name = (labels or {}).get(table)
    return name or (singular(table) if singularize else table).upper()


def transform(df: DataFrame, ignore: list[str] = (), hoist: list[str] = (), separator: str | None = None, camel_case: bool = False, key: list[str] | None = None) -> DataFrame:
    """Leaves columns out, lifts fields of structs to the top, flattens the other structs with a separator, renames.

    With ``key``, a column __key joins the key's values.
    """
    if key:
        df = df.withColumn("__key", F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    df = df.drop(*ignore)
    shown = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType) and f.name in hoist:
            shown += [F.col(f"{f.name}.{x.name}").alias(x.name) for x in f.dataType]
        elif isinstance(f.dataType, T.StructType) and separator is not None:
            shown += _flat(f.name, f.name, f.dataType, separator)
        else:
            shown.append(F.col(f.name))
    out = df.select(*shown)
    return out.toDF(*[c if c.startswith("__") else camel(c) for c in out.columns]) if camel_case else out


def _flat(path: str, name: str, t: T.StructType, separator: str) -> list:
    out = []
    for f in t:
        p, n = f"{path}.{f.name}", f"{name}{separator}{f.name}"
        out += _flat(p, n, f.dataType, separator) if isinstance(f.dataType, T.StructType) else [F.col(p).alias(n)]
    return out
