"""Changes of records as new DataFrames: create, update, upsert, delete."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ID


def deduplicated(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key: by ``order``, or by its place in ``rows``; of equals in order, the greatest row."""
    ties = [F.col(f"`{f.name}`").desc() for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    if order is None:
        rows = rows.withColumn("__at", F.monotonically_increasing_id())
    last = [F.col("__at").desc()] if order is None else [F.col(order).desc(), *ties]
    w = Window.partitionBy(*keys).orderBy(*last)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__at")


def upsert(current: DataFrame, new: DataFrame, merge_by: list[str] | None = None, strategy: str = "append", order: str | None = None) -> DataFrame:
    """Merges rows by keys, or by all columns that they bring; a null key never matches.

    append sets what a row brings and keeps the rest; rewrite leaves nothing else. New rows need an id column of
    their own, which counts only where no record matches.
    """
    if strategy not in ("append", "rewrite"):
        raise ValueError(f"unknown strategy {strategy}")
    keys = merge_by or [c for c in new.columns if c != ID]
    props = [c for c in new.columns if c != ID and c not in keys]
    with_key = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    matching = deduplicated(new.where(with_key), keys, order)
    unmatched = new.where(f"NOT ({with_key})")
    n = matching.select(*[F.col(c).alias(f"__n_{c}") for c in matching.columns])
    known = [k for k in keys if k in current.columns]
    if len(known) < len(keys):
        return current.unionByName(matching, allowMissingColumns=True).unionByName(unmatched, allowMissingColumns=True)
    on = [F.col(k) == F.col(f"__n_{k}") for k in keys]
    j = current.join(n, on, "full_outer")
    hit, fresh = F.col(f"__n_{keys[0]}").isNotNull(), F.col(ID).isNull()
    out = []
    for c in dict.fromkeys([*current.columns, *new.columns]):
        if c == ID:
            made = F.col(f"__n_{ID}") if ID in new.columns else F.concat(F.lit("new:"), F.sha2(F.concat_ws("\x1f", *[F.col(f"__n_{k}").cast("string") for k in keys]), 256))
            out.append(F.coalesce(F.col(ID), made).alias(ID))
        elif c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"__n_{c}")).alias(c))
        elif c in props:
            old = F.col(c) if c in current.columns else F.lit(None)
            value = F.coalesce(F.col(f"__n_{c}"), old) if strategy == "append" else F.col(f"__n_{c}")
            out.append(F.when(hit, value).otherwise(old).alias(c))
        else:
            out.append((F.when(hit & ~fresh, F.lit(None)).otherwise(F.col(c)) if strategy == "rewrite" else F.col(c)).alias(c))
    return j.select(*out).unionByName(unmatched, allowMissingColumns=True)


def patch(df: DataFrame, ids: list[str] | DataFrame, values: dict[str, Any]) -> DataFrame:
    """Sets properties of some records; others of theirs stay."""
    if isinstance(ids, DataFrame):
        marks = ids.select(F.col(ID), F.lit(True).alias("__hit")).distinct()
        df, hit = df.join(marks, ID, "left"), F.col("__hit").isNotNull()
    else:
        hit = F.col(ID).isin(ids)
    new = {k: F.when(hit, F.lit(v)).otherwise(F.col(k) if k in df.columns else F.lit(None)) for k, v in values.items()}
    return df.withColumns(new).drop("__hit")


def replace_record(df: DataFrame, id_: str, values: dict[str, Any]) -> DataFrame:
    """Gives one record these properties and no others."""
    hit = F.col(ID) == id_
    new = {c: F.when(hit, F.lit(values.get(c))).otherwise(F.col(c)) for c in df.columns if not c.startswith("__")}
    new |= {k: F.when(hit, F.lit(v)) for k, v in values.items() if k not in df.columns}
    return df.withColumns(new)


def delete(df: DataFrame, matches: DataFrame) -> DataFrame:
    """Without the records whose ids ``matches`` has."""
    return df.join(matches.select(ID), ID, "left_anti")


def delete_edges_of(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Without relationships that touch a deleted record."""
    ids = matches.select(F.col(ID).alias("__gone")).distinct()
    return edges.join(ids, F.col("src") == F.col("__gone"), "left_anti").join(ids, F.col("dst") == F.col("__gone"), "left_anti")


def create_unique(df: DataFrame, new: DataFrame, unique: list[str], on_conflict: str = "throw", defaults: dict[str, Any] | None = None) -> DataFrame:
    """Adds rows after defaults; rows that share a unique value with a record raise, replace it, or are left out."""
    for k, v in (defaults or {}).items():
        new = new.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in new.columns else F.lit(v))
    hits = None
    for k in unique:
        found = new.where(F.col(k).isNotNull()).join(df.select(k), k, "left_semi").select(new.columns)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None or on_conflict not in ("throw", "upsert", "skip"):
        raise ValueError("unique fields and a policy of throw, upsert or skip are needed")
    if on_conflict == "throw":
        if not hits.isEmpty():
            raise ValueError(f"a record with the same {' or '.join(unique)} exists")
        return df.unionByName(new, allowMissingColumns=True)
    if on_conflict == "upsert":
        for k in unique:
            df = df.join(new.where(F.col(k).isNotNull()).select(k), k, "left_anti").select(df.columns)
        return df.unionByName(new, allowMissingColumns=True)
    for k in unique:
        new = new.join(df.where(F.col(k).isNotNull()).select(k), k, "left_anti").select(new.columns)
    return df.unionByName(new, allowMissingColumns=True)
