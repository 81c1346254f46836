"""Operators that make, change, find and remove relationships. Relationship tables have src, dst, type and properties."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ID, Graph, is_array, logical_type
from ..plans.predicates import Property, combine, criteria
from ..plans.query import LOGIC, QueryError
from ..plans.search import search

#: Rows of a key on either side beyond which they are split, so that a cell has about the square of this in pairs.
CELL = 2048


def _side(graph: Graph, side: dict, keyed: bool) -> DataFrame:
    """Ids of one side with its key; list keys give a row for each element."""
    df = search(graph, {"labels": [side["label"]], "where": side.get("where") or {}}, full_scan=True)
    if not keyed:
        return df.select(ID)
    key = side["key"]
    if key not in df.columns:
        raise QueryError(f"{side['label']} has no property {key}")
    value = F.explode(key) if is_array(df, key) else F.col(key)
    return df.select(ID, value.alias("__key")).where(F.col("__key").isNotNull())


def _keyed(graph: Graph, source: dict, target: dict) -> tuple[DataFrame, DataFrame] | None:
    """Both sides of a key join with keys of one type, or None if theirs never match."""
    a, b = _side(graph, source, True), _side(graph, target, True)
    kinds = [df.schema["__key"].dataType for df in (a, b)]
    if logical_type(kinds[0]) != logical_type(kinds[1]):
        return None
    kind = kinds[0] if kinds[0] == kinds[1] else a.select("__key").union(b.select("__key")).schema["__key"].dataType
    key = F.col("__key").cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        key = key + F.lit(0.0).cast(kind)  # a negative zero equals zero in sets too
    return a.withColumn("__key", key), b.withColumn("__key", key)


def _check(source: dict, target: dict, many_to_many: bool) -> bool:
    """Whether the sides are joined by keys."""
    keyed = bool(source.get("key") or target.get("key"))
    if keyed and not (source.get("key") and target.get("key")):
        raise QueryError("both sides need a key")
    if not keyed and not (many_to_many and source.get("where") and target.get("where")):
        raise QueryError("pairs without keys need manyToMany and a where on both sides")
    return keyed


def _rows(side: DataFrame, name: str) -> DataFrame:
    """A row for each record and different key of it, with ``__all``: its keys where it has several, else null."""
    by_id = side.groupBy(F.col(ID).alias(name)).agg(F.collect_set("__key").alias("__k"))
    return by_id.select(name, F.explode("__k").alias("__key"), F.when(F.size("__k") > 1, F.col("__k")).alias("__all"))


def _cells(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__i`` and ``__j``: the pairs of a key with many rows are dealt over a grid of cells, so that no
    task makes all of them. A row of one side goes into one row of its key's grid, one of the other into one column."""
    cuts = [df.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("__key", F.ceil(F.col("n") / CELL).cast("int").alias(n)) for df, n in ((a, "__p"), (b, "__q"))]
    cut = cuts[0].join(cuts[1], "__key", "full")
    out = []
    for df, id_, own, other, at, along in ((a, "src", "__p", "__q", "__i", "__j"), (b, "dst", "__q", "__p", "__j", "__i")):
        df = df.join(cut, "__key", "left")
        df = df.withColumn(at, F.pmod(F.xxhash64(id_), F.coalesce(own, F.lit(1))).cast("int"))
        out.append(df.withColumn(along, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("__p", "__q"))
    return out[0], out[1]


def pairs(graph: Graph, source: dict, target: dict, many_to_many: bool = False) -> DataFrame:
    """src and dst, each pair once: records with an equal key, or all pairs of two filtered sides.

    Keys of different types never match. All pairs need ``many_to_many`` and a where on both sides. Pairs are never
    gathered to be made distinct: each side's rows are, and two records with several keys meet at the least common one.
    """
    keyed = _check(source, target, many_to_many)
    sides = _keyed(graph, source, target) if keyed else None
    if sides is None:
        a, b = (_side(graph, s, False).select(F.col(ID).alias(n)).distinct() for s, n in ((source, "src"), (target, "dst")))
        out = a.crossJoin(b)  # asked for by name, over filtered sides
        if keyed:
            return out.where(F.lit(False))
    else:
        a, b = _cells(_rows(sides[0], "src"), _rows(sides[1], "dst"))
        at = ["__key", "__i", "__j"]
        tasks = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))  # by number: sizes of sides say little about pairs
        out = a.withColumnRenamed("__all", "__a").repartition(tasks, *at).join(b.withColumnRenamed("__all", "__b"), at)
        out = out.where(F.expr("__a IS NULL OR __b IS NULL OR array_min(array_intersect(__a, __b)) = __key")).select("src", "dst")
    if source["label"] == target["label"]:
        out = out.where("src <> dst")
    return out


def create_many(graph: Graph, edges: DataFrame, source: dict, target: dict, type_: str, direction: str = "out", properties: dict[str, Any] | None = None, many_to_many: bool = False) -> DataFrame:
    """``edges`` with one relationship for each pair: new ones are added, and those there get the properties."""
    new = pairs(graph, source, target, many_to_many)
    if direction == "in":
        new = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    props = {k: F.lit(v) for k, v in (properties or {}).items()}
    new = new.withColumns({"type": F.lit(type_), **props})
    keys = ["src", "dst", "type"]
    old = edges.join(new.select(*keys), keys, "left_anti")
    merged = new
    kept = [c for c in edges.columns if c not in new.columns]
    if kept:  # properties that the call doesn't set stay as they were
        merged = new.join(edges.select(*keys, *kept), keys, "left")
    return old.unionByName(merged, allowMissingColumns=True)


def probe(graph: Graph, source: dict, target: dict, limit: int) -> DataFrame:
    """One row, n: the number of pairs, counted up to ``limit``.

    Records are counted by key first. A key whose pairs reach the limit settles it, and only pairs of other keys, each
    with fewer than the limit, are made.
    """
    _check(source, target, False)
    sides = _keyed(graph, source, target)
    if sides is None:
        return graph.spark.range(1).select(F.lit(0).cast("long").alias("n"))
    a, b = (df.distinct() for df in sides)
    counts = a.groupBy("__key").agg(F.count(F.lit(1)).alias("a")).join(b.groupBy("__key").agg(F.count(F.lit(1)).alias("b")), "__key")
    same = source["label"] == target["label"]
    at_least = F.col("a").cast("double") * F.col("b") - (F.least("a", "b") if same else F.lit(0))  # a record is no pair with itself
    enough = counts.where(at_least >= limit).limit(1).select(F.lit(limit).cast("long").alias("n"))
    rest = counts.where(at_least < limit).select("__key")
    found = a.withColumnRenamed(ID, "src").join(rest, "__key", "left_semi").join(b.withColumnRenamed(ID, "dst"), "__key").select("src", "dst")
    if same:
        found = found.where("src <> dst")
    found = found.distinct().limit(limit).agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(enough).agg(F.least(F.sum("n"), F.lit(limit).cast("long")).alias("n"))


def delete_many(graph: Graph, edges: DataFrame, source: dict, target: dict, type_: str, direction: str = "out", many_to_many: bool = False) -> DataFrame:
    """``edges`` without the relationships of a type between the pairs."""
    gone = pairs(graph, source, target, many_to_many)
    if direction == "in":
        gone = gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(gone.withColumn("type", F.lit(type_)), ["src", "dst", "type"], "left_anti")


def delete_between(edges: DataFrame, a: str, b: str, type_: str) -> DataFrame:
    """``edges`` without those of a type between two labels, either way."""
    both = ((F.col("src_label") == a) & (F.col("dst_label") == b)) | ((F.col("src_label") == b) & (F.col("dst_label") == a))
    return edges.where(~(both & (F.col("type") == type_)))


def retype(edges: DataFrame, source: str, target: str, old: str, new: str) -> DataFrame:
    """Relationships of an old type between two labels, either way, become one of a new type from source to target."""
    hit = (F.col("type") == old) & (((F.col("src_label") == source) & (F.col("dst_label") == target)) | ((F.col("src_label") == target) & (F.col("dst_label") == source)))
    turn = hit & (F.col("src_label") != source)
    moved = edges.where(hit).withColumns({
        "src": F.when(turn, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turn, F.col("src")).otherwise(F.col("dst")),
        "type": F.lit(new), "src_label": F.lit(source), "dst_label": F.lit(target),
    })
    return edges.where(~hit).unionByName(moved).dropDuplicates(["src", "dst", "type"])


def attach(edges: DataFrame, source: str, targets: DataFrame, type_: str, direction: str = "out") -> DataFrame:
    """Links a record with each of ``targets`` (column id); one of that type that is there, either way, is replaced."""
    new = targets.select(F.lit(source).alias("src"), F.col("id").alias("dst"), F.lit(type_).alias("type")).distinct()
    if direction == "in":
        new = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return detach(edges, source, targets, [type_]).unionByName(new, allowMissingColumns=True)


def detach(edges: DataFrame, source: str, targets: DataFrame, types: list[str] | None = None, direction: str | None = None) -> DataFrame:
    """``edges`` without those between a record and ``targets`` of the types, or of any type."""
    ids = targets.select(F.col("id").alias("__id")).distinct()
    typed = F.col("type").isin(types) if types else F.lit(True)
    other = F.when((F.col("src") == source) & typed & F.lit(direction != "in"), F.col("dst"))
    back = F.when((F.col("dst") == source) & typed & F.lit(direction != "out"), F.col("src"))
    e = edges.withColumns({"__a": other, "__b": back})
    e = e.join(ids, F.col("__a") == F.col(ID), "left_anti").join(ids, F.col("__b") == F.col(ID), "left_anti")
    return e.drop("__a", "__b")


def edge_where(df: DataFrame, where: dict) -> Column:
    """A test on relationships: ``type`` and properties, with the operators and logic of records."""
    parts = []
    for key, value in where.items():
        if key in LOGIC:
            members = value if isinstance(value, list) else [{k: v} for k, v in value.items()]
            parts.append(combine(key, [edge_where(df, m) for m in members]))
            continue
        known = key in df.columns
        kind = logical_type(df.schema[key].dataType) if known else None
        column = F.col(key) if known else F.lit(None)
        parts.append(criteria(Property(column, known and is_array(df, key), kind, kind == "datetime"), value))
    return combine("$and", parts)


def find(graph: Graph, edges: DataFrame, source: dict | None = None, target: dict | None = None, where: dict | None = None, direction: str = "out",
         order_by: dict | None = None, skip: int = 0, limit: int | None = 1000) -> DataFrame:
    """sourceId, sourceLabel, targetId, targetLabel, type, direction and properties of relationships that match."""
    e = edges.where(edge_where(edges, where)) if where else edges
    if direction == "in":
        turned = {"src": "dst", "dst": "src", "src_label": "dst_label", "dst_label": "src_label"}
        e = e.select(*[F.col(c).alias(turned.get(c, c)) for c in e.columns])
    for side, column in ((source, "src"), (target, "dst")):
        if side:
            if side.get("labels"):
                e = e.where(F.col(f"{column}_label").isin(side["labels"]))
            if side.get("where"):
                ids = search(graph, {"labels": side.get("labels") or [], "where": side["where"]}, full_scan=True).select(F.col(ID).alias("__match"))
                e = e.join(ids, F.col(column) == F.col("__match"), "left_semi")
    props = [c for c in edges.columns if c not in ("src", "dst", "type", "src_label", "dst_label")]
    out = e.select(F.col("src").alias("sourceId"), F.col("src_label").alias("sourceLabel"), F.col("dst").alias("targetId"), F.col("dst_label").alias("targetLabel"), "type", F.lit(direction).alias("direction"), *props)
    if order_by:
        keys = [F.col(k).desc_nulls_first() if w == "desc" else F.col(k).asc_nulls_last() for k, w in order_by.items()]
        out = out.orderBy(*keys, "sourceId", "targetId", "type")
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)
