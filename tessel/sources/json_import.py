"""Nested JSON to record tables and relationships by level, without a loop over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import DEFAULT_TYPE, ID, Edge, Graph
from ..functions.values import skip_empty, skip_empty_array
from ..functions.work import new_folder
from ..operators.records import upsert
from .csv_files import infer_all
from ..plans.query import QueryError


def needs_label(data) -> bool:
    """Whether JSON data has no labels of its own: a list, an empty object, or an object with a plain value."""
    return not isinstance(data, dict) or not data or any(not isinstance(v, dict) and not (isinstance(v, list) and v and all(isinstance(x, dict) for x in v)) for v in data.values())


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One object a line; a line that isn't one fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A file of one object or a list of objects."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_text(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A file of lines, each an object, or of one JSON value over several lines; a byte order mark is left out.

    One pass over the lines tells which: if any line is an object by itself they all must be, and a wrong one raises.
    """
    raw = spark.read.text(path)
    mark = F.col("value").startswith("\ufeff")
    text = raw.select(F.trim(F.when(mark, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))).alias("value")).where("value <> ''")
    whole = F.try_parse_json("value").isNotNull()
    n = text.agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(whole & F.col("value").startswith("{"), 1)).alias("objects"), F.count(F.when(whole, 1)).alias("whole"), F.min(F.when(~whole, F.substring("value", 1, 60))).alias("bad")).first()
    if not raw.where(mark).isEmpty():
        path = new_folder(spark, "json")
        (text if n.objects == n.lines else text.coalesce(1)).write.text(path)
    if n.objects and n.objects == n.lines:
        return read_json_lines(spark, path, schema)
    if n.objects > 1 and n.whole < n.lines and n.objects >= n.lines / 2:
        raise QueryError(f"a line is no JSON object: {n.bad}")
    return read_json(spark, path, schema)


def is_complex(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType))


def flatten(df: DataFrame, label: str, root_id: Column, relationship: str = DEFAULT_TYPE, upper: bool = False, drop_empty: bool = False) -> Graph:
    """Records by label and relationships from parent to child.

    Objects and lists of objects become records labelled by their key, everything else properties. Ids of children
    are the parent's id, the key and the place in the list, so that a second run gives the same. A root without
    plain values and with at most one complex child is skipped, and its children are roots.
    """
    graph = Graph(df.sparkSession)
    name = str.upper if upper else str

    def add(label: str, records: DataFrame) -> None:
        old = graph.labels.get(label)
        graph.labels[label] = records if old is None else old.unionByName(records, allowMissingColumns=True)

    def level(rows: DataFrame, label: str, root: bool) -> None:
        fields = [f for f in rows.schema if not f.name.startswith("__")]
        plain, deep = [f for f in fields if not is_complex(f.dataType)], [f for f in fields if is_complex(f.dataType)]
        skipped = root and not plain and len(deep) <= 1
        if not skipped:
            values = [_value(f, drop_empty).alias(f.name) for f in plain]
            add(label, rows.select(ID, *values))
        for f in deep:
            child = name(f.name)
            if isinstance(f.dataType, T.ArrayType):
                parts = rows.select(F.col(ID).alias("__parent"), F.posexplode(f.name).alias("__at", "__item"))
                inner = f.dataType.elementType
            else:
                parts = rows.select(F.col(ID).alias("__parent"), F.lit(0).alias("__at"), F.col(f.name).alias("__item")).where("__item IS NOT NULL")
                inner = f.dataType
            parts = parts.where("__item IS NOT NULL").withColumn(ID, F.concat_ws("/", "__parent", F.lit(child), F.col("__at").cast("string")))
            rest = parts.select(ID, *[F.col("__item")[x.name].alias(x.name) for x in inner])
            level(rest, child, False)
            if not skipped:
                pairs = parts.select(F.col("__parent").alias("src"), F.col(ID).alias("dst"))
                graph.edges.append(Edge(relationship, label, child, df=pairs))

    level(df.withColumn(ID, root_id), name(label), True)
    return graph


def merge_into(graph: Graph, new: Graph, merge_by: list[str] | None = None, strategy: str = "append", typed: bool = False) -> Graph:
    """``graph`` with the records and relationships of an import.

    With ``merge_by``, records of a label that has all these keys are merged with those there, nested ones too, and
    relationships follow: a child that is there already is linked by its id of before. ``typed`` makes numbers and
    booleans of text columns where all values are, and marks those of datetimes.
    """
    labels, times, renamed = dict(graph.labels), {k: set(v) for k, v in graph.datetimes.items()}, {}
    for label, df in new.labels.items():
        if typed:
            df, found = infer_all(df, [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != ID])
            times.setdefault(label, set()).update(found)
        old = labels.get(label)
        keys = [k for k in merge_by or [] if k in df.columns]
        if old is None and not keys:
            labels[label] = df
        elif not keys or len(keys) < len(merge_by or []):
            labels[label] = df if old is None else old.unionByName(df, allowMissingColumns=True)
        else:
            labels[label] = upsert(df.where(F.lit(False)) if old is None else old, df, keys, strategy)
            now = labels[label].select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(ID).alias("__now"))
            same = df.select(F.col(ID).alias("__was"), *keys).join(now, [F.col(k) == F.col(f"__k_{k}") for k in keys])
            renamed[label] = same.select("__was", "__now").distinct()

    def moved(pairs: DataFrame, label: str, end: str) -> DataFrame:
        if label not in renamed:
            return pairs
        out = pairs.join(renamed[label], F.col(end) == F.col("__was"), "left")
        return out.withColumn(end, F.coalesce("__now", end)).drop("__was", "__now")

    edges = list(graph.edges)
    for e in new.edges:
        df = moved(moved(e.df, e.src, "src"), e.dst, "dst").select("src", "dst").distinct()
        same = [k for k, x in enumerate(edges) if (x.type, x.src, x.dst) == (e.type, e.src, e.dst) and x.df is not None]
        if same:
            df = edges[same[0]].df.unionByName(df.join(edges[same[0]].df, ["src", "dst"], "left_anti"), allowMissingColumns=True)
            edges[same[0]] = Edge(e.type, e.src, e.dst, df=df)
        else:
            edges.append(Edge(e.type, e.src, e.dst, df=df))
    return Graph(graph.spark, labels, edges, times, graph.keys)


def _value(f: T.StructField, drop_empty: bool) -> Column:
    if drop_empty and isinstance(f.dataType, T.StringType):
        return skip_empty(F.col(f.name))
    if drop_empty and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
        return skip_empty_array(F.col(f.name))
    return F.col(f.name)


def restore_backup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and relationships of a backup: a folder that ``write_backup`` made, or a file {records: [...], relationships: [...]},
    which one task reads."""
    if path.rstrip("/").endswith(".backup"):
        return read_json_lines(spark, f"{path}/records"), read_json_lines(spark, f"{path}/relationships")
    df = spark.read.option("multiLine", True).json(path)
    if not {"records", "relationships"} <= set(df.columns):
        raise QueryError("a backup has records and relationships")
    return df.select(F.inline("records")), df.select(F.inline("relationships"))


def write_backup(records: DataFrame, relationships: DataFrame, path: str) -> None:
    """A folder <name>.backup with JSON lines of records and of relationships, which Spark can split."""
    if not path.rstrip("/").endswith(".backup"):
        raise QueryError("a backup's name ends with .backup")
    records.write.json(f"{path}/records")
    relationships.write.json(f"{path}/relationships")
