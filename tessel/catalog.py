"""Records by label, relationships between them, and the property types that columns alone don't tell."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, LABEL = "__id", "__label"
DEFAULT_TYPE = "DEFAULT"


@dataclass(frozen=True)
class Edge:
    """One relationship type between two labels.

    Either ``on`` names equal columns of the source and target records, as a foreign key does, so that a traversal is
    one equi-join; or ``df`` has src and dst (record ids) and any properties.
    """

    type: str
    src: str
    dst: str
    on: tuple[str, str] | None = None
    df: DataFrame | None = None


@dataclass
class Graph:
    spark: SparkSession
    labels: dict[str, DataFrame] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    #: Columns of strings whose values are datetimes, by label.
    datetimes: dict[str, set[str]] = field(default_factory=dict)
    #: By label the columns that ``make_id`` made its ids from, so that an id can be looked up by column.
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def records(self, label: str) -> DataFrame:
        if label not in self.labels:
            raise KeyError(f"unknown label {label}")
        return self.labels[label]

    def scan(self, labels: list[str] | None = None) -> DataFrame:
        """Records of the labels with their label; several labels, or all, are united by column name."""
        out = None
        for label in labels or sorted(self.labels):
            df = self.records(label).withColumn(LABEL, F.lit(label))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise KeyError("no labels")
        return out

    def has_id(self, label: str, ids: list[str]) -> Column:
        """Whether a record of the label has one of the ids; by its key columns where there are some, which a scan can skip by."""
        test, keys = F.col(ID).isin(ids), self.keys.get(label)
        if keys is None or any(k not in self.records(label).columns for k in keys):
            return test
        kind, parts = self.records(label).schema[keys[0]].dataType, [i[len(label) + 1 :] for i in ids if i.startswith(f"{label}:")]
        first = [p.split(":", 1)[0] if len(keys) > 1 else p for p in parts]
        if isinstance(kind, T.IntegralType):
            first = [int(p) for p in first if p.lstrip("-").isdigit()]
        elif not isinstance(kind, T.StringType) or len(keys) > 1:
            return test
        return F.col(keys[0]).isin(first) & test

    def label_of(self, id_: str) -> str | None:
        """The label that an id names, where ids of it are made from columns."""
        label = id_.split(":", 1)[0]
        return label if label in self.keys else None

    def properties(self, label: str) -> list[str]:
        return [c for c in self.records(label).columns if not c.startswith("__")]

    def type_of(self, label: str, prop: str) -> str | None:
        """string, number, boolean or datetime; None if the label lacks the property."""
        schema = self.records(label).schema
        if prop not in schema.names:
            return None
        if prop in self.datetimes.get(label, ()):
            return "datetime"
        return logical_type(schema[prop].dataType)

    def edge_rows(self, edge: Edge) -> DataFrame:
        """src, dst, type, src_label, dst_label of a relationship, with properties if it has a table."""
        if edge.df is not None:
            df = edge.df
        else:
            a, b = edge.on
            src = self.records(edge.src).select(F.col(ID).alias("src"), F.col(a).alias("__k"))
            dst = self.records(edge.dst).select(F.col(ID).alias("dst"), F.col(b).alias("__k"))
            df = src.join(dst, "__k").drop("__k")
        return df.withColumns({"type": F.lit(edge.type), "src_label": F.lit(edge.src), "dst_label": F.lit(edge.dst)})

    def edge_count(self, edge: Edge) -> DataFrame:
        """One row, n: how many relationships an edge has; equal columns are counted by value and never joined by row."""
        if edge.df is not None:
            return edge.df.agg(F.count(F.lit(1)).alias("n"))
        a, b = edge.on
        src, dst = (self.records(x).groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias(n)) for x, c, n in ((edge.src, a, "n_src"), (edge.dst, b, "n_dst")))
        return src.join(dst, "k").agg(F.coalesce(F.sum(F.col("n_src") * F.col("n_dst")), F.lit(0)).alias("n"))

    def all_edges(self, types: list[str] | None = None) -> DataFrame:
        """src, dst, type and labels of all relationships, or of some types."""
        cols, out = ["src", "dst", "type", "src_label", "dst_label"], None
        for e in self.edges:
            if types is None or e.type in types:
                df = self.edge_rows(e).select(cols)
                out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], ", ".join(f"{c} string" for c in cols))

    def with_records(self, label: str, df: DataFrame) -> Graph:
        return replace(self, labels={**self.labels, label: df})

    def with_edges(self, *edges: Edge) -> Graph:
        return replace(self, edges=[*self.edges, *edges])


def logical_type(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return logical_type(t.elementType)
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def make_id(label: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.concat_ws(":", *[F.col(k) for k in keys]))
