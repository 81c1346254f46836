"""What labels, properties and relationships there are, and which values properties have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ID, LABEL, Graph, is_array
from ..plans.search import search


def label_counts(graph: Graph, labels: list[str] | None = None) -> DataFrame:
    """label and records, most first."""
    parts = [graph.records(x).agg(F.lit(x).alias("label"), F.count(F.lit(1)).alias("records")) for x in labels or sorted(graph.labels)]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("records"), "label")


def property_counts(graph: Graph, label: str) -> DataFrame:
    """property, type and records of a label, in one pass over its columns."""
    df, props = graph.records(label), graph.properties(label)
    counted = df.agg(*[F.count(p).alias(p) for p in props])
    rows = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(graph.type_of(label, p)).alias("type"), F.col(p).alias("records")) for p in props])
    return counted.select(F.inline(rows)).where("records > 0")


def property_stats(graph: Graph, label: str) -> DataFrame:
    """property, type, isArray, min and max (as texts) of numbers and datetimes, in one pass."""
    df, rows, aggs = graph.records(label), [], []
    for p in graph.properties(label):
        kind = graph.type_of(label, p)
        if kind not in ("number", "datetime"):
            continue
        array = is_array(df, p)
        low, high = (F.array_min(p), F.array_max(p)) if array else (F.col(p), F.col(p))
        aggs += [F.min(low).alias(f"lo_{p}"), F.max(high).alias(f"hi_{p}")]
        rows.append(F.struct(F.lit(p).alias("property"), F.lit(kind).alias("type"), F.lit(array).alias("isArray"), F.col(f"lo_{p}").cast("string").alias("min"), F.col(f"hi_{p}").cast("string").alias("max")))
    if not rows:
        return df.sparkSession.createDataFrame([], "property string, type string, isArray boolean, min string, max string")
    return df.agg(*aggs).select(F.inline(F.array(*rows))).where("min IS NOT NULL")


def samples(graph: Graph, label: str, prop: str, records: int = 100, values: int = 10) -> DataFrame:
    """Up to some distinct values from a property's first records by id; a report, not a statistic."""
    df = graph.records(label).where(F.col(prop).isNotNull())
    first = df.orderBy(ID).limit(records).select(F.explode(prop).alias("value") if is_array(df, prop) else F.col(prop).alias("value"))
    return first.distinct().orderBy("value").limit(values)


def _values(graph: Graph, prop: str, labels: list[str] | None, where: dict | None, pattern: str | None) -> DataFrame:
    df = search(graph, {"labels": labels or [x for x in sorted(graph.labels) if prop in graph.properties(x)], "where": where or {}}, full_scan=True)
    rows = df.select(ID, F.explode(prop).alias("value") if is_array(df, prop) else F.col(prop).alias("value")).where("value IS NOT NULL")
    return rows.where(F.col("value").cast("string").rlike(f"(?i).*{pattern}.*")) if pattern else rows


def property_values(graph: Graph, prop: str, labels: list[str] | None = None, where: dict | None = None, query: str | None = None, order: str = "asc", skip: int = 0, limit: int | None = None) -> DataFrame:
    """value: distinct values, those of lists each; min and max over all are in columns of that name."""
    values = _values(graph, prop, labels, where, query)
    ends = values.agg(F.min("value").alias("min"), F.max("value").alias("max"))
    out = values.select("value").distinct()
    out = out.orderBy(F.desc("value") if order == "desc" else F.asc("value"))
    out = out.offset(skip) if skip else out
    return (out if limit is None else out.limit(limit)).crossJoin(F.broadcast(ends))  # ends is one row


def facets(graph: Graph, prop: str, labels: list[str] | None = None, where: dict | None = None, query: str | None = None) -> DataFrame:
    """value and records that have it."""
    return _values(graph, prop, labels, where, query).groupBy("value").agg(F.count_distinct(ID).alias("records"))


def find_properties(graph: Graph, labels: list[str] | None = None, where: dict | None = None) -> DataFrame:
    """label, property, type and records among records that match a where."""
    parts = []
    for label in labels or sorted(graph.labels):
        df = search(graph, {"labels": [label], "where": where or {}}, full_scan=True) if where else graph.records(label)
        parts.append(property_counts(graph.with_records(label, df.drop(LABEL)), label).select(F.lit(label).alias("label"), "property", "type", "records"))
    return reduce(DataFrame.unionByName, parts)


def relationship_counts(graph: Graph) -> DataFrame:
    """label, direction, type, other and n: each kind of relationship from both ends; within one label once, as out."""
    none = graph.spark.createDataFrame([], "n long, src_label string, type string, dst_label string")
    parts = [graph.edge_count(e).select("n", F.lit(e.src).alias("src_label"), F.lit(e.type).alias("type"), F.lit(e.dst).alias("dst_label")) for e in graph.edges]
    n = reduce(DataFrame.unionByName, parts, none).groupBy("src_label", "type", "dst_label").agg(F.sum("n").alias("n")).where("n > 0")
    out = n.select(F.col("src_label").alias("label"), F.lit("out").alias("direction"), "type", F.col("dst_label").alias("other"), "n")
    back = n.where("src_label <> dst_label").select(F.col("dst_label").alias("label"), F.lit("in").alias("direction"), "type", F.col("src_label").alias("other"), "n")
    return out.unionByName(back)


def edge_properties(edges: DataFrame) -> DataFrame:
    """property, n, min and max (as numbers where all are, else as texts) of relationship properties, in one pass."""
    props = [c for c in edges.columns if c not in ("src", "dst", "type", "src_label", "dst_label")]
    aggs = [a for p in props for a in (F.count(p).alias(f"n_{p}"), F.min(p).cast("string").alias(f"lo_{p}"), F.max(p).cast("string").alias(f"hi_{p}"))]
    rows = [F.struct(F.lit(p).alias("property"), F.col(f"n_{p}").alias("n"), F.col(f"lo_{p}").alias("min"), F.col(f"hi_{p}").alias("max")) for p in props]
    return edges.agg(*aggs).select(F.inline(F.array(*rows))).where("n > 0")


def label_summary(graph: Graph, label: str) -> DataFrame:
    """One row: label, records and properties (property, type, records, isArray, min, max), from one pass over the records."""
    df, aggs, rows = graph.records(label), [F.count(F.lit(1)).alias("records")], []
    for p in sorted(graph.properties(label)):
        kind, array = graph.type_of(label, p), is_array(df, p)
        aggs.append(F.count(p).alias(f"n_{p}"))
        low = high = F.lit(None).cast("string")
        if kind in ("number", "datetime"):
            ends = (F.array_min(p), F.array_max(p)) if array else (F.col(p), F.col(p))
            aggs += [F.min(ends[0]).cast("string").alias(f"lo_{p}"), F.max(ends[1]).cast("string").alias(f"hi_{p}")]
            low, high = F.col(f"lo_{p}"), F.col(f"hi_{p}")
        known = low.isNotNull() & F.lit(array)
        rows.append(F.struct(F.lit(p).alias("property"), F.lit(kind).alias("type"), F.col(f"n_{p}").alias("records"), known.alias("isArray"), low.alias("min"), high.alias("max")))
    kept = F.filter(F.array(*rows), lambda r: r["records"] > 0) if rows else F.lit(None)
    return df.agg(*aggs).select(F.lit(label).alias("label"), "records", kept.alias("properties"))


def full_schema(graph: Graph, labels: list[str] | None = None) -> DataFrame:
    """label, records, properties and relationships, most records first; one pass a label."""
    parts = reduce(DataFrame.unionByName, [label_summary(graph, x) for x in labels or sorted(graph.labels)])
    rels = relationship_counts(graph).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("direction", "other", "type", "n"))).alias("relationships"))
    return parts.join(rels, "label", "left").orderBy(F.desc("records"), "label")


def markdown(graph: Graph, labels: list[str] | None = None, values: int = 5, width: int = 48) -> str:
    """The schema, which has as many rows as there are labels, as a text; with a few values of texts and booleans."""
    out = ["# Schema", ""]
    for row in full_schema(graph, labels).collect():
        out += [f"## {row.label} ({row.records} records)", "", "| property | type | values |", "|---|---|---|"]
        for p in row.properties or []:
            if p.min is not None:
                shown = f"{p.min}..{p.max}"
            elif p.type == "boolean":
                shown = "true, false"
            else:
                shown = ", ".join(str(v.value)[:width] for v in samples(graph, row.label, p.property, values=values).collect())
            out.append(f"| {p.property} | {p.type}{'[]' if p.isArray else ''} | {shown} |")
        for r in row.relationships or []:
            out.append(f"- {'->' if r.direction == 'out' else '<-'} {r.type} {r.other} ({r.n})")
        out.append("")
    return "\n".join(out)


def project_stats(graph: Graph) -> DataFrame:
    """records and properties over all labels."""
    n = label_counts(graph).agg(F.sum("records").alias("records"))
    names = len({(p, graph.type_of(x, p)) for x in graph.labels for p in graph.properties(x)})
    return n.withColumn("properties", F.lit(names).cast("long"))


class SchemaCache:
    """Keeps collected schemas by the version of the data for a time."""

    def __init__(self, clock, ttl: float = 3600.0):
        self.clock, self.ttl, self.held = clock, ttl, {}

    def get(self, version, build, force: bool = False):
        found = self.held.get(version)
        if force or found is None or self.clock() - found[0] > self.ttl:
            found = self.held[version] = (self.clock(), build())
        return found[1]
