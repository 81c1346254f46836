"""The methods that users call, over one graph whose tables are replaced by each change."""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import DEFAULT_TYPE, ID, Edge, Graph
from .functions import values
from .operators import discover, edges, paths, records, schema, vectors
from .plans.query import MAX_HOPS, MAX_LIMIT, QueryError, SearchQuery, is_heavy, validate
from .plans.search import labels_histogram, search, total
from .sources import csv_files, json_import


class Store:
    """A graph with records, relationships, properties, labels, ai and query."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.records, self.relationships = Records(self), Relationships(self)
        self.properties, self.labels, self.ai, self.query = Properties(self), Labels(self), Ai(self), Query(self)
        self.patterns = Patterns(self)
        self.held: Graph | None = None

    def begin(self) -> None:
        """Remembers the graph; tables never change in place, so that is all a transaction needs."""
        self.held = self.graph.with_edges()

    def commit(self) -> None:
        self.held = None

    def rollback(self) -> None:
        if self.held is None:
            raise QueryError("no transaction is open")
        self.graph, self.held = self.held, None


class Part:
    def __init__(self, store: Store):
        self.store = store

    @property
    def graph(self) -> Graph:
        return self.store.graph

    def _set(self, label: str, df: DataFrame) -> None:
        """Replaces a label's records; patterns in force follow each change."""
        self.store.graph = self.graph.with_records(label, df)
        self.store.patterns.reapply(label)

    def _edges(self, new: list[Edge]) -> None:
        g = self.graph
        self.store.graph = Graph(g.spark, g.labels, new, g.datetimes, g.keys)

    def _labels_of(self, ids: list[str]) -> dict[str, list[str]]:
        """The ids of records that are there, by label."""
        out: dict[str, list[str]] = {}
        for label in sorted(self.graph.labels):
            mine = [i for i in ids if self.graph.label_of(i) in (None, label)]
            found = self.graph.records(label).where(self.graph.has_id(label, mine)).select(ID).collect() if mine else []
            if found:  # at most as many as were asked for
                out[label] = sorted(r[ID] for r in found)
        return out


class Records(Part):
    def create(self, label: str, data: dict[str, Any]) -> None:
        self.create_many(label, [data])

    def create_many(self, label: str, rows: list[dict[str, Any]], separator: str | None = None, vectors: list[list[dict]] | None = None) -> dict[int, str]:
        """Adds records and gives the id of each by its place. ``separator`` splits texts into lists; ``vectors`` has for each
        row what goes into vector indexes: propertyName, vector and maybe similarityFunction."""
        rows = [{ID: str(uuid.uuid4()), **r} for r in rows]
        new = self.graph.spark.createDataFrame(rows)
        if separator:
            new = new.withColumns({f.name: values.split_values(F.col(f.name), separator) for f in new.schema if isinstance(f.dataType, T.StringType) and f.name != ID})
        old = self.graph.labels.get(label)
        self._set(label, new if old is None else old.unionByName(new, allowMissingColumns=True))
        for row, some in zip(rows, vectors or [], strict=False):
            for v in some:
                self.store.ai.put(label, row[ID], v)
        return {k: r[ID] for k, r in enumerate(rows)}

    def import_json(self, label: str, path: str, merge_by: list[str] | None = None, strategy: str = "append", relationship: str = DEFAULT_TYPE, upper: bool = False, drop_empty: bool = False, typed: bool = True) -> None:
        """Nested objects of a JSON or JSON lines file as records and relationships, merged by keys where these are given."""
        df = json_import.read_json_text(self.graph.spark, path)
        root = F.concat(F.lit(f"{label}/"), F.sha2(F.to_json(F.struct("*")), 256))
        new = json_import.flatten(df, label, root, relationship, upper, drop_empty)
        self.store.graph = json_import.merge_into(self.graph, new, merge_by, strategy, typed)
        self.store.patterns.reapply()

    def import_csv(self, label: str, path: str, merge_by: list[str] | None = None, strategy: str = "append", **how) -> None:
        """Rows of a CSV file as records; numbers and booleans by their values, datetimes marked."""
        df = csv_files.read_csv(self.graph.spark, path, suggest_types=False, **how)
        df = df.withColumn(ID, F.concat(F.lit(f"{label}/"), F.sha2(F.to_json(F.struct("*")), 256)))
        new = Graph(self.graph.spark, {label: df})
        self.store.graph = json_import.merge_into(self.graph, new, merge_by, strategy, typed=True)
        self.store.patterns.reapply(label)

    def export_csv(self, query: dict, path: str) -> None:
        csv_files.write_csv(search(self.graph, query, full_scan=True), path)

    def attach(self, source: str, targets: list[str], type_: str = DEFAULT_TYPE, direction: str = "out") -> None:
        """Links a record with others; a relationship of that type that is there, either way, is replaced."""
        self.detach(source, targets, [type_])
        own = next(iter(self._labels_of([source])), None)
        if own is None:
            raise QueryError(f"no record {source}")
        for label, ids in self._labels_of(targets).items():
            a, b = (own, label) if direction == "out" else (label, own)
            new = self.graph.spark.createDataFrame([(source, i) if direction == "out" else (i, source) for i in ids], "src string, dst string")
            same = [e for e in self.graph.edges if (e.type, e.src, e.dst) == (type_, a, b)]
            old = self.graph.edge_rows(same[0]).drop("type", "src_label", "dst_label") if same else new.where(F.lit(False))
            self._edges([*[e for e in self.graph.edges if e not in same], Edge(type_, a, b, df=old.unionByName(new, allowMissingColumns=True))])

    def detach(self, source: str, targets: list[str], types: list[str] | None = None, direction: str | None = None) -> None:
        """Removes relationships between a record and others, of some types or of all."""
        ids, label = self.graph.spark.createDataFrame([(t,) for t in targets], "id string"), [*self._labels_of([source])]
        others, new = {*self._labels_of(targets)}, []
        for e in self.graph.edges:
            touched = (e.src in label and e.dst in others) or (e.dst in label and e.src in others)
            if touched and (types is None or e.type in types):
                left = edges.detach(self.graph.edge_rows(e), source, ids, types, direction)
                e = Edge(e.type, e.src, e.dst, df=left.drop("type", "src_label", "dst_label"))
            new.append(e)
        self._edges(new)

    def delete_by_id(self, ids: list[str], cascade: bool = False) -> None:
        """Deletes records with their relationships; with ``cascade`` also what outgoing paths reach from them."""
        gone = self.graph.spark.createDataFrame([(i,) for i in ids], f"{ID} string")
        if cascade:
            below = paths.reach(self.graph, gone.select(F.col(ID).alias("start")), (1, MAX_HOPS), None, "out")
            gone = gone.unionByName(below.select(F.col("node").alias(ID))).distinct()
        self._remove(gone, list(self.graph.labels))

    def _remove(self, hits: DataFrame, labels: list[str]) -> None:
        kept = [Edge(e.type, e.src, e.dst, e.on, None if e.df is None else records.delete_edges_of(e.df, hits)) for e in self.graph.edges]
        for label in labels:
            self._set(label, records.delete(self.graph.records(label), hits))
        self._edges(kept)

    def upsert(self, label: str, new: DataFrame, merge_by: list[str] | None = None, strategy: str = "append") -> None:
        old = self.graph.labels.get(label)
        if old is None:
            fields = [f for f in new.schema.fields if f.name != ID]
            old = self.graph.spark.createDataFrame([], T.StructType([T.StructField(ID, T.StringType()), *fields]))
        self._set(label, records.upsert(old, new, merge_by, strategy))

    def find(self, query: dict, **how) -> tuple[DataFrame, DataFrame]:
        """The page and, as one row, the total."""
        return search(self.graph, query, **how), total(self.graph, query)

    def find_by_id(self, id_: str) -> DataFrame:
        label = self.graph.label_of(id_)
        if label is not None:
            return self.graph.scan([label]).where(self.graph.has_id(label, [id_]))
        return self.graph.scan().where(F.col(ID) == id_)

    def find_one(self, query: dict) -> DataFrame:
        return search(self.graph, {**query, "limit": 1})

    def find_uniq(self, query: dict) -> DataFrame:
        if (n := total(self.graph, query).first().total) > 1:
            raise QueryError(f"{n} records match")
        return self.find_one(query)

    def next_page(self, query: dict) -> dict:
        q = SearchQuery.of(dict(query))
        skip, limit = q.page()
        return {**query, "skip": skip + limit, "limit": limit}

    def update(self, label: str, ids: list[str], values: dict[str, Any]) -> None:
        self._set(label, records.patch(self.graph.records(label), ids, values))

    def set(self, label: str, id_: str, values: dict[str, Any]) -> None:
        self._set(label, records.replace_record(self.graph.records(label), id_, values))

    def delete(self, query: dict) -> None:
        hits = search(self.graph, query, full_scan=True).select(ID)
        self._remove(hits, query.get("labels") or list(self.graph.labels))

    def vector_search(self, index: vectors.VectorIndex, query: list[float], **how) -> DataFrame:
        return vectors.vector_search(self.graph, index, query, **how)


class Relationships(Part):
    def create_many(self, source: dict, target: dict, type_: str, direction: str = "out", many_to_many: bool = False, **properties) -> None:
        a, b = (source, target) if direction == "out" else (target, source)
        same = [e for e in self.graph.edges if (e.type, e.src, e.dst) == (type_, a["label"], b["label"])]
        old = self.graph.edge_rows(same[0]).select("src", "dst", "type") if same else self.graph.spark.createDataFrame([], "src string, dst string, type string")
        out = edges.create_many(self.graph, old, source, target, type_, direction, properties, many_to_many)
        rest = [e for e in self.graph.edges if e not in same]
        self._edges([*rest, Edge(type_, a["label"], b["label"], df=out.drop("type"))])

    def delete_many(self, source: dict, target: dict, type_: str, direction: str = "out", many_to_many: bool = False) -> None:
        a, b = (source, target) if direction == "out" else (target, source)
        new = []
        for e in self.graph.edges:
            if (e.type, e.src, e.dst) == (type_, a["label"], b["label"]):
                rows = edges.delete_many(self.graph, self.graph.edge_rows(e), source, target, type_, direction, many_to_many)
                e = Edge(e.type, e.src, e.dst, df=rows.drop("type", "src_label", "dst_label"))
            new.append(e)
        self._edges(new)

    def find(self, **how) -> DataFrame:
        return edges.find(self.graph, self.graph.all_edges(), **how)

    def find_from(self, id_: str, where: dict | None = None, direction: str | None = None, skip: int = 0, limit: int | None = 1000) -> tuple[DataFrame, DataFrame]:
        """Relationships of one record, both ways unless a direction is given, and, as one row, their total."""
        labels, mine = {*self._labels_of([id_])}, None
        for e in self.graph.edges:
            rows = self.graph.edge_rows(e).select("src", "dst", "type", "src_label", "dst_label")
            for own, end, way in ((e.src, "src", "out"), (e.dst, "dst", "in")):
                if own in labels and direction in (None, way):
                    part = edges.find(self.graph, rows.where(F.col(end) == id_), where=where, direction=way, limit=None)
                    mine = part if mine is None else mine.unionByName(part)
        if mine is None:
            mine = edges.find(self.graph, self.graph.all_edges([]), limit=None)
        total_ = mine.select("sourceId", "targetId", "type", "direction").distinct().agg(F.count(F.lit(1)).alias("total"))
        page = mine.orderBy("type", "targetId", "direction").offset(skip)
        return page if limit is None else page.limit(limit), total_


class Properties(Part):
    def find(self, labels: list[str] | None = None, where: dict | None = None) -> DataFrame:
        return schema.find_properties(self.graph, labels, where)

    def find_by_id(self, name: str, type_: str) -> DataFrame:
        """property, type and records over all labels of a property, which its name and type tell."""
        found = schema.find_properties(self.graph).where((F.col("property") == name) & (F.col("type") == type_))
        return found.groupBy("property", "type").agg(F.sum("records").alias("records"))

    def values(self, prop: str, **how) -> DataFrame:
        return schema.property_values(self.graph, prop, **how)

    def delete(self, prop: str) -> None:
        for label in list(self.graph.labels):
            self._set(label, self.graph.records(label).drop(prop))


class Labels(Part):
    def find(self, query: dict) -> DataFrame:
        return labels_histogram(self.graph, query)


class Ai(Part):
    def __init__(self, store: Store):
        super().__init__(store)
        self.indexes = vectors.VectorIndexes()
        self.cache = schema.SchemaCache(time.monotonic)

    def get_schema(self, labels: list[str] | None = None) -> DataFrame:
        return schema.full_schema(self.graph, labels)

    def cached_schema(self, labels: list[str] | None = None, force: bool = False) -> list:
        """The schema's rows, a label each, kept for an hour while no table changes."""
        version = (tuple(labels or ()), tuple(sorted((k, id(v)) for k, v in self.graph.labels.items())), tuple((e.type, e.src, e.dst, id(e.df)) for e in self.graph.edges))
        return self.cache.get(version, lambda: self.get_schema(labels).collect(), force)

    def create_index(self, label: str, prop: str, dimensions: int, similarity: str = "cosine") -> vectors.VectorIndex:
        return self.indexes.create(vectors.VectorIndex(label, prop, dimensions, similarity), self.graph)

    def upsert_vectors(self, index: vectors.VectorIndex, new: DataFrame) -> vectors.VectorIndex:
        """Adds or replaces vectors (record_id, vector) of an index."""
        self.indexes.all[index.signature] = out = vectors.upsert_vectors(self.graph, self.indexes.all[index.signature], new)
        return out

    def put(self, label: str, id_: str, inline: dict) -> None:
        """One inline vector: the index that matches it must be one alone."""
        index = self.indexes.matching(label, inline["propertyName"], len(inline["vector"]), inline.get("similarityFunction"))
        self.upsert_vectors(index, self.graph.spark.createDataFrame([(id_, [float(x) for x in inline["vector"]])], "record_id string, vector array<float>"))

    def index_stats(self, index: vectors.VectorIndex) -> DataFrame:
        return vectors.index_stats(self.graph, self.indexes.all[index.signature])

    def search(self, label: str, prop: str, query: list[float], similarity: str | None = None, **how) -> DataFrame:
        index = self.indexes.matching(label, prop, len(query), similarity)
        if index.vectors is None:
            raise QueryError("the index has no vectors yet")
        return vectors.vector_search(self.graph, index, query, **how)

    def get_schema_markdown(self, labels: list[str] | None = None) -> str:
        return schema.markdown(self.graph, labels)

    def suggest(self) -> list[discover.Candidate]:
        known = {x: {p: self.graph.type_of(x, p) for p in self.graph.properties(x)} for x in self.graph.labels}
        return discover.rank(discover.probe(self.graph, discover.suggest(known)))


class Patterns(Part):
    """Relationships that names suggest and data confirm, and what was decided of them: suggested, active or ignored."""

    def __init__(self, store: Store):
        super().__init__(store)
        self.all: dict[str, tuple[discover.Candidate, str]] = {}

    def list(self, status: str | None = None) -> dict[str, tuple[discover.Candidate, str]]:
        return {k: v for k, v in self.all.items() if status in (None, v[1])}

    def analyze(self) -> dict[str, tuple[discover.Candidate, str]]:
        """Adds what is suggested now; decisions of before stay."""
        g = self.graph
        known = {x: {p: g.type_of(x, p) for p in g.properties(x)} for x in g.labels}
        linked = {(e.src, e.dst) for e in g.edges}
        found = [c for c in discover.suggest(known) + discover.suggest_chains(known) if c.source == c.target or not {(c.source, c.target), (c.target, c.source)} & linked]
        for c in discover.rank(discover.probe(g, found)):
            self.all.setdefault(f"{c.source}.{c.source_key}->{c.target}.{c.target_key}", (c, "suggested"))
        return self.list()

    def approve(self, id_: str) -> None:
        self.all[id_] = (self.all[id_][0], "active")
        self._apply(self.all[id_][0])

    def ignore(self, id_: str) -> None:
        self.all[id_] = (self.all[id_][0], "ignored")

    def delete(self, id_: str, delete_existing: bool = False) -> None:
        c, _ = self.all.pop(id_)
        if delete_existing:
            self._edges([e for e in self.graph.edges if (e.type, e.src, e.dst) != (c.type, c.source, c.target)])

    def reapply(self, label: str | None = None) -> None:
        for c, status in self.all.values():
            if status == "active" and label in (None, c.source, c.target) and {c.source, c.target} <= set(self.graph.labels):
                self._apply(c)

    def _apply(self, c: discover.Candidate) -> None:
        """The pattern's relationships, and no default ones between the same records."""
        self.store.relationships.create_many({"label": c.source, "key": c.source_key}, {"label": c.target, "key": c.target_key}, c.type)
        made = next(e for e in self.graph.edges if (e.type, e.src, e.dst) == (c.type, c.source, c.target))
        new = []
        for e in self.graph.edges:
            if e.type == DEFAULT_TYPE and {e.src, e.dst} == {c.source, c.target} and e.df is not None:
                pairs = made.df.select("src", "dst") if e.src == c.source else made.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
                e = Edge(e.type, e.src, e.dst, df=e.df.join(pairs, ["src", "dst"], "left_anti"))
            new.append(e)
        self._edges(new)


class Query(Part):
    def raw(self, sql: str, **args) -> DataFrame:
        """SQL over the labels as views and the relationships as view edges."""
        for label, df in self.graph.labels.items():
            df.createOrReplaceTempView(label)
        self.graph.all_edges().createOrReplaceTempView("edges")
        return self.graph.spark.sql(sql, args=args)

    def explain(self, query: dict) -> str:
        df = search(self.graph, query)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def validate(self, query: dict) -> list[str]:
        return validate(query, {x: set(self.graph.properties(x)) for x in self.graph.labels})

    @staticmethod
    def is_heavy(query: dict) -> bool:
        return is_heavy(query)

    max_limit = MAX_LIMIT


def connect(spark: SparkSession) -> Store:
    return Store(Graph(spark))
