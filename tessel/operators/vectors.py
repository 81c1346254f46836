"""Vectors of records: kept in a table of record_id and vector, searched exactly after any filter."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ID, Graph
from ..functions.similarity import cosine, euclidean
from ..plans.query import QueryError
from ..plans.search import search

MAX_DIMENSIONS, DEFAULT_LIMIT = 4096, 20
FUNCTIONS = {"cosine": cosine, "euclidean": euclidean}


@dataclass
class VectorIndex:
    """A property's vectors; ``vectors`` has record_id and vector."""

    label: str
    property: str
    dimensions: int
    similarity: str = "cosine"
    source: str = "external"
    vectors: DataFrame | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.dimensions <= MAX_DIMENSIONS:
            raise QueryError(f"dimensions must be 1 to {MAX_DIMENSIONS}")
        if self.similarity not in FUNCTIONS:
            raise QueryError(f"unknown similarity {self.similarity}")

    @property
    def signature(self) -> tuple:
        return self.label, self.property, self.source, self.similarity, self.dimensions


class VectorIndexes:
    """Indexes by signature; each may be there once."""

    def __init__(self) -> None:
        self.all: dict[tuple, VectorIndex] = {}

    def create(self, index: VectorIndex, graph: Graph | None = None) -> VectorIndex:
        if index.signature in self.all:
            raise QueryError("such an index exists")
        if graph is not None and graph.type_of(index.label, index.property) not in (None, "string"):
            raise QueryError("only properties of texts have an index")
        self.all[index.signature] = index
        return index

    def matching(self, label: str, prop: str, dimensions: int, similarity: str | None = None) -> VectorIndex:
        found = [i for i in self.all.values() if (i.label, i.property, i.dimensions) == (label, prop, dimensions) and similarity in (None, i.similarity)]
        if len(found) != 1:
            raise QueryError("no index matches" if not found else "several indexes match: name the similarity")
        return found[0]

    def delete(self, index: VectorIndex) -> None:
        del self.all[index.signature]


def upsert_vectors(graph: Graph, index: VectorIndex, new: DataFrame) -> VectorIndex:
    """Adds or replaces vectors by record_id; wrong lengths, values that aren't finite and unknown records raise."""
    wrong = F.size("vector") != index.dimensions
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    bad = new.agg(F.count(F.when(wrong, 1)).alias("length"), F.count(F.when(odd, 1)).alias("finite")).first()
    if bad.length or bad.finite:
        raise QueryError(f"{bad.length} vectors have another length, {bad.finite} have values that aren't finite")
    if not new.join(graph.records(index.label), F.col("record_id") == F.col(ID), "left_anti").isEmpty():
        raise QueryError("vectors for unknown records")
    merged = new if index.vectors is None else index.vectors.join(new.select("record_id"), "record_id", "left_anti").unionByName(new)
    return VectorIndex(index.label, index.property, index.dimensions, index.similarity, index.source, merged)


def vector_search(graph: Graph, index: VectorIndex, query: list[float], where: dict | None = None, skip: int = 0, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Records with __score, best first: the where decides first, then all that are left are scored."""
    if len(query) != index.dimensions:
        raise QueryError(f"the query needs {index.dimensions} values")
    df = search(graph, {"labels": [index.label], "where": where or {}}, full_scan=True)
    v = F.array(*[F.lit(float(x)) for x in query])
    scored = df.join(index.vectors, F.col(ID) == F.col("record_id")).withColumn("__score", FUNCTIONS[index.similarity](F.col("vector"), v))
    out = scored.where("__score IS NOT NULL").drop("record_id", "vector").orderBy(F.desc("__score"), ID)
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def index_stats(graph: Graph, index: VectorIndex) -> DataFrame:
    """totalRecords (with the property) and indexedRecords."""
    has = graph.records(index.label).where(F.col(index.property).isNotNull()).select(ID)
    j = has.join(index.vectors.select(F.col("record_id").alias(ID), F.lit(1).alias("one")), ID, "left")
    return j.agg(F.count(F.lit(1)).alias("totalRecords"), F.count("one").alias("indexedRecords"))


def recall(events: DataFrame, facts: DataFrame, vectors: DataFrame, recent: DataFrame, query: list[float], terms: list[str], scope: dict, exclude_session: str | None = None, limit: int = 8) -> DataFrame:
    """id, text and score: events of other sessions and active facts by vector, recent ones by shared terms, best score each.

    events and facts have id, text and the scope's columns (events session, facts active); recent has id and text.
    """
    limit = min(20, max(1, limit))
    for k, v in scope.items():
        events, facts = events.where(F.col(k) == v), facts.where(F.col(k) == v)
    if exclude_session is not None:
        events = events.where(F.col("session") != exclude_session)
    v = F.array(*[F.lit(float(x)) for x in query])
    both = events.select("id", "text").unionByName(facts.where("active").select("id", "text"))
    by_vector = both.join(vectors.select(F.col("record_id").alias("id"), "vector"), "id").select("id", "text", cosine(F.col("vector"), v).alias("score"))
    hits = F.size(F.array_intersect(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(t.lower()) for t in terms])))
    by_terms = recent.select("id", "text", F.least(F.lit(1.0), 0.55 + hits / len(terms) / 2).alias("score")).where("score > 0.55")
    best = by_vector.unionByName(by_terms).groupBy("id").agg(F.max("score").alias("score"), F.first("text").alias("text"))
    return best.orderBy(F.desc("score"), "id").limit(limit)
