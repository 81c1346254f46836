"""Paths of several hops and cycles over relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Edge, Graph
from ..functions.work import written
from ..plans.query import QueryError, hops_of

Way = tuple[Edge, bool]


def ways(graph: Graph, type_: str | None, direction: str | None) -> list[Way]:
    """Relationships of a type with whether they are walked from source to target."""
    edges = [e for e in graph.edges if type_ is None or e.type == type_]
    return [(e, True) for e in edges if direction != "in"] + [(e, False) for e in edges if direction != "out"]


def ends(way: Way) -> tuple[str, str]:
    e, out = way
    return (e.src, e.dst) if out else (e.dst, e.src)


def plan(all_ways: list[Way], low: int, high: int, from_labels: set[str] | None, to_labels: set[str] | None) -> list[list[Way]]:
    """For each step the ways that can lie on a path of low..high hops between the labels; labels alone decide."""
    labels = {x for w in all_ways for x in ends(w)}
    ahead = [set(labels if from_labels is None else from_labels)]
    back = [set(labels if to_labels is None else to_labels)]
    for _ in range(high):
        ahead.append({ends(w)[1] for w in all_ways if ends(w)[0] in ahead[-1]})
        back.append({ends(w)[0] for w in all_ways if ends(w)[1] in back[-1]})
    return [
        [w for w in all_ways if ends(w)[0] in ahead[n - 1] and any(ends(w)[1] in back[left] for left in range(max(0, low - n), high - n + 1))]
        for n in range(1, high + 1)
    ]


def steps(graph: Graph, some: list[Way], numbered: bool = False) -> DataFrame | None:
    """a and b, one row for each way to walk; ``numbered`` adds eid, which tells relationships apart, parallel ones too."""
    rows = []
    for e, out in some:
        df = graph.edge_rows(e).select("src", "dst")
        if numbered:
            n = F.lit(1)
            if e.df is not None:
                n = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.lit(0)))
            df = df.withColumn("eid", F.xxhash64("src", "dst", F.lit(e.type), n))
        df = df.select(F.col("src" if out else "dst").alias("a"), F.col("dst" if out else "src").alias("b"), *(["eid"] if numbered else []))
        # a loop is one way, whatever the direction
        rows.append(df.where("a <> b") if not out and (e, True) in some else df)
    return reduce(DataFrame.unionByName, rows) if rows else None


def reach(graph: Graph, starts: DataFrame, hops, type_: str | None = None, direction: str | None = None, from_labels: set[str] | None = None, to_labels: set[str] | None = None) -> DataFrame:
    """start, node and hops: the nodes at the ends of paths of min..max hops from ``starts`` (a column of ids, start).

    A path never walks a relationship twice. Where min is 1, a node is reached by some such path within max hops just
    if it is by a shortest walk, so each step keeps new pairs of start and node alone, and rows grow with what is
    reached. For a larger min, paths carry the relationships they walked. Labels at both ends, where they are known,
    leave out relationships that can't lie on a path. Each step is written, so that no step is worked out twice.
    """
    low, high = hops if isinstance(hops, tuple) else hops_of(hops)
    by_step = plan(ways(graph, type_, direction), low, high, from_labels, to_labels)
    returns = from_labels is None or to_labels is None or bool(from_labels & to_labels)
    none = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).where(F.lit(False))
    if low > 1:
        return _paths(graph, starts, by_step, low, high, none).select("start", "node", "hops").distinct()
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen, out = frontier, none
    for n, some in enumerate(by_step, 1):
        walk = steps(graph, some)
        if walk is None:
            break
        frontier = written(frontier.join(walk, frontier.node == walk.a).select("start", F.col("b").alias("node")).distinct(), "frontier")
        if returns and direction is not None:  # a start may be reached again; undirected ways back need their own path
            out = out.unionByName(frontier.where("start = node").withColumn("hops", F.lit(n)))
        if n > 1 or returns:
            frontier = written(frontier.join(seen, ["start", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
        out = out.unionByName(frontier.withColumn("hops", F.lit(n)))
    if returns and direction is None:
        out = out.unionByName(_closed(graph, starts, by_step, 1, high, none))
    return out.groupBy("start", "node").agg(F.min("hops").alias("hops"))


def _paths(graph: Graph, starts: DataFrame, by_step: list[list[Way]], low: int, high: int, none: DataFrame, closed: bool = False) -> DataFrame:
    """One row a path, with the relationships it walked; of closed paths alone, those that are back at the start."""
    at, out = starts.select("start", F.col("start").alias("node"), F.array().cast("array<long>").alias("eids")).distinct(), none
    for n, some in enumerate(by_step, 1):
        walk = steps(graph, some, numbered=True)
        if walk is None:
            break
        at = at.join(walk, at.node == walk.a).where(~F.array_contains("eids", F.col("eid")))
        at = written(at.select("start", F.col("b").alias("node"), F.concat("eids", F.array("eid")).alias("eids")), "paths")
        if n >= low:
            out = out.unionByName(at.select("start", "node", F.lit(n).alias("hops")))
        if closed and low <= n:  # the first way back is enough
            done = at.where("start = node").select("start").distinct()
            at = at.join(done, "start", "left_anti")
    return out


def _closed(graph: Graph, starts: DataFrame, by_step: list[list[Way]], low: int, high: int, none: DataFrame) -> DataFrame:
    return _paths(graph, starts, by_step, low, high, none, closed=True).where("start = node").groupBy("start", "node").agg(F.min("hops").alias("hops"))


def trimmed(walk: DataFrame, rounds: int) -> DataFrame:
    """Directed steps without those from a node that none leads to or to one that leads nowhere, some rounds of it."""
    for _ in range(rounds):
        walk = walk.join(walk.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        walk = written(walk.join(walk.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "steps")
    return walk


def cycles(graph: Graph, starts: DataFrame, hops, type_: str | None = None, direction: str | None = None, labels: set[str] | None = None) -> DataFrame:
    """start: the ids of ``starts`` that lie on a closed path of at least two hops."""
    if hops is None:
        raise QueryError("$cycle needs hops")
    low, high = hops_of(hops, 2)
    by_step = plan(ways(graph, type_, direction), low, high, labels, labels)
    none = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).where(F.lit(False))
    if direction is None or low > 2:
        return _closed(graph, starts, by_step, low, high, none).select("start").distinct()
    # directed from two hops on: the shortest closed walk from a node repeats no relationship
    some = [w for w in ways(graph, type_, direction) if any(w in s for s in by_step)]
    walk = steps(graph, some)
    if walk is None:
        return none.select("start")
    walk = trimmed(written(walk.where("a <> b").distinct(), "steps"), 2)
    frontier, out = starts.select("start", F.col("start").alias("node")).distinct(), none.select("start")
    for n in range(1, high + 1):
        frontier = written(frontier.join(walk, frontier.node == walk.a).select("start", F.col("b").alias("node")).distinct(), "frontier")
        out = out.unionByName(frontier.where("start = node").select("start")) if n >= 2 else out
        back = frontier.where("start = node").select("start")
        frontier = frontier.join(back, "start", "left_anti")  # the first way back is enough
    return out.distinct()
