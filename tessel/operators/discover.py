"""Relationships that names suggest and data confirm."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Graph
from ..plans.query import QueryError
from . import edges as E


@dataclass(frozen=True)
class Candidate:
    source: str
    source_key: str
    target: str
    target_key: str
    type: str
    confidence: float
    matches: int = 0

    def inverse_of(self, other: Candidate) -> bool:
        return (self.source, self.source_key, self.target, self.target_key) == (other.target, other.target_key, other.source, other.source_key)


def tokens(name: str) -> list[str]:
    """Words of a name: at capitals and at signs, lower-cased, singular by plain rules."""
    words = re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name))
    return [w[:-3] + "y" if w.endswith("ies") and len(w) > 3 else w[:-1] if w.endswith("s") and len(w) > 1 else w for w in map(str.lower, words) if w]


def suggest(schema: dict[str, dict[str, str]], arrays: set[tuple[str, str]] = frozenset()) -> list[Candidate]:
    """Properties whose names hold another label's words and those of one of its keys; schema: label, property, type."""
    out = []
    for source, props in schema.items():
        for prop, kind in props.items():
            if kind in ("boolean", "datetime"):
                continue
            for target, others in schema.items():
                for key, other_kind in others.items():
                    if target != source and other_kind == kind and set(tokens(target)) | set(tokens(key)) <= set(tokens(prop)) and prop != key:
                        out.append(Candidate(source, prop, target, key, f"HAS_{'_'.join(tokens(target)).upper()}", 0.9 if (source, prop) in arrays else 0.86))
    return out


OPPOSITE = ({"from", "to"}, {"source", "target"}, {"sender", "receiver"}, {"parent", "child"}, {"start", "end"}, {"previous", "next"})
GENERIC = {"id", "key", "name", "code", "ref", "value", "type"}


def suggest_chains(schema: dict[str, dict[str, str]]) -> list[Candidate]:
    """Two properties of one label with a word in common and opposite directions, as in toStation and fromStation."""
    out = []
    for label, props in schema.items():
        for a in props:
            for b in props:
                ta, tb = set(tokens(a)), set(tokens(b))
                if a != b and props[a] == props[b] and (shared := (ta & tb) - GENERIC):
                    if any(x != y and x in ta - tb and y in tb - ta for pair in OPPOSITE for x in sorted(pair) for y in pair if x in ("to", "target", "receiver", "child", "end", "next")):
                        out.append(Candidate(label, a, label, b, f"FLOWS_TO_{'_'.join(sorted(shared)).upper()}", 0.82))
    return out


def validate(c: Candidate, schema: dict[str, dict[str, str]], arrays: set[tuple[str, str]] = frozenset(), linked: set[tuple[str, str]] = frozenset()) -> None:
    """Raises unless the labels and keys exist, can be joined, and aren't linked yet."""
    for label, key in ((c.source, c.source_key), (c.target, c.target_key)):
        if key not in schema.get(label, {}):
            raise QueryError(f"{label} has no {key}")
        if schema[label][key] in ("boolean", "datetime"):
            raise QueryError(f"{key} can't be joined")
    if (c.source, c.source_key) in arrays and (c.target, c.target_key) in arrays:
        raise QueryError("two lists can't be joined")
    if {(c.source, c.target), (c.target, c.source)} & set(linked):
        raise QueryError("the labels are linked already")


def rank(candidates: list[Candidate], keep: int = 20) -> list[Candidate]:
    """Best first by confidence and matches; of two inverse ones the better stays."""
    out: list[Candidate] = []
    for c in sorted(candidates, key=lambda c: (-(c.confidence + c.matches / 10_000), c.source, c.source_key, c.target)):
        if not any(c.inverse_of(o) or c == o for o in out):
            out.append(c)
    return out[:keep]


def probe(graph: Graph, candidates: list[Candidate], limit: int = 100) -> list[Candidate]:
    """Candidates with the number of pairs in the data, counted up to a limit; those without any go."""
    out = []
    for c in candidates:  # as many jobs as the schema has candidates
        n = E.probe(graph, {"label": c.source, "key": c.source_key}, {"label": c.target, "key": c.target_key}, limit).first().n
        if n:
            out.append(Candidate(c.source, c.source_key, c.target, c.target_key, c.type, c.confidence, n))
    return out


def apply(graph: Graph, edges: DataFrame, c: Candidate, default: str = "DEFAULT") -> DataFrame:
    """Adds the candidate's relationships and removes default ones between the same records."""
    out = E.create_many(graph, edges, {"label": c.source, "key": c.source_key}, {"label": c.target, "key": c.target_key}, c.type)
    made = out.where(F.col("type") == c.type).select(F.least("src", "dst").alias("__a"), F.greatest("src", "dst").alias("__b")).distinct()
    plain = F.col("type") == default
    kept = out.where(plain).join(made, (F.least("src", "dst") == F.col("__a")) & (F.greatest("src", "dst") == F.col("__b")), "left_anti")
    return out.where(~plain).unionByName(kept)


def signature(schema: dict, candidates: list[Candidate]) -> str:
    """Tells whether a schema and its candidates have changed."""
    return hashlib.sha256(json.dumps([schema, [asdict(c) for c in candidates]], sort_keys=True).encode()).hexdigest()
