"""The query object, its checks, and the sorting of ``where`` keys into predicates and related records."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DEFAULT_LIMIT, MAX_LIMIT, MAX_HOPS = 100, 1000, 10
LOGIC = ("$and", "$or", "$not", "$nor", "$xor")
COMPARE = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$contains", "$startsWith", "$endsWith", "$exists", "$type")
DATE_PARTS = ("$year", "$month", "$day", "$hour", "$minute", "$second", "$millisecond", "$microsecond", "$nanosecond")
TRAVERSAL = ("$relation", "$alias", "$cycle", "$id")
UNITS = ("day", "week", "month", "quarter", "year", "hour", "minute", "second")
SIZED_UNITS = ("months", "years", "hours", "minutes", "seconds")
MATH = ("$add", "$subtract", "$multiply", "$divide")
AGGREGATES = ("$sum", "$avg", "$count", "$min", "$max", "$collect")
OPERATORS = (*AGGREGATES, *MATH, "$ref", "$timeBucket", "$cosine", "$euclidean")


class QueryError(ValueError):
    """The query can't be read."""


@dataclass
class SearchQuery:
    labels: list[str] = field(default_factory=list)
    where: dict = field(default_factory=dict)
    select: dict | None = None
    aggregate: dict | None = None
    groupBy: list[str] = field(default_factory=list)  # noqa: N815  the name users write
    orderBy: dict | str | None = None  # noqa: N815
    skip: int = 0
    limit: int | None = None
    id: str | None = None

    @classmethod
    def of(cls, query: dict | SearchQuery) -> SearchQuery:
        if isinstance(query, SearchQuery):
            return query
        if unknown := set(query) - set(cls.__dataclass_fields__):
            raise QueryError(f"unknown keys {sorted(unknown)}")
        q = cls(**query)
        if q.select and q.aggregate:
            raise QueryError("select and aggregate can't be used together")
        if isinstance(q.groupBy, str):
            q.groupBy = [q.groupBy]
        q.where = normalized(q.where or {})
        return q

    def page(self) -> tuple[int, int]:
        """Rows to skip and to return; what is out of range falls back to the default."""
        limit = self.limit if self.limit is not None and 1 <= self.limit <= MAX_LIMIT else DEFAULT_LIMIT
        return max(0, self.skip or 0), limit


def normalized(where: Any) -> Any:
    """Logical operators with an object become those with a list of its members."""
    if isinstance(where, list):
        return [normalized(x) for x in where]
    if not isinstance(where, dict):
        return where
    out = {}
    for k, v in where.items():
        if k in LOGIC and isinstance(v, dict):
            v = [v] if all(x in (*COMPARE, *DATE_PARTS) for x in v) else [{x: y} for x, y in v.items()]
        out[k] = normalized(v)
    return out


def is_criteria(value: Any) -> bool:
    """Whether a key's value speaks of a property: a literal, or an object of operators alone."""
    if not isinstance(value, dict):
        return True
    if not value or any(k in TRAVERSAL for k in value):
        return False
    for k, v in value.items():
        if k in LOGIC:
            if not all(is_criteria(x) for x in (v if isinstance(v, list) else [v])):
                return False
        elif k not in COMPARE and k not in DATE_PARTS:
            return False
    return True


def hops_of(spec: Any, least: int = 1) -> tuple[int, int]:
    """Least and most hops; n stands for exactly n."""
    if isinstance(spec, bool) or not isinstance(spec, (int, dict)):
        raise QueryError("hops must be a number or {min, max}")
    if isinstance(spec, int):
        low = high = spec
    else:
        low, high = spec.get("min", 1), spec.get("max")
        if high is None:
            raise QueryError("hops need a max")
    if not (isinstance(low, int) and isinstance(high, int)) or low < 1 or low > high:
        raise QueryError(f"hops {low}..{high} are not a range")
    if high > MAX_HOPS:
        raise QueryError(f"at most {MAX_HOPS} hops")
    if high < least:
        raise QueryError(f"at least {least} hops")
    return max(low, least), high


def relation_of(spec: Any) -> tuple[str | None, str | None, tuple[int, int] | None]:
    """Type, direction (in, out or None for both) and hops."""
    if spec is None:
        return None, None, None
    if isinstance(spec, str):
        return spec, None, None
    if not isinstance(spec, dict):
        raise QueryError("$relation must be a type or an object")
    hops = hops_of(spec["hops"]) if spec.get("hops") is not None else None
    direction = spec.get("direction")
    if hops and direction not in (None, "in", "out"):
        raise QueryError(f"unknown direction {direction}")
    return spec.get("type"), direction if direction in ("in", "out") else None, hops


def has_aggregate(expr: Any) -> bool:
    if isinstance(expr, dict):
        return any(k in AGGREGATES or has_aggregate(v) for k, v in expr.items() if k != "$timeBucket")
    return isinstance(expr, list) and any(map(has_aggregate, expr))


def refs_of(expr: Any) -> set[str]:
    """Select keys that an expression takes through $ref."""
    if isinstance(expr, dict):
        return set().union(*({v} if k == "$ref" else refs_of(v) for k, v in expr.items()), set())
    return set().union(*map(refs_of, expr), set()) if isinstance(expr, list) else set()


def layers(select: dict) -> list[list[str]]:
    """Select keys in an order in which each comes after those it refers to."""
    left, done, out = dict(select), set(), []
    for k, e in select.items():
        if missing := refs_of(e) - set(select):
            raise QueryError(f"{k} refers to unknown {sorted(missing)}")
    while left:
        now = [k for k, e in left.items() if refs_of(e) <= done]
        if not now:
            raise QueryError(f"circular $ref among {sorted(left)}")
        out.append(now)
        done |= set(now)
        for k in now:
            del left[k]
    return out


def from_legacy(aggregate: dict) -> dict:
    """The select form of the older aggregate form, where it has one."""
    out = {}
    for key, a in aggregate.items():
        if isinstance(a, str):
            out[key] = a
            continue
        fn, alias = a.get("fn"), a.get("alias", "$record")
        ref = f"{alias}.{a['field']}" if a.get("field") else alias
        if fn == "count":
            out[key] = {"$count": ref if a.get("field") or alias != "$record" else "*"}
            if a.get("unique") is False:
                out[key]["$unique"] = False
        elif fn in ("sum", "min", "max", "avg"):
            out[key] = {f"${fn}": ref} | ({"$precision": a["precision"]} if a.get("precision") is not None else {})
        elif fn == "collect":
            out[key] = {"$collect": {"from": alias, **{k: v for k, v in a.items() if k in ("field", "limit", "skip", "orderBy", "unique")}}}
            if a.get("aggregate"):
                out[key]["$collect"]["nested"] = {k: e["$collect"] for k, e in from_legacy(a["aggregate"]).items() if isinstance(e, dict) and "$collect" in e}
        elif fn == "timeBucket":
            unit = a["granularity"]
            out[key] = {"$timeBucket": {"field": ref, "unit": unit, "as": "datetime"} | ({"size": a["size"]} if a.get("size") else {})}
        elif fn in ("vector.similarity.cosine", "vector.similarity.euclidean"):
            out[key] = {"$" + fn.rsplit(".", 1)[1]: [ref, a["query"]]}
        else:
            raise QueryError(f"unknown function {fn}")
    return out


def depth(where: Any) -> int:
    """How many related records deep a where goes."""
    if isinstance(where, list):
        return max(map(depth, where), default=0)
    if not isinstance(where, dict):
        return 0
    out = 0
    for k, v in where.items():
        if k in LOGIC:
            out = max(out, depth(v))
        elif not k.startswith("$") and not is_criteria(v):
            out = max(out, 1 + depth({x: y for x, y in v.items() if x not in TRAVERSAL}))
    return out


def is_heavy(query: dict) -> bool:
    """Whether a query aggregates, groups, or goes more than two records deep."""
    return bool(query.get("aggregate") or query.get("groupBy") or has_aggregate(query.get("select") or {}) or depth(normalized(query.get("where") or {})) > 2)


def validate(query: dict, schema: dict[str, set[str]]) -> list[str]:
    """What is wrong with a query against labels and their properties; an empty list if nothing is."""
    wrong: list[str] = []
    try:
        q = SearchQuery.of(query)
        layers(q.select or {})
    except QueryError as e:
        return [str(e)]
    wrong += [f"unknown label {x}" for x in q.labels if x not in schema]

    def look(where: dict, labels: list[str]) -> None:
        for k, v in where.items():
            if k in LOGIC:
                for x in v if isinstance(v, list) else [v]:
                    if isinstance(x, dict):
                        look(x, labels)
            elif k.startswith("$"):
                continue
            elif is_criteria(v):
                if labels and not any(k in schema.get(x, ()) for x in labels):
                    wrong.append(f"unknown property {k}")
                values = v.values() if isinstance(v, dict) else [v]
                wrong.extend(f"{k} compares with {x}, which is taken as text" for x in values if isinstance(x, str) and x.startswith("$") and "." in x)
            elif k not in schema:
                wrong.append(f"unknown label {k}")
            else:
                look({x: y for x, y in v.items() if x not in TRAVERSAL}, [k])

    look(q.where, q.labels)
    for key, e in (q.select or {}).items():
        if isinstance(e, dict) and len([k for k in e if k in OPERATORS]) != 1:
            wrong.append(f"{key} needs exactly one operator")
    return wrong
