"""From a query object to one DataFrame: records, their joins, aggregation, order and page."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import ID, LABEL, Edge, Graph, is_array, logical_type
from ..functions.buckets import bucket_millis, bucket_start
from ..functions.similarity import cosine, euclidean
from ..operators.paths import cycles, reach
from .predicates import Property, combine, criteria
from .query import LOGIC, MATH, QueryError, SearchQuery, from_legacy, has_aggregate, is_criteria, layers, refs_of, relation_of

ROOT = "$record"


class Frame:
    """A DataFrame whose columns are properties of aliases: those of the root by their names, others as alias__name."""

    def __init__(self, df: DataFrame, aliases: dict[str, list[str]]):
        self.df, self.aliases = df, aliases

    def name(self, alias: str, prop: str) -> str:
        if alias not in self.aliases:
            raise QueryError(f"unknown alias {alias}")
        return prop if alias == ROOT else f"{alias[1:]}__{prop}"

    def column(self, ref: str) -> Column:
        alias, _, prop = ref.partition(".")
        prop = prop or ID
        name = self.name(alias, prop)
        return F.col(name) if name in self.df.columns else F.lit(None)


class Compiler:
    def __init__(self, graph: Graph, query: SearchQuery, pattern: bool, compat: str):
        self.graph, self.q, self.pattern, self.compat = graph, query, pattern, compat
        self.select = dict(query.select or from_legacy(query.aggregate or {}))
        self.used = self._used_aliases()
        self.marks = 0

    def _used_aliases(self) -> set[str]:
        """Aliases that the output needs, so that their records must be joined and not only looked for."""
        out: set[str] = set()

        def look(e: Any) -> None:
            if isinstance(e, str) and e.startswith("$"):
                out.add(e.partition(".")[0])
            elif isinstance(e, dict):
                for v in e.values():
                    look(v)
            elif isinstance(e, list):
                for v in e:
                    look(v)

        look(self.select)
        look(self.q.groupBy)
        return out - {ROOT}

    # where

    def property(self, df: DataFrame, labels: list[str], name: str, column: str) -> Property:
        if column not in df.columns:
            return Property(F.lit(None), False, None, False)
        kind = logical_type(df.schema[column].dataType)
        stored = kind == "datetime"
        if any(name in self.graph.datetimes.get(x, ()) for x in labels):
            kind = "datetime"
        return Property(F.col(column), is_array(df, column), kind, stored)

    def aliases_in(self, block: Any) -> set[str]:
        if isinstance(block, list):
            return set().union(*map(self.aliases_in, block), set())
        if not isinstance(block, dict):
            return set()
        out = {block["$alias"]} if "$alias" in block else set()
        return out.union(*(self.aliases_in(v) for k, v in block.items() if k not in ("$relation", "$cycle")))

    def apply(self, frame: Frame, alias: str, labels: list[str], where: dict) -> Frame:
        """Keeps the rows for which all of ``where`` holds for an alias."""
        tests = []
        for key, value in where.items():
            if key == "$id":
                tests.append(self.has_id(frame, alias, labels, value))
            elif key in ("$relation", "$alias"):
                continue
            elif key == "$cycle":
                for spec in value if isinstance(value, list) else [value]:
                    frame = self.mark(frame, alias, labels, {"$cycle": spec}, "left_semi")
            elif key == "$and":
                for x in value:
                    frame = self.apply(frame, alias, labels, x)
            elif key in LOGIC:
                one = value[0] if len(value) == 1 and len(value[0]) == 1 else None
                if key == "$not" and one and self.is_related(*next(iter(one.items()))):
                    frame = self.mark(frame, alias, labels, one, "left_anti")
                else:
                    frame, test = self.tree(frame, alias, labels, key, value)
                    tests.append(test)
            elif self.is_related(key, value):
                if self.aliases_in({key: value}) & self.used:
                    frame = self.joined(frame, alias, labels, key, value)
                else:
                    frame = self.mark(frame, alias, labels, {key: value}, "left_semi")
            else:
                column = frame.name(alias, key)
                tests.append(criteria(self.property(frame.df, labels, key, column), value, self.pattern))
        if tests:
            frame = Frame(frame.df.where(combine("$and", tests)), frame.aliases)
        return frame

    def has_id(self, frame: Frame, alias: str, labels: list[str], value: Any) -> Column:
        """A test of ids, by the columns that they are made from where one label is asked for by name."""
        value = value["$eq"] if isinstance(value, dict) and set(value) == {"$eq"} else value
        ids = [value] if isinstance(value, str) else value.get("$in") if isinstance(value, dict) and set(value) == {"$in"} else None
        if alias == ROOT and len(labels) == 1 and ids and all(isinstance(i, str) for i in ids):
            return self.graph.has_id(labels[0], ids)
        return criteria(Property(F.col(frame.name(alias, ID)), False, "string", False), value)

    @staticmethod
    def is_related(key: str, value: Any) -> bool:
        return key == "$cycle" or (not key.startswith("$") and not is_criteria(value))

    def tree(self, frame: Frame, alias: str, labels: list[str], op: str, members: list) -> tuple[Frame, Column]:
        """A boolean of members; related records come in as marks, so that they never multiply rows."""
        parts = []
        for member in members:
            inner = []
            for key, value in member.items():
                if key in LOGIC:
                    frame, test = self.tree(frame, alias, labels, key, value)
                    inner.append(test)
                elif key == "$id":
                    inner.append(criteria(Property(F.col(frame.name(alias, ID)), False, "string", False), value))
                elif self.is_related(key, value):
                    self.marks += 1
                    mark = f"__mark{self.marks}"
                    frame = self.mark(frame, alias, labels, {key: value}, mark)
                    inner.append(F.col(mark))
                else:
                    inner.append(criteria(self.property(frame.df, labels, key, frame.name(alias, key)), value, self.pattern))
            parts.append(combine("$and", inner))
        return frame, combine(op, parts)

    def links(self, labels: list[str], label: str, relation: Any) -> list[tuple[Edge, bool]]:
        """Relationships from one of the labels to ``label`` and whether they go out."""
        type_, direction, _ = relation_of(relation)
        out = []
        for e in self.graph.edges:
            if type_ is None or e.type == type_:
                if e.src in labels and e.dst == label and direction != "in":
                    out.append((e, True))
                if e.dst in labels and e.src == label and direction != "out":
                    out.append((e, False))
        return out

    def related(self, labels: list[str], label: str, block: dict, alias: str) -> tuple[Frame, str, str]:
        """Records of ``label`` that satisfy a block, with a column to join with one of the other side: (frame, theirs, ours)."""
        relation = block.get("$relation")
        _, direction, hops = relation_of(relation)
        inner = {k: v for k, v in block.items() if k not in ("$relation", "$alias")}
        df = self.graph.records(label)
        prefix = f"{alias[1:]}__"
        frame = Frame(df.select(*[F.col(c).alias(prefix + c) for c in df.columns]), {alias: df.columns})
        if alias == ROOT:
            raise QueryError("$record is the name of the root")
        frame = self.apply(frame, alias, [label], inner)
        if hops:
            starts = None
            for x in labels:
                ids = self.graph.records(x).select(F.col(ID).alias("start"))
                starts = ids if starts is None else starts.unionByName(ids)
            pairs = reach(self.graph, starts, hops, relation_of(relation)[0], direction, set(labels), {label}).select(F.col("start").alias("__from"), F.col("node").alias("__to"))
            return Frame(frame.df.join(pairs, F.col(prefix + ID) == F.col("__to")).drop("__to"), frame.aliases), "__from", ID
        links = self.links(labels, label, relation)
        if len(links) == 1 and links[0][0].on is not None and len(labels) == 1:
            e, out = links[0]
            ours, theirs = e.on if out else e.on[::-1]
            return frame, prefix + theirs, ours
        pairs = None
        for e, out in links:
            rows = self.graph.edge_rows(e)
            a, b = ("src", "dst") if out else ("dst", "src")
            rows = rows.select(F.col(a).alias("__from"), F.col(b).alias("__to"))
            pairs = rows if pairs is None else pairs.unionByName(rows)
        if pairs is None:
            pairs = self.graph.spark.createDataFrame([], "__from string, __to string")
        return Frame(frame.df.join(pairs, F.col(prefix + ID) == F.col("__to")).drop("__to"), frame.aliases), "__from", ID

    def joined(self, frame: Frame, alias: str, labels: list[str], label: str, block: dict) -> Frame:
        """The rows with those of related records beside them."""
        name = block.get("$alias") or f"${label}__{len(frame.aliases)}"
        other, theirs, ours = self.related(labels, label, block, name)
        if set(other.aliases) & set(frame.aliases):
            raise QueryError("an alias is used twice")
        df = frame.df.join(other.df, F.col(frame.name(alias, ours)) == F.col(theirs))
        return Frame(df.drop("__from"), frame.aliases | other.aliases)

    def mark(self, frame: Frame, alias: str, labels: list[str], block: dict, how: str) -> Frame:
        """Keeps rows with a related record (left_semi) or without (left_anti), or adds a boolean of the given name."""
        ((key, value),) = block.items()
        if key == "$cycle":
            starts = frame.df.select(F.col(frame.name(alias, ID)).alias("start")).distinct()
            keys, ours = cycles(self.graph, starts, value.get("hops"), value.get("type"), value.get("direction"), set(labels)).select(F.col("start").alias("__key")), ID
        else:
            other, theirs, ours = self.related(labels, key, value, value.get("$alias") or f"$m{self.marks}__{key}")
            keys = other.df.select(F.col(theirs).alias("__key"))
        column = F.col(frame.name(alias, ours))
        if how in ("left_semi", "left_anti"):
            return Frame(frame.df.join(keys, column == F.col("__key"), how), frame.aliases)
        keys = keys.distinct().withColumn(how, F.lit(True))
        df = frame.df.join(keys, column == F.col("__key"), "left").drop("__key")
        return Frame(df.withColumn(how, F.coalesce(F.col(how), F.lit(False))), frame.aliases)

    # output

    def expr(self, frame: Frame, e: Any, rank: Column | None = None) -> Column:
        if isinstance(e, (int, float, bool)):
            return F.lit(e)
        if isinstance(e, str):
            return frame.column(e) if e.startswith("$") else F.lit(e)
        if not isinstance(e, dict):
            raise QueryError(f"{e} is not an expression")
        ops = [k for k in e if k.startswith("$") and k not in ("$precision", "$unique")]
        if len(ops) != 1:
            raise QueryError("an expression needs one operator")
        op, arg = ops[0], e[ops[0]]
        if op == "$ref":
            return F.col(f"__s_{arg}")
        if op in MATH:
            if not isinstance(arg, list) or len(arg) != 2:
                raise QueryError(f"{op} needs two operands")
            a, b = (self.expr(frame, x) for x in arg)
            return {"$add": lambda: a + b, "$subtract": lambda: a - b, "$multiply": lambda: a * b, "$divide": lambda: F.try_divide(a.cast("double"), b.cast("double"))}[op]()
        if op == "$sum":
            return F.coalesce(F.sum(self.expr(frame, arg)), F.lit(0))
        if op == "$avg":
            avg, digits = F.avg(self.expr(frame, arg)), e.get("$precision")
            return avg if digits is None else avg.cast("bigint") if digits == 0 else F.round(avg, digits)
        if op == "$count":
            if arg == "*" and set(frame.aliases) == {ROOT}:  # a record is one row there
                return F.count(F.lit(1))
            if e.get("$unique") is False:
                return F.count(self.expr(frame, arg) if arg != "*" else F.col(ID))
            return F.count_distinct(F.col(ID) if arg == "*" else self.expr(frame, arg))
        if op in ("$min", "$max"):
            return (F.min if op == "$min" else F.max)(self.expr(frame, arg))
        if op == "$timeBucket":
            return self.bucket(frame, arg)
        if op in ("$cosine", "$euclidean"):
            vector = F.array(*[F.lit(float(x)) for x in arg[1]])
            return (cosine if op == "$cosine" else euclidean)(self.expr(frame, arg[0]), vector)
        if op == "$collect":
            return self.collect(frame, arg, rank)
        raise QueryError(f"unknown operator {op}")

    def bucket(self, frame: Frame, arg: dict) -> Column:
        ref = arg["field"]
        alias, _, name = ref.partition(".")
        column = frame.name(alias, name)
        if column not in frame.df.columns:
            return F.lit(None).cast("bigint")
        kind = logical_type(frame.df.schema[column].dataType)
        declared = any(name in names for names in self.graph.datetimes.values())
        if kind != "datetime" and not declared:
            return F.lit(None).cast("bigint")
        ts = F.col(column) if kind == "datetime" else F.try_to_timestamp(F.col(column))
        return (bucket_start if arg.get("as") == "datetime" else bucket_millis)(ts, arg["unit"], arg.get("size"))

    def collect_rank(self, frame: Frame, arg: dict, by: list[Column]) -> Column | None:
        """The place of an alias's record in its group's order, by which only those within the limit are gathered."""
        if arg.get("limit") is None or "field" in arg or arg.get("from") not in frame.aliases:
            return None
        key, down = self.collect_order(arg)
        order = [frame.column(f"{arg['from']}.{k}") for k in (key, ID)]
        order = [order[1].isNull(), *[c.desc() if down else c.asc() for c in order]]
        return (F.row_number() if arg.get("unique") is False else F.dense_rank()).over(Window.partitionBy(*by).orderBy(*order))

    def collect(self, frame: Frame, arg: dict, rank: Column | None = None) -> Column:
        """Records or projections of an alias: distinct, ordered by one key, cut to places skip up to limit."""
        alias = arg.get("from")
        if alias is None:
            raise QueryError("$collect needs from or label")
        if alias not in frame.aliases:
            raise QueryError(f"unknown alias {alias}")
        if "field" in arg:
            values = F.collect_list(frame.column(f"{alias}.{arg['field']}"))
            if is_array(frame.df, frame.name(alias, arg["field"])):
                values = F.flatten(values)
            values = F.array_sort(values if arg.get("unique") is False else F.array_distinct(values))
            return self.cut(values, arg)
        names = [c for c in frame.aliases[alias] if not c.startswith("__") or c == ID]
        shown = {n: f"{alias}.{n}" for n in names} if not arg.get("select") else {k: v if isinstance(v, str) else None for k, v in arg["select"].items()}
        fields = [frame.column(ref.replace("$self", alias)).alias(k) for k, ref in shown.items()]
        key, down = self.collect_order(arg)
        sort = frame.column(f"{alias}.{key}")
        row = F.struct(sort.alias("__sort"), frame.column(f"{alias}.{ID}").alias("__tie"), F.struct(*fields).alias("row"))
        within = frame.column(f"{alias}.{ID}").isNotNull()
        rows = F.collect_list(F.when(within if rank is None else within & (rank <= arg["limit"]), row))
        if arg.get("unique") is not False:
            rows = F.array_distinct(rows)
        rows = F.sort_array(rows, asc=not down)
        return F.transform(self.cut(rows, arg), lambda x: x["row"])

    @staticmethod
    def collect_order(arg: dict) -> tuple[str, bool]:
        order = arg.get("orderBy") or "desc"
        if isinstance(order, str):
            return ID, order == "desc"
        key, way = next(iter(order.items()))
        return key, way == "desc"

    @staticmethod
    def cut(values: Column, arg: dict) -> Column:
        skip, limit = arg.get("skip") or 0, arg.get("limit")
        if limit is None and not skip:
            return values
        if limit is None:
            return F.slice(values, F.lit(skip + 1), F.greatest(F.size(values) - skip, F.lit(0)))
        return F.slice(values, skip + 1, max(limit - skip, 0))

    def late(self) -> bool:
        """Whether order and page come after aggregation: one key that is made, not read."""
        order = self.q.orderBy
        if not isinstance(order, dict) or len(order) != 1:
            return False
        e = self.select.get(next(iter(order)))
        return e is not None and not isinstance(e, str)

    def order(self, df: DataFrame, tie: list[str]) -> DataFrame:
        order = self.q.orderBy
        items = {ID: order or "desc"} if not isinstance(order, dict) else order
        keys = [F.col(k).desc_nulls_first() if way == "desc" else F.col(k).asc_nulls_last() for k, way in items.items() if k in df.columns]
        ties = [F.col(t) for t in tie if t not in items and t in df.columns]
        return df.orderBy(*keys, *ties) if keys else df

    def paged(self, df: DataFrame, tie: list[str]) -> DataFrame:
        skip, limit = self.q.page()
        df = self.order(df, tie)
        return (df.offset(skip) if skip else df).limit(limit)

    def early_page(self, frame: Frame) -> Frame:
        """Cuts the page of records before anything is aggregated, by rows or by distinct records."""
        if self.compat == "rows" or set(frame.aliases) == {ROOT}:
            return Frame(self.paged(frame.df, [ID]), frame.aliases)
        keys = [k for k in ([*self.q.orderBy] if isinstance(self.q.orderBy, dict) else [ID]) if k in frame.df.columns]
        roots = frame.df.select(*dict.fromkeys([ID, *keys])).distinct()
        page = self.paged(roots, [ID]).select(ID)
        return Frame(frame.df.join(page, ID, "left_semi"), frame.aliases)

    def label_collects(self, frame: Frame) -> dict[str, DataFrame]:
        """Columns of nested records by select key, each gathered from below: __owner, the record's id, and __s_key."""
        made = {}
        for key, e in self.select.items():
            if isinstance(e, dict) and "$collect" in e and "nested" in e["$collect"]:
                made[key] = self.nested(frame, [ID], e["$collect"]).withColumnsRenamed({ID: "__owner", "rows": f"__s_{key}"})
            elif isinstance(e, dict) and "$collect" in e and "label" in e["$collect"]:
                if any(g.startswith("$") for g in self.q.groupBy):
                    raise QueryError("$collect by label can't be grouped by a property")
                made[key] = self.gather(self.q.labels, e["$collect"]).withColumnsRenamed({"owner": "__owner", "rows": f"__s_{key}"})
        return made

    def with_collects(self, df: DataFrame, gathered: dict[str, DataFrame]) -> DataFrame:
        """The rows with gathered columns, by the record's id."""
        for key, rows in gathered.items():
            df = df.join(rows, F.col(ID) == F.col("__owner"), "left").drop("__owner")
            if "label" in self.select[key]["$collect"]:
                df = df.withColumn(f"__s_{key}", F.coalesce(F.col(f"__s_{key}"), F.array()))
        return df

    def nested(self, frame: Frame, by: list[str], spec: dict) -> DataFrame:
        """``by`` and rows: records of an alias, each with those of other aliases beside it, gathered from the innermost on."""
        alias = spec["from"]
        if alias not in frame.aliases:
            raise QueryError(f"unknown alias {alias}")
        own = frame.name(alias, ID)
        names = [c for c in frame.aliases[alias] if not c.startswith("__") or c == ID]
        df = frame.df.select(*by, *[F.col(frame.name(alias, c)) for c in dict.fromkeys([*names, ID])]).distinct()
        for key, inner in (spec.get("nested") or {}).items():
            below = self.nested(frame, [*by, own], inner).withColumnsRenamed({**{c: f"__j_{c}" for c in [*by, own]}, "rows": f"__c_{key}"})
            df = df.join(below, [F.col(c) == F.col(f"__j_{c}") for c in [*by, own]], "left").drop(*[f"__j_{c}" for c in [*by, own]])
        fields = [F.col(frame.name(alias, c)).alias(c) for c in names] + [F.coalesce(F.col(f"__c_{k}"), F.array()).alias(k) for k in spec.get("nested") or {}]
        key, down = self.collect_order(spec)
        row = F.struct(F.col(frame.name(alias, key)).alias("__sort"), F.col(own).alias("__tie"), F.struct(*fields).alias("row"))
        rows = df.select(*by, row.alias("r"))
        if spec.get("limit") is not None:
            w = Window.partitionBy(*by).orderBy(*[F.col(f"r.{c}").desc() if down else F.col(f"r.{c}").asc() for c in ("__sort", "__tie")])
            rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= spec["limit"]).drop("n")
        rows = rows.groupBy(*by).agg(F.collect_list("r").alias("r"))
        sort = lambda a, b: F.when(a["__tie"] == b["__tie"], 0).when((a["__sort"] > b["__sort"]) | (a["__sort"] == b["__sort"]) & (a["__tie"] > b["__tie"]), -1 if down else 1).otherwise(1 if down else -1)
        return rows.select(*by, F.transform(self.cut(F.array_sort("r", sort), spec), lambda x: x["row"]).alias("rows"))

    def gather(self, owners: list[str], spec: dict) -> DataFrame:
        """owner and rows: the records of a label next to each owner, with nested ones, ordered and cut."""
        label, select = spec["label"], spec.get("select")
        df = self.graph.records(label)
        frame = self.apply(Frame(df, {ROOT: df.columns}), ROOT, [label], spec.get("where") or {})
        df, fields = frame.df, []
        if select is None:
            fields = [F.col(c) for c in df.columns if not c.startswith("__") or c == ID]
        for key, e in (select or {}).items():
            if isinstance(e, dict) and "$collect" in e:
                inner = self.gather([label], e["$collect"]).select(F.col("owner").alias("__o"), F.col("rows").alias(f"__c_{key}"))
                df = df.join(inner, F.col(ID) == F.col("__o"), "left").drop("__o")
                fields.append(F.coalesce(F.col(f"__c_{key}"), F.array()).alias(key))
            else:
                fields.append(F.col(e.split(".", 1)[1]).alias(key) if isinstance(e, str) else self.expr(Frame(df, {ROOT: df.columns}), e).alias(key))
        links = self.links(owners or sorted(self.graph.labels), label, spec.get("relation"))
        pairs = reduce(DataFrame.unionByName, [self.graph.edge_rows(e).select(F.col("src" if out else "dst").alias("owner"), F.col("dst" if out else "src").alias("__b")) for e, out in links], self.graph.spark.createDataFrame([], "owner string, __b string"))
        key, down = self.collect_order(spec)
        rows = pairs.distinct().join(df, F.col("__b") == F.col(ID)).select("owner", F.struct(F.col(key).alias("__sort"), F.col(ID).alias("__tie"), F.struct(*fields).alias("row")).alias("r"))
        if spec.get("limit") is not None:  # only the first rows of an owner are gathered
            w = Window.partitionBy("owner").orderBy(F.col("r").desc() if down else F.col("r").asc())
            rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= spec["limit"]).drop("n")
        rows = rows.groupBy("owner").agg(F.sort_array(F.collect_list("r"), asc=not down).alias("r"))
        return rows.select("owner", F.transform(self.cut(F.col("r"), spec), lambda x: x["row"]).alias("rows"))

    def matched(self) -> Frame:
        """Rows of roots, and of aliases in use, that satisfy the where."""
        q = self.q
        labels = q.labels or sorted(self.graph.labels)
        df = self.graph.scan(labels)
        frame = Frame(df, {ROOT: df.columns})
        if q.id is not None:
            frame = Frame(df.join(self.neighbours(q.id, labels), F.col(ID) == F.col("__near"), "left_semi"), frame.aliases)
        return self.apply(frame, ROOT, labels, q.where)

    def neighbours(self, id_: str, labels: list[str]) -> DataFrame:
        """__near: ids of records of the labels next to one record. A branch for each relationship and direction; that of
        equal columns looks the record up and joins its value, and no other relationships are made."""
        own, parts = self.graph.label_of(id_), []
        for e in self.graph.edges:
            for here, there, out in ((e.src, e.dst, True), (e.dst, e.src, False)):
                if there not in labels or own not in (None, here):
                    continue
                if e.df is not None:
                    a, b = ("src", "dst") if out else ("dst", "src")
                    parts.append(e.df.where(F.col(a) == id_).select(F.col(b).alias("__near")))
                else:
                    a, b = e.on if out else e.on[::-1]
                    one = self.graph.records(here).where(self.graph.has_id(here, [id_])).select(F.col(a).alias("__k"))
                    other = self.graph.records(there)
                    parts.append(other.join(one, F.col(b) == F.col("__k"), "left_semi").select(F.col(ID).alias("__near")))
        return reduce(DataFrame.unionByName, parts) if parts else self.graph.spark.createDataFrame([], "__near string")

    def run(self, full_scan: bool) -> DataFrame:
        frame = self.matched()
        if missing := {a for a in self.used if a not in frame.aliases and a != "$self"}:
            raise QueryError(f"unknown alias {sorted(missing)}")
        late = self.late()
        roots = [c for c in frame.aliases[ROOT] if c != LABEL] + [LABEL]
        if not late and not full_scan:
            frame = self.early_page(frame)
        gathered = self.label_collects(frame)
        plain = {k: e for k, e in self.select.items() if k not in gathered}
        # what is gathered joins a record once, after its rows with other aliases are one, unless an expression reads it
        early = [k for k in gathered if any(k in refs_of(e) for e in plain.values())]
        later = {k: rows for k, rows in gathered.items() if k not in early}
        frame = Frame(self.with_collects(frame.df, {k: gathered[k] for k in early}), frame.aliases)
        steps = layers(plain)
        dims = [g for g in self.q.groupBy if g.startswith("$")]
        keys = [g for g in self.q.groupBy if not g.startswith("$")]
        if bad := [k for k in keys if k not in self.select]:
            raise QueryError(f"groupBy names unknown keys {bad}")
        aggregated = [k for k in plain if has_aggregate(plain[k])]
        before, after = [], []
        for step in steps:
            for k in step:
                if k not in aggregated:
                    (after if refs_of(plain[k]) & {*aggregated, *after} else before).append(k)
        df = frame.df
        for k in before:
            df = df.withColumn(f"__s_{k}", self.expr(Frame(df, frame.aliases), plain[k]))
        frame = Frame(df, frame.aliases)
        if aggregated or self.q.groupBy:
            by = [F.col(ID)]
            if dims or keys:
                implicit = [k for k in before if not isinstance(plain[k], str)] if any(k in before for k in keys) else []
                by = [frame.column(g).alias(g.rpartition(".")[2]) for g in dims] + [F.col(f"__s_{k}") for k in dict.fromkeys([*[k for k in keys if k in before], *implicit])]
            ranks = {}
            for k in aggregated:
                if "$collect" in plain[k] and (rank := self.collect_rank(frame, plain[k]["$collect"], by)) is not None:
                    df, ranks[k] = df.withColumn(f"__r_{k}", rank), F.col(f"__r_{k}")
            frame = Frame(df, frame.aliases)
            aggs = [self.expr(frame, plain[k], ranks.get(k)).alias(f"__s_{k}") for k in aggregated]
            if dims or keys:
                df = df.groupBy(*by).agg(*(aggs or [F.lit(1).alias("__one")])) if by else df.agg(*aggs)
                shown = [g.rpartition(".")[2] for g in dims] + [k for k in plain if f"__s_{k}" in df.columns or k in after]
            else:
                # records' own columns don't go through the aggregation but are joined to it
                made = df.groupBy(ID).agg(*[F.first(F.col(f"__s_{k}")).alias(f"__s_{k}") for k in [*before, *early]], *aggs)
                own = self.graph.scan(self.q.labels or sorted(self.graph.labels))
                df = own.join(made.withColumnRenamed(ID, "__agg"), F.col(ID) == F.col("__agg")).drop("__agg")
                df = self.with_collects(df, later)
                shown = [c for c in roots if c not in self.select] + [*self.select]
        else:
            if set(frame.aliases) != {ROOT} and not before:
                df = df.dropDuplicates([ID])
            elif set(frame.aliases) != {ROOT} and later:
                df = df.select(*dict.fromkeys([*frame.aliases[ROOT], *[f"__s_{k}" for k in [*before, *early]]])).dropDuplicates()
            df = self.with_collects(df, later)
            shown = [c for c in roots if c not in self.select] + [*self.select]
        for k in after:
            df = df.withColumn(f"__s_{k}", self.expr(Frame(df, frame.aliases), plain[k]))
        df = df.select(*[F.col(f"__s_{c}").alias(c) if c in self.select and f"__s_{c}" in df.columns else F.col(c) for c in dict.fromkeys(shown)])
        if not (aggregated or self.q.groupBy) and set(frame.aliases) != {ROOT} and before:
            df = df.dropDuplicates()
        if late:
            tie = [c for c in df.columns if c not in (self.q.orderBy or {})]
            return self.order(df, tie) if full_scan else self.paged(df, tie)
        if full_scan and not self.q.orderBy:
            return df
        return self.order(df, [ID])  # what came after the page may have lost its order; at most a page of records is left


def search(graph: Graph, query: dict | SearchQuery, full_scan: bool = False, pattern: bool = False, compat: str = "roots") -> DataFrame:
    """Runs a query. ``full_scan`` takes no page; ``pattern`` reads $contains as a pattern; ``compat='rows'`` cuts pages by joined rows."""
    return Compiler(graph, SearchQuery.of(query), pattern, compat).run(full_scan)


def total(graph: Graph, query: dict | SearchQuery) -> DataFrame:
    """One row, total: the distinct records that a query's where finds."""
    q = SearchQuery.of(query)
    plain = SearchQuery(labels=q.labels, where=q.where, id=q.id)
    return Compiler(graph, plain, False, "roots").matched().df.agg(F.count_distinct(ID).alias("total"))


def labels_histogram(graph: Graph, query: dict | SearchQuery) -> DataFrame:
    """Records by label among those that a where finds."""
    q = SearchQuery.of(query)
    frame = Compiler(graph, SearchQuery(labels=q.labels, where=q.where), False, "roots").matched()
    return frame.df.groupBy(LABEL).agg(F.count_distinct(ID).alias("records"))
