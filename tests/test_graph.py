"""Small graphs with results that are known."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessel.api import Store
from tessel.catalog import Edge, Graph
from tessel.operators import edges as E
from tessel.operators import paths, records, schema, vectors
from tessel.plans.query import QueryError
from tessel.plans.search import search, total
from tessel.sources import csv_files, json_import
from tessel.streaming.changes import bucketed_counts, merge_stream


def table(spark, label, rows, ddl):
    return spark.createDataFrame([(f"{label}:{r[0]}", *r) for r in rows], f"__id string, {ddl}")


@pytest.fixture(scope="module")
def rail(spark):
    g = Graph(spark)
    g.labels["LINE"] = table(spark, "LINE", [("Coast", 1901), ("Valley", 1954), ("Ring", 1978)], "name string, opened int")
    g.labels["STOP"] = table(spark, "STOP", [("Harbour", "open", 6), ("Mill", "open", 2), ("Summit", "closed", 1), ("Market", "open", 4)], "name string, status string, platforms int")
    g.labels["SERVICE"] = table(spark, "SERVICE", [("lift",), ("kiosk",), ("lockers",)], "name string")
    link = lambda a, b, rows: spark.createDataFrame([(f"{a}:{x}", f"{b}:{y}") for x, y in rows], "src string, dst string")
    g.edges = [
        Edge("DEFAULT", "LINE", "STOP", df=link("LINE", "STOP", [("Coast", "Harbour"), ("Coast", "Mill"), ("Valley", "Mill"), ("Valley", "Summit"), ("Ring", "Market"), ("Ring", "Harbour")])),
        Edge("DEFAULT", "STOP", "SERVICE", df=link("STOP", "SERVICE", [("Harbour", "lift"), ("Harbour", "lockers"), ("Mill", "kiosk"), ("Market", "lift")])),
    ]
    return g


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_nested_filters(rail):
    ask = lambda where, label="LINE": names(search(rail, {"labels": [label], "where": where}))
    assert ask({"STOP": {"name": "Mill"}}) == ["Coast", "Valley"]
    assert ask({"STOP": {"status": "open", "platforms": {"$gte": 4}}}) == ["Coast", "Ring"]
    assert ask({"SERVICE": {"name": {"$in": ["kiosk", "lockers"]}}}, "STOP") == ["Harbour", "Mill"]
    assert ask({"STOP": {"SERVICE": {"name": "kiosk"}}}) == ["Coast", "Valley"]
    assert ask({"STOP": {"$relation": {"direction": "in"}}}) == []
    assert ask({"STOP": {"$relation": {"type": "DEFAULT", "direction": "out"}, "$id": "STOP:Summit"}}) == ["Valley"]
    assert ask({"$not": {"STOP": {"status": "closed"}}}) == ["Coast", "Ring"]
    assert ask({"STOP": {"$not": {"SERVICE": {}}}}) == ["Valley"]
    assert ask({"$or": [{"opened": {"$lt": 1950}}, {"STOP": {"platforms": {"$gt": 4}}}]}) == ["Coast", "Ring"]
    assert ask({"$xor": [{"opened": {"$gt": 1950}}, {"STOP": {"platforms": {"$gt": 4}}}]}) == ["Coast", "Valley"]
    assert ask({"SERVICE": {"$relation": {"hops": 2}, "name": "lift"}}) == ["Coast", "Ring"]
    assert total(rail, {"labels": ["LINE"], "where": {"STOP": {}}}).first().total == 3
    near = search(rail, {"labels": ["STOP"], "id": "LINE:Ring"})
    assert names(near) == ["Harbour", "Market"] and names(search(rail, {"labels": ["LINE", "SERVICE"], "id": "STOP:Harbour"})) == ["Coast", "Ring", "lift", "lockers"]


def test_select_and_errors(rail):
    q = {"labels": ["LINE"], "where": {"STOP": {"$alias": "$p", "SERVICE": {"$alias": "$t"}}}, "select": {"services": {"$count": "$t"}, "platforms": {"$sum": "$p.platforms"}}}
    got = {r.name: (r.services, r.platforms) for r in search(rail, q).collect()}
    assert got == {"Coast": (3, 14), "Valley": (1, 2), "Ring": (2, 16)}  # a stop counts once for each of its services
    for wrong in ({"select": {"x": "$q.a"}}, {"select": {"x": {"$median": 1}}}, {"groupBy": ["nope"]}, {"where": {"name": {"$in": []}}}, {"where": {"name": {"$in": [1, "a"]}}}, {"where": {"name": {"$gt": "not a date"}}}, {"where": {"$cycle": {}}}):
        with pytest.raises(QueryError):
            search(rail, {"labels": ["LINE"], **wrong})


def test_order_of_results(spark):
    n = 400
    g = Graph(spark, {"P": table(spark, "P", [(i, (i * 7) % n) for i in range(n)], "k int, v int"), "C": table(spark, "C", [(i, i % n) for i in range(3 * n)], "c int, p int")})
    g.edges = [Edge("HAS", "P", "C", ("k", "p"))]
    plain = {"labels": ["P"], "orderBy": {"v": "asc"}}
    joined = {**plain, "where": {"C": {"$alias": "$c"}}}
    for q, how in ((plain, {}), (plain, {"full_scan": True}), (joined, {}), ({**joined, "select": {"one": "$c.c"}}, {}), ({**joined, "select": {"n": {"$count": "$c"}}}, {}), ({**joined, "select": {"n": {"$count": "$c"}}}, {"full_scan": True}), (joined, {"full_scan": True}), (joined, {"compat": "rows"})):
        got = [r.v for r in search(g, q, **how).collect()]
        assert got == sorted(got) and len(got) >= (n if how.get("full_scan") else 34)
        assert how.get("full_scan") or how.get("compat") or sorted(set(got)) == list(range(100))
    down = [r.v for r in search(g, {**joined, "orderBy": {"v": "desc"}, "skip": 10, "limit": 20}).collect()]
    assert down == list(range(n - 11, n - 31, -1))
    top = search(g, {"labels": ["P"], "where": {"k": {"$lt": 3}, "C": {"$alias": "$c"}}, "select": {"x": {"$collect": {"from": "$c", "select": {"c": "$self.c"}, "orderBy": {"c": "desc"}, "limit": 2}}}})
    assert {r.k: [x.c for x in r.x] for r in top.collect()} == {k: [k + 2 * n, k + n] for k in range(3)}


def test_ids_are_looked_up_by_key_columns(spark):
    from tessel.sources import star

    g = star.load(spark, "/root/testdata/sf0.001", ["CUSTOMER", "NATION", "ORDER"])
    df = search(g, {"labels": ["CUSTOMER"], "where": {"$id": "CUSTOMER:7"}})
    plan = df._jdf.queryExecution().toString()
    assert [r.c_custkey for r in df.collect()] == [7] and "c_custkey" in plan[plan.index("PushedFilters") :][:200]
    assert search(g, {"labels": ["CUSTOMER"], "where": {"$id": {"$in": ["CUSTOMER:7", "CUSTOMER:007", "ORDER:8", "CUSTOMER:x"]}}}).count() == 1
    assert Store(g).records.find_by_id("NATION:3").first().n_nationkey == 3


def test_chain_ring_and_islands(spark):
    g = Graph(spark, {"PIPE": table(spark, "PIPE", [(f"p{i}", f"p{i + 10}") for i in range(10, 60, 10)], "name string, next string"), "HUB": table(spark, "HUB", [("n", "e"), ("e", "s"), ("s", "w"), ("w", "n"), ("t", "n"), ("u", None)], "name string, to string")})
    g.edges = [Edge("FEEDS", "PIPE", "PIPE", ("next", "name")), Edge("SENDS", "HUB", "HUB", ("to", "name"))]

    def up(hops):
        return names(search(g, {"labels": ["PIPE"], "where": {"PIPE": {"$relation": {"type": "FEEDS", "direction": "out", "hops": hops}, "name": "p50"}}}))

    assert up({"max": 4}) == ["p10", "p20", "p30", "p40"] and up({"max": 2}) == ["p30", "p40"] and up(3) == ["p20"] and up({"min": 2, "max": 4}) == ["p10", "p20", "p30"]
    cycle = {"$cycle": {"type": "SENDS", "direction": "out", "hops": {"min": 2, "max": 6}}}
    ask = lambda where: names(search(g, {"labels": ["HUB"], "where": where}))
    assert ask(cycle) == ["e", "n", "s", "w"] and ask({"$not": cycle}) == ["t", "u"] and ask({"$or": [cycle, {"name": "u"}]}) == ["e", "n", "s", "u", "w"]
    assert ask({"$cycle": {"type": "SENDS", "direction": "out", "hops": {"max": 3}}}) == []
    assert ask({"$cycle": {"hops": {"max": 6}}}) == ["e", "n", "s", "w"] and ask({"$cycle": {"hops": {"min": 3, "max": 3}}}) == []
    start = g.records("HUB").where("name = 'n'").select(F.col("__id").alias("start"))
    assert {(r.node, r.hops) for r in paths.reach(g, start, {"max": 3}, "SENDS", "out").collect()} == {("HUB:e", 1), ("HUB:s", 2), ("HUB:w", 3)}
    assert {(r.node, r.hops) for r in paths.reach(g, start, {"max": 2}, "SENDS").collect()} == {("HUB:e", 1), ("HUB:w", 1), ("HUB:t", 1), ("HUB:s", 2)}
    # two parallel relationships are two: there and back is a closed path
    g.edges.append(Edge("WIRE", "HUB", "HUB", df=spark.createDataFrame([("HUB:t", "HUB:u")] * 2, "src string, dst string")))
    assert ask({"$cycle": {"type": "WIRE", "hops": {"max": 2}}}) == ["t", "u"]


def test_dates(spark):
    g = Graph(spark, {"D": table(spark, "D", [("start", "2026-07-23"), ("end", "2026-12-31"), ("none", None)], "event string, date string")}, datetimes={"D": {"date"}})
    ask = lambda where: names(search(g, {"labels": ["D"], "where": where}), "event")
    assert ask({"date": {"$gte": "2026-07-01", "$lte": "2026-08-01"}}) == ["start"]
    assert ask({"date": {"$type": "datetime"}}) == ["end", "start"]
    assert ask({"date": "2026-12-31"}) == ["end"] and ask({"date": {"$eq": {"$year": 2026, "$month": 12, "$day": 31}}}) == ["end"]
    months = search(g, {"labels": ["D"], "where": {"date": {"$exists": True}}, "select": {"m": {"$timeBucket": {"field": "$record.date", "unit": "month"}}, "n": {"$count": "*"}}, "groupBy": ["m"]})
    millis = lambda *x: int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert {(r.m, r.n) for r in months.collect()} == {(millis(2026, 7, 1), 1), (millis(2026, 12, 1), 1)}


def test_pages_after_traversal(spark):
    g = Graph(spark, {"P": table(spark, "P", [("A",), ("B",)], "name string"), "C": table(spark, "C", [(i, "A" if i < 150 else "B") for i in range(300)], "seq int, p string")})
    g.edges = [Edge("HAS", "P", "C", ("name", "p"))]
    q = {"labels": ["C"], "where": {"P": {"name": "B"}}, "orderBy": {"seq": "asc"}}
    assert [r.seq for r in search(g, q).collect()] == list(range(150, 250)) and total(g, q).first().total == 150
    wide = {"labels": ["P"], "where": {"C": {"$alias": "$c"}}, "select": {"n": {"$count": "$c"}}, "limit": 1, "orderBy": {"name": "asc"}}
    assert [(r.name, r.n) for r in search(g, wide).collect()] == [("A", 150)]
    assert [(r.name, r.n) for r in search(g, {**wide, "limit": 20}, compat="rows").collect()] == [("A", 20)]


def test_key_joins(spark):
    src = table(spark, "S", [(i, f"k{i}") for i in range(2100)], "n int, key string")
    dst = table(spark, "T", [(i, f"k{i * 3}") for i in range(600)], "n int, key string")
    g = Graph(spark, {"S": src, "T": dst})
    none = spark.createDataFrame([], "src string, dst string, type string")
    a, b = {"label": "S", "key": "key"}, {"label": "T", "key": "key"}
    out = E.create_many(g, none, a, b, "R", properties={"w": 1})
    assert out.count() == 600 and E.create_many(g, out, a, b, "R", properties={"w": 2}).where("w = 2").count() == 600
    assert E.create_many(g, none, a, {**b, "where": {"n": {"$lt": 100}}}, "R").count() == 100
    assert E.delete_many(g, out, a, b, "R").count() == 0
    for wrong in ((a, {"label": "T"}, True), ({"label": "S"}, {"label": "T"}, False), ({"label": "S"}, {"label": "T", "where": {"n": 1}}, True)):
        with pytest.raises(QueryError):
            E.pairs(g, *wrong)
    typed = Graph(spark, {"S": src, "N": table(spark, "N", [(1,)], "key int")})
    assert E.pairs(typed, a, {"label": "N", "key": "key"}).count() == 0


def plan_rows(df):
    """Collects a frame; returns what its plan's nodes are called with the rows that each gave and their columns."""
    df.collect()
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            left.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            out.append((node.nodeName(), metric.get().value(), [node.output().apply(i).name() for i in range(node.output().size())]))
        left += [node.children().apply(i) for i in range(node.children().size())]
    return out


def brute_pairs(source, target, same):
    """Pairs of (id, keys) rows with a common key, each once."""
    return {(a, b) for a, x in source for b, y in target if set(x) & set(y) and not (same and a == b)}


def keyed_graph(spark):
    """Labels with equal, several, repeated and missing keys, and an id that has two rows."""
    ones = [(f"A:{i}", [0, 1, 1, 2, None, i + 10][i % 6]) for i in range(40)] + [("A:1", 2), ("A:1", 1)]
    many = [(f"M:{i}", [[0, 1], [1, 2, 2], [], [i + 10], None, [0, 1, 2]][i % 6]) for i in range(30)]
    reals = [(f"D:{i}", [0.0, -0.0, 1.0, float("nan"), i + 10.0][i % 5]) for i in range(25)]
    g = Graph(spark, {"A": spark.createDataFrame(ones, "__id string, key int"), "M": spark.createDataFrame(many, "__id string, key array<int>"), "D": spark.createDataFrame(reals, "__id string, key double")})
    keys = {label: [(r[0], r[1] if isinstance(r[1], list) else [r[1]] if r[1] is not None else []) for r in rows] for label, rows in (("A", ones), ("M", many), ("D", reals))}
    return g, {k: [(i, [x for x in v if x is not None]) for i, v in (rows or [])] for k, rows in keys.items()}


@pytest.mark.parametrize(("source", "target"), [("A", "M"), ("M", "A"), ("A", "A"), ("M", "M"), ("A", "D"), ("D", "M")])
def test_probe_counts_pairs_once(spark, source, target):
    g, keys = keyed_graph(spark)
    want = len(brute_pairs(keys[source], keys[target], source == target))
    for limit in (1, 7, want - 1, want, want + 1, 10_000):
        assert E.probe(g, {"label": source, "key": "key"}, {"label": target, "key": "key"}, limit).first().n == min(want, limit)


def test_probe_makes_no_pairs_of_a_key_that_reaches_the_limit(spark):
    rows = lambda x: spark.range(300).select(F.concat(F.lit(f"{x}:"), "id").alias("__id"), F.lit("k").alias("key"))
    g = Graph(spark, {"A": rows("A"), "B": rows("B"), "N": spark.createDataFrame([("N:1", 1)], "__id string, key int")})
    for target in ("A", "B"):
        probe = E.probe(g, {"label": "A", "key": "key"}, {"label": target, "key": "key"}, 100)
        assert max(n for _, n, _ in plan_rows(probe)) <= 300 and probe.first().n == 100
    assert E.probe(g, {"label": "A", "key": "key"}, {"label": "N", "key": "key"}, 100).first().n == 0


@pytest.mark.parametrize("cell", [2, E.CELL])
@pytest.mark.parametrize(("source", "target"), [("A", "M"), ("A", "A"), ("M", "M"), ("A", "D")])
def test_pairs_of_keys_come_once(spark, monkeypatch, source, target, cell):
    monkeypatch.setattr(E, "CELL", cell)
    g, keys = keyed_graph(spark)
    got = [tuple(r) for r in E.pairs(g, {"label": source, "key": "key"}, {"label": target, "key": "key"}).collect()]
    assert sorted(got) == sorted(brute_pairs(keys[source], keys[target], source == target))


def test_pairs_are_neither_gathered_nor_made_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 50)
    rows = lambda x: spark.range(300).select(F.concat(F.lit(f"{x}:"), "id").alias("__id"), F.lit("k").alias("key"))
    out = E.pairs(Graph(spark, {"A": rows("A"), "B": rows("B")}), {"label": "A", "key": "key"}, {"label": "B", "key": "key"})
    kept = [n for name, n, _ in plan_rows(out) if "Aggregate" in name or "Sort" == name]
    assert kept and max(kept) <= 300  # before, all 90,000 pairs went through an aggregation
    by_task = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(by_task) == 90_000 and len(by_task) > 1 and max(by_task) < 60_000


@pytest.mark.parametrize("more", [{}, {"n": {"fn": "count", "alias": "$y"}}, {"tag": "$record.tag"}, {"n": {"fn": "count", "alias": "$y"}, "tag": "$record.tag"}])
def test_collected_records_join_each_root_once(spark, more):
    make = lambda label, n, up: spark.range(n).select(F.concat(F.lit(f"{label}:"), "id").alias("__id"), F.col("id").alias("k"), (F.col("id") % up).alias("up"), F.lit(label).alias("tag"))
    g = Graph(spark, {"X": make("X", 4, 1), "Y": make("Y", 20, 3), "Z": make("Z", 200, 20)}, [Edge("R", "Y", "X", ("up", "k")), Edge("R", "Z", "Y", ("up", "k"))])
    nested = {"ys": {"fn": "collect", "alias": "$y", "orderBy": {"k": "asc"}, "aggregate": {"zs": {"fn": "collect", "alias": "$z", "orderBy": {"k": "desc"}, "limit": 2}}}}
    df = search(g, {"labels": ["X"], "where": {"Y": {"$alias": "$y", "Z": {"$alias": "$z"}}}, "aggregate": {**nested, **more}}, full_scan=True)
    joined = [n for _, n, columns in plan_rows(df) if "__s_ys" in columns]
    assert joined and max(joined) == 3  # before, each of the 200 rows of X, Y and Z had the records of X beside it
    rows = df.collect()
    assert {r.k: [(y.k, [z.k for z in y.zs]) for y in r.ys] for r in rows} == {x: [(y, [180 + y, 160 + y]) for y in range(x, 20, 3)] for x in range(3)}
    assert len(rows) == 3 and all(r.tag == "X" for r in rows) and ("n" not in more or {r.k: r.n for r in rows} == {0: 7, 1: 7, 2: 6})


def test_schema_of_boats(spark):
    rows = [("Petrel", "Rhos", 9, dt.datetime(1971, 3, 4), True, ["sloop", "oak"], [5.5, 6.25]), ("Gannet", "Voe", 14, dt.datetime(1988, 11, 30), True, ["oak", "ketch"], [7.0]),
            ("Tern", "Rhos", 6, dt.datetime(2003, 6, 1), False, ["sloop"], [4.75]), ("Auk", "Voe", 11, None, None, None, None)]
    g = Graph(spark, {"BOAT": table(spark, "BOAT", rows, "name string, yard string, length int, launched timestamp, afloat boolean, marks array<string>, speeds array<double>")})
    counts = {r.property: (r.type, r.records) for r in schema.property_counts(g, "BOAT").collect()}
    assert counts["length"] == ("number", 4) and counts["marks"] == ("string", 3) and counts["launched"] == ("datetime", 3) and counts["afloat"] == ("boolean", 3)
    stats = {r.property: (r.isArray, r.min, r.max) for r in schema.property_stats(g, "BOAT").collect()}
    assert stats["length"] == (False, "6", "14") and stats["speeds"] == (True, "4.75", "7.0") and stats["launched"][1].startswith("1971-03-04")
    (whole,) = schema.full_schema(g).collect()
    assert whole.records == 4 and {p.property: (p.type, p.records, p.isArray, p.min, p.max) for p in whole.properties} == {k: (*v, *stats.get(k, (False, None, None))) for k, v in counts.items()}
    assert [r.value for r in schema.property_values(g, "marks", limit=2).collect()] == ["ketch", "oak"]
    assert {(r.value, r.records) for r in schema.facets(g, "marks").collect()} == {("sloop", 2), ("oak", 2), ("ketch", 1)}
    assert names(search(g, {"labels": ["BOAT"], "where": {"marks": "sloop", "speeds": {"$gt": 6}}})) == ["Petrel"]
    assert "| length | number | 6..14 |" in schema.markdown(g)
    now = [0.0]
    cache = schema.SchemaCache(lambda: now[0])
    seen = []
    for t, force in ((0, False), (10, False), (4000, False), (4001, True)):
        now[0] = t
        cache.get("v", lambda: seen.append(1), force)
    assert len(seen) == 3


def test_json_import(spark, tmp_path):
    data = [{"name": "Acme", "tags": ["a", ""], "DEPARTMENT": [{"name": "R&D", "EMPLOYEE": [{"name": "Ann"}, {"name": "Bo"}]}, {"name": "Ops", "EMPLOYEE": []}]}, {"name": "", "tags": [], "DEPARTMENT": None}]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(map(json.dumps, data)))
    df = json_import.read_json_lines(spark, str(path))
    g = json_import.flatten(df, "company", F.concat(F.lit("C:"), F.coalesce(F.nullif("name", F.lit("")), F.lit("none"))), upper=True, drop_empty=True)
    assert {k: v.count() for k, v in g.labels.items()} == {"COMPANY": 2, "DEPARTMENT": 2, "EMPLOYEE": 2}
    assert {(r["__id"], r.name, tuple(r.tags or ())) for r in g.records("COMPANY").collect()} == {("C:Acme", "Acme", ("a",)), ("C:none", None, ())}
    assert names(search(g, {"labels": ["COMPANY"], "where": {"DEPARTMENT": {"EMPLOYEE": {"name": "Bo"}}}})) == ["Acme"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        json_import.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    tree = spark.createDataFrame([(1, [("x",)])], "k int, ITEM array<struct<v:string>>").drop("k")
    assert set(json_import.flatten(tree, "ROOT", F.lit("r")).labels) == {"ITEM"}
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"id": "a"}, {"id": "b"}], "relationships": [{"src": "a", "dst": "b"}]}))
    recs, rels = json_import.restore_backup(spark, str(tmp_path / "b.json"))
    assert recs.count() == 2 and rels.first().dst == "b"


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('code,unit price,ok\na,1.5,true\n"b,c",2,false\n,,\n')
    df = csv_files.read_csv(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in df.collect()] == [("a", 1.5, True), ("b,c", 2.0, False)] and df.columns == ["code", "unit_price", "ok"]
    csv_files.write_csv(df.withColumn("__id", F.col("code")), str(tmp_path / "out"))
    assert csv_files.read_csv(spark, str(tmp_path / "out")).count() == 2


def test_upserts(spark):
    first = spark.createDataFrame([(f"id{i}", f"r-{i}", f"n{i}") for i in range(100)], "__id string, key string, name string")
    second = spark.createDataFrame([(f"x{i}", f"r-{i}", i) for i in range(50, 150)] + [("lost", None, 0)], "__id string, key string, grade int")
    out = records.upsert(first, second, ["key"])
    assert out.count() == 151
    row = out.where("key = 'r-75'").first()
    assert (row["__id"], row.name, row.grade) == ("id75", "n75", 75)
    assert records.upsert(out.where("key is not null"), second.where("key is not null"), ["key"]).count() == 150
    wiped = records.upsert(first, second, ["key"], "rewrite").where("key = 'r-75'").first()
    assert (wiped.name, wiped.grade) == (None, 75)
    twice = spark.createDataFrame([("a", "k", 1, 1), ("b", "k", 2, 2)], "__id string, key string, v int, at int")
    assert [r.v for r in records.upsert(first, twice, ["key"], order="at").where("key = 'k'").collect()] == [2]
    with pytest.raises(ValueError, match="exists"):
        records.create_unique(first, first.limit(1), ["key"])
    assert records.create_unique(first, first.limit(1).withColumn("name", F.lit("z")), ["key"], "upsert").where("name = 'z'").count() == 1


def test_vectors(spark):
    g = Graph(spark, {"DOC": table(spark, "DOC", [("alpha", 1), ("beta", 2), ("gamma", 3)], "title string, n int")})
    index = vectors.VectorIndexes().create(vectors.VectorIndex("DOC", "title", 3), g)
    rows = lambda *r: spark.createDataFrame(list(r), "record_id string, vector array<float>")
    index = vectors.upsert_vectors(g, index, rows(("DOC:alpha", [1.0, 0.0, 0.0]), ("DOC:beta", [0.0, 1.0, 0.0]), ("DOC:gamma", [0.0, 0.0, 1.0])))
    hits = vectors.vector_search(g, index, [1, 0, 0]).collect()
    assert hits[0].title == "alpha" and all(0 < h["__score"] <= 1 for h in hits) and [h["__score"] for h in hits] == sorted((h["__score"] for h in hits), reverse=True)
    assert [h.title for h in vectors.vector_search(g, index, [1, 0, 0], where={"n": {"$gt": 1}}, limit=1).collect()] == ["beta"]
    for bad in (rows(("DOC:alpha", [1.0])), rows(("DOC:alpha", [float("nan"), 0.0, 0.0])), rows(("DOC:zeta", [1.0, 0.0, 0.0]))):
        with pytest.raises(QueryError):
            vectors.upsert_vectors(g, index, bad)
    with pytest.raises(QueryError):
        vectors.vector_search(g, index, [1, 0])
    assert vectors.index_stats(g, index).first()[:] == (3, 3)


def copy_of(g):
    return Store(Graph(g.spark, dict(g.labels), list(g.edges)))


def test_store(rail):
    s = copy_of(rail)
    s.begin()
    s.records.create("LINE", {"name": "Moor", "opened": 2001, "__id": "LINE:Moor"})
    s.records.update("LINE", ["LINE:Moor"], {"opened": 2002})
    assert names(s.records.find({"labels": ["LINE"], "where": {"opened": 2002}})[0]) == ["Moor"]
    s.relationships.create_many({"label": "LINE", "where": {"name": "Moor"}}, {"label": "SERVICE", "where": {"name": "kiosk"}}, "SELLS", many_to_many=True)
    assert s.relationships.find(where={"type": "SELLS"}).count() == 1
    s.records.delete({"labels": ["LINE"], "where": {"name": "Coast"}})
    assert s.relationships.find(where={"type": "DEFAULT"}).count() == 8
    s.rollback()
    assert s.records.find_by_id("LINE:Coast").count() == 1 and s.relationships.find().count() == 10
    with pytest.raises(QueryError):
        s.records.find_uniq({"labels": ["LINE"]})
    assert s.records.next_page({"labels": ["LINE"], "limit": 10}) == {"labels": ["LINE"], "limit": 10, "skip": 10}
    assert s.query.raw("SELECT count(*) AS n FROM edges").first().n == 10
    assert "Scan" in s.query.explain({"labels": ["LINE"]}) and s.query.validate({"labels": ["NOPE"]}) == ["unknown label NOPE"]
    assert {r.label for r in s.ai.get_schema().collect()} == {"LINE", "STOP", "SERVICE"}
    assert s.ai.cached_schema() is s.ai.cached_schema() and s.ai.cached_schema(force=True) == s.ai.cached_schema()
    assert s.properties.find_by_id("name", "string").first().records == 10


def test_attach_detach_and_cascade(rail):
    s = copy_of(rail)
    s.records.attach("LINE:Valley", ["STOP:Market", "STOP:Mill", "SERVICE:lift"], "VISITS")
    assert {(r.dst, r.type) for r in s.graph.all_edges(["VISITS"]).collect()} == {("STOP:Market", "VISITS"), ("STOP:Mill", "VISITS"), ("SERVICE:lift", "VISITS")}
    page, n = s.relationships.find_from("STOP:Mill")
    assert [(r.type, r.targetId, r.direction) for r in page.collect()] == [("DEFAULT", "LINE:Coast", "in"), ("DEFAULT", "LINE:Valley", "in"), ("DEFAULT", "SERVICE:kiosk", "out"), ("VISITS", "LINE:Valley", "in")] and n.first().total == 4
    s.records.detach("LINE:Valley", ["STOP:Market"], ["VISITS"])
    s.records.detach("LINE:Valley", ["STOP:Mill"])
    assert s.relationships.find_from("LINE:Valley")[1].first().total == 2
    s.records.delete_by_id(["LINE:Ring"], cascade=True)
    assert names(search(s.graph, {"labels": ["STOP"]})) == ["Mill", "Summit"] and names(search(s.graph, {"labels": ["SERVICE"]})) == ["kiosk"]
    assert s.graph.all_edges().count() == 3


def test_upsert_of_new_labels_and_equal_keys(spark):
    s = Store(Graph(spark))
    s.records.upsert("TOOL", spark.createDataFrame([("saw", 1), ("saw", 3), ("awl", 2)], "name string, n int"), ["name"])
    assert {(r.name, r.n) for r in s.graph.records("TOOL").collect()} == {("saw", 3), ("awl", 2)}  # the last one wins
    s.records.upsert("TOOL", spark.createDataFrame([("saw", 9)], "name string, n int"), ["name"])
    assert {(r.name, r.n) for r in s.graph.records("TOOL").collect()} == {("saw", 9), ("awl", 2)} and s.graph.records("TOOL").where("__id is null").count() == 0


def test_inline_vectors(spark):
    s = Store(Graph(spark))
    s.records.create_many("NOTE", [{"title": "x"}])
    index = s.ai.create_index("NOTE", "title", 2)
    ids = s.records.create_many("NOTE", [{"title": "a"}, {"title": "b, c"}], vectors=[[{"propertyName": "title", "vector": [1, 0]}], [{"propertyName": "title", "vector": [0, 1]}]])
    assert [r.title for r in s.ai.search("NOTE", "title", [0, 1]).collect()] == ["b, c", "a"] and s.ai.index_stats(index).first()[:] == (3, 2) and len(ids) == 2
    with pytest.raises(QueryError):
        s.records.create_many("NOTE", [{"title": "d"}], vectors=[[{"propertyName": "title", "vector": [1, 0, 0]}]])
    s.ai.create_index("NOTE", "title", 2, "euclidean")
    with pytest.raises(QueryError):
        s.ai.search("NOTE", "title", [0, 1])
    s.records.create_many("NOTE2", [{"tags": "a; b;"}], separator=";")
    assert s.graph.records("NOTE2").first().tags == ["a", "b"]


def test_patterns(spark):
    g = Graph(spark, {"Driver": table(spark, "Driver", [("vk",), ("lm",)], "code string"), "Race": table(spark, "Race", [("Rye", "vk"), ("Ely", "lm"), ("Wye", "zz")], "place string, winnerDriverCode string")})
    s = Store(g)
    (key,) = s.patterns.analyze()
    assert s.patterns.list("suggested").keys() == {key} and s.patterns.list("active") == {}
    s.patterns.approve(key)
    assert s.graph.all_edges(["HAS_DRIVER"]).count() == 2
    s.records.create("Driver", {"__id": "Driver:zz", "code": "zz"})  # patterns in force follow each write
    assert s.graph.all_edges(["HAS_DRIVER"]).count() == 3 and s.patterns.analyze()[key][1] == "active"
    s.patterns.delete(key, delete_existing=True)
    assert s.graph.edges == [] and s.patterns.list() == {}


def test_imports(spark, tmp_path):
    s = Store(Graph(spark))
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps([{"name": "Acme", "since": "2020-01-02T03:04:05", "size": "12", "TEAM": [{"name": "Ops", "on": "true"}]}], indent=1), encoding="utf-8")
    s.records.import_json("FIRM", str(tmp_path / "a.json"))
    firm = s.graph.records("FIRM").first()
    assert firm.size == 12.0 and s.graph.type_of("FIRM", "since") == "datetime" and s.graph.records("TEAM").first().on is True
    assert names(search(s.graph, {"labels": ["FIRM"], "where": {"since": {"$gte": "2020-01-02T00:00:00", "$lt": {"$year": 2021}}}})) == ["Acme"]
    (tmp_path / "b.jsonl").write_text('{"name": "Acme", "city": "Ayr", "TEAM": [{"name": "Ops", "head": "Jo"}, {"name": "Lab"}]}\n{"name": "Brim", "TEAM": []}\n')
    s.records.import_json("FIRM", str(tmp_path / "b.jsonl"), merge_by=["name"])
    assert {(r.name, r.city, r.size) for r in s.graph.records("FIRM").collect()} == {("Acme", "Ayr", 12.0), ("Brim", None, None)}
    assert {(r.name, r.on, r.head) for r in s.graph.records("TEAM").collect()} == {("Ops", True, "Jo"), ("Lab", None, None)}
    assert names(search(s.graph, {"labels": ["TEAM"], "where": {"FIRM": {"name": "Acme"}}})) == ["Lab", "Ops"] and s.graph.all_edges().count() == 2
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": 2}\nnot json\n')
    with pytest.raises(QueryError, match="not json"):
        json_import.read_json_text(spark, str(tmp_path / "c.jsonl"))
    (tmp_path / "d.csv").write_text("name,when\nx,2024-02-03\ny,2024-03-04T05:06:07Z\n")
    s.records.import_csv("DAY", str(tmp_path / "d.csv"))
    assert s.graph.type_of("DAY", "when") == "datetime" and names(search(s.graph, {"labels": ["DAY"], "where": {"when": {"$gt": "2024-03-01"}}})) == ["y"]
    s.records.export_csv({"labels": ["DAY"]}, str(tmp_path / "out"))
    assert csv_files.client_csv(csv_files.read_csv(spark, str(tmp_path / "out"))).columns == ["name", "when"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", 1, dt.datetime(2026, 1, 1, 5)), ("b", 2, dt.datetime(2026, 1, 1, 9)), ("a", 3, dt.datetime(2026, 1, 2))]
    spark.createDataFrame(rows, "key string, v int, at timestamp").write.parquet(source)
    stream = spark.readStream.schema("key string, v int, at timestamp").parquet(source)
    state = {"table": spark.createDataFrame([("id-a", "a", 0)], "__id string, key string, v int")}
    def write(df, number):
        df = df.select("__id", "key", "v")
        df.write.mode("overwrite").parquet(str(tmp_path / f"t{number}"))
        state["table"] = spark.read.parquet(str(tmp_path / f"t{number}"))
    q = merge_stream(stream, lambda: state["table"], write, ["key"], str(tmp_path / "cp"), order="at")
    q.awaitTermination(60)
    assert {(r.key, r.v) for r in state["table"].collect()} == {("a", 3), ("b", 2)}
    counts = bucketed_counts(stream, "at", "day", ["key"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert {(r.bucket.day, r.key, r.n) for r in spark.table("counts").collect()} == {(1, "a", 1), (1, "b", 1), (2, "a", 1)}
