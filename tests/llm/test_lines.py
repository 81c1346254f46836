import hashlib
import random
from collections import defaultdict

from tessel.llm import lines as L

WS = " \t\n\x0b\x0c\r"


def brute(rows, least=40, docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(WS)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].append(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        i0 = -(2**63) if i is None else i
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(held.get(key(x), ())) >= docs and max(held[key(x)]) != i0)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.kept or "").encode()).hexdigest()) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [("Line Number %d " % k) + "xÄ" * 20 for k in range(12)] + ["short", "", "  \t", "y" * 39, "z" * 40, " \t" + "Z" * 40 + "\x0b"]
    rows = [(k * 7 % 101, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 8)))) for k in range(80)]
    rows += [(None, pool[0]), (500, None), (501, ""), (3, rows[0][1]), (502, "\n".join([pool[1]] * 3000))]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, owner string")
    want = brute(rows)
    for batches in (1, 4, 7):
        assert got(L.with_kept(docs, batches=batches)) == want
    out = L.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_runs_keep_levels_and_owners(spark):
    runs = L.LineRuns(spark, fanout=3)
    for b in range(7):
        keys = [(k, k, 100 - b, 1) for k in range(b, b + 3)]
        df = spark.createDataFrame(keys, "h1 long, h2 long, owner long, n_docs long")
        assert runs.novel(df).count() == (3 if b == 0 else 1)
        runs.add(df)
    assert {lev: len(r) for lev, r in runs.levels.items() if r} == {0: 1, 1: 2}
    assert {(r.h1, r.owner, r.n_docs) for r in runs.totals().collect()} == {(k, 100 - max(0, k - 2), min(k + 1, 3, 9 - k)) for k in range(9)}
    known = runs.owners()
    assert known.count() == known.select("h1").distinct().count() == 9
    batch = runs._write(spark.createDataFrame([(3, 3, 9, 1), (90, 90, 9, 1)], "h1 long, h2 long, owner long, n_docs long"), "batch")
    plan = runs.novel(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs and batch lie in equal buckets
    runs.drop()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.with_kept(docs).count() == 0
