import hashlib
import random
from collections import Counter, defaultdict

from tessel.llm import mixing as M


def fill(budget, kids):
    """Budgets of (offer, weight) by plain rounds: give by weight, take back what is too much, go on with the rest."""
    given, free = {}, dict(kids)
    while free:
        total = sum(w for _, w in free.values())
        full = {k: o for k, (o, w) in free.items() if budget * w >= o * total}
        if not full:
            return given | {k: budget * w // total for k, (_, w) in free.items()}
        for k, o in full.items():
            given[k], budget = o, budget - o
            del free[k]
    return given


def brute(rows, weights, share, epochs, seed):
    def domain(s):
        digits = "".join(c for c in s if c.isdigit())
        return M.DOMAINS[int(digits) % 4] if digits else M.DOMAINS[-1]
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        leaves[domain(source or ""), lang or "", source or ""].append((i, max(1, len((text or "").split()))))
    offer = {k: epochs * sum(t for _, t in v) for k, v in leaves.items()}
    given = {(): sum(o for o in offer.values()) // epochs * share // 100}
    for d in range(3):
        kids = defaultdict(dict)
        for k, o in offer.items():
            node = kids[k[:d]].get(k[: d + 1], (0, 0))
            kids[k[:d]][k[: d + 1]] = (node[0] + o, weights[M.LEVELS[d]].get(k[d], 1))
        for parent, nodes in kids.items():
            given |= fill(given[parent], nodes)
    out = Counter()
    for k, docs in leaves.items():
        whole, more = divmod(given[k], sum(t for _, t in docs))
        used = 0
        for i, t in sorted(docs, key=lambda x: hashlib.md5(f"{seed}:{whole}:{x[0]}".encode()).hexdigest()):
            used += t
            out[i] += whole + (used <= more)
    return {i: n for i, n in out.items() if n}


def test_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 16)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["en", "en", "de", None]), rng.choice(["src0"] * 12 + ["src1", "src2", "src5", "other", None])) for i in range(600)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, source string, tokens string")
    for share, epochs in ((80, 2), (30, 1), (100, 1), (190, 2), (250, 2)):
        got = {r.row.doc_id: r.copies for r in M.mix(docs, share_percent=share, epochs=epochs).collect()}
        assert got == brute(rows, M.WEIGHTS, share, epochs, M.SEED), (share, epochs)
    out = M.mixed(docs, share_percent=150, epochs=2)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(brute(rows, M.WEIGHTS, 150, 2, M.SEED))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src1"), (1, "a b", "en", "src1"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert M.mix(docs, share_percent=200).count() == 3
    assert [r.row.doc_id for r in M.mix(docs, share_percent=100).collect()] == [None]  # equal rows pass the budget together
    assert M.mix(docs.limit(0)).count() == 0
