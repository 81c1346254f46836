import random

import numpy as np
import pytest
import xxhash

from tessel.llm import simhash as S
from tessel.llm.components import components


def union_find(nodes, pairs):
    up = {n: n for n in nodes}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute_groups(texts):
    """The root of each id, from all pairs within the filter's bits whose sets of five-word shingles are 0.8 alike."""
    ids, words = list(texts), {i: t.lower().split() for i, t in texts.items()}
    arr = np.array([S.fingerprint(texts[i].encode()) for i in ids], np.int64)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    close = np.argwhere(np.bitwise_count((arr[:, None] ^ arr[None, :]).view(np.uint64)) <= S.FILTER_BITS)
    pairs = [(ids[a], ids[b]) for a, b in close if a < b]
    return union_find(ids, [(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])


def test_filter_checks_pairs_by_five_words(spark):
    rng, texts = random.Random(5), {}
    for base in range(4):
        words = [f"b{base}w{rng.randrange(90)}" for _ in range(200)]
        for _ in range(45):
            copy = list(words)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(200)] = f"e{rng.randrange(1000)}"
            texts[len(texts)] = " ".join(copy)
    roots = brute_groups(texts)
    near = np.array([S.fingerprint(t.encode()) for t in texts.values()], np.int64)
    within = np.argwhere(np.bitwise_count((near[:, None] ^ near[None, :]).view(np.uint64)) <= S.FILTER_BITS)
    assert len(set(union_find(texts, within).values())) < len(set(roots.values())) < len(texts)
    kept = S.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots.values()))


def test_fingerprint_against_plain_counting(spark):
    for text in ["", " \n", "One", "one TWO", "a b c", "Ä ö a b  c\x0bd e f", "x y z " * 50]:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert S.fingerprint(text.encode()) % 2**64 == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(500, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("near", "most", "parts"), [(False, 3, 2), (True, 3, 2), (False, 4, 2), (True, 4, 2), (False, 5, 3)])
def test_links_against_all_pairs(spark, near, most, parts):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base) | {0, 2**64 - 1}
    for _ in range(700):
        x = rng.choice(base[:3] if near else base)
        for b in rng.sample(range(64), rng.randrange(1, most + 3)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(S.signed(x) for x in fps)
    arr = np.array(fps, np.int64)
    close = np.argwhere(np.bitwise_count((arr[:, None] ^ arr[None, :]).view(np.uint64)) <= most)
    want = union_find(fps, [(fps[a], fps[b]) for a, b in close if a < b])
    found = S.links(spark.createDataFrame([(f, 1 + f % 3) for f in fps], "fp long, n long"), most, parts).collect()
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= most for r in found)
    assert union_find(fps, [(r.a, r.b) for r in found]) == want
    if near:
        assert len(found) < (len(close) - len(fps)) / 2  # a star, not all pairs


def test_thresholds_sum():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    for parts in (1, 2, 3, 4, 6):
        groups = S.group_bits(1000, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(S.thresholds(1000, both, groups, 3)) == 3 - parts + 1


def test_near_duplicates_and_filter(spark):
    text = " ".join(f"w{i}" for i in range(300))
    data = [(5, text, "a"), (3, text + " end", "b"), (9, None, "c"), (8, "", "d"), (7, "other words entirely", "e"), (7, "other words entirely", "e"), (None, "alone here", "f"), (2, "very " * 30000, "g")]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 8), (8, 8), (7, 7), (None, None), (2, 2)}
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.fp for r in kept.collect()) == ["b", "d", "e", "f", "g"]
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.drop_near_duplicates(docs.limit(0)).count() == 0
