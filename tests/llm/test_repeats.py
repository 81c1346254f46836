import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import repeats as R
from tessel.llm import suffixes as S
from tessel.llm.suffixes import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 3), max_size=60), st.text("ab", max_size=8).map(lambda t: [ord(c) for c in t * 7])))
def test_suffix_array_against_sorting(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


texts_of_few_bytes = st.lists(st.one_of(st.binary(max_size=40), st.text("ab\0", max_size=6).map(lambda t: t.encode() * 9)), min_size=1, max_size=12)


def matrix(texts):
    out = np.zeros((len(texts), max(map(len, texts))), np.uint8)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = list(t)
    return out, np.array([len(t) for t in texts])


@settings(max_examples=300, deadline=None)
@given(texts_of_few_bytes, st.integers(1, 9))
def test_suffixes_of_many_texts_against_sorting(texts, least):
    text, place = S.sorted_suffixes(*matrix(texts), least)
    assert [texts[t][p:] for t, p in zip(text, place, strict=True)] == sorted(t[p:] for t in texts for p in range(len(t) - least + 1))
    assert len(set(zip(text.tolist(), place.tolist(), strict=True))) == len(text)


def test_rounds_go_with_the_length_of_texts(monkeypatch):
    # classes of equal anchors are sorted together: Python steps must not grow with their number
    rounds, was = [], S.less
    monkeypatch.setattr(S, "less", lambda *a: rounds.append(1) or was(*a))
    rng, out = random.Random(5), []
    for n in (30, 3000):
        texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(R.MIN, R.WIDTH + 1))) for _ in range(n)]
        rounds.clear()
        S.sorted_suffixes(*matrix(texts), R.MIN)
        out.append(len(rounds))
    assert 0 < out[1] <= R.WIDTH * (R.WIDTH + 1) / 2 and out[1] < 5 * out[0]


def brute(rows):
    """Removed bytes of each row: covered by a 50-byte string that also starts in a row with a smaller id."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            least[s] = min(least.get(s, 2**63), -(2**63) if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < (-(2**63) if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(12)] + ["a" * 70, "ab" * 45, "x" * 49, "y" * 50, "z" * 51]
    rows = []
    for i in rng.sample(range(1000), n):
        parts = [rng.choice(passages)[rng.randrange(0, 6) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 7))]
        rows.append((i, rng.choice(["", " ", "-"]).join(parts)))
    near = rows[5][1] + " " + passages[0] + passages[3]
    rows += [(2000 + k, near[:k] + "#" + near[k + 1 :]) for k in range(0, 60, 7)] + [(3000, near), (3001, near), (1, near[10:])]
    rows += [(None, None), (None, passages[1]), (4000, ""), (4001, passages[2] * 3), (4001, passages[2]), (rows[0][0], rows[0][1])]
    return rows


def test_against_brute_force(spark, monkeypatch):
    # the last two: names that their short forms don't tell apart, in some buckets or nearly all
    for seed, block, bucket, hot, short in ((1, 16_000_000, 48_000_000, 10**6, 40), (2, 3000, 4000, 10**6, 40), (3, 1, 1000, 10**6, 40), (4, 3000, 3000, 5, 40), (5, 1, 5000, 0, 12), (6, 4000, 5000, 10**6, 6)):
        monkeypatch.setattr(R, "SHORT_BITS", short)
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "BUCKET_BYTES", bucket)
        monkeypatch.setattr(R, "HOT", hot)
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, raw string").repartition(5)
        assert got(R.repeats(docs)) == brute(rows), seed


def test_splits_may_differ_between_passes(spark):
    # what is filed goes by the numbers that rows were written with, however the files are split for a pass
    rng = random.Random(3)
    noise = lambda: "".join(chr(rng.randrange(33, 127)) for _ in range(400))
    rows = [(i, (t or "") + noise()) for i, t in corpus(6)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, part string").coalesce(1)
    hadoop, names = spark.sparkContext._jsc.hadoopConfiguration(), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        hadoop.set("parquet.block.size", "2000")  # many row groups in one file
        hadoop.set("parquet.block.size.row.check.min", "5")
        hadoop.set("parquet.page.size.row.check.min", "5")
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 7000)
        out, counts = R.repeats(docs), set()
        for size in (7000, 3000, 10**7, 12000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            again = out.select("*")
            counts.add(again.rdd.getNumPartitions())
            assert got(again) == brute(rows)
        assert len(counts) > 2
    finally:
        for n in ("parquet.block.size", "parquet.block.size.row.check.min", "parquet.page.size.row.check.min"):
            hadoop.unset(n)
        for n, v in before.items():
            spark.conf.set(n, v)


def test_missing_part_raises(tmp_path):
    filed = R.Filed(f"file://{tmp_path}", {"name": ("<u8", True)})
    with pytest.raises(RuntimeError, match="part 3"):
        filed.rows(3)


def one_block(ids, raws):
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    return R.Block(0, np.array(ids), np.frombuffer(b"".join(raws), np.uint8), starts)


def test_anchors_by_definition(monkeypatch):
    rng = random.Random(7)
    raws = [bytes(rng.choice(b"abcd") for _ in range(rng.choice((0, 10, 49, 50, 51, 200, 700)))) for _ in range(40)] + [b"z" * 120]
    block = one_block(range(len(raws)), raws)
    want = block.anchors()
    for raw, a, b in zip(raws, block.starts, block.starts[1:], strict=False):
        alone = one_block([0], [raw]).anchors()
        inside = (want[0] >= a) & (want[0] < b)
        assert alone[0].tolist() == (want[0][inside] - a).tolist() and alone[1].tolist() == want[1][inside].tolist()
        for p in range(len(raw) - R.MIN + 1):  # every string has an anchor
            assert ((alone[0] >= p) & (alone[0] <= p + R.MIN - R.GRAM)).any()
    monkeypatch.setattr(R, "CHUNK", 64)
    small = block.anchors()
    assert small[0].tolist() == want[0].tolist() and small[1].tolist() == want[1].tolist()


def test_slices_of_anchors(monkeypatch):
    rng = random.Random(4)
    raws = [("".join(rng.choice("ab") for _ in range(rng.randrange(60, 200))) + "common passage of letters that is long enough to repeat " * 2)[: rng.randrange(80, 300)].encode() for _ in range(60)]
    block = one_block(range(60), raws)
    at, h = block.anchors()
    every = R.surroundings(block, at, h)
    names, first, least = R.least_of(R.names_of(every), block.ids[block.row_of(at)])

    def strings():
        runs, row = {}, block.row_of(at)
        for c, lo, hi in zip(*R.settle(every[first], least), strict=True):
            runs.setdefault(int(c), []).append((lo, hi))
        name = np.searchsorted(names, R.names_of(every))
        return {(int(r), int(a) - s) for r, a, c in zip(row, at, name, strict=True) if block.ids[r] == least[c] for lo, hi in runs.get(int(c), ()) for s in range(lo, hi + 1)}

    whole = strings()
    monkeypatch.setattr(R, "SLICE", 3)
    monkeypatch.setattr(R, "ANCHORS", 7)
    assert strings() == whole and len(whole) > 200


def test_hot_anchors_leave_slices_whole():
    # an anchor that counts as hot becomes a row for each of its strings, and makes slices of the others no smaller
    rng = random.Random(9)
    raws = [bytes(rng.choice(b"abcdefgh") for _ in range(900)) for _ in range(400)]
    block = one_block(range(len(raws)), raws)
    _, h = block.anchors()
    known = np.unique(h)

    class Few(R.Filed):
        def rows(self, part):
            tag, first = np.unique(R.tag_of(known), return_index=True)
            return [{"bucket": 0, "tag": tag, "hot": np.isin(known[first], h[100:103])}]

    slices = [(len(keys), int(single.sum())) for _, keys, _, _, single in R.Shared(Few("", {}), 1)(block)]
    rows = sum(n for n, _ in slices)
    assert sum(hot for _, hot in slices) >= 3 and rows >= len(h)
    assert max(n for n, _ in slices) <= R.ANCHORS and len(slices) == -(-rows // R.ANCHORS)


def test_finder_against_a_set():
    rng = np.random.default_rng(2)
    for known in ([], [0], [2**64 - 1], [0, 2**64 - 1], rng.integers(0, 2**36, 900), rng.integers(2**62, 2**64 - 1, 900, dtype=np.uint64), [*range(500), 2**62]):
        known = np.unique(np.array(known, np.uint64))
        asked = np.concatenate([known, known - np.uint64(1), known + np.uint64(1), rng.integers(0, 2**36, 50).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at, found = R.Finder(known)(asked)
        assert found.tolist() == [x in set(known.tolist()) for x in asked.tolist()]
        assert (known[at[found]] == asked[found]).all()


def test_packed_numbers():
    for kind in ("<u4", "<u8", "<i8", "u1"):
        for x in (np.zeros(0, kind), np.array([5], kind), np.sort(np.random.default_rng(1).integers(0, 120, 1000).astype(kind))):
            assert R.unpack(R.pack(x), kind).tolist() == x.tolist() and R.unpack(R.pack(x, True), kind, True).tolist() == x.tolist()


def test_empty(spark):
    assert R.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
