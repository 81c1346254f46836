"""SimHash near-duplicates by generalised pigeonhole search.

A text's fingerprint has bit i set if over half of its shingles' XXH64 values have it. Two fingerprints link at
``max_bits`` or fewer differing bits. Documents with one fingerprint are one class, so copies never meet in pairs.

The search groups correlated bits into ``parts`` partitions, estimates for each partition and threshold how many
pairs of fingerprints it would let through, and a dynamic program gives each partition its own threshold so that
thresholds sum to ``max_bits - parts + 1`` at the least cost. By the general pigeonhole principle, linked
fingerprints differ within some partition by no more than its threshold. Every fingerprint is held under its key in
that partition with all flips up to half the threshold and probes with all flips up to the other half, so that keys
within the threshold meet; the full distance is verified in the join. With two partitions a key has 32 bits, so
chance candidates stay few where 16-bit keys would grow with the square.

First, each key's most common fingerprint becomes its hub, and fingerprints in reach of it link to it. Probing then
leaves out pairs that share a hub, so a large group of near copies gives a star and not all its pairs; no link
between two components is lost by it.

As a filter, links also need five-word shingles that are alike by 0.8 or more: hubs are checked first, and only those
that pass let their pairs go; then the pairs are checked, by the shingles of both texts.

Defined results: fewer words than a shingle make one shingle of all; texts without words (null, empty, white
space) have fingerprint zero and link like any other; a null doc_id never is a component's name unless all of its
ids are null; repeated rows are copies; other columns keep their values whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_and_text, materialize, packed, row_key, unpacked, utf8
from .components import components

BITS, SEED, SHINGLE, MAX_BITS, PARTS = 64, 42, 3, 3, 2
#: For filtering: the distance at which pairs are looked up, its partitions, and what the found pairs are checked by.
FILTER_BITS, FILTER_PARTS, FILTER_SHINGLE, SIMILAR = 6, 3, 5, (8, 10)
#: Shingles whose bits are counted at once.
BLOCK = 65536


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, A-Z lower-cased, over shingles of words with repeats; a signed 64-bit number."""
    words = raw.lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        at = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[shingle:], strict=False)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds long column ``fp``."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(bytes(x), shingle) for x in texts], dtype="int64")

    return df.withColumn("fp", each(utf8(F.col(text))))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and a 64 x 64 table of how many have both bits; 4096 sums reach the driver."""

    def part(frames):
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in frames:
            x = np.unpackbits(pdf["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both.ravel(), n).astype(np.int64)})

    rows = fps.select("fp").mapInPandas(part, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    n, both = 0, np.zeros((BITS, BITS))
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits by partition: each partition takes the free bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / np.where(spread > 1e-9, spread, np.inf)
    np.fill_diagonal(phi, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        mine = [max(free, key=lambda b: (phi[b, sorted(free)].sum(), -b))]
        free.remove(mine[0])
        while len(mine) < size:
            nxt = max(free, key=lambda b: (phi[b, mine].sum(), -b))
            mine.append(nxt)
            free.remove(nxt)
        out.append(sorted(mine))
    return out


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], max_bits: int) -> list[int]:
    """The cheapest thresholds, -1 or more each, that sum to max_bits - partitions + 1.

    The cost of a threshold is its rows, held and probing, and the pairs of fingerprints expected to differ by no more
    than it in the partition, from each bit's share of ones.
    """
    p = np.diag(both) / max(n, 1)
    cost = []
    for group in groups:
        dist = np.zeros(max_bits + 2)  # chances of a distance; the last cell is all beyond
        dist[0] = 1
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            moved = np.append(0, dist[:-1] * q)
            moved[-1] += dist[-1] * q
            dist = dist * (1 - q) + moved
        flips = np.cumsum([comb(len(group), t) for t in range(max_bits + 1)])
        probes = np.array([flips[t // 2] + flips[t - t // 2] for t in range(max_bits + 1)])
        cost.append([0.0, *(n * probes + n * n / 2 * np.cumsum(dist)[: max_bits + 1])])  # index is threshold + 1
    total = max_bits - len(groups) + 1 + len(groups)  # sum of threshold + 1
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for c in cost:
        row: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, picks) in best[-1].items():
            for t in range(min(len(c) - 1, total - used) + 1):
                if used + t not in row or so_far + c[t] < row[used + t][0]:
                    row[used + t] = (so_far + c[t], [*picks, t - 1])
        best.append(row)
    return best[-1][total][1]


def signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def flipped(fps: DataFrame, group: list[int], most: int) -> DataFrame:
    """Each row once for every flip of up to ``most`` bits of ``group``, with key, its flipped bits of the group."""
    mask = signed(sum(1 << b for b in group))
    flips = [signed(sum(1 << b for b in c)) for t in range(most + 1) for c in combinations(group, t)]
    key = F.col("fp").bitwiseAND(F.lit(mask))
    if most == 0:
        return fps.withColumn("key", key)
    return fps.withColumn("flip", F.explode(F.array([F.lit(x) for x in flips]))).withColumn("key", key.bitwiseXOR(F.col("flip")))


def shingle_set(raw: bytes, shingle: int = FILTER_SHINGLE) -> np.ndarray:
    """The different shingles of words of a text, A-Z lower-cased, each as 32 bits of its XXH64; of few words, all as one."""
    words = raw.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    at = [0, *accumulate(len(w) + 1 for w in words)]
    parts = [joined[a : b - 1] for a, b in zip(at, at[shingle:], strict=False)] or [joined]
    return np.unique(np.fromiter((digest(x, SEED) & 0xFFFFFFFF for x in parts), np.uint32, len(parts)).view(np.int32))


def similar(pairs: DataFrame, least: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b of fingerprints whose texts' five-word shingles have a Jaccard similarity of 0.8 or more.

    ``least`` has a row key k for each fp, ``texts`` k and text. Only texts of a pair are split into shingles.
    """

    @F.pandas_udf("array<int>")
    def shingle_sets(some: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(bytes(x)) for x in some], dtype="object")

    pairs = materialize(pairs.distinct(), "pairs")
    wanted = materialize(least.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi"), "wanted")
    sets = texts.join(wanted, "k").groupBy("fp").agg(F.first("text").alias("text"))
    sets = materialize(sets.select("fp", shingle_sets(utf8(F.col("text"))).alias("s")), "sets")
    x, y = sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), sets.select(F.col("fp").alias("b"), F.col("s").alias("y"))
    part, whole = SIMILAR
    sizes = whole * F.least(F.size("x"), F.size("y")) >= part * F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    found = pairs.join(x, "a").join(y, "b").where(sizes).withColumn("common", common)
    return materialize(found.where(whole * F.col("common") >= part * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b"), "similar")


def links(fps: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links a, b that connect exactly what all pairs of fingerprints within ``max_bits`` connect, or those of these
    pairs that ``check`` keeps.

    ``fps`` has each fp once, with n, how many documents have it.
    """
    n, both = bit_counts(fps)
    groups = group_bits(n, both, parts)
    limits = thresholds(n, both, groups, max_bits)
    masks = [signed(sum(1 << b for b in g)) for g in groups]

    hubs, stars = fps, None
    for k, mask in enumerate(masks):
        key = F.col("fp").bitwiseAND(F.lit(mask))
        top = fps.groupBy(key.alias("key")).agg(F.max_by("fp", F.struct("n", "fp")).alias(f"hub{k}"))
        hubs = hubs.withColumn("key", key).join(top, "key").drop("key")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col(f"hub{k}"))) <= max_bits
        hubs = hubs.withColumn(f"hub{k}", F.when(near, F.col(f"hub{k}")))
    names = [f"hub{k}" for k in range(parts)]
    hubs = materialize(hubs, "hubs")
    stars = hubs.select(F.col("fp").alias("a"), F.explode(F.array(*names)).alias("b")).where("b IS NOT NULL AND a <> b")
    if check is None:
        hubs = hubs.withColumn("hub", F.coalesce(*names, "fp"))
    else:  # the hub is one that passed, else the fingerprint itself
        stars = check(stars)
        hubs = hubs.join(stars.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("hub")), "fp", "left")
        hubs = materialize(hubs.select("fp", F.coalesce("hub", "fp").alias("hub")), "hubs")

    index = probes = None
    for k, (group, limit) in enumerate(zip(groups, limits, strict=True)):
        if limit < 0:
            continue
        held = flipped(hubs, group, limit // 2).select(F.lit(k).alias("part"), "key", F.col("fp").alias("b"), F.col("hub").alias("hub_b"))
        asked = flipped(hubs, group, limit - limit // 2).select(F.lit(k).alias("part"), "key", F.col("fp").alias("a"), F.col("hub").alias("hub_a"))
        index = held if index is None else index.unionByName(held)
        probes = asked if probes is None else probes.unionByName(asked)
    verified = (F.col("a") < F.col("b")) & (F.col("hub_a") != F.col("hub_b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # no partition has more held keys than probes
    i = index.alias("i")
    pairs = probes.alias("p").join(i, (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & verified)
    pairs = pairs.select("a", "b")
    return stars.unionByName(pairs if check is None else check(pairs)).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    rows = materialize(fingerprints(id_and_text(docs), "text", shingle).select("doc_id", "fp"), "fingerprints")
    return _components(rows, max_bits)


def _components(rows: DataFrame, max_bits: int, parts: int = PARTS, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds component_id to written rows with doc_id and fp."""
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(fps, max_bits, parts, check))
    rooted = materialize(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp")


def drop_near_duplicates(docs: DataFrame, max_bits: int = FILTER_BITS, parts: int = FILTER_PARTS, shingle: int = SHINGLE) -> DataFrame:
    """The documents, all columns, that name their component: one of each group stays, that with the smallest doc_id.

    Groups are connected by pairs within ``max_bits`` whose five-word shingles have a Jaccard similarity of 0.8 or more.
    Texts of one fingerprint count as copies; the least row key among them stands for all. Of rows that repeat a doc_id
    with another text in one group, all stay; exact repeats of a row become one.
    """
    d = id_and_text(docs).withColumn("k", row_key(F.col("doc_id"), F.col("text")))
    rows = materialize(fingerprints(d, "text", shingle).select("doc_id", "k", "fp"), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("k").alias("k"))
    found = _components(rows, max_bits, parts, lambda pairs: similar(pairs, least, d.select("k", "text")))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("k").distinct()
    keyed = packed(docs).withColumn("k", row_key(F.col("row.doc_id").cast("long"), F.col("row.text")))
    return unpacked(keyed.join(keep, "k", "left_semi").dropDuplicates(["k"]), docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
