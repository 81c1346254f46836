"""Removal of long strings that start in a document with a smaller id too, by suffix arrays of candidate text.

Every ``MIN``-byte string is anchored at its least-hashed gram of ``GRAM`` bytes, so equal strings have equal anchors
at equal places in them. The documents are first written once, each row with the number of its part (the task that
wrote it), which all later passes read; how Spark splits the files for a pass does not matter.

1. Anchors' hashes with the documents that have them are dealt out to buckets by hash; those that two documents have
   are shared. Only they go on, filed by part.
2. The surroundings of shared anchors, as far as a string around the anchor can reach, are classes of equal text,
   told by hashes beside that of the anchor. Each block sends a class once, with the smallest document that has it; the
   answer is the smallest of all blocks, and whether the anchor has other classes. All strings of a class start in its
   smallest document, so the others lose them.
3. Where classes of an anchor differ, each class is sent as text by the parts of its smallest document alone. Hashes of
   strings tell which could be equal; the suffixes of the text around those, each different piece once, are sorted
   together by grouping. Neighbours in that order with equal first ``MIN`` bytes are equal strings, and their
   smallest document decides.
4. Removed stretches of each document are joined and cut out.

An anchor in more than ``HOT`` documents counts as many: its strings are classes of their own and are dealt out by
their own hashes, so one frequent gram doesn't gather in one bucket. A hot string is sent once a block, so its rows
grow with the blocks and not with the documents that hold it, and no pairs are made. Strings are judged on the input.
Blocks are ``BLOCK`` bytes of whole documents.

Defined results: a null text is empty; texts under ``MIN`` bytes keep everything; rows of equal doc_id never count as
smaller than each other; a null doc_id is the smallest; repeated rows each get a result; other columns are not read; an
empty table gives no rows. What a pass filed for a part and another can't find raises an error.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from numpy.lib.stride_tricks import sliding_window_view
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_and_text, utf8, work_dir
from .suffixes import sorted_suffixes

MIN, GRAM = 50, 16
GRAMS = MIN - GRAM + 1
#: An anchor's surroundings: bytes before it and from it on that a string with it can have.
LEFT, RIGHT = MIN - GRAM, MIN
WIDTH = LEFT + RIGHT
#: Bytes of documents in a block, and of all documents to a bucket.
BLOCK, BUCKET_BYTES = 32_000_000, 16_000_000
#: Places hashed together, anchors looked at together, and classes settled together.
CHUNK, ANCHORS, SLICE = 1 << 16, 100_000, 50_000
#: How hard packed numbers are compressed; bits of an anchor's hash in its bucket, and of the hash of its surroundings.
LEVEL, TAG_BITS, NAME_BITS = 5, 28, 48
#: Bits of a class's name by which a part looks it up in a bucket, if they tell all the part's classes there apart.
SHORT_BITS = 40
#: Documents with an anchor from which on its strings are dealt out singly.
HOT = 200_000
M1, M2, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x100000001B3)
NO_ID = -(2**63)


def _extreme(a: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """The least or greatest of each window, by doubling."""
    size = 1
    while size * 2 <= width:
        a, size = f(a[:-size], a[size:]), size * 2
    rest = width - size
    return f(a[: len(a) - rest], a[rest:]) if rest else a


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data.data, strides=(1,))


class Block:
    """Some documents of one part: their ids, bytes joined, and where each starts (and the last ends)."""

    def __init__(self, part: int, ids: np.ndarray, data: np.ndarray, starts: np.ndarray):
        self.part, self.ids, self.data, self.starts = part, ids, data, starts

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of all strings, in order of place."""
        data, grams = self.data, len(self.data) - GRAM + 1
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        ends = self.starts[1:]
        # windows that start less than MIN bytes before their document's end hold no string
        for c in range(0, max(0, grams), CHUNK):
            lo, hi = max(0, c - GRAMS + 1), min(grams, c + CHUNK + GRAMS - 1)
            words = _words(np.ascontiguousarray(data[lo : hi + GRAM - 1]))
            n = hi - lo
            if n < GRAMS:
                break
            full = gram_hash(words[:n], words[8 : 8 + n])
            h = np.maximum((full >> np.uint64(32)).astype(np.uint32), 1)
            least = _extreme(h, GRAMS, np.minimum)
            near = ends[np.searchsorted(ends, lo) : np.searchsorted(ends, lo + len(least) + MIN)]
            gone = (near[:, None] - np.arange(1, MIN)).ravel() - lo
            least[gone[(gone >= 0) & (gone < len(least))]] = 0
            edge = np.zeros(GRAMS - 1, np.uint32)
            at = np.flatnonzero(_extreme(np.concatenate([edge, least, edge]), GRAMS, np.maximum) == h)
            at = at[(at + lo >= c) & (at + lo < c + CHUNK)]
            places.append(at + lo)
            hashes.append(full[at])
        return np.concatenate(places), np.concatenate(hashes)

    @cached_property
    def padded(self) -> np.ndarray:
        """The bytes, with room for the surroundings of the first and last anchors."""
        return np.concatenate([np.zeros(LEFT, np.uint8), self.data, np.zeros(RIGHT, np.uint8)])

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    """Blocks of rows (part, doc_id, raw) that follow each other."""
    for batch in batches:
        part, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "doc_id"))
        raw = batch.column("raw").cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
            other = np.flatnonzero(part[a:b] != part[a])
            b = a + int(other[0]) if len(other) else b
            yield Block(int(part[a]), ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Numbers as bytes: differences where they are sorted, like bytes beside each other, compressed."""
    if delta and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, kind: str, delta: bool = False) -> np.ndarray:
    n, kind = int.from_bytes(blob[:8], "little"), np.dtype(kind)
    planes = np.frombuffer(pa.decompress(blob[8:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if delta else values


def groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different key with the places that have it, in their order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    for k, a, z in zip(found.tolist(), first, [*first[1:], len(order)], strict=True):
        yield k, order[a:z]


class Filed:
    """What was filed for a part by an earlier step, read once while its blocks follow each other."""

    def __init__(self, folder: str, columns: dict[str, tuple[str, bool]]):
        self.folder, self.columns, self.part, self.held = folder, columns, None, []

    def rows(self, part: int) -> list[dict]:
        if part != self.part:
            where, path = fs.FileSystem.from_uri(self.folder)
            path = posixpath.join(path, f"part={part}")
            if where.get_file_info(path).type != fs.FileType.Directory:
                raise RuntimeError(f"nothing is filed for part {part} in {self.folder}")
            files = sorted(f.path for f in where.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
            rows = [r for f in files for r in pq.read_table(f, filesystem=where, partitioning=None).to_pylist()]
            self.part, self.held = part, [{c: unpack(r[c], *self.columns[c]) if c in self.columns else r[c] for c in r} for r in rows]
        return self.held

    def joined(self, part: int) -> dict[str, np.ndarray]:
        rows = self.rows(part)
        return {c: np.concatenate([r[c] for r in rows]) for c in self.columns}


KEY = np.dtype([("h", "<u8"), ("lo", "u1"), ("hi", "u1"), ("around", f"V{WIDTH}")])
SENT = np.dtype([("lo", "u1"), ("hi", "u1"), ("around", f"V{WIDTH}")])


def tag_of(h: np.ndarray) -> np.ndarray:
    """What tells an anchor within its bucket."""
    return (h & np.uint64(2**TAG_BITS - 1)).astype(np.uint32)


def gram_hash(words: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Hashes of grams from their first and last eight bytes."""
    h = (words * M1) ^ ((later + np.uint64(12345)) * M2)
    h ^= h >> np.uint64(31)
    h *= M1
    h ^= h >> np.uint64(29)
    return h


def keys_of(sent: np.ndarray) -> np.ndarray:
    """Keys with their anchors' hashes."""
    out = np.zeros(len(sent), KEY)
    for c in SENT.names:
        out[c] = sent[c]
    gram = np.ascontiguousarray(np.frombuffer(sent["around"].tobytes(), np.uint8).reshape(-1, WIDTH)[:, LEFT : LEFT + GRAM]).view("<u8")
    out["h"] = gram_hash(gram[:, 0], gram[:, -1])
    return out


def with_tag(low: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Names from their low bits and tags, which are the bits above."""
    return low | tag.astype(np.uint64) << np.uint64(NAME_BITS)


def short_name(names: np.ndarray, bucket: np.ndarray, bits: int) -> np.ndarray:
    """Some bits of names, with their bucket above."""
    return names & np.uint64(2**bits - 1) | bucket << np.uint64(bits)


def names_of(keys: np.ndarray) -> np.ndarray:
    """Hashes of keys with some bits of the anchor's tag above."""
    around = np.zeros((len(keys), -(-WIDTH // 8) * 8), np.uint8)
    around[:, :WIDTH] = np.frombuffer(keys["around"].tobytes(), np.uint8).reshape(-1, WIDTH)
    h = (keys["h"] ^ (keys["lo"].astype(np.uint64) << np.uint64(8)) ^ keys["hi"].astype(np.uint64)) * M1
    for word in around.view("<u8").T:
        h = (h ^ (h >> np.uint64(32)) ^ word) * M2
    h ^= h >> np.uint64(29)
    h *= M1
    return with_tag((h ^ (h >> np.uint64(32))) & np.uint64(2**NAME_BITS - 1), tag_of(keys["h"]))


def surroundings(block: Block, at: np.ndarray, h: np.ndarray, single: np.ndarray | None = None) -> np.ndarray:
    """Per anchor its key: hash, the least and most bytes that a string can have before it, and the bytes around it.

    Where ``single`` is not negative, the key is that of the one string with so many bytes before the anchor.
    """
    row = block.row_of(at)
    start, end = block.starts[row], block.starts[row + 1]
    out = np.zeros(len(at), KEY)
    out["h"], out["hi"], out["lo"] = h, np.minimum(at - start, LEFT), np.maximum(MIN - (end - at), 0)
    around = np.ndarray((len(block.data) + 1,), f"V{WIDTH}", block.padded.data, strides=(1,))[at].view(np.uint8).reshape(-1, WIDTH)
    first, last = start - at + LEFT, end - at + LEFT
    if single is not None:
        one = single >= 0
        out["hi"][one] = out["lo"][one] = single[one]
        first, last = np.where(one, LEFT - single, first), np.where(one, LEFT - single + MIN, last)
    place, cut = np.arange(WIDTH), np.flatnonzero((first > 0) | (last < WIDTH))
    around[cut] *= (place >= first[cut, None]) & (place < last[cut, None])
    out["around"] = around.view(f"V{WIDTH}").ravel()
    return out


class Finder:
    """Looks up numbers among different sorted ones. Those are hashes, so that high bits lead near to each."""

    def __init__(self, known: np.ndarray):
        n, bits = len(known), int(known[-1]).bit_length() if len(known) else 0
        self.size, self.known = n, np.append(known, np.uint64(2**64 - 1))
        self.shift = np.uint64(max(0, bits - n.bit_length()))
        self.first = np.searchsorted(known, np.arange(int(known[-1] >> self.shift) + 2 if n else 1, dtype=np.uint64) << self.shift).astype(np.int32)
        self.even = n == 0 or int(np.diff(self.first).max()) <= 32

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each number is, and whether it is there."""
        if self.even:
            at = self.first[np.minimum(asked >> self.shift, np.uint64(len(self.first) - 1))].astype(np.int64)
            live = np.flatnonzero(self.known[at] < asked)
            while len(live):
                at[live] += 1
                live = live[self.known[at[live]] < asked[live]]
        else:
            at = np.searchsorted(self.known[: self.size], asked)
        found = (at < self.size) & (self.known[at] == asked)
        return np.where(found, at, 0), found


class Shared:
    """A block's shared anchors, some at a time: place, key, name and bucket of each, and whether it is a string of a hot one."""

    def __init__(self, filed: Filed, buckets: int):
        self.filed, self.buckets, self.part, self.known, self.hot = filed, buckets, None, None, None

    def bucket_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def place_of(self, h: np.ndarray) -> np.ndarray:
        """Bucket and tag as one number."""
        return (self.bucket_of(h).astype(np.uint64) << np.uint64(TAG_BITS)) | tag_of(h).astype(np.uint64)

    def _look(self, part: int) -> None:
        rows = self.filed.rows(part)
        known = np.concatenate([(np.uint64(r["bucket"]) << np.uint64(TAG_BITS)) | r["tag"].astype(np.uint64) for r in rows])
        known, first = np.unique(known, return_index=True)
        self.known = Finder(known)
        self.hot, self.part = np.concatenate([r["hot"] for r in rows]).astype(bool)[first], part

    def __call__(self, block: Block) -> Iterator[tuple[np.ndarray, ...]]:
        if block.part != self.part:
            self._look(block.part)
        at, h = block.anchors()
        i, hit = self.known(self.place_of(h))
        at, h, hot = at[hit], h[hit], self.hot[i[hit]]
        row = block.row_of(at)
        lo = np.maximum(MIN - (block.starts[row + 1] - at), 0)
        n = np.where(hot, np.minimum(at - block.starts[row], LEFT) - lo + 1, 1)
        ends, z = np.cumsum(n), 0
        while z < len(at):
            a, z = z, max(z + 1, int(np.searchsorted(ends, ends[z] - n[z] + ANCHORS, "right")))
            p, x, many = at[a:z], h[a:z], hot[a:z]
            single = np.full(len(p), -1)
            if many.any():
                each = n[a:z]
                back = np.repeat(np.arange(len(p)), each)
                single = np.where(many[back], lo[a:z][back] + np.arange(len(back)) - np.repeat(np.cumsum(each) - each, each), -1)
                p, x = p[back], x[back]
            keys = surroundings(block, p, x, single)
            names = names_of(keys)
            yield p, keys, names, self.bucket_of(np.where(single < 0, x, names)), single >= 0


def ends_of(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the smallest and of the greatest id with each different name, in the order of names."""
    order = np.lexsort((ids, names))
    sorted_names = names[order]
    new = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1], [True]]) if len(names) else np.zeros(1, bool)
    return order[new[:-1]], order[new[1:]]


def least_of(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different name, a place that has it, and the smallest id with it."""
    first, _ = ends_of(names, ids)
    return names[first], first, ids[first]


def settle(keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For classes of some anchors: class, lo and hi of runs of strings that start in a smaller document too.

    keys has each class once and least its smallest document. Anchors are taken some at a time.
    """
    order = np.argsort(keys["h"], kind="stable")
    h = keys["h"][order]
    out = [(np.zeros(0, np.int64),) * 3]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
    many = order[np.repeat(np.diff(edges) > 1, np.diff(edges))] if len(h) else order
    h, at = keys["h"][many], 0
    while at < len(many):
        end = int(np.searchsorted(h, h[min(at + SLICE, len(many)) - 1], "right"))
        out.append(_settle(keys, least, many[at:end]))
        at = end
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _settle(keys: np.ndarray, least: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    # which strings could be equal: equal hashes within the anchor's classes
    k = keys[many]
    around = np.frombuffer(k["around"].tobytes(), np.uint8).reshape(-1, WIDTH)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(WIDTH, BASE, np.uint64)]))
    hashes = np.empty((LEFT + 1, len(many)), np.uint64)
    for a in range(0, len(many), CHUNK):
        some = around[a : a + CHUNK]
        sums = np.zeros((len(some), WIDTH + 1), np.uint64)
        np.cumsum((some + np.uint64(1)) * powers[:-1], axis=1, out=sums[:, 1:])
        hashes[:, a : a + CHUNK] = (sums[:, MIN : MIN + LEFT + 1] - sums[:, : LEFT + 1]).T[::-1]
    could = np.zeros((len(many), LEFT + 1), bool)
    for s in range(LEFT + 1):
        ok = np.flatnonzero((k["lo"] <= s) & (s <= k["hi"]))
        w = hashes[s, ok] * M1 ^ k["h"][ok] * M2
        in_order = np.sort(w)
        twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
        if len(twice):
            could[ok, s] = twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w
    # the text of each run of such strings, each different text once
    padded = np.pad(could, ((0, 0), (1, 1)))
    c, lo = np.nonzero(padded[:, 1:-1] & ~padded[:, :-2])
    c2, hi = np.nonzero(padded[:, 1:-1] & ~padded[:, 2:])
    texts: dict[bytes, int] = {}
    flat = around.tobytes()
    text_of = np.array([texts.setdefault(flat[x * WIDTH + LEFT - b : x * WIDTH + LEFT - a + MIN], len(texts)) for x, a, b in zip(c.tolist(), lo.tolist(), hi.tolist(), strict=True)], np.int64)
    if not len(c):
        return none, none, none
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, text_of, least[many[c]])
    starts, smallest = equal_strings(list(texts), low)
    # back to the classes: the string at place j of a run has hi - j bytes before the anchor
    size = hi - lo + 1
    run = np.repeat(np.arange(len(c)), size)
    j = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    gone = smallest[starts[text_of[run]] + j] < least[many[c[run]]]
    s = hi[run] - j
    name = many[c[run]][gone]
    s = s[gone]
    cut = np.concatenate([[True], (name[1:] != name[:-1]) | (s[1:] != s[:-1] - 1)]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:] - 1, [len(s) - 1]]) if len(s) else first
    return name[first], s[last], s[first]


def equal_strings(texts: list[bytes], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's strings start in the answer, and per string the least ``low`` of texts that hold it.

    The texts' suffixes that start with a string are sorted by grouping.
    """
    sizes = np.array([len(t) for t in texts])
    counts = sizes - MIN + 1
    heads = np.cumsum(counts) - counts
    symbols = np.zeros((len(texts), max(MIN, int(sizes.max(initial=0)))), np.uint8)
    symbols[np.arange(symbols.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    text, place = sorted_suffixes(symbols, sizes, MIN)
    windows = sliding_window_view(symbols, MIN, axis=1)
    same = np.zeros(len(text), bool)
    for a in range(1, len(text), ANCHORS):
        z = min(a + ANCHORS, len(text))
        same[a:z] = (windows[text[a:z], place[a:z]] == windows[text[a - 1 : z - 1], place[a - 1 : z - 1]]).all(1)
    group = np.cumsum(~same) - 1
    best = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(best, group, low[text])
    out = np.empty(len(text), np.int64)
    out[heads[text] + place] = best[group]
    return heads, out


def joined(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each row in order, those that overlap or touch made one; places grow with the rows."""
    if not len(a):
        return row, a, b
    order = np.argsort(a, kind="stable")
    row, a, most = row[order], a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], (a[1:] > most[:-1]) | (row[1:] != row[:-1])]))
    return row[new], a[new], most[np.concatenate([new[1:] - 1, [len(a) - 1]])]


def cut_out(block: Block, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Result rows of a block without the stretches a..b of its documents."""
    row, a, b = joined(row, a, b)
    edges = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(block.data)]])
    keep = np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges))
    left = block.starts - np.concatenate([[0], np.cumsum(b - a)])[np.searchsorted(row, np.arange(len(block.ids) + 1))]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block.ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(block.data[keep])])
    spans = pa.StructArray.from_arrays([pa.array(a - block.starts[row]), pa.array(b - block.starts[row])], names=["start", "end"])
    each = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(block.ids) + 1)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(np.diff(block.starts)), each, kept.cast(pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def table(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if c in ("part", "bucket", "full") else pa.binary() for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=columns)


def by_bucket(batches: Iterator[pa.RecordBatch], columns: dict[str, tuple[str, bool]]) -> Iterator[tuple[int, list[int], dict[str, list[np.ndarray]]]]:
    """The rows of a task's buckets: bucket, the part of each row, and its columns unpacked."""
    rows: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            rows.setdefault(r["bucket"], []).append(r)
    for bucket in sorted(rows):
        held = rows.pop(bucket)
        yield bucket, [r["part"] for r in held], {c: [unpack(r[c], *how) for r in held] for c, how in columns.items()}


def answers(parts: list[int], *per_row: list[np.ndarray]) -> Iterator[tuple]:
    """Per part the arrays of its rows, joined."""
    at: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        at.setdefault(p, []).append(i)
    for p, rows in at.items():
        yield (p, *[np.concatenate([x[i] for i in rows]) for x in per_row])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed stretches, joined) and kept (the other bytes)."""
    spark = docs.sparkSession
    home = work_dir(spark, "repeats")
    d = id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), utf8(F.col("text")).alias("raw"))
    d = d.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "raw")
    d.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(f"{home}/documents")
    d = spark.read.schema("part long, doc_id long, raw binary").parquet(f"{home}/documents")
    size = d.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets, hot_from, most, short_bits = max(1, -(-int(size) // BUCKET_BYTES)), HOT, BLOCK, SHORT_BITS

    tags, classes, told = {"tag": ("<u4", True), "n": ("<u2", False)}, {"tag": ("<u4", True), "low": ("<u8", False), "least": ("<i8", False), "sole": ("u1", False)}, {"key": ("<u1", False), "least": ("<i8", False)}
    shared_files, class_files, run_files = ({"tag": ("<u4", True), "hot": ("u1", False)}, {"name": ("<u8", True), "least": ("<i8", False), "many": ("u1", False)}, {"name": ("<u8", True), "lo": ("u1", False), "hi": ("u1", False)})

    def dealt(df: DataFrame, meet: Callable, columns: str, name: str) -> None:
        """Rows of one bucket meet in one task; what comes of them is filed by part."""
        met = df.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(meet, f"part long, {columns}")
        met.repartition("part").write.partitionBy("part").option("compression", "none").parquet(f"{home}/{name}")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Shared(None, buckets)
        for block in blocks(batches, most):
            at, h = block.anchors()
            full = find.place_of(h)
            order = np.argsort(full, kind="stable")
            full, row = full[order], block.row_of(at[order])
            other = np.concatenate([[True], full[1:] != full[:-1]]) if len(full) else np.zeros(0, bool)
            new = np.flatnonzero(other)
            docs_with = (other | np.concatenate([[True], row[1:] != row[:-1]])).astype(np.int64) if len(full) else new
            n = np.minimum(np.add.reduceat(docs_with, new) if len(full) else new, 65535).astype("<u2")
            bucket, tag = (full[new] >> np.uint64(TAG_BITS)).astype(np.int64), tag_of(full[new])
            rows = [(block.part, k, pack(tag[i], True), pack(n[i])) for k, i in groups(bucket)]
            rows.append((block.part, block.part % buckets, pack(tag[:0], True), pack(n[:0])))
            yield table(rows, ["part", "bucket", "tag", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts, x in by_bucket(batches, tags):
            every = np.concatenate(x["tag"])
            known, back = np.unique(every, return_inverse=True)
            total = np.bincount(back, np.concatenate(x["n"]), len(known))
            keep, hot, out = (total > 1)[back], (total > hot_from)[back], []
            ends = np.cumsum([len(t) for t in x["tag"]])
            places = [np.arange(e - len(t), e) for e, t in zip(ends, x["tag"], strict=True)]
            for part, i in answers(parts, places):
                tag, first = np.unique(every[i[keep[i]]], return_index=True)
                out.append((part, bucket, pack(tag, True), pack(hot[i[keep[i]]][first].astype("u1"))))
            yield table(out, ["part", "bucket", "tag", "hot"])

    text = d.select("part", "doc_id", "raw")
    dealt(text.mapInArrow(hashes, "part long, bucket long, tag binary, n binary"), shared, "bucket long, tag binary, hot binary", "shared")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Shared(Filed(f"{home}/shared", shared_files), buckets)
        for block in blocks(batches, most):
            got = [(keys["h"], names, block.ids[block.row_of(at)], bucket) for at, keys, names, bucket, _ in find(block)]
            h, every, ids, bucket = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(4))
            every = every.astype("<u8")
            first, last = ends_of(every, ids)
            names, least, sole = every[first], ids[first], ids[first] == ids[last]
            tag = tag_of(h[first].astype(np.uint64))
            order = np.lexsort((names, tag))
            names, tag, least, sole, bucket = names[order], tag[order], least[order], sole[order].astype("u1"), bucket[first][order]
            low = names & np.uint64(2**NAME_BITS - 1)
            rows = [(block.part, k, pack(tag[i], True), pack(low[i]), pack(least[i]), pack(sole[i])) for k, i in [*groups(bucket), (block.part % buckets, order[:0])]]
            yield table(rows, ["part", "bucket", "tag", "low", "least", "sole"])

    def leasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per part the names whose strings it may lose or must send: with the smallest document, the least number where
        all of the part's documents come after it, and whether the anchor has other classes."""
        for bucket, parts, x in by_bucket(batches, classes):
            tag, own, sole = (np.concatenate(x[c]) for c in ("tag", "least", "sole"))
            every = with_tag(np.concatenate(x["low"]), tag)
            order = np.lexsort((own, every, tag))
            new = np.concatenate([[True], (every[order][1:] != every[order][:-1]) | (tag[order][1:] != tag[order][:-1])]) if len(order) else order
            cls = np.empty(len(order), np.int64)
            cls[order] = np.cumsum(new) - 1
            least, tags_of = own[order[new.astype(bool)]], tag[order[new.astype(bool)]]
            _, group, n = np.unique(tags_of, return_inverse=True, return_counts=True)
            many = (n[group] > 1)[cls]
            ends = np.cumsum([len(t) for t in x["tag"]])
            places = [np.arange(e - len(t), e) for e, t in zip(ends, x["tag"], strict=True)]
            out = []
            for part, i in answers(parts, places):
                i = i[np.lexsort((own[i], every[i]))]
                head = np.flatnonzero(np.concatenate([[True], every[i][1:] != every[i][:-1]])) if len(i) else i
                alone = (np.diff(np.append(head, len(i))) == 1) & (sole[i[head]] == 1)
                i = i[head]
                late = own[i] > least[cls[i]]
                told_least = np.where(late, NO_ID, least[cls[i]])
                keep = late | many[i] | ~alone
                name = every[i] & np.uint64(2**short_bits - 1)
                full = int(len(np.unique(name)) < len(name))
                name = every[i][keep] if full else name[keep]
                order = np.argsort(name)
                out.append((part, bucket, full, pack(name[order], True), pack(told_least[keep][order]), pack(many[i][keep][order].astype("u1"))))
            yield table(out, ["part", "bucket", "full", "name", "least", "many"])

    dealt(text.mapInArrow(firsts, "part long, bucket long, tag binary, low binary, least binary, sole binary"), leasts, "bucket long, full long, name binary, least binary, many binary", "classes")

    class Known:
        """Which documents of a block lose all strings of their classes, and which classes must be sent."""

        def __init__(self) -> None:
            self.filed, self.part = Filed(f"{home}/classes", class_files), None

        def _look(self, part: int) -> None:
            rows, self.by = self.filed.rows(part), []
            for full in (0, 1):
                mine = [r for r in rows if r["full"] == full]
                names = [r["name"] if full else short_name(r["name"], np.uint64(r["bucket"]), short_bits) for r in mine] or [np.zeros(0, np.uint64)]
                names, (least, many) = np.concatenate(names), (np.concatenate([r[c] for r in mine] or [np.zeros(0, np.int64)]) for c in ("least", "many"))
                order = np.argsort(names, kind="stable")
                self.by.append((Finder(names[order]), least[order], many[order].astype(bool), np.unique([r["bucket"] for r in mine])))
            self.part = part

        def __call__(self, part: int, names: np.ndarray, buckets_of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if part != self.part:
                self._look(part)
            late, send = np.zeros(len(names), bool), np.zeros(len(names), bool)
            for full, (known, least, many, here) in enumerate(self.by):
                at = np.flatnonzero(np.isin(buckets_of, here))
                if known.size and len(at):
                    asked = names[at] if full else short_name(names[at], buckets_of[at].astype(np.uint64), short_bits)
                    i, found = known(asked)  # the others' only document is their smallest, and their anchor has no other class
                    late[at] = found & (ids[at] > least[i])
                    send[at] = found & many[i]
            return late, send & ~late

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = Shared(Filed(f"{home}/shared", shared_files), buckets), Known()
        for block in blocks(batches, most):
            held: dict[str, list] = {"keys": [np.zeros(0, KEY)], "least": [np.zeros(0, np.int64)], "bucket": [np.zeros(0, np.int64)], "names": [np.zeros(0, np.uint64)]}
            for at, keys, names, bucket, single in find(block):
                ids = block.ids[block.row_of(at)]
                _, many = known(block.part, names, bucket, ids)
                mine = np.flatnonzero(many & ~single)
                mine = mine[least_of(names[mine], ids[mine])[1]]
                for c, v in (("keys", keys), ("least", ids), ("bucket", bucket), ("names", names)):
                    held[c].append(v[mine])
            keys, least, bucket, names = (np.concatenate(held[c]) for c in ("keys", "least", "bucket", "names"))
            _, first, _ = least_of(names, least)
            first = first[np.argsort(keys["h"][first], kind="stable")]
            keys, least, bucket = keys[first], least[first], bucket[first]
            sent = np.zeros(len(keys), SENT)
            for c in SENT.names:
                sent[c] = keys[c]
            rows = [(block.part, k, pack(sent[i].view("u1")), pack(least[i])) for k, i in groups(bucket)]
            rows.append((block.part, block.part % buckets, pack(np.zeros(0, "u1")), pack(least[:0])))
            yield table(rows, ["part", "bucket", "key", "least"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts, x in by_bucket(batches, told):
            every = keys_of(np.frombuffer(np.concatenate(x["key"]).tobytes(), SENT))
            name = names_of(every)
            names, first, least = least_of(name, np.concatenate(x["least"]))
            found, lo, hi = settle(every[first], least)
            order = np.argsort(found, kind="stable")
            found, lo, hi = found[order], lo[order], hi[order]
            place_of = Finder(names)
            runs, ends = np.searchsorted(found, np.arange(len(names) + 1)), np.cumsum([len(t) for t in x["least"]])
            places = [np.arange(e - len(t), e) for e, t in zip(ends, x["least"], strict=True)]
            out = []
            for part, i in answers(parts, places):
                c = np.unique(place_of(name[i])[0])
                n = runs[c + 1] - runs[c]
                r = np.repeat(runs[c], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out.append((part, pack(np.repeat(names[c], n), True), pack(lo[r].astype("u1")), pack(hi[r].astype("u1"))))
            yield table(out, ["part", "name", "lo", "hi"])

    dealt(text.mapInArrow(heads, "part long, bucket long, key binary, least binary"), meet, "name binary, lo binary, hi binary", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, filed, part = Shared(Filed(f"{home}/shared", shared_files), buckets), Known(), Filed(f"{home}/runs", run_files), None
        for block in blocks(batches, most):
            if block.part != part:
                x, part = filed.joined(block.part), block.part
                order = np.argsort(x["name"], kind="stable")
                name, lo, hi = (x[c][order] for c in ("name", "lo", "hi"))
                name, begin, times = np.unique(name, return_index=True, return_counts=True)
                name = Finder(name)
            rows, a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def add(row: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
                rows.append(row)
                a.append(at - high)
                b.append(at - low + MIN)

            for at, keys, names, bucket, _ in find(block):
                row = block.row_of(at)
                late, _ = known(part, names, bucket, block.ids[row])
                add(row[late], at[late], keys["lo"][late].astype(np.int64), keys["hi"][late].astype(np.int64))
                i, found = name(names[~late])
                i, at, row = i[found], at[~late][found], row[~late][found]
                first, n = begin[i], times[i]
                r = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                add(np.repeat(row, n), np.repeat(at, n), lo[r].astype(np.int64), hi[r].astype(np.int64))
            yield cut_out(block, *(np.concatenate(v) for v in (rows, a, b)))

    out = text.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
