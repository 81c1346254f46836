"""Media columns: texts kept as ISO media files, and a reader that walks boxes and sample tables.

``write_media`` stores a payload as uncompressed 8-bit grey frames of 16 x 12 pixels, 192 bytes each, in
``ftyp``, ``mdat`` and ``moov`` boxes. ``read_media`` walks the nested boxes of any such file, decodes the
sample tables (``stsd stts stsc stsz/stz2 stco/co64 stss``) and fragments (``moof/traf/trun``), and gives
codec, time scale, duration and the byte ranges of keyframes. It never decodes a sample.

Defined results: a null or empty text is a payload of 192 spaces; equal texts give equal bytes; a file that
ends early, whose boxes do not fit into each other or nest deeper than ``DEPTH``, or whose counts are greater than the
bytes there can hold, raises ``MediaError`` in ``read_media`` and gets a null codec in ``media_columns``; no count is
believed before it is held against the size of its box or of the file. ids, repeated rows and empty tables need nothing
special; what ``media_columns`` adds has the first free name of media_info, media_info_2 and so on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_and_text, utf8

FRAME, WIDTH, HEIGHT = 192, 16, 12
#: Boxes in boxes at most: moov, trak, mdia, minf, stbl and what they hold are six deep.
DEPTH = 16
#: Frames to a chunk, frames from one keyframe to the next, and frames a second of what is written.
CHUNK_FRAMES, KEY_EVERY, FPS = 32, 12, 25
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """The bytes are not a readable ISO media file."""


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    if n > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, n + 8) + b"".join(parts)
    return struct.pack(">I4s", n, kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """Appends spaces up to a positive multiple of a frame."""
    return payload + b" " * ((-len(payload)) % FRAME if payload else FRAME)


def write_media(payload: bytes) -> bytes:
    """The payload, a multiple of 192 bytes, as a file; the media data come before the tables, so offsets are fixed."""
    frames = len(payload) // FRAME
    if not payload or frames * FRAME != len(payload):
        raise MediaError("the payload must be a positive multiple of 192 bytes")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    data = box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    chunks = -(-frames // CHUNK_FRAMES)
    offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK_FRAMES)
    keys = np.arange(1, frames + 1, KEY_EVERY)
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1),
        bytes(32), struct.pack(">Hh", 40, -1),
    )
    where = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if offsets[-1] > 0xFFFFFFFF else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, frames, 1)),
        full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, frames)),
        where,
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FPS, frames, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, FPS, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return head + data + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first and last byte of the content of each box between start and end."""
    at = start
    while at < end:
        if end - at < 8:
            raise MediaError(f"a box of fewer than 8 bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise MediaError(f"no room for a large size at {at}")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise MediaError(f"box {kind!r} at {at} does not fit")
        yield kind, at + head, at + size
        at += size


def tree(data: memoryview, start: int, end: int, depth: int = 1) -> dict[bytes, list]:
    """Boxes by kind: (start, end, children), children only where boxes nest."""
    if depth > DEPTH:
        raise MediaError(f"boxes more than {DEPTH} deep")
    out: dict[bytes, list] = {}
    for kind, a, b in walk(data, start, end):
        out.setdefault(kind, []).append((a, b, tree(data, a, b, depth + 1) if kind in CONTAINERS else {}))
    return out


def _table(data: memoryview, at: tuple, kind: str, skip: int = 4) -> np.ndarray:
    """The entries that follow a count, which follows version and flags."""
    a, b, _ = at
    n = struct.unpack_from(">I", data, a + skip)[0]
    width = np.dtype(kind).itemsize
    if a + skip + 4 + n * width > b:
        raise MediaError("a sample table is longer than its box")
    return np.frombuffer(data, kind, n, a + skip + 4)


def _stts(data: memoryview, stbl: dict, n: int) -> int:
    runs = _table(data, stbl[b"stts"][0], ">u4,>u4") if b"stts" in stbl else np.zeros(0, ">u4,>u4")
    if int(runs["f0"].astype(np.int64).sum()) != n:
        raise MediaError("stts counts other samples than stsz")
    return int((runs["f0"].astype(np.int64) * runs["f1"].astype(np.int64)).sum())


def _sizes(data: memoryview, stbl: dict) -> np.ndarray:
    if b"stsz" in stbl:
        a = stbl[b"stsz"][0][0]
        one, n = struct.unpack_from(">II", data, a + 4)
        if one and one * n > len(data):
            raise MediaError("stsz counts more bytes than there are")
        return np.full(n, one, np.int64) if one else _table(data, stbl[b"stsz"][0], ">u4", 8).astype(np.int64)
    a, b, _ = stbl[b"stz2"][0]
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits not in (4, 8, 16) or (n * bits + 7) // 8 > b - a - 12:
        raise MediaError("stz2 is longer than its box")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, {8: ">u1", 16: ">u2"}[bits], n, a + 12).astype(np.int64)


def _offsets(data: memoryview, stbl: dict, sizes: np.ndarray) -> np.ndarray:
    """Where each sample starts: chunk offsets, then sizes summed within the chunk."""
    chunks = _table(data, stbl[b"co64"][0], ">u8") if b"co64" in stbl else _table(data, stbl[b"stco"][0], ">u4")
    chunks, runs = chunks.astype(np.int64), _table(data, stbl[b"stsc"][0], ">u4,>u4,>u4")
    first = np.append(runs["f0"].astype(np.int64) - 1, len(chunks))
    if len(runs) and (first[0] != 0 or (np.diff(first) < 0).any()):
        raise MediaError("stsc does not count up through the chunks")
    per = np.repeat(runs["f1"].astype(np.int64), np.maximum(np.diff(first), 0))
    if len(per) != len(chunks) or int(per.sum()) != len(sizes):
        raise MediaError("stsc, stco and stsz disagree")
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    heads = np.concatenate([[0], np.cumsum(per)])[:-1]
    return np.repeat(chunks - before[heads], per) + before if len(sizes) else np.zeros(0, np.int64)


def _fragments(data: memoryview, top: list, track: int) -> tuple[list[int], list[int], list[bool], int]:
    """Offsets, sizes and keyframe marks of the samples in fragments, and their duration."""
    starts, sizes, keys, lasts = [], [], [], 0
    for base, moof in top:
        for _, _, traf in moof.get(b"traf", []):
            a = traf[b"tfhd"][0][0]
            flags, this = struct.unpack_from(">II", data, a)
            if this != track:
                continue
            at, known = a + 8, {}
            for bit, name, kind in ((1, "base", ">Q"), (2, "desc", ">I"), (8, "dur", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
                if flags & bit:
                    known[name] = struct.unpack_from(kind, data, at)[0]
                    at += struct.calcsize(kind)
            place = known.get("base", base)
            for a, b, _ in traf.get(b"trun", []):
                flags, n = struct.unpack_from(">II", data, a)
                at = a + 8
                each = 4 * sum(bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800))
                if n * each > b - at or not each and n * known.get("size", 0) > len(data) or not each and not known.get("size") and n > len(data):
                    raise MediaError("trun counts more samples than there can be")
                if flags & 1:
                    place, at = known.get("base", base) + struct.unpack_from(">i", data, at)[0], at + 4
                first = None
                if flags & 4:
                    first, at = struct.unpack_from(">I", data, at)[0], at + 4
                for i in range(n):
                    row = {"dur": known.get("dur", 0), "size": known.get("size", 0), "flags": known.get("flags", 0)}
                    for bit, name in ((0x100, "dur"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")):
                        if flags & bit:
                            row[name], at = struct.unpack_from(">I", data, at)[0], at + 4
                    mark = first if i == 0 and first is not None else row["flags"]
                    starts.append(place)
                    sizes.append(row["size"])
                    keys.append(not mark & 0x10000)
                    place, lasts = place + row["size"], lasts + row["dur"]
    return starts, sizes, keys, lasts


def ranges(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, those that touch joined."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut - 1, [len(ends) - 1]])].tolist(), strict=True))


def read_media(raw: bytes) -> list[dict]:
    """Per track: codec, width, height, timescale, duration, n_samples, samples (starts and ends), keyframes (ranges)."""
    data = memoryview(raw)
    try:
        top = list(walk(data, 0, len(data)))
        moov = next((tree(data, a, b) for kind, a, b in top if kind == b"moov"), None)
        moofs = [(a - 8, tree(data, a, b)) for kind, a, b in top if kind == b"moof"]
    except struct.error as e:
        raise MediaError(str(e)) from e
    if moov is None:
        raise MediaError("no moov box")
    out = []
    try:
        for _, _, trak in moov.get(b"trak", []):
            mdia = trak[b"mdia"][0][2]
            stbl = mdia[b"minf"][0][2][b"stbl"][0][2]
            a = mdia[b"mdhd"][0][0]
            scale = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
            a = trak[b"tkhd"][0][0]
            track = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
            a, b, _ = stbl[b"stsd"][0]
            kind, at, _ = next(walk(data, a + 8, b))
            width, height = struct.unpack_from(">HH", data, at + 24)
            sizes = _sizes(data, stbl)
            starts = _offsets(data, stbl, sizes)
            key = np.ones(len(sizes), bool)
            if b"stss" in stbl:
                key[:] = False
                key[_table(data, stbl[b"stss"][0], ">u4").astype(np.int64) - 1] = True
            duration = _stts(data, stbl, len(sizes))
            more = _fragments(data, moofs, track)
            starts, sizes = np.concatenate([starts, np.array(more[0], np.int64)]), np.concatenate([sizes, np.array(more[1], np.int64)])
            key = np.concatenate([key, np.array(more[2], bool)])
            ends = starts + sizes
            if len(ends) and (ends.max() > len(data) or starts.min() < 0):
                raise MediaError("a sample lies outside the file")
            out.append({
                "codec": kind.decode("latin-1"), "width": width, "height": height, "timescale": scale, "duration": duration + more[3],
                "n_samples": len(sizes), "starts": starts, "ends": ends, "keyframes": ranges(starts[key], ends[key]), "n_keyframes": int(key.sum()),
            })
    except (KeyError, IndexError, struct.error, StopIteration, ValueError, OverflowError) as e:
        raise MediaError(str(e)) from e
    return out


def samples(raw: bytes, track: dict) -> bytes:
    """The stored bytes of all samples in order, as they are."""
    return b"".join(raw[a:b] for a, b in ranges(track["starts"], track["ends"]))


MEDIA = "codec string, width int, height int, timescale long, duration long, n_samples long, n_keyframes long, keyframes array<struct<start:long,end:long>>"


def media_columns(df: DataFrame, media: str) -> DataFrame:
    """Adds a struct, ``media_info``, of the first track of each file in binary column ``media``; nulls where it can't be read."""

    @F.pandas_udf(MEDIA)
    def info(files: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in MEDIA.split(", ")]
        rows = []
        for raw in files:
            try:
                found = read_media(bytes(raw)) if raw is not None else []
            except MediaError:
                found = []
            t = found[0] if found else {}
            rows.append([[{"start": a, "end": b} for a, b in t["keyframes"]] if n == "keyframes" and t else t.get(n) for n in names])
        return pd.DataFrame(rows, columns=names)

    taken, name, k = {c.lower() for c in df.columns}, "media_info", 2
    while name in taken:
        name, k = f"media_info_{k}", k + 1
    return df.withColumn(name, info(F.col(media)))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a media file."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda raw: write_media(pad(bytes(raw))))

    d = id_and_text(docs).select("doc_id", utf8(F.col("text")).alias("raw"))
    return d.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), stored("raw").alias("media"))


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, keyframes array<struct<start:long,end:long>>"


def digest(stored: DataFrame) -> DataFrame:
    """What the stored files say: payload and its digests as read back, and a feature text from the sample tables."""

    def each(raw: bytes) -> tuple:
        t = read_media(raw)[0]
        payload = samples(raw, t)
        keys = t["keyframes"]
        first, last = (keys[0], keys[-1]) if keys else (None, None)
        feature = f"{t['codec'].strip()} {t['width']}x{t['height']} duration={t['duration']}/{t['timescale']} samples={t['n_samples']} keyframes={t['n_keyframes']} first={first[0]}-{first[1]} last={last[0]}-{last[1]}"
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature,
            t["codec"], t["duration"], [{"start": a, "end": b} for a, b in keys],
        )

    @F.pandas_udf(DIGEST)
    def read(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([each(bytes(raw)) for raw in files], columns=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", read("media").alias("m")).select("doc_id", "n_bytes", "m.*")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store_texts(documents(spark, sf_dir)))
