import hashlib
import zlib

import pytest

from tessel.llm import media as M


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, n_bytes string, feature string")


def test_round_trip_and_tables():
    for n in (1, 191, 192, 193, 192 * 32, 192 * 32 + 1, 192 * 100 + 5):
        payload = M.pad(bytes(i % 251 for i in range(n)))
        raw = M.write_media(payload)
        (t,) = M.read_media(raw)
        assert M.samples(raw, t) == payload
        assert t["codec"] == "raw " and t["n_samples"] == len(payload) // 192 == t["duration"]
        assert [raw[a:b] for a, b in t["keyframes"]] == [payload[i : i + 192] for i in range(0, len(payload), 192 * 12)]


def test_broken_files():
    raw = M.write_media(M.pad(b"x"))
    for bad in (b"", raw[:-5], raw[:40], b"\0\0\0\7abcd", raw.replace(b"stts", b"sttx")):
        with pytest.raises(M.MediaError):
            M.read_media(bad)


def test_fragments():
    import struct

    raw = M.write_media(M.pad(b"abc"))
    tail = b"0123456789"
    def moof(shift):
        run = M.full(b"trun", struct.pack(">Ii", 2, shift), struct.pack(">II", 4, 0), struct.pack(">II", 6, 0x10000), flags=0x601)
        return M.box(b"moof", M.box(b"traf", M.full(b"tfhd", struct.pack(">II", 1, 3), flags=8), run))
    raw += moof(len(moof(0)) + 8) + M.box(b"mdat", tail)
    (t,) = M.read_media(raw)
    assert M.samples(raw, t).endswith(tail) and t["n_samples"] == 3 and t["n_keyframes"] == 2 and t["duration"] == 7


def test_query_against_plain_digests(spark):
    texts = ["", None, "a", "ä" * 500, "x" * 192, "long " * 20000, "a"]
    out = {r.doc_id: r for r in M.digest(M.store_texts(rows(spark, [(i, t, "c", "d") for i, t in enumerate(texts)]))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert out[2][1:] == out[6][1:] and out[0][1:] == out[1][1:]
    assert M.digest(M.store_texts(rows(spark, []))).count() == 0


def test_media_columns_take_broken_files(spark):
    df = spark.createDataFrame([(1, bytearray(M.write_media(M.pad(b"x")))), (2, bytearray(b"junk")), (3, None)], "id int, f binary")
    got = {r.id: r.media_info for r in M.media_columns(df, "f").collect()}
    assert got[1].codec == "raw " and got[1].n_samples == 1 and got[2].codec is None and got[3].codec is None


def test_counts_and_depths_of_broken_files(spark):
    import struct
    import zlib

    nested = b""
    for _ in range(3000):
        nested = M.box(b"moov", nested)
    good = M.write_media(M.pad(b"some text"))
    huge = good.replace(struct.pack(">II", M.FRAME, 1) + struct.pack(">I", 36)[:0], struct.pack(">II", M.FRAME, 0xF0000000), 1)
    moof = M.box(b"moof", M.box(b"traf", M.full(b"tfhd", struct.pack(">I", 1)), M.full(b"trun", struct.pack(">I", 0xF0000000))))
    for raw in (nested, huge, good + moof, good[:100], b"", b"x" * 50):
        assert zlib.crc32(raw) >= 0
        with __import__("pytest").raises(M.MediaError):
            M.read_media(raw)
    rows = M.media_columns(spark.createDataFrame([(1, bytearray(nested), "q"), (2, bytearray(good), "q")], "id long, f binary, media_info string"), "f").collect()
    assert {r.id: (r.media_info, r.media_info_2.codec) for r in rows} == {1: ("q", None), 2: ("q", "raw ")}
