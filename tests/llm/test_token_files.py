import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessel.llm import token_files as T
from tessel.llm._common import work_dir

LIB = Tokenizer.from_file(T.tokenizer_path())  # as loaded
ENC = T.Encoder(open(T.tokenizer_path(), "rb").read())
SIGN = st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\u00a0\u1680\u2003\u202f\u3000abc1!é's<|>"), st.characters(exclude_categories=["Cs"]))
TEXT = st.text(SIGN, max_size=50) | st.lists(st.sampled_from(["the", "word,", "it's", "'.", "a.b", "é.", "3.5", "(x)", "\n\nz", "q\n", "—.", "!'ll", "_a", "ŉ!", "\n\n\n", "\u00a0", "\u2003", "", "<|endoftext|>", "x<|endoftext|>", "<|endof"]), max_size=12).map(" ".join)


def encoded(encoder, texts):
    raws = [t.encode() for t in texts]
    ids, n = encoder.encode(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def library(texts):
    return [[*LIB.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@settings(max_examples=1000, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_as_the_library(texts):
    assert encoded(ENC, texts) == library(texts)


def test_words_joined_for_the_library(monkeypatch):
    monkeypatch.setattr(T, "JOINED", 3)
    monkeypatch.setattr(T, "KEPT", 10)
    monkeypatch.setattr(T, "KEPT_BYTES", 6)
    texts = ["one two three four", " 's 'll it's '", "one\x00two \x00 x", "<|endoftext|> a  b\n c ", "x " * 100, "\n\n\n\n", "\n", "a\n\n b"] * 2
    for k in range(len(texts)):
        assert encoded(ENC, texts[k:]) == library(texts[k:])


@pytest.mark.parametrize("file_ids", [50, T.FILE_IDS])
def test_files_round_trip(spark, monkeypatch, file_ids):
    monkeypatch.setattr(T, "FILE_IDS", file_ids)
    monkeypatch.setattr(T, "TASK_BYTES", 2000)
    texts = [None, "", "hello world " * 40, "ä b", "x", "same", "same", "tail " * 100]
    rows = [(i * 3, texts[i % len(texts)], "q") for i in range(40)] + [(None, "lost id", "q"), (6, "another six", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    folder = work_dir(spark, "files")
    index = T.write_files(docs, folder, length=16, batch_rows=3)
    got = T.read_files(index, folder).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    for i, t, _ in order:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    # sequences: equal length, masks false only at the end of a file, no copies
    names = [r.file for r in index.select("file").distinct().collect()]
    assert len(names) > 1
    for name in names:
        f = T.FileReader(folder, name)
        n = sum(r.n_tokens for r in index.where(f"file = '{name}'").collect())
        count = int(f.ends[-1]) // f.length
        masks = []
        for k in range(count):
            ids, mask = f.sequence(k)
            assert len(ids) == 16 and not ids.flags.owndata
            masks += mask.to_pylist()
        assert sum(masks) == n and masks == [True] * n + [False] * (len(masks) - n) and len(masks) - n < 16


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = work_dir(spark, "none")
    assert T.read_files(T.write_files(docs, folder), folder).count() == 0


def test_added_tokens_as_the_library_loads_them(spark):
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f" {end} ", f"one {end}two  {end}{end}\n three", f"{end[:-1]} {end[1:]}", "a b c", f"it's{end}.\n\n{end} x ", "word, it's (x) <|end|> of text"]
    want = library(texts)
    assert want[0] == [64, 50256, 65, 2]
    for _ in range(2):  # the second time from kept words
        assert encoded(ENC, texts) == want
    folder = work_dir(spark, "added")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in T.read_files(T.write_files(docs, folder), folder).collect()}
    for i, ids in enumerate(want):
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
