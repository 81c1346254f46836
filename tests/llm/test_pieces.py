import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import pieces as P

BLOB = open(P.model_path(), "rb").read()
CODEC, LIB = P.Codec(BLOB), sentencepiece.SentencePieceProcessor(model_proto=BLOB)
TEXT = st.text(st.one_of(st.sampled_from(" \n\tabcdeéß▁.,0'’中"), st.characters(exclude_categories=["Cs"])), max_size=60)


def check(text):
    raw = text.encode()
    ids, said, decoded = CODEC.encode(raw)
    want = LIB.encode(text)
    assert ids.tolist() == want and said == " ".join(map(str, want))
    full = [*want, LIB.eos_id()]
    assert decoded == LIB.decode(full) == CODEC.decode(full)
    a, b = CODEC.spans(raw, ids)
    if len(ids):  # spans follow each other and cover the text
        assert a[0] == 0 and b[-1] == len(raw) and (a[1:] == b[:-1]).all()
        for k, i, j in zip(ids.tolist(), a, b, strict=True):
            piece = raw[i:j].decode(errors="replace")
            if k not in CODEC.bytes_of and "▁" not in text:
                assert CODEC.pieces[k].replace("▁", " ") in (piece, " " + piece)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_ids_text_and_offsets_as_the_library(text):
    check(text)


def test_long_and_odd_texts():
    for text in ["", " ", "  ", "a  b", " a", "a ", "\n", "a\n\nb c\n", "▁", "x▁y", "\0", "abc" * 3000, "é" * 100, "word " * 5000, "🙂 🙃", "　 全角", "aaaa" * 40 + " " * 40 + "b"]:
        check(text)


def test_both_ways_to_merge_agree():
    for text in ["▁internationalization", "aaaaaaaaaa", "▁▁▁▁▁▁", "Donaudampfschifffahrt"]:
        assert CODEC._merge_short(text) == CODEC._merge_long(text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_map_against_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for dummy, squeeze in ((True, True), (False, False), (True, False)):
        norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
        spec = pb.ModelProto()
        spec.ParseFromString(BLOB)
        other = pb.ModelProto()
        other.ParseFromString(norm.serialized_model_proto())
        spec.normalizer_spec.CopyFrom(other.normalizer_spec)
        spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.escape_whitespaces = dummy, squeeze, True
        codec = P.Codec(spec.SerializeToString())
        for text in ["Ａｂｃ  ①② ﬁne ", "  café é ㍿", "ｶﾞ​ x\ty", "plain", "İß"]:
            got, where = codec.normalize(text.encode())
            want, offsets = norm.Normalize(text, with_offsets=True)
            assert got.decode() == want, (rule, text)
            assert len(where) == len(got) + 1 and (np.diff(where) >= 0).all()
            starts = np.cumsum([0, *(len(c.encode()) for c in text)])
            at = np.cumsum([0, *(len(c.encode()) for c in want)])[:-1]
            assert [int(np.searchsorted(starts, where[i])) for i in at] == list(offsets)[: len(want)]


def test_query(spark):
    texts = ["one two", None, "", "one two", "käse \n" * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in P.digest(docs).collect()}
    for i, t in enumerate(texts):
        ids = LIB.encode(t or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    e = {r.doc_id: r for r in P.encode(docs).collect()}
    assert e[0].ids == LIB.encode("one two", add_eos=True) and e[0].starts[:2] == [0, 3] and e[0].ends[-1] == 7
    assert P.digest(docs.limit(0)).count() == 0
