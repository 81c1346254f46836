import zlib

import numpy as np

from tessel.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = L.identify(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    known = {x[0] for x in lang.values()}
    assert all((r.lang_pred in known) != (r.lang_pred == "und") and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in test]) > 0.95
    assert np.mean([r.rejected for r in test]) < 0.05


def test_predictor_sums_as_features_do():
    rng = np.random.default_rng(0)
    rows = [(("x", "y")[k % 2], *L.features(("abc abd abe " if k % 2 else "uvw uvx ") * (k + 1)), k % 5 == 0) for k in range(40)]
    m = L.fit(rows)
    p = L.Predictor(m)
    for text in ["abc uvw Äb abd", "uvx uvx " * 9000, "q"]:
        at, share = L.features(text)
        want = L.softmax((share @ m.rows[at] + m.bias) / m.temperature)
        ((lang, score, _),) = p([text.encode()])
        assert lang == m.langs[int(want.argmax())] and abs(score - want.max()) < 1e-4
    assert p([None, "12 3.4 ²".encode()]) == [("und", 0.0, True)] * 2 and p([]) == [] and rng is not None


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string"
    data = [(i, t, g, "s", "p") for i, (t, g) in enumerate([("der die das und " * 5, "de"), ("the and of to " * 5, "en")] * 12)]
    data += [(100, None, "de", None, None), (101, "", None, None, None), (None, "the of and", "en", None, None), (3, data[3][1], "en", "s", "p")]
    docs = spark.createDataFrame(data, schema)
    got = L.identify(docs).collect()
    assert len(got) == len(data) and {r.lang_pred for r in got if r.doc_id in (100, 101)} == {"und"}
    kept = L.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (100, 101)").count() == 0 and kept.count() >= 24
    nothing = spark.createDataFrame([(1, "abc", None, "", "")], schema)
    assert [r.lang_pred for r in L.identify(nothing).collect()] == ["und"]
    assert L.identify(docs.limit(0)).count() == 0
