"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's words (runs of letters, lower-cased) give subwords: the word in angle brackets and its 2- to 4-grams,
each hashed to one of ``BUCKETS`` embeddings. The mean over all subwords of the whole text goes through a linear
softmax. Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded sample:
about ``PER_LANG`` labelled documents a language, chosen by a hash of doc_id; a fifth of them fit a temperature
and the score, one half at most, below which a prediction is rejected, so that no more than ``REJECT`` of right ones go.
Only text and lang of the sample are learned from; a prediction sees the text alone.

After training, a bucket's embedding times the softmax weights is one row of logits, so predicting sums rows; each
task keeps the sums of tokens it has seen, up to ``CACHE`` tokens.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; without any labelled
row all texts are; a null doc_id is never held out and never learned from; repeated rows get equal results; other
columns keep their values whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, packed, unpacked

BITS, DIM, GRAMS, MIX = 14, 16, (2, 3, 4), np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 2**BITS
PER_LANG, EPOCHS, RATE, REJECT = 600, 6, 2.0, 0.001
#: Tokens kept, and tokens of a text looked up at once.
CACHE, BLOCK = 200_000, 20_000


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words in a text, and where in the text each one's word starts."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    is_letter = np.concatenate([[False], letters()[codes], [False]])
    edges = np.flatnonzero(is_letter[1:] != is_letter[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.cumsum(sizes + 2) - sizes - 2  # each word stands between two marks
    run = np.repeat(np.arange(len(starts)), sizes + 2)
    seq = np.full(len(run), ord(">"), np.uint64)
    seq[heads] = ord("<")
    inside = np.repeat(heads + 1 - starts, sizes)
    at = np.flatnonzero(is_letter[1:-1])
    seq[at + inside] = codes[at]
    place = np.arange(len(run)) - heads[run]
    powers = np.cumprod(np.full(int(sizes.max()) + 2, MIX, np.uint64))
    found, owner = [np.add.reduceat(seq * powers[place], heads)], [np.arange(len(starts))]
    h = seq
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * MIX + seq[n - 1 :]
        if n in GRAMS:
            whole = run[n - 1 :] == run[: 1 - n]
            found.append(h[whole] + np.uint64(n))
            owner.append(run[: 1 - n][whole])
    h = np.concatenate(found)
    return (((h ^ h >> np.uint64(29)) * MIX) >> np.uint64(64 - BITS)).astype(np.int64), starts[np.concatenate(owner)]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of the text's subwords."""
    at, _ = grams(text.lower())
    sums = np.bincount(at, minlength=1)
    hit = np.flatnonzero(sums)
    return hit.astype(np.int32), (sums[hit] / max(1, len(at))).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    rows: np.ndarray  # BUCKETS x languages: logits of each bucket
    bias: np.ndarray
    temperature: float
    least: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, bool]]) -> Model | None:
    """Trains on (language, buckets, shares, for calibration) and calibrates on the rows so marked."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    y = {lang: k for k, lang in enumerate(langs)}
    rng = np.random.default_rng(11)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    train = [r for r in rows if not r[3]] or rows
    steps = EPOCHS * len(train)
    for step in range(steps):
        if step % len(train) == 0:
            order = rng.permutation(len(train))
        lang, at, share, _ = train[order[step % len(train)]]
        h = share @ emb[at]
        g = softmax(h @ w + b)
        g[y[lang]] -= 1
        rate = RATE * (1 - step / steps)
        back = w @ g
        w -= rate * np.outer(h, g)
        b -= 0.1 * rate * g
        emb[at] -= (rate * 20 * share)[:, None] * back
    table = emb @ w
    held = [r for r in rows if r[3]] or rows
    z = np.stack([share @ table[at] + b for _, at, share, _ in held])
    want = np.array([y[r[0]] for r in held])
    temps = np.geomspace(0.25, 8, 41)
    temperature = float(min(temps, key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), want], 1e-12)).mean()))
    p = softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == want]
    # some hundred scores hardly tell so low a quantile: beyond an even chance it would reject more right ones than REJECT
    least = float(min(0.5, np.quantile(right, REJECT))) if len(right) else 0.0
    return Model(langs, table.astype(np.float32), b, temperature, least)


class Predictor:
    """Sums logits over a text's tokens between white space, keeping those of tokens and grams it has seen."""

    def __init__(self, model: Model):
        self.m, self.seen = model, {}
        self.sums = np.zeros((CACHE, len(model.langs) + 1), np.float32)

    def learn(self, tokens: list[str]) -> None:
        """Keeps the sums of tokens, all at once."""
        at, where = grams(" ".join(tokens))
        ends = np.cumsum([len(t) + 1 for t in tokens])
        token = np.searchsorted(ends, where, "right")
        first = len(self.seen)
        sums, rows = self.sums[first : first + len(tokens)], self.m.rows[at]
        for k in range(rows.shape[1]):
            sums[:, k] = np.bincount(token, rows[:, k], len(tokens))
        sums[:, -1] = np.bincount(token, minlength=len(tokens))
        self.seen.update(zip(tokens, range(first, first + len(tokens)), strict=True))

    def totals(self, blocks: list[list[str]]) -> np.ndarray:
        """The sums of each block's tokens; together the blocks have fewer tokens than are kept."""
        flat = list(chain.from_iterable(blocks))
        if len(self.seen) + len(flat) > CACHE:
            self.seen.clear()
        get = self.seen.get
        at = [get(t, -1) for t in flat]
        if -1 in at:
            self.learn(list(dict.fromkeys([t for t, k in zip(flat, at, strict=True) if k < 0])))
            at = [get(t) for t in flat]
        n = np.array([len(b) for b in blocks])
        return np.add.reduceat(self.sums[at].astype(np.float64), np.cumsum(n) - n, axis=0)

    def __call__(self, raws: Sequence[bytes | None]) -> list[tuple[str, float, bool]]:
        total = np.zeros((len(raws), len(self.m.langs) + 1))
        blocks, owners, held = [], [], 0
        for k, text in enumerate(map(text_of, raws)):
            if text is None or not any(map(str.isalpha, text)):
                continue
            tokens = text.lower().split()
            for i in range(0, len(tokens), BLOCK):
                blocks.append(tokens[i : i + BLOCK])
                owners.append(k)
                held += len(blocks[-1])
                if held >= BLOCK:
                    np.add.at(total, owners, self.totals(blocks))
                    blocks, owners, held = [], [], 0
        if blocks:
            np.add.at(total, owners, self.totals(blocks))
        p = softmax((total[:, :-1] / np.maximum(total[:, -1:], 1) + self.m.bias) / self.m.temperature)
        best = p.argmax(1)
        return [(self.m.langs[k], float(q[k]), bool(q[k] < self.m.least)) if n else ("und", 0.0, True) for k, q, n in zip(best, p, total[:, -1], strict=True)]


def text_of(raw: bytes | None) -> str | None:
    return None if raw is None else bytes(raw).decode("utf-8", "replace")


def train(docs: DataFrame, may_learn: Column, per_lang: int = PER_LANG) -> Model | None:
    """Fits on about ``per_lang`` rows of each language where ``may_learn`` holds; docs has doc_id, text and lang.

    Counts by language cover all rows and choose the share of each to sample. The tasks turn whole texts into at most
    BUCKETS shares each, so what reaches the driver is bounded by per_lang, BUCKETS and the number of languages.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    u = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, math.ceil(1e6 * per_lang / n)))])
    picked = rows.where(u < share[F.col("lang")]).select("doc_id", "lang", F.col("text").cast("binary").alias("raw"), (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) == 0).alias("held"))

    def featured(frames):
        for pdf in frames:
            f = [features(text_of(x)) for x in pdf["raw"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "held": pdf["held"], "b": [x[0].tobytes() for x in f], "s": [x[1].tobytes() for x in f]})

    got = picked.mapInPandas(featured, "doc_id long, lang string, held boolean, b binary, s binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang, r.b, r.s))
    return fit([(r.lang, np.frombuffer(r.b, np.int32), np.frombuffer(r.s, np.float32), r.held) for r in got])


def predict(df: DataFrame, text: str, model: Model | None) -> DataFrame:
    """Adds lang_pred, score and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS times the number of languages

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        predictor = Predictor(m) if m is not None else None  # what it keeps goes when the task ends
        for raws in batches:
            out = predictor(raws) if predictor else [("und", 0.0, True)] * len(raws)
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    columns = df.columns
    return df.withColumn("said", each(F.col(text).cast("binary"))).select(*columns, "said.*")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected; learns from labelled rows that are not held out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(d, ~held_out())
    return predict(d.select("doc_id", held_out().alias("held_out"), "text"), "text", model).drop("text")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language the model does not reject."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), ~held_out())
    got = predict(packed(docs), "row.text", model)
    return unpacked(got.where(~F.col("rejected")), docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
