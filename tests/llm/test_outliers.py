import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessel.llm import outliers as O

WS = r"[\x20\x09-\x0D]"


def plain(text):
    text = text or ""
    words = [w for w in re.split(WS + "+", text) if w]
    seen, lines, dup = set(), [x for x in text.split("\n") if re.sub(WS, "", x)], 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in O.SYMBOLS for c in text), dup, len(covered), len(lines)


def brute(rows):
    """d2 of each row that passes, by numpy: rows are (lang, source, statistics)."""
    x = {}
    for k, (_, _, s) in enumerate(rows):
        n, chars, sym, dup, rep, lines = s
        if n >= 50 and 100 * rep <= 50 * n:
            x[k] = np.array([math.log1p(n), chars / n, math.sqrt(sym / max(chars, 1)), math.sqrt(dup / max(lines, 1)), math.sqrt(rep / n)])
    floor2 = np.array([O.FLOOR[d] ** 2 for d in O.DIMS])
    sizes, langs = Counter(rows[k][:2] for k in x), Counter(rows[k][0] for k in x)
    def group(k):
        lang, source = rows[k][:2]
        return (lang, source) if sizes[lang, source] >= O.MIN_GROUP else (lang,) if langs[lang] >= O.MIN_GROUP else ()
    members = defaultdict(list)
    for k in x:
        for g in ((rows[k][:2]), (rows[k][0],), ()):
            members[g].append(x[k])
    def klass(v):
        return np.floor(np.log2(np.maximum(v, O.LEAST)) * O.CLASSES)
    def cut(d2, percent):
        c = np.sort(klass(d2))
        return c[math.ceil(len(c) * percent / 100) - 1]
    def dist(v, m, cov):
        z = np.linalg.solve(np.linalg.cholesky(cov), (v - m).T)
        return (z * z).sum(0)
    def low_median(v):
        return np.sort(v, axis=0)[math.ceil(len(v) / 2) - 1]
    out, est = {}, {}
    for k in x:
        g = group(k)
        if g not in est:
            v = np.array(members[g])
            def of(some):
                return some.mean(0), np.cov(some.T, bias=True) + np.diag(floor2)
            def step(m, cov):
                d2 = dist(v, m, cov)  # noqa: B023
                return of(v[klass(d2) <= cut(d2, O.KEEP_PERCENT)])  # noqa: B023
            mid = low_median(v)
            wide = np.sqrt((1.4826 * low_median(np.abs(v - mid))) ** 2 + floor2)
            starts = [(mid, np.diag(wide**2)), of(mid + wide * np.tanh((v - mid) / wide)), of(v)]
            for _ in range(O.FIRST_STEPS):
                starts = [step(*s) for s in starts]
            m, cov = min(starts, key=lambda s: np.linalg.slogdet(s[1])[1])
            for _ in range(O.MAX_STEPS):
                new = step(m, cov)
                if not np.linalg.slogdet(new[1])[1] < np.linalg.slogdet(cov)[1] - O.FALL:
                    break
                m, cov = new
            est[g] = m, cov, max(1.0, 2 ** ((cut(dist(v, m, cov), 50) + 0.5) / O.CLASSES) / O.CHI2_MEDIAN)
        m, cov, scale = est[g]
        out[k] = dist(x[k][None, :], m, cov)[0] / scale
    return out


def texts(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    return ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 15))) for _ in range(rng.randrange(8, 40))) for _ in range(n)]


def test_statistics_against_plain(spark):
    rng = random.Random(5)
    odd = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "\n".join(["same line here"] * 9), "a\x0bb\x0cc  d\r\n", "# $ % <a|b>", "ä ö ü " * 40, "w " * 3000]
    odd += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r for r in O.statistics(docs).collect()}
    for i, t in enumerate(odd):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == plain(t), t
        n, *_ = s = plain(t)
        assert r.base_failed == (n < 50 or 100 * s[4] > 50 * n)


def test_distances_against_numpy(spark):
    rows = [(i, t, "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 40}", "x") for i, t in enumerate(texts(500, 6))]
    rows += [(1000 + i, "# $ % & <> | " * 40, "en", "hot", "x") for i in range(12)] + [(1100 + i, "unbelievablylongwordsagain " * 3 + t, "en", "hot", "x") for i, t in enumerate(texts(3, 7))]
    rows += [(2000, None, None, None, "x"), (2001, texts(1, 8)[0], None, None, "x"), (None, texts(1, 9)[0], "en", "hot", "x"), (5, rows[5][1], rows[5][2], rows[5][3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, d2 string")
    out = O.quality(docs).collect()
    assert len(out) == len(rows)
    want = brute([(r[2] or "", r[3] or "", plain(r[1])) for r in rows])
    got = {r.doc_id: r for r in out}
    for k, r in enumerate(rows):
        d2 = got[r[0]].d2
        assert (d2 is None) == (k not in want) and (d2 is None or abs(d2 - want[k]) < 1e-6 * max(1, want[k])), (r[0], d2, want.get(k))
    assert not any(got[1000 + i].kept for i in range(12)) and sum(got[i].kept for i in range(500)) >= 495


def test_empty_and_constant(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert O.quality(docs).count() == 0
    same = spark.createDataFrame([(i, "word%d " % i + " ".join(f"w{k}" for k in range(80)), "en", "s") for i in range(100)], docs.schema)
    assert O.quality(same).where(F.col("kept")).count() == 100


def test_an_outlier_in_each_statistic(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    lines = lambda n, size=10, chars=5: [" ".join(word(chars) for _ in range(size)) for _ in range(n)]
    clean = ["\n".join(lines(rng.randrange(15, 40))) for _ in range(300)]
    again = " ".join(lines(6)).split()  # 60 words that come twice, in lines that never do
    planted = {
        "log_words": "\n".join(lines(1500)),
        "word_length": "\n".join(lines(25, chars=9)),
        "symbols": "\n".join(x + " #$%" for x in lines(25)),
        "dup_lines": "\n".join(x + "\nsame" for x in lines(25)),
        "repeats": "\n".join([" ".join(again[i : i + 10]) for i in range(0, 60, 10)] + lines(15) + [" ".join(again[i : i + 7]) for i in range(0, 60, 7)]),
    }
    rows = [(i, t, "en", "s") for i, t in enumerate([*clean, *planted.values()])]
    out = {r.doc_id: r for r in O.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in out.values())
    assert {d for i, d in enumerate(planted) if out[len(clean) + i].kept} == set()
    assert sum(out[i].kept for i in range(len(clean))) >= 290


def test_least_determinant_of_all_subsets(spark):
    """Small groups with outliers: no subset of three quarters of the vectors has a smaller determinant."""
    rng = np.random.default_rng(3)
    floor2 = np.diag([O.FLOOR[d] ** 2 for d in O.DIMS])
    scale = np.array([3, 2, 0.4, 1.5, 1.5])
    groups = {}
    for g in ("a", "b"):
        v = rng.normal(0, 1, (16, 5)) * scale
        v[12:] += np.array([[90, 0, 0, 0, 0], [0, 80, 5, 0, 0], [-70, 0, 0, 60, 0], [0, 0, 9, 0, -80]]) * (1 if g == "a" else -1)
        groups[g] = v
    rows = [(g, i % O.SALTS, *map(float, x)) for g, v in groups.items() for i, x in enumerate(v)]
    fit = spark.createDataFrame(rows, "grp string, salt int, " + ", ".join(f"{d} double" for d in O.DIMS))
    got = {r.grp: r for r in O.mcd(fit).collect()}
    for g, v in groups.items():
        least = min(np.linalg.slogdet(np.cov(v[list(c)].T, bias=True) + floor2)[1] for c in combinations(range(16), 12))
        assert got[g].logdet <= least + 1e-6
        assert np.allclose([got[g][f"m_{d}"] for d in O.DIMS], v[:12].mean(0))
