"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Fixed rules come first: too few words, or too many of them inside repeated three-word windows. The documents that
pass give transformed statistic vectors, and each language and source its own minimum-covariance-determinant
estimate. Three starts (medians and median deviations; mean and covariance of vectors drawn in towards the medians;
those of all vectors) take ``FIRST_STEPS`` concentration steps each: the documents with the least Mahalanobis distances,
``KEEP_PERCENT`` of each group, give the next mean and covariance. The start with the least determinant goes on until its
determinant falls no more, ``MAX_STEPS`` at most. That covariance is scaled so that its median distance is that of a
chi-squared variable, and a document further out than ``CUTOFF`` is rejected. Groups of fewer than ``MIN_GROUP`` documents
use their language's estimate, and languages of fewer the estimate of all.

All steps are aggregations with map-side partial sums, and documents meet their group's estimate by a salt beside the
group, so a source with a third of all rows costs no more than any other; the least distances are found through counts in narrow classes, not by sorting. The inverse is a Cholesky
factorisation, written out as column expressions over one row a group.

Repeated windows are found inside a document's row: a window is hashed to 64 bits from its words' 64-bit hashes, the
pairs of hash and place are sorted, and equal neighbours are repeats. Nothing is exploded or shuffled for it.

Defined results: a null or empty text has no words and fails; a null language or source is a group of its own;
equal rows get equal results; a statistic that hardly varies in a group counts with a least spread, so near-constant
groups reject nobody for noise; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WS, WS_CLASS, documents, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_PERCENT, FIRST_STEPS, MAX_STEPS, MIN_GROUP = 75, 2, 20, 60
#: Parts of a group's documents in joins with its estimate, and the fall of a determinant's logarithm that counts.
SALTS, FALL = 16, 1e-6
#: The 99.9 % quantile of chi-squared with as many degrees as DIMS, beyond which a squared distance is rejected, and its median.
CUTOFF, CHI2_MEDIAN = 20.515, 4.351
DIMS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
#: The least spread of each statistic: differences below it are never far. Its full range is far beyond CUTOFF of them.
FLOOR = {"log_words": 0.25, "word_length": 0.2, "symbols": 0.02, "dup_lines": 0.1, "repeats": 0.1}
#: Classes of distances to a doubling, from this least distance on.
CLASSES, LEAST = 16, 1e-6


def words_of(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_CLASS + "+", -1))


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    # the hashes are bound as an element of a one-element array, so that they are computed once
    windows = F.flatten(F.transform(F.array(hashes), lambda h: F.transform(at, lambda i: F.struct(F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("h"), i.alias("i")))))
    found = F.flatten(F.transform(F.array(F.array_sort(windows)), _repeated))
    return F.when(n < 3, F.lit(0)).otherwise(F.aggregate(F.array(F.array_sort(found)), F.lit(0), lambda _, p: _covered(p))).cast("long")


def _repeated(pairs: Column) -> Column:
    """Places of windows whose neighbour in the sorted pairs has the same hash."""
    def same(j: Column) -> Column:
        return (j > 0) & (F.get(pairs, j - 1)["h"] == pairs[j]["h"]) | F.coalesce(F.get(pairs, j + 1)["h"] == pairs[j]["h"], F.lit(False))

    marked = F.transform(pairs, lambda p, j: F.when(same(j), p["i"]))
    return F.filter(marked, lambda i: i.isNotNull())


def _covered(places: Column) -> Column:
    """Words under windows of three at sorted places."""
    return F.aggregate(F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)


def statistics(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    d = docs.withColumns({"__words": words_of(F.col("text")), "__lines": lines})
    d = d.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__words")),
    })
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return d.drop("__words", "__lines", "text")


def vector(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics, all defined for every row."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.col("word_chars") / n,
        "symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]


def cholesky(cov: dict[tuple[str, str], Column]) -> list[tuple[str, Column]]:
    """Named expressions, each using names before it, of the lower factor of a covariance; l_a_b and l_a_a."""
    out = []
    for i, a in enumerate(DIMS):
        for b in DIMS[: i + 1]:
            x = cov[a, b]
            for c in DIMS[: DIMS.index(b)]:
                x = x - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            out.append((f"l_{a}_{b}", F.sqrt(F.greatest(x, F.lit(FLOOR[a] ** 2 / 100))) if a == b else x / F.col(f"l_{b}_{b}")))
    return out


def distance(shift: str = "m_") -> Column:
    """The squared Mahalanobis distance by forward substitution, from columns of DIMS, means and the factor."""
    z: dict[str, Column] = {}
    for i, a in enumerate(DIMS):
        x = F.col(a) - F.col(f"{shift}{a}")
        for b in DIMS[:i]:
            x = x - F.col(f"l_{a}_{b}") * z[b]
        z[a] = x / F.col(f"l_{a}_{a}")
    out = F.lit(0.0)
    for a in DIMS:
        out = out + z[a] * z[a]
    return out


def _class(x: Column) -> Column:
    return F.floor(F.log2(F.greatest(x, F.lit(LEAST))) * CLASSES)


def _class_at(rows: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """keys and at, the lowest class of ``value`` up to which a group has ``percent`` of its rows."""
    counts = rows.groupBy(*keys, _class(F.col(value)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("at"))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return upto.where(F.col("upto") * 100 >= F.col("all") * percent).groupBy(*keys).agg(F.min("at").alias("at"))


MEANS, FACTORS = [f"m_{a}" for a in DIMS], [f"l_{a}_{b}" for a, b in PAIRS]


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group means m_*, the factor l_* of the rows' covariance, and logdet, the logarithm of its determinant."""
    sums = [F.avg(a).alias(f"m_{a}") for a in DIMS] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in PAIRS]
    est = rows.groupBy(*keys).agg(*sums)
    cov = {(a, b): F.coalesce(F.col(f"c_{a}_{b}"), F.lit(0.0)) + (FLOOR[a] ** 2 if a == b else 0.0) for a, b in PAIRS}
    for name, expr in cholesky(cov):
        est = est.withColumn(name, expr)
    return est.select(*keys, *MEANS, *FACTORS, reduce(Column.__add__, [2 * F.log(f"l_{a}_{a}") for a in DIMS]).alias("logdet"))


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))


def for_all_salts(few: DataFrame) -> DataFrame:
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def concentrated(fit: DataFrame, est: DataFrame) -> DataFrame:
    """The next estimates, of each group's vectors that are nearest by the given ones; est has grp and start."""
    keys = ["grp", "start"]
    near = fit.join(for_all_salts(est), ["grp", "salt"]).select(*keys, distance().alias("d2"))
    held = est.join(_class_at(near, keys, "d2", KEEP_PERCENT), keys)
    kept = fit.join(for_all_salts(held), ["grp", "salt"]).where(_class(distance()) <= F.col("at"))
    return _estimate(kept.select(*keys, *DIMS), keys)


def mcd(fit: DataFrame) -> DataFrame:
    """grp, start, means and factor of the least determinant found; fit has grp, salt and DIMS."""
    mid = fit.groupBy("grp").agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in DIMS])
    off = fit.join(for_all_salts(mid), ["grp", "salt"]).select("grp", *[F.abs(F.col(a) - F.col(f"m_{a}")).alias(a) for a in DIMS])
    spread = off.groupBy("grp").agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"s_{a}") for a in DIMS])
    wide = [F.sqrt((1.4826 * F.col(f"s_{a}")) ** 2 + F.lit(FLOOR[a] ** 2)).alias(f"s_{a}") for a in DIMS]
    mid = materialize(mid.join(spread, "grp").select("grp", *MEANS, *wide), "medians")
    first = mid.select("grp", F.lit(0).alias("start"), *MEANS, *[(F.col(f"s_{a}") if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for a, b in PAIRS], F.lit(0.0).alias("logdet"))
    drawn = fit.join(for_all_salts(mid), ["grp", "salt"]).select("grp", F.lit(1).alias("start"), *[(F.col(f"m_{a}") + F.col(f"s_{a}") * F.tanh((F.col(a) - F.col(f"m_{a}")) / F.col(f"s_{a}"))).alias(a) for a in DIMS])
    every = fit.select("grp", F.lit(2).alias("start"), *DIMS)
    est = materialize(first.unionByName(_estimate(drawn.unionByName(every), ["grp", "start"])), "starts")
    for step in range(FIRST_STEPS):
        est = materialize(concentrated(fit, est), f"first-{step}")
    w = Window.partitionBy("grp").orderBy("logdet", "start")
    best = est.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").withColumn("falls", F.lit(True))
    names = ["start", *MEANS, *FACTORS, "logdet"]
    for step in range(MAX_STEPS):
        best = materialize(best, f"best-{step}")
        open_ = best.where("falls").drop("falls")
        if open_.isEmpty():
            break
        new = concentrated(fit, open_)
        new = new.select("grp", *[F.col(c).alias(f"new_{c}") for c in names])
        falls = F.coalesce(F.col("new_logdet") < F.col("logdet") - FALL, F.lit(False))
        best = best.join(new, "grp", "left").select("grp", *[F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names], falls.alias("falls"))
    return best.select("grp", *names)


def distances(rows: DataFrame) -> DataFrame:
    """The rows, with lang, source and DIMS, and d2, their squared robust distance."""
    columns = rows.columns
    rows = salted(rows.withColumns({"__l": F.coalesce("lang", F.lit("")), "__s": F.coalesce("source", F.lit(""))}))
    sizes = rows.groupBy("__l", "__s").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("nl", F.sum("n").over(Window.partitionBy("__l")))
    grp = F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\x1f", "__l", "__s")).when(F.col("nl") >= MIN_GROUP, F.col("__l")).otherwise(F.lit("\x1e"))
    # a language's estimate takes in all its sources, and that of all takes in every language
    small = materialize(sizes.withColumn("own", grp).select("__l", "__s", "own"), "sizes")
    used = small.select(F.col("own").alias("grp")).distinct()
    member = small.select("__l", "__s", F.explode(F.array_distinct(F.array(F.concat_ws("\x1f", "__l", "__s"), F.col("__l"), F.lit("\x1e")))).alias("grp"))
    member = member.join(used, "grp", "left_semi")
    fit = materialize(rows.join(for_all_salts(member), ["__l", "__s", "salt"]).select("grp", "salt", *DIMS), "vectors")
    est = mcd(fit)
    far = fit.join(for_all_salts(est), ["grp", "salt"]).select("grp", distance().alias("d2"))
    middle = _class_at(far, ["grp"], "d2", 50).select("grp", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("at") + 0.5) / CLASSES) / CHI2_MEDIAN).alias("scale"))
    own = small.join(est.join(middle, "grp"), F.col("own") == F.col("grp")).select("__l", "__s", *MEANS, *FACTORS, "scale")
    own = materialize(own, "estimates")
    return rows.join(for_all_salts(own), ["__l", "__s", "salt"]).select(*columns, (distance() / F.col("scale")).alias("d2"))


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the statistics, base_failed, d2 (null where base_failed) and kept."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    stats = materialize(vector(statistics(d)), "statistics")
    far = distances(stats.where(~F.col("base_failed")))
    out = far.unionByName(stats.where("base_failed").withColumn("d2", F.lit(None).cast("double")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= cutoff)).drop("lang", "source")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 4).alias("distance"))
