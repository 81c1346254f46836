"""Mixing sources to target weights through a tree of domains, languages and sources; DataFrame operations only.

A token budget flows from the root down. Each node offers at most what its documents hold times ``epochs``. Among
siblings the budget is split by weight; what a node can't take goes to its siblings by their weights, and only when
a whole family is full do its ancestors' other children get the rest, because a family's offer is the sum of its
leaves'. The split is computed in whole tokens with window functions over the tree's nodes, which are few rows next
to the documents. Tokens that whole-number division leaves over, fewer than the children of a node, stay unspent.

A leaf fills its budget by whole epochs and then a prefix of one more: epoch e orders the leaf's documents by the
MD5 of seed, e and doc_id, and the prefix ends before the first document that would pass the budget. To find it
without sorting a leaf, which may hold a third of all rows, documents fall into ranges of their hash; sums of tokens
by range give the one range in which the prefix ends, and only its documents are sorted.

Defined results: null lang, source or domain are values of their own (the empty text); unknown names weigh 1; a
document counts max(1, words) tokens; null texts count one token; rows of equal doc_id in a leaf go in or stay out
together where they are equal; other columns keep their values whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WS, WS_CLASS, documents, materialize, unpacked

#: Domains by the source's number, as this corpus has no such column, and weights by level and name.
DOMAINS = ("web", "books", "news", "reference")
WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2, "reference": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
LEVELS = ("domain", "lang", "source")
SEED, EPOCHS, SHARE_PERCENT = 17, 2, 80
#: Documents to a hash range, on average at most: what one sort handles.
RANGE_ROWS, HEX = 4096, 8


def domain_of(source: Column) -> Column:
    """The domain by the digits of a source's name; without digits the last one."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)", 1)
    return F.when(digits == "", F.lit(DOMAINS[-1])).otherwise(F.element_at(F.array([F.lit(d) for d in DOMAINS]), (F.pmod(F.substring(digits, -6, 6).cast("int"), F.lit(len(DOMAINS))) + 1)))


def tokens_of(text: Column) -> Column:
    """Words, at least one."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.greatest(F.lit(1), F.when(t == "", 0).otherwise(F.size(F.split(t, WS_CLASS + "+", -1)))).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def split_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Splits each parent's ``budget`` over its children by ``weight``, none above its ``offer``; adds ``given``.

    In order of offer by weight, a child is full as long as its share of what those before it left exceeds its offer.
    The others share the rest by weight, rounded down.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [F.col("offer") / F.col("weight"), F.col(name)]
    before = family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = family.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    dec = lambda c: c.cast("decimal(38,0)")
    n = nodes.withColumn("taken", F.coalesce(F.sum("offer").over(before), F.lit(0))).withColumn("rest", F.sum("weight").over(onward))
    n = n.withColumn("full", dec(F.col("budget") - F.col("taken")) * F.col("weight") >= dec(F.col("offer")) * F.col("rest"))
    n = n.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("offer")).otherwise(0)).over(family))
    n = n.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family))
    share = F.expr("CAST(left AS DECIMAL(38,0)) * weight div open")
    return n.withColumn("given", F.when(F.col("full"), F.col("offer")).otherwise(share)).drop("taken", "rest", "full", "left", "open")


def leaf_budgets(leaves: DataFrame, weights: dict, share_percent: int, epochs: int) -> DataFrame:
    """leaves has LEVELS, tokens and n; adds budget. The root's budget is share_percent of all tokens."""
    leaves = leaves.withColumn("offer", F.col("tokens") * epochs)
    root = leaves.agg((F.expr(f"sum(tokens) * {share_percent} div 100")).alias("budget"))
    above = root.select(F.col("budget").cast("long").alias("budget"))
    for k, level in enumerate(LEVELS):
        parent, here = list(LEVELS[:k]), list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*here).agg(F.sum("offer").alias("offer")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # above is one row there
        above = split_budget(nodes, parent, level).select(*here, F.col("given").cast("long").alias("budget"))
    return leaves.join(above, list(LEVELS))


def mix(docs: DataFrame, domain: Column | None = None, weights: dict | None = None, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """row (all columns of a document), copies (how often it is taken), domain and n_tokens; only rows taken at least once.

    ``domain`` is an expression over the columns of ``docs``; lang and source are columns.
    """
    weights = WEIGHTS if weights is None else weights
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    d = docs.select(
        row.alias("row"),
        F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("")).alias("__domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("__lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("__source"),
        tokens_of(F.col("text")).alias("__tokens"),
        F.col("doc_id").alias("doc_id"),
    )
    leaf = [F.col(f"__{x}").alias(x) for x in LEVELS]
    sizes = materialize(d.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), *leaf, F.col("__tokens").alias("tokens")), "sizes")
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = leaf_budgets(materialize(leaves, "leaves"), weights, share_percent, epochs)
    leaves = leaves.withColumn("whole", F.expr("budget div tokens")).withColumn("more", F.expr("budget % tokens"))
    leaves = materialize(leaves.withColumn("ranges", F.expr(f"1 + n div {RANGE_ROWS}")), "budgets")

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.col("doc_id")).cast("binary"))
    placed = sizes.join(leaves.select(*LEVELS, "whole", "more", "ranges"), list(LEVELS)).withColumn("order", order)
    at = F.conv(F.substring("order", 1, HEX), 16, 10).cast("long")
    placed = placed.withColumn("range", F.floor(at * F.col("ranges") / F.lit(16**HEX)))
    sums = placed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("sum"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    # a range is in, out, or the one in which the prefix ends
    placed = placed.join(sums, [*LEVELS, "range"])
    inside = placed.where((F.col("before") < F.col("more")) & (F.col("before") + F.col("sum") > F.col("more")))
    run = Window.partitionBy(*LEVELS, "range").orderBy("order", "doc_id", "tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = inside.withColumn("fits", F.col("before") + F.sum("tokens").over(run) <= F.col("more"))
    ends = ends.groupBy(*LEVELS).agg(F.min(F.when(~F.col("fits"), F.col("order"))).alias("end"))
    edge = sums.join(leaves.select(*LEVELS, "more"), list(LEVELS)).where(F.col("before") + F.col("sum") <= F.col("more"))
    edge = edge.groupBy(*LEVELS).agg(F.max("range").alias("last"))
    plan = leaves.select(*LEVELS, "whole", "ranges").join(edge, list(LEVELS), "left").join(ends, list(LEVELS), "left")
    plan = materialize(plan.select(*[F.col(x).alias(f"__{x}") for x in LEVELS], *[F.col(x).alias(f"__{x}") for x in ("whole", "ranges", "last", "end")]), "plan")

    out = d.join(plan, [f"__{x}" for x in LEVELS])
    out = out.withColumn("__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole"), F.coalesce("doc_id", F.lit(-1))).cast("binary")))
    spot = F.floor(F.conv(F.substring("__order", 1, HEX), 16, 10).cast("long") * F.col("__ranges") / F.lit(16**HEX))
    in_prefix = F.coalesce(spot <= F.col("__last"), F.lit(False)) | F.coalesce(F.col("__order") < F.col("__end"), F.lit(False))
    out = out.withColumn("__copies", F.col("__whole") + in_prefix.cast("long")).where("__copies > 0")
    return out.select("row", F.col("__copies").alias("copies"), F.col("__domain").alias("domain"), F.col("__tokens").alias("n_tokens"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents taken, all columns, each as often as it is taken."""
    out = mix(docs, **how).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return unpacked(out, docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("row.doc_id", "domain", "row.lang", "row.source", "n_tokens", "copies")


def _case(level: str, column: str) -> str:
    cases = " ".join(f"WHEN {column} = '{n}' THEN {w}" for n, w in WEIGHTS[level].items())
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def _level_sql(k: int) -> str:
    level, parent = LEVELS[k], list(LEVELS[:k])
    here = ", ".join(LEVELS[: k + 1])
    join = f"JOIN given{k} g USING ({', '.join(parent)})" if parent else "CROSS JOIN given0 g"
    family = f"PARTITION BY {', '.join(parent)}" if parent else ""
    return f"""
nodes{k} AS (
  SELECT n.*, g.budget FROM (SELECT {here}, sum(offer) AS offer, {_case(level, level)} AS weight FROM leaves GROUP BY {here}) n {join}
), split{k} AS (
  SELECT *, coalesce(sum(offer) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM nodes{k} WINDOW w AS ({family} ORDER BY CAST(offer AS DOUBLE) / weight, {level})
), full{k} AS (
  SELECT *, (budget - taken)::HUGEINT * weight >= offer::HUGEINT * rest AS is_full FROM split{k}
), given{k + 1} AS (
  SELECT {here}, CASE WHEN is_full THEN offer ELSE (budget - sum(CASE WHEN is_full THEN offer ELSE 0 END) OVER f)::HUGEINT * weight
    // nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER f, 0)::HUGEINT END AS budget
  FROM full{k} WINDOW f AS ({family})
)"""


def mix_sql(table: str, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """WITH clauses up to ``mixed``: doc_id, domain, lang, source, n_tokens and copies, one row a document taken."""
    ws = "'[\\x20\\x09-\\x0D]+'"
    domains = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"
    trimmed = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    digits = "regexp_extract(coalesce(source, ''), '([0-9]+)', 1)"
    return f"""
sizes AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN {digits} = '' THEN '{DOMAINS[-1]}' ELSE {domains}[CAST(right({digits}, 6) AS INT) % {len(DOMAINS)} + 1] END AS domain,
    CASE WHEN {trimmed} = '' THEN 1 ELSE len(string_split_regex({trimmed}, {ws})) END AS tokens
  FROM {table}
), leaves AS (
  SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {epochs} AS offer FROM sizes GROUP BY ALL
), given0 AS (SELECT sum(tokens) * {share_percent} // 100 AS budget FROM leaves),{",".join(_level_sql(k) for k in range(3))},
filled AS (
  SELECT l.domain, l.lang, l.source, g.budget // l.tokens AS whole, g.budget % l.tokens AS more
  FROM leaves l JOIN given3 g USING (domain, lang, source)
), ordered AS (
  SELECT s.*, f.whole, f.more, sum(s.tokens) OVER (PARTITION BY s.domain, s.lang, s.source
    ORDER BY md5('{seed}:' || CAST(f.whole AS BIGINT) || ':' || s.doc_id), s.doc_id, s.tokens) AS upto
  FROM sizes s JOIN filled f USING (domain, lang, source)
), mixed AS (
  SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS n_tokens, CAST(whole + CASE WHEN upto <= more THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM ordered WHERE whole + CASE WHEN upto <= more THEN 1 ELSE 0 END > 0
)"""


OP7_SQL = f"WITH {mix_sql('documents')} SELECT * FROM mixed"
