"""Line deduplication by levelled sorted runs of line hashes, in DataFrame operations only.

``LineRuns`` keeps what is known of all line keys in runs, tables bucketed and sorted by a 128-bit hash. A batch's keys,
written in equal buckets, merge-anti-join the runs without another shuffle: keys that no run has are the batch's own, and
it becomes their owner; of keys already known it only keeps the counts. The batch is then a run of level 0. When
``fanout`` runs of one level have gathered, they merge into one run of the next level, so a key is rewritten once a level.

``drop_repeated_lines`` feeds batches of documents by falling doc_id, so that the owner of a key is the largest
doc_id that holds it, and then drops a frequent key's lines in all documents but that one. Only hashes, ids and line
numbers are shuffled for the search. Frequent keys are not assumed few: the join against them is an ordinary one,
which Spark broadcasts below its size limit and splits where a key is hot.

Defined results: a null or empty text is one empty line; a text that lost all its lines becomes empty, and null texts
stay null where nothing was dropped; each row counts as a document, so a repeated row is one more document, and rows
with the owner's doc_id all keep their lines; a null doc_id counts as the lowest; other columns keep their values whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS, ascii_lower, documents, materialize, packed, row_key, unpacked, work_dir

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 3
LOWEST = -(2**63)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(WS))


def _hash(key: Column) -> list[Column]:
    """128 bits: two hashes with different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Runs by level. Each is two tables bucketed and sorted by hash: the keys that no older run has, with their owner, and
    the number of documents with each key of its batches. Tables of equal buckets join without a shuffle."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets, self.tables = int(spark.conf.get("spark.sql.shuffle.partitions")), []

    def _runs(self) -> list[tuple[DataFrame, DataFrame]]:
        return [run for level in self.levels.values() for run in level]

    def owners(self) -> DataFrame | None:
        """h1, h2 and owner of all keys, each key once."""
        runs = [r[0] for r in self._runs()]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path, table = work_dir(self.spark, name), f"line_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def novel(self, keys: DataFrame) -> DataFrame:
        """The keys (h1, h2, ...) that no run has: an anti-join with each run in turn."""
        for owners, _ in self._runs():
            keys = keys.join(owners.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds a batch's keys: h1, h2, owner and n_docs, each key once."""
        batch = self._write(keys, "batch")
        new = self._write(self.novel(batch).select("h1", "h2", "owner"), "run")
        self.levels.setdefault(0, []).append((new, batch.select("h1", "h2", "n_docs")))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            runs = self.levels.pop(level)
            owners, counts = (reduce(DataFrame.unionByName, [r[k] for r in runs]) for k in range(2))
            merged = self._write(owners.repartition(self.buckets, "h1", "h2"), "run"), self._write(self.folded(counts), "counts")
            self.levels.setdefault(level + 1, []).append(merged)
            level += 1

    @staticmethod
    def folded(counts: DataFrame) -> DataFrame:
        return counts.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def totals(self, min_docs: int = 1) -> DataFrame:
        """Keys of at least so many documents over all batches: h1, h2, owner and n_docs."""
        counts = self.folded(reduce(DataFrame.unionByName, [r[1] for r in self._runs()])).where(F.col("n_docs") >= min_docs)
        return self.owners().join(counts, ["h1", "h2"])

    def drop(self) -> None:
        """Forgets the tables; their files stay in the folder of spark.checkpoint.dir."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []


def batch_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each key of a batch once; docs has id and text."""
    long_lines = F.filter(F.transform(split_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    keys = docs.select("id", F.explode(F.array_distinct(long_lines)).alias("key")).select("id", *_hash(F.col("key")))
    return keys.groupBy("h1", "h2").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n_docs"))


def with_kept(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """row (all columns of a document), n_lines, n_dropped and kept (the other lines joined again)."""
    spark = docs.sparkSession
    full = packed(docs)
    doc_id, text = F.col("row.doc_id").cast("long"), F.col("row.text")
    ids = full.select(F.coalesce(doc_id, F.lit(LOWEST)).alias("id"), text.alias("text"))
    cuts = ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] or [] if batches > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    runs = LineRuns(spark)
    for high, low in zip([None, *cuts], [*cuts, None], strict=True):
        part = ids
        if high is not None:
            part = part.where(F.col("id") <= high)
        if low is not None:
            part = part.where(F.col("id") > low)
        runs.add(batch_keys(part, min_chars))
    frequent = materialize(runs.totals(min_docs).select("h1", "h2", "owner"), "frequent")
    runs.drop()

    full = full.withColumn("key", row_key(doc_id, text))
    lines = full.select(F.col("key").alias("of"), F.posexplode(split_lines(text)).alias("at", "line")).select("of", "at", line_key(F.col("line")).alias("line"))
    lines = lines.where(F.length("line") >= min_chars).select("of", "at", *_hash(F.col("line")))
    lost = lines.join(frequent, ["h1", "h2"]).where(F.col("of.id") != F.col("owner")).groupBy("of").agg(F.collect_set("at").alias("lost"))
    full = full.join(lost, F.col("key") == F.col("of"), "left").withColumn("lines", split_lines(text))
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    kept = F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")
    return full.select(
        "row", n.cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), text).otherwise(kept).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents, all columns, with the text that is left; n_chars follows it where there is such a column."""
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(with_kept(docs, min_chars, min_docs, batches), docs.columns, **new)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_kept(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL AND k.doc_id <> f.owner) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL OR k.doc_id = f.owner), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY k.doc_id
"""
