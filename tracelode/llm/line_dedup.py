"""Line dedup over levelled sorted runs of line hashes.

A run is an immutable table (k1, k2, doc), bucketed and sorted by the 128-bit hash of a line's key. A new batch is
merge-anti-joined with the runs, bucket by bucket and without a shuffle; keys that no run holds open an entry, so all runs
are disjoint and an entry's document is that of the first batch with the key. The entries of a batch are its run; when a
level holds `fanout` runs they are merged into one run of the next level.

Dropping lines needs the last document of each key, so batches are ranges of documents that come in descending order: what
the anti-join lets through is a key's last document, and what it holds back is a repetition of a later one. How many documents
hold a key is the sum over the batches' own tables.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, lower_ascii, scratch, stored

KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """The levelled runs; `levels[i]` lists the tables of level i."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.base = spark, fanout, scratch(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def write(self, rows: DataFrame) -> DataFrame:
        """rows as a bucketed, sorted table: one file a bucket, so that joins by the key neither shuffle nor sort much."""
        name = f"run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.base}/{name}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def admit(self, batch: DataFrame) -> DataFrame:
        """Anti-join a batch (k1, k2, doc), one row a key and written by `write`, with all runs; add what is new as a run of level 0,
        compact full levels and return it."""
        new = self.write(reduce(lambda b, run: b.join(run.select(*KEY).hint("merge"), KEY, "left_anti"), self.runs(), batch.select(*KEY, "doc")))
        run = new
        for depth in range(len(self.levels) + 1):
            if depth == len(self.levels):
                self.levels.append([])
            self.levels[depth].append(run)
            if len(self.levels[depth]) < self.fanout:
                break
            run = self.write(reduce(DataFrame.unionByName, self.levels[depth]))  # disjoint: nothing to add up
            self.levels[depth] = []
        return new

    def all(self) -> DataFrame:
        """(k1, k2, doc): every key once."""
        return reduce(DataFrame.unionByName, self.runs())

    def close(self) -> None:
        """Forget the tables' names; their files stay in the scratch folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def first_lines(runs: LineRuns, lines: DataFrame) -> DataFrame:
    """Streaming form: of a batch of lines (doc_id, k1, k2), those whose key no run holds, one for each key (doc: the smallest
    doc_id); the batch is then added. Null keys are dropped; an empty batch adds an empty run."""
    return runs.admit(runs.write(lines.where("k1 is not null").groupBy(*KEY).agg(F.min("doc_id").alias("doc"))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Drop repeated lines: (doc_id, n_lines, n_dropped, kept_text) and the columns `keep` of docs, one row for each row.

    A line's key is `line_key`. Keys of at least min_chars code points that at least min_docs documents hold lose all
    lines but those of the largest such doc_id. Other lines stay, in order. A null or empty text is one empty line.
    Rows that share a doc_id count as one document, each keeping a row. A null doc_id counts as a document smaller than all others.
    If every line goes the kept text is empty.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(keep or [F.lit(0).alias("none")])).alias("rest"))
    base = base.withColumn("same", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("kind", F.xxhash64("text"))
    lines = base.select("same", "kind", F.posexplode(_lines(F.col("text"))).alias("line_no", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    hashed = stored(lines.select("same", "kind", "line_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), F.reverse(F.col("key")), "key").alias("k2")), "lines")
    cuts = hashed.agg(F.percentile_approx("same", [i / batches for i in range(1, batches)], 1000).alias("q"), F.count("*").alias("n")).collect()[0]
    bounds = [None, *sorted(set(cuts["q"] or []), reverse=True), None]
    runs, counts = LineRuns(spark, fanout), []
    for high, low in zip(bounds, bounds[1:], strict=False):  # the largest ids first
        part = hashed if low is None else hashed.where(F.col("same") > low)
        part = part if high is None else part.where(F.col("same") <= high)
        batch = runs.write(part.select(*KEY, "same").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("same").alias("doc")))
        counts.append(batch.select(*KEY, "docs"))
        runs.admit(batch)
    heavy = reduce(DataFrame.unionByName, counts).groupBy(*KEY).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    lost = stored(heavy.join(runs.all().hint("merge"), KEY).select(*KEY, "docs", "doc"), "lost")
    runs.close()
    # lines that over a thousandth of all documents' lines equal: less than a thousand keys, whose lines are found without a shuffle
    hot = stored(lost.where(F.col("docs") * 1000 > cuts["n"]).select(*KEY, F.col("doc").alias("hot_doc")), "hot")
    marked = hashed.join(F.broadcast(hot), KEY, "left")
    rest = marked.where("hot_doc is null").drop("hot_doc").join(lost.where(F.col("docs") * 1000 <= cuts["n"]).select(*KEY, "doc").hint("merge"), KEY)
    gone = marked.where("same <> hot_doc").select("same", "kind", "line_no").unionByName(rest.where("same <> doc").select("same", "kind", "line_no"))
    dropped = gone.groupBy("same", "kind").agg(F.collect_set("line_no").alias("dropped"))
    # both tables grow with the input, so neither is broadcast at any size; each text moves once
    joined = base.join(stored(dropped, "dropped").hint("merge"), ["same", "kind"], "left")
    all_lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("dropped"))
    kept_text = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("all_lines"), i)), "\n"))
    return joined.withColumn("all_lines", all_lines).select("doc_id", F.size("all_lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept_text.alias("kept_text"), *[F.col("rest")[c].alias(c) for c in keep or []])
