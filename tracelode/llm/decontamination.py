"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Each window of an item is a set of shingles. Containing the whole window needs every one of its shingles, so its single
rarest shingle is prefix enough. A first pass counts how often documents hold each benchmark shingle: an aggregate, of which
nothing but the counts is written. They give the order of rarity. A second pass joins documents with the windows at their
rarest shingles only. A match has a position: the window's start in the document follows from the shingle's place in the
window, must not be negative and must leave room for the window. It also carries the words around it, as many as its windows
can reach, so candidates are verified word by word where they meet and texts never move.

Shingles of documents are sifted by a bitmap of bounded size before they are joined. Shingles with more than a thousandth of
all matches are dealt with a salt; there are less than a thousand of them, so their list is sent to all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bitmap, in_bitmap, lower_ascii, stored

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Matches of one frequent shingle that go to one task, about.
SALTED = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all shingles of `size` words, by place; empty if there are fewer words."""
    n = F.size(words) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def windows_of(benchmark: DataFrame, length: int) -> DataFrame:
    """(item, size, window): the distinct windows of every item, words joined by one space; items without words have none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(length))
    starts = F.sequence(F.lit(0), F.size("words") - size)
    return items.select("item", size.alias("size"), "words", F.explode(starts).alias("at")).select("item", "size", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("window")).distinct()


def _sifted(words: DataFrame, keys: list[int], bits: DataFrame) -> DataFrame:
    """Rows with a column `words`, exploded to those of their shingles of k words that may be in the bitmap: columns pos, h, k."""
    if len(keys) == 1:
        at = words.select("*", F.posexplode(_shingles(F.col("words"), keys[0])).alias("pos", "h"), F.lit(keys[0]).alias("k"))
    else:
        placed = lambda k: F.transform(_shingles(F.col("words"), k), lambda h, i: F.struct(h.alias("h"), i.alias("pos"), F.lit(k).alias("k")))
        hashes = F.concat(*map(placed, keys))
        at = words.select("*", F.explode(hashes).alias("s")).select(*words.columns, F.col("s.pos").alias("pos"), F.col("s.h").alias("h"), F.col("s.k").alias("k"))
    return in_bitmap(at, "h", bits)


def _held(base: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """(same, kind, start, size, window): where documents (same, kind, words) hold windows (size, window)."""
    spark = base.sparkSession
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # as many as a window's words at most
    schema = "same bigint, kind bigint, start int, size int, window string"
    if not sizes:
        return spark.createDataFrame([], schema)
    parts = [windows.where(F.col("size") == n).select("size", "window", F.posexplode(_shingles(F.split("window", " "), min(shingle, n))).alias("place", "h")) for n in sizes]
    placed = stored(reduce(DataFrame.unionByName, parts), "placed")
    keys = sorted({min(shingle, n) for n in sizes})
    # how often documents hold each shingle; false positives of the bitmap fall away in the join
    counts = _sifted(base.select("words"), keys, bitmap(placed.select("h"))).groupBy("h").agg(F.count("*").alias("n"))
    seen = stored(counts.join(placed.select("h").distinct(), "h"), "rarity")
    # the rarest shingle of each window; a window with a shingle that no document holds is in none
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "h", "place"))
    ranked = placed.join(seen, "h", "left").withColumn("rank", rank).where("rank = 1 and n > 0")
    prefix = stored(ranked.select("h", "n", "size", "window", "place"), "prefix")
    total = prefix.select("h", "n").distinct().agg(F.sum("n")).collect()[0][0] or 0
    salts = F.when(F.col("n") * 1000 > total, F.ceil(F.col("n") / SALTED)).otherwise(1).cast("int")
    hot = stored(prefix.where((F.col("n") * 1000 > total) & (F.col("n") > SALTED)).select("h", salts.alias("salts")).distinct(), "hot")
    # a window of fewer words than a shingle is one itself; others need the words that they reach
    reach = F.when(F.col("k") < shingle, 0).otherwise(sizes[-1])
    around = F.array_join(F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, 2 * reach + F.col("k")), " ")
    found = _sifted(base.select("same", "kind", "words"), keys, bitmap(prefix.select("h")))
    found = found.select("same", "kind", "pos", "h", around.alias("around"), F.least("pos", reach).alias("back"), (F.size("words") - F.col("pos")).alias("room"))
    found = found.join(F.broadcast(hot), "h", "left").withColumn("salt", F.pmod(F.xxhash64("same", "kind", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    met = found.join(dealt, ["h", "salt"]).where((F.col("pos") >= F.col("place")) & (F.col("room") + F.col("place") >= F.col("size")))
    checked = met.where(F.array_join(F.slice(F.split("around", " "), F.greatest(F.col("back") - F.col("place"), F.lit(0)) + 1, F.col("size")), " ") == F.col("window"))
    return stored(checked.select("same", "kind", (F.col("pos") - F.col("place")).alias("start"), "size", "window").distinct(), "held")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    A window is `length` consecutive words of an item, or a shorter item's all. n_hit counts words inside any occurrence
    of a window; n_items the items with occurring windows; items_sha256 digests their ids as sorted strings, comma-joined. Null texts have no
    words, a null item_id is the empty string, items that share an id are one, and repeated document rows keep theirs.
    The columns `keep` of docs follow.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(keep or [F.lit(0).alias("none")])).alias("rest"))
    base = base.withColumn("same", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("kind", F.xxhash64("text"))
    items = stored(windows_of(benchmark, length), "windows")
    held = _held(base.select("same", "kind", words_of(F.col("text")).alias("words")), items.select("size", "window").distinct(), shingle)
    # distinct places of one document: bounded by its words
    hit = held.select("same", "kind", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word")).distinct().groupBy("same", "kind").agg(F.count("*").alias("n_hit"))
    named = held.select("same", "kind", "window").distinct().join(items.select("item", "window"), "window").groupBy("same", "kind").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    told = stored(hit.join(named, ["same", "kind"]), "told")
    none = F.array().cast("array<string>")
    # rows that are certainly clean do not move
    marked, bits = base.withColumn("h", F.xxhash64("same", "kind")), bitmap(told.select(F.xxhash64("same", "kind").alias("h")))
    n_words = F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    result = in_bitmap(marked, "h", bits).select("doc_id", "same", "kind", n_words, "rest").join(told.hint("merge"), ["same", "kind"], "left").select("doc_id", "n_words", "n_hit", "ids", "rest")
    clean = in_bitmap(marked, "h", bits, "left_anti").select("doc_id", n_words, F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("ids"), "rest")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", none)
    return result.unionByName(clean).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        *[F.col("rest")[c].alias(c) for c in keep or []],
    )
