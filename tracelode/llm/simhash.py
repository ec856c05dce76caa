"""SimHash near-dedup with BK-trees.

Equal fingerprints collapse first. Distinct ones are dealt to shards by pigeonhole: of three bit bands two fingerprints
within two bits agree on one at least, so each is sent to three shards, one for each band's value. A shard keeps its
fingerprints in a BK-tree (children keyed by their Hamming distance to the parent) and a search follows only edges within
the radius. A tree over all fingerprints has no size bound, so trees are not sent out from the driver: each lives in the
task that owns its shard. Shards over `max_shard` are dealt again by the bits outside their band, which stays exact.
A shard reports a spanning forest, never all pairs; connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

BITS = 64


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if set in over half of the XXH64 of the lower-cased (A-Z) word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(words) - k + 1
    pairs = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    while chunk := [digest(joined[a:b], seed) for a, b in islice(pairs, 65536)]:
        ones += np.unpackbits(np.array(chunk, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null text: no words, fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([simhash(t, width, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Nodes are [value, children by distance]; equal values are one node."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append(node[0])
            children = node[1]
            if children:
                for edge in range(max(1, d - radius), d + radius + 1):
                    if (child := children.get(edge)) is not None:
                        todo.append(child)
        return found


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of values within radius of each other that span the components of all such pairs."""
    tree, parent = BKTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in dict.fromkeys(values):
        parent[v] = v
        for other in tree.within(v, radius):
            a, b = find(v), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield v, other
        tree.add(v)


def _bands(n: int, bits: list[int]) -> list[int]:
    """Masks of n bands that split the given bit positions."""
    return [sum(1 << b for b in bits[i * len(bits) // n : (i + 1) * len(bits) // n]) for i in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(distinct: DataFrame, radius: int = 2, max_shard: int = 20_000) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that give the same components as all pairs within radius."""
    n = radius + 1
    masks = [[m] for m in _bands(n, list(range(BITS)))]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m[0]))).alias("key")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.path", "x.key")
    out = []
    for _ in range(3):
        keyed = stored(keyed, "shards")
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = stored(sizes, "sizes")
        out.append(keyed.join(sizes.where(F.col("n") <= max_shard).select("path", "key"), ["path", "key"]))
        hot = sizes.where(F.col("n") > max_shard).select("path", "key")
        if hot.isEmpty():
            break
        deeper, choices = [], []
        for i, used in enumerate(masks):
            free = [b for b in range(BITS) if not any(m >> b & 1 for m in used)]
            for m in _bands(n, free):
                choices.append((i, len(deeper), m))
                deeper.append([*used, m])
        array = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(j).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(sum(deeper[j])))).alias("key")) for i, j, m in choices])
        keyed = keyed.join(hot, ["path", "key"]).select("fp", F.explode(F.filter(array, lambda s: s["of"] == F.col("path"))).alias("x")).select("fp", "x.path", "x.key")
        masks = deeper
    else:
        out.append(keyed)  # split three times, a shard differs in few free bits only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values = None, []

        def flushed():
            pairs = list(forest(values, radius))
            return np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)

        def table(parts):
            both = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            parts = []
            fps = np.asarray(batch.column(0)).view(np.uint64).tolist()
            for key, fp in zip(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), fps, strict=True):
                if key != shard:
                    if values:
                        parts.append(flushed())
                    shard, values = key, []
                values.append(fp)
            if parts:
                yield table(parts)
        if values:
            yield table([flushed()])

    shards = reduce(DataFrame.unionByName, [o.select("fp", "path", "key") for o in out])
    return shards.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node of node's component, for every node of edges (a, b) of longs.

    Alternating large-star and small-star steps; each is one grouped minimum and a join, so no neighbour list is
    gathered. Every round is stored in the shared folder.
    """
    both = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = around.join(least, "u")
        moved = joined.where(F.col("v") > F.col("u")) if large else joined
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    # the sum of all edge ends falls until nothing changes
    state = None
    while True:
        both = stored(star(star(both, True), False), "star")
        now = both.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.col("u").cast("decimal(38,0)")).alias("t")).collect()[0]
        if tuple(now) == state:
            break
        state = tuple(now)
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(both.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, max_shard: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links of at most `radius`
    differing bits, a document's own included. Null and empty texts have fingerprint zero and link like any other.
    Repeated doc_ids keep their rows. A null doc_id joins its component but is never the component_id unless all are null.
    """
    prints = stored(fingerprints(docs, width, seed), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    edges = stored(links(distinct.select("fp"), radius, max_shard), "links")
    if edges.isEmpty():
        roots = distinct.select("fp", F.col("rep").alias("component_id"), "n")
    else:
        found = stored(components(edges), "components")
        merged = found.join(distinct.select("fp", "rep"), F.col("node") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("component_id"))
        of = found.join(merged, "root").select(F.col("node").alias("fp"), "component_id")
        roots = distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "n")
    roots = stored(roots, "roots")
    # fingerprints of over a thousandth of all rows, as that of empty texts: less than a thousand, found without a shuffle
    total = distinct.agg(F.sum("n")).collect()[0][0] or 0
    hot = roots.where(F.col("n") * 1000 > total).select("fp", F.struct("component_id").alias("hot"))
    marked = prints.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("hot is null").drop("hot").join(roots.where(F.col("n") * 1000 <= total).select("fp", "component_id"), "fp")
    every = marked.where("hot is not null").select("fp", "doc_id", "hot.component_id").unionByName(rest)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
