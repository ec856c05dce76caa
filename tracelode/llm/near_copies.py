"""Near copies by exact shingle similarity: the rule of the pipeline's third stage, operator 5 with a check behind it.

Two texts are near copies if the sets of their word shingles have a Jaccard similarity of 4/5 or more. Operator 5's fingerprints
and BK-trees come first: links within a few bits, each verified, join most members of large groups. What differs in more bits
(four fifths of shingles in common leave some ten of 64) no radius that bands can serve would find, so a prefix filter finds
the rest: in any fixed order of shingles, two such sets of n and m share one among the first n - ceil(4n/5) + 1 and
m - ceil(4m/5) + 1, so texts meet at the shingles of their prefixes, and none is missed. The order goes by the number of texts
that hold a shingle, counted over all texts, rarest first; a shingle that one text holds alone is met by no other and is
not sent. Every candidate is verified.

Large groups of copies must not give all pairs: each text meets the one before it in its groups, if that is in another component,
first at its rarest shingles and then at all, and the verified links make components. Then large groups give every pair that is
still in two components and that the texts' parities do not rule out. So components are those of all pairs.

Counting follows operator 1: blocks of texts send their distinct shingles, packed, to buckets of hashes, which answer them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, discard, frugal, give_back, in_bitmap, pack, stored, unpack
from .katz import _filled, distinct, pack_planes, pack_sorted, unpack_planes, unpack_sorted
from .simhash import components, links

#: Groups, of its rarest shingles, in which a text meets the one before it at first.
FIRST = 2
#: Bits of a text's parities.
PARITIES = 512
#: Differing bits of fingerprints whose texts are compared first.
RADIUS = 3


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct XXH64 of the lower-cased (A-Z) word shingles, ascending; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64))


def _fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def _parities(found: np.ndarray) -> bytes:
    """For each of PARITIES classes of shingles whether the set has an odd number of them. Two sets' parities differ in at most as
    many bits as the sets in shingles, so they prove most candidates to be no near copies."""
    return np.packbits(np.bincount((found >> np.uint64(7)) % np.uint64(PARITIES), minlength=PARITIES).astype(np.uint8) & 1).tobytes()


_BLOCK = "kind string, bucket int, block bigint, x binary, y binary, z binary, w binary, v binary"


def _blocks(nodes: DataFrame, width: int, size: int, buckets: int) -> DataFrame:
    """Rows: block (x: nodes, y: where each one's shingles end, z: each shingle's place among the block's distinct ones, w:
    fingerprints, v: parities) and ask (bucket, x: distinct shingles, y: how many of the block's texts hold each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId() << 32, set()
        ids, parts, total = [], [], 0

        def closed() -> pa.RecordBatch:
            keys, places, _ = distinct(np.concatenate(parts))
            held = np.bincount(places).astype(np.uint32)
            ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
            rows = [("block", None, number, pack(np.array(ids, np.int64)), pack(ends), pack_planes(places), pack(np.array([_fingerprint(p) for p in parts], np.int64)), b"".join(map(_parities, parts)))]
            rows += [("ask", k, number, pack_sorted(keys[s]), pack_planes(held[s]), None, None, None) for k, s in _filled(keys, buckets)]
            types = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if node in seen:  # exact copies nearby; others meet as one in their group
                        continue
                    if len(seen) < 500_000:
                        seen.add(node)
                    ids.append(node)
                    parts.append(shingles(text, width))
                    total += len(parts[-1])
                    if total >= size:
                        yield closed()
                        ids, parts, total, number = [], [], 0, number + 1
        if parts:
            yield closed()

    return nodes.mapInArrow(frugal(run), _BLOCK)


def _holders(asked: pa.Table) -> pa.Table:
    """A bucket's answers: (bucket, block, held, keys): of each asked shingle how many texts hold it; those that several do."""
    asked = asked.sort_by("block")
    parts = [unpack_sorted(x) for x in asked.column("x").to_pylist()]
    cuts = np.cumsum([0, *map(len, parts)])
    keys, of, _ = distinct(np.concatenate(parts))
    held = np.bincount(of, np.concatenate([unpack_planes(y, np.uint32) for y in asked.column("y").to_pylist()]), len(keys)).astype(np.int64)[of]
    out = [(pack_planes(held[a:b]), pack_sorted(keys[of[a:b]][held[a:b] > 1])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return give_back(pa.table({"bucket": asked.column("bucket"), "block": asked.column("block"), "held": pa.array([h for h, _ in out], pa.binary()), "keys": pa.array([k for _, k in out], pa.binary())}))


def _prefix_rows(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
    """(nth, h, node, n, at) of a block: each text's prefix, without the shingles that it alone holds; at: the place in the order, nth:
    that among those which are left."""
    del key
    row = block.slice(0, 1).to_pylist()[0]
    answers = answers.sort_by("bucket")
    nodes, ends, places = unpack(row["x"], np.int64), unpack(row["y"], np.int64), unpack_planes(row["z"], np.int32)
    held = np.concatenate([unpack_planes(x, np.int64) for x in answers.column("held").to_pylist()])
    keys = np.zeros(len(held), np.uint64)
    keys[held > 1] = np.concatenate([unpack_sorted(x) for x in answers.column("keys").to_pylist()])
    n = np.diff(ends, prepend=0)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((places, held[places], of))  # places ascend with the hashes
    at = np.arange(len(of)) - np.repeat(ends - n, n)
    size = n - -(-4 * n // 5) + 1
    places = places[order]
    keep = (at < size[of]) & (held[places] > 1)
    kept = of[keep]
    nth = np.arange(len(kept)) - np.searchsorted(kept, kept)
    return give_back(pa.table({"nth": pa.array(nth.astype(np.int32)), "h": pa.array(keys[places[keep]].view(np.int64)), "node": pa.array(nodes[of[keep]]), "n": pa.array(n[of[keep]].astype(np.int32)), "at": pa.array(at[keep].astype(np.int32))}))


def _prints(blocks: DataFrame) -> DataFrame:
    """(node, fp, parities) of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, w, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = PARITIES // 8
                yield pa.RecordBatch.from_arrays([pa.array(unpack(x, np.int64)), pa.array(unpack(w, np.int64)), pa.array([v[i : i + size] for i in range(0, len(v), size)], pa.binary())], names=["node", "fp", "parities"])

    return blocks.select("x", "w", "v").mapInArrow(run, "node bigint, fp bigint, parities binary")


def _alike(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): texts to compare because their fingerprints are equal or linked by operator 5's trees."""
    first = stored(prints.groupBy("fp").agg(F.min("node").alias("first")), "first")
    equal = prints.join(first, "fp").where("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    near = links(first.select("fp"), radius)
    named = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")).hint("merge"), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")).hint("merge"), "b")
    return equal.unionByName(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m whose first common shingle is at these places can reach 4/5: o >= 4/9 (n + m)."""
    return (9 * np.minimum(n - at, m - to) >= 4 * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches sorted by their first, cut so that no run of equal values is divided; a binary column gives rows of
    64-bit words."""
    rest: list[list[np.ndarray]] = []
    plain = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) if pa.types.is_binary(c.type) else np.asarray(c)
    for b in batches:
        if not b.num_rows:
            continue
        cols = [plain(c) for c in b.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (rest and rest[0][0][0] != cols[0][0]):
            # all before the last value's run is complete
            parts = [*rest, [c[:last] for c in cols]]
            yield tuple(np.concatenate([p[k] for p in parts]) for k in range(len(cols)))
            rest = []
        rest.append([c[last:] for c in cols])
    if rest:
        yield tuple(np.concatenate([p[k] for p in rest]) for k in range(len(rest[0])))


def _met(rows: DataFrame) -> DataFrame:
    """(a, b, h, n, at): candidates (a, b), h null, of texts with the one before them, if it is in another component; and members a
    of larger groups of more than one component. rows: (h, node, n, at, root)."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, node, at, root in _groups(batches):
            once = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
            h, n, node, at, root = h[once], n[once], node[once], at[once], root[once]
            ok = np.flatnonzero((h[1:] == h[:-1]) & (root[1:] != root[:-1]) & _possible(n[1:], at[1:], n[:-1], at[:-1]))
            a, b = np.minimum(node[ok + 1], node[ok]), np.maximum(node[ok + 1], node[ok])
            keep = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            if len(keep):
                null = pa.nulls(len(keep), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keep[:, 0].copy()), pa.array(keep[:, 1].copy()), null, pa.nulls(len(keep), pa.int32()), pa.nulls(len(keep), pa.int32())], schema=fields)
            edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            sizes = np.diff(edges)
            mixed = np.minimum.reduceat(root, edges[:-1]) != np.maximum.reduceat(root, edges[:-1])
            large = np.repeat((sizes > 2) & mixed, sizes)
            if large.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(h[large]), pa.array(n[large]), pa.array(at[large])], schema=fields)

    dealt = rows.repartition("h").sortWithinPartitions("h", "n", "node").select("h", "n", "node", "at", "root")
    return dealt.mapInArrow(frugal(run), "a bigint, b bigint, h bigint, n int, at int")


def _apart(members: DataFrame) -> DataFrame:
    """(a, b): candidates among members (h, n, node, at, root, parities) of one group that have two roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, node, at, root, parities in _groups(batches):
            edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (root[s:e] == root[s]).all():
                    continue
                first = s + np.searchsorted(n[s:e], -(-4 * n[s:e].astype(np.int64) // 5))  # sizes ascend
                out, count = [], 0
                for i in range(s + 1, e):
                    j = slice(int(first[i - s]), i)
                    ok = np.flatnonzero((root[j] != root[i]) & _possible(n[j], at[j], n[i], at[i])) + j.start
                    # sets that reach 4/5 differ in a ninth of their sizes' sum at most
                    ok = ok[9 * np.bitwise_count(parities[ok] ^ parities[i]).sum(axis=1, dtype=np.int64) <= n[ok].astype(np.int64) + n[i]]
                    if len(ok):
                        out.append(np.stack([np.minimum(node[ok], node[i]), np.maximum(node[ok], node[i])], 1))
                        count += len(ok)
                    if out and (count > 100_000 or i == e - 1):
                        both = np.concatenate(out)
                        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
                        out, count = [], 0
                if out:
                    both = np.concatenate(out)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return members.repartition("h").sortWithinPartitions("h", "n", "node").select("h", "n", "node", "at", "root", "parities").mapInArrow(frugal(run), "a bigint, b bigint")


def _sets(nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, found): shingles of the wanted nodes, and of a few more that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b, ids, out = whole.slice(i, 500), [], []
                for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if node not in seen:
                        ids.append(node)
                        out.append(shingles(text, width).tobytes())
                    if len(seen) < 500_000:
                        seen.add(node)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["node", "found"])

    kept = in_bitmap(nodes, "node", bitmap(wanted.select(F.col("node").alias("h"))))
    return stored(kept.mapInArrow(frugal(run), "node bigint, found binary").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The pairs whose similarity is 4/5 or more."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = _sets(nodes, wanted, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(5 * both >= 4 * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")).hint("merge"), "b")
    return stored(joined.select("a", "b", "x", "y").mapInArrow(frugal(run), "a bigint, b bigint"), "verified")


def _rooted(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with the component (root) of their node, itself where no link has it."""
    if found is None or found.isEmpty():
        return rows.withColumn("root", F.col("node"))
    return rows.join(stored(components(found), "components").hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_copies(docs: DataFrame, width: int = 5, block_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, component_id), one row for each row of docs.

    component_id: the smallest doc_id reachable over near copies. Texts without words are copies of each other. Repeated
    doc_ids keep their rows. A null doc_id joins its component but is never the component_id unless all are null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nodes = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    length = nodes.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    made = stored(_blocks(nodes, width, block_shingles, max(1, -(-int(length / 6) // block_shingles))), "blocks", partition_by=("kind",))
    kind = lambda k: made.where(F.col("kind") == k).toDF(*made.columns)
    prints = stored(_prints(kind("block")).dropDuplicates(["node"]), "prints")
    alike = stored(_alike(prints, RADIUS), "alike")
    verified = _verified(alike, nodes, width)
    answers = stored(kind("ask").select("bucket", "block", "x", "y").groupBy("bucket").applyInArrow(_holders, "bucket int, block bigint, held binary, keys binary"), "answers")
    discard(made, "kind=ask")
    prefixes = kind("block").select("block", "x", "y", "z").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_prefix_rows, "nth int, h bigint, node bigint, n int, at int")
    prefixes = stored(prefixes, "prefixes")
    discard(made, "kind=block")
    discard(answers)
    pairs = lambda met: _verified(stored(met.where("h is null").select("a", "b").distinct(), "pairs"), nodes, width)
    # large groups of copies are joined at their rarest shingles, before all shingles are looked at
    verified = verified.unionByName(pairs(_met(_rooted(prefixes.where(F.col("nth") < FIRST).drop("nth"), verified))))
    met = stored(_met(_rooted(prefixes.drop("nth"), verified)), "met")
    verified = verified.unionByName(pairs(met))
    large = met.where("h is not null").select("h", "n", F.col("a").alias("node"), "at")
    if not large.isEmpty():
        more = stored(_apart(_rooted(large, verified).join(prints.select("node", "parities").hint("merge"), "node")).distinct(), "pairs")
        verified = verified.unionByName(_verified(more, nodes, width))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"))
    roots = _rooted(ids.select("node").distinct(), verified)
    placed = stored(ids.join(roots.hint("merge"), "node").select("doc_id", "root"), "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least.hint("merge"), "root").select("doc_id", "component_id")
