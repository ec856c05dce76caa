"""Katz back-off language model, trained and evaluated where the counts live.

Documents are cut into blocks of some million tokens, tokenised once and stored. For each order, a block sends its distinct
n-grams with their training counts, packed, to buckets of n-gram hashes; a bucket adds them up over all blocks, stores the
model's table and answers each block in the order it asked. So an n-gram crosses the network once for each block that
holds it and not once for each occurrence, no vocabulary is gathered anywhere, and a frequent context is no hot key, for its
n-grams are dealt by their own hashes.

Tables, stored in the shared folder and partitioned by kind: `count` (order, bucket, keys, counts) holds all n-grams, those
seen once as well; `reply` and `size` serve the evaluation. Counts up to 5 get Good-Turing discounts. A context's back-off
weight is the mass that its discounts free, divided by the lower order's mass of the words it was not seen with. Of all blocks
that hold an n-gram one owns it and adds it to its context's two sums, so each counts once; contexts that no
other block may ask for are summed in place, the others in buckets. Tokens are evaluated recursively: the n-gram, or else the context's weight
times the probability of the shorter n-gram, down to discounted words and the mass of unseen ones.

A block's messages to a bucket are as many as blocks times buckets, (tokens / block_tokens) squared, and never more than
its n-grams: block_tokens should follow the memory of executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, discard, frugal, pack, stored, unpack

#: Both the context before a text's first word and the token after its last.
EDGE = np.uint64(0x9AE16A3B2F90404F)
CUT = 5
#: Parts in which blocks are evaluated, and n-grams of an order beyond two counted, one after another: less is on disk at a time.
TURNS, COUNT_TURNS = 3, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def good_turing(n: dict[int, int]) -> tuple[float, ...]:
    """Katz's discounts of counts 1..5 from the numbers n of items of each count. Where the numbers do not give a discount
    between 0 and 1, absolute discounting stands in."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    absolute = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    common = (CUT + 1) * n.get(CUT + 1, 0) / n1 if n1 else 1.0
    out = []
    for r in range(1, CUT + 1):
        d = 0.0
        if n.get(r) and n.get(r + 1) and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out.append(d if 0 < d < 1 else (r - absolute) / r)
    return tuple(out)


@dataclass(frozen=True)
class Totals:
    tokens: int
    words: int
    discounts: tuple[tuple[float, ...], ...]  # by order, from 1, and count, from 1
    unseen: float  # the probability of all unseen words

    def discounted(self, order: int, count: np.ndarray) -> np.ndarray:
        return np.array([0, *self.discounts[order - 1], 1.0])[np.minimum(count, CUT + 1)] * count

    def word(self, count: np.ndarray) -> np.ndarray:
        """Unigram probabilities from counts."""
        return np.where(count > 0, self.discounted(1, count) / max(1, self.tokens), self.unseen)


# --- blocks --------------------------------------------------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending; each value's place among them; where one of each stands."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    places = np.empty(len(values), np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], places, order[new]


_BLOCK = "block bigint, doc_ids array<bigint>, trained binary, held binary, ends binary, words binary, local binary"


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """Blocks of at least `size` tokens (but each partition's last) of docs (doc_id, text, trained, held_out). words: the
    block's distinct token hashes, ascending; local: each token's place among them; ends: where documents end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = _Hashes(), TaskContext.get().partitionId() << 32
        ids, trained, held, parts, total = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            joined = np.concatenate(parts)
            parts.clear()
            words, local, _ = distinct(joined)
            blobs = [pa.array([x], pa.binary()) for x in (pack(np.array(trained, bool)), pack(np.array(held, bool)), pack(ends.astype(np.int64)), pack_sorted(words), pack_planes(local))]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), *blobs], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for i, text, used, out in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    h = [hashes[w] for w in (text or "").encode().lower().split()]
                    h.append(int(EDGE))
                    parts.append(np.array(h, dtype=np.uint64))
                    ids.append(i)
                    trained.append(used)
                    held.append(out)
                    total += len(h)
                    if total >= size:
                        yield closed()
                        ids, trained, held, total, number = [], [], [], 0, number + 1
        if parts:
            yield closed()

    return docs.mapInArrow(frugal(run), _BLOCK)


def pack_planes(values: np.ndarray) -> bytes:
    """Compressed byte planes: planes of high bytes, mostly equal, take next to no room."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack_planes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not (raw := zstandard.decompress(blob)):
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences."""
    return pack_planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob, np.uint64), dtype=np.uint64)


@dataclass
class Grams:
    """A block's distinct n-grams of one order. keys: their hashes, ascending; place: each token's n-gram, -1 if its text has
    not enough before it; context: each n-gram's context among those of the order below; at: a token that ends it."""

    keys: np.ndarray
    place: np.ndarray
    context: np.ndarray
    at: np.ndarray


def grams(words: np.ndarray, local: np.ndarray, ends: np.ndarray, orders: int) -> list[Grams]:
    """N-grams of orders 1 to `orders`. The first token's context is EDGE; contexts do not reach further back."""
    words_at = words[local]
    out = [Grams(words, local, np.zeros(0, np.int32), np.zeros(0, np.int64))]
    starts = np.append(0, ends[:-1])
    edge = int(np.searchsorted(words, EDGE))
    hashes, valid = words_at, np.ones(len(local), bool)
    for order in range(2, orders + 1):
        before, below = np.empty_like(hashes), np.empty_like(out[-1].place)
        before[1:], below[1:] = hashes[:-1], out[-1].place[:-1]
        if order == 2:
            before[starts], below[starts] = EDGE, edge
        else:
            valid = valid.copy()
            late = starts + order - 3  # a text's tokens from here on have a context of this length
            valid[late[late < ends]] = False
        with np.errstate(over="ignore"):
            mixed = (before + np.uint64(order)) * _MIX + words_at
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = mixed ^ (mixed >> np.uint64(29))
        del before, mixed
        at = np.flatnonzero(valid).astype(np.int32)
        keys, places, sample = distinct(hashes[at])
        place = np.full(len(local), -1, np.int32)
        place[at] = places
        sample = at[sample]
        out.append(Grams(keys, place, below[sample], sample))
        del at, places
    return out


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of equal hash ranges begins among ascending keys."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def _filled(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    edges = _edges(keys, buckets)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(edges[k], edges[k + 1])


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, local, ends, trained tokens) of a stored block."""
    ends = unpack(row["ends"], np.int64)
    used = np.repeat(unpack(row["trained"], bool), np.diff(ends, prepend=0))
    return unpack_sorted(row["words"]), unpack_planes(row["local"], np.int32), ends, used


# --- counting ------------------------------------------------------------------------------------------------------


def _ask(blocks: DataFrame, orders: list[int], buckets: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(order, bucket, block, keys, counts, held): each block's n-grams of these orders in each bucket of this turn, with their training counts
    and whether texts that are scored only hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, local, ends, used = _read(row)
                found = grams(words, local, ends, max(orders))
                for order in orders:
                    g = found[order - 1]
                    counts = np.bincount(g.place[used & (g.place >= 0)], minlength=len(g.keys)).astype(np.int64)
                    held = np.zeros(len(g.keys), bool)
                    held[g.place[~used & (g.place >= 0)]] = True
                    out = [(order, k, row["block"], pack_sorted(g.keys[s]), pack_planes(counts[s]), pack(np.packbits(held[s]))) for k, s in _filled(g.keys, buckets) if k % turns == turn]
                    if out:
                        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["order", "bucket", "block", "keys", "counts", "held"])

    return blocks.select("block", "trained", "ends", "words", "local").mapInArrow(frugal(run), "order int, bucket int, block bigint, keys binary, counts binary, held binary")


_ROWS = "kind string, order int, bucket int, block bigint, n bigint, m bigint, x binary, y binary"


def _counted(asked: pa.Table) -> pa.Table:
    """A bucket's counts. Rows: count (x: keys, y: counts); size (n: n-grams of count m; m = 0: of any count, with the sum of
    counts as block); reply (block; y: for each asked n-gram its count, times four, plus two if other blocks asked for it as
    well and one of them may want its weight as a context, plus one if the block owns it)."""
    asked = asked.sort_by("block")
    order, bucket = asked.column("order")[0].as_py(), asked.column("bucket")[0].as_py()
    parts = [unpack_sorted(x) for x in asked.column("keys").to_pylist()]
    cuts = np.cumsum([0, *map(len, parts)])
    keys, of, _ = distinct(np.concatenate(parts))
    counts = np.concatenate([unpack_planes(x, np.int64) for x in asked.column("counts").to_pylist()])
    totals = np.bincount(of, counts, len(keys)).astype(np.int64)
    given = np.flatnonzero(counts)
    owner = np.full(len(keys), -1, np.int64)
    owner[of[given[::-1]]] = given[::-1]  # the first that was seen in training
    held = np.concatenate([np.unpackbits(unpack(x, np.uint8), count=len(p)) for x, p in zip(asked.column("held").to_pylist(), parts, strict=True)])
    answer = 4 * totals[of] + 2 * ((np.bincount(of, minlength=len(keys)) > 1) & (np.bincount(of, held, len(keys)) > 0))[of]
    answer[owner[owner >= 0]] += 1
    seen = totals > 0
    sizes = np.bincount(np.minimum(totals, CUT + 2), minlength=CUT + 3)
    rows = [("count", order, bucket, None, None, None, pack_sorted(keys[seen]), pack_planes(totals[seen])), ("size", order, bucket, int(totals.sum()), int(seen.sum()), 0, None, None)]
    rows += [("size", order, bucket, None, int(sizes[r]), r, None, None) for r in range(1, CUT + 2)]
    rows += [("reply", order, bucket, b, None, None, None, pack_planes(answer[cuts[i] : cuts[i + 1]])) for i, b in enumerate(asked.column("block").to_pylist())]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _ROWS.split(", ")])


def _totals(sizes: DataFrame, orders: int) -> Totals:
    """Sums of the buckets' sizes: a few numbers for each order."""
    got = sizes.groupBy("order", "m").agg(F.sum("n").alias("n"), F.sum("block").alias("s")).collect()
    n = {(r["order"], r["m"]): r["n"] for r in got}
    tokens = sum(r["s"] for r in got if (r["order"], r["m"]) == (1, 0))
    by = [{r: n.get((k, r), 0) for r in range(1, CUT + 2)} for k in range(1, orders + 1)]
    discounts = [good_turing(b) for b in by]
    freed = sum((1 - discounts[0][r - 1]) * r * by[0][r] for r in range(1, CUT + 1)) / max(1, tokens)
    if tokens and freed <= 0:  # no word is rare: free half a count of each rare class, or half a count
        discounts[0] = tuple((r - 0.5) / r for r in range(1, CUT + 1))
        freed = max(0.5 / tokens, sum(0.5 * by[0][r] for r in range(1, CUT + 1)) / tokens)
    return Totals(tokens, n.get((1, 0), 0), tuple(discounts), freed if tokens else 1.0)


# --- evaluation ----------------------------------------------------------------------------------------------------


def weight(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 of the back-off weight of contexts: q is the probability of the words seen after them, p that of the same words
    in the order below."""
    return np.log10(np.maximum(1 - q, 1e-12)) - np.log10(np.maximum(1 - p, 1e-12))


#: Mantissa bits of sums of probabilities that are not sent: what is left is exact to a part in 10**8 of them.
_SPARED = np.uint64((1 << 64) - (1 << 24))
_STATE = "kind string, order int, bucket int, block bigint, keys binary, total binary, classes binary, p binary, asked binary, doc_ids array<bigint>, held binary, n_tokens binary, n_known binary, base binary, score binary, waiting array<binary>"


def _classes(context: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """For each of n contexts how many n-grams have a count of 1 to 5, and the sum of larger counts."""
    rows = [np.bincount(context[count == r], minlength=n) for r in range(1, CUT + 1)]
    large = count > CUT
    return np.array([*rows, np.bincount(context[large], count[large], n).astype(np.int64)])


def _evaluated(totals: Totals, orders: int, buckets: int):
    """Score a block but for the weights of contexts that other blocks hold as well. Rows: sum (keys of such contexts, their
    counts, how many n-grams of each count from 1 to 5 the block owns and the sum of larger counts, the lower order's probability p of
    their words, and which weights the block asks for), state (the scores so far; waiting: for each
    order, the documents and places among the asked contexts whose weights are to be added)."""

    def run(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        del key
        row = block.slice(0, 1).to_pylist()[0]
        words, local, ends, _ = _read(row)
        found = grams(words, local, ends, orders)
        replies = replies.sort_by([("order", "ascending"), ("bucket", "ascending")])
        told: list[list[np.ndarray]] = [[] for _ in found]
        for order, blob in zip(replies.column("order").to_pylist(), replies.column("y").to_pylist(), strict=True):
            told[order - 1].append(unpack_planes(blob, np.int64))
        answers = [np.concatenate(t) if t else np.zeros(0, np.int64) for t in told]
        count, shared, own = [a >> 2 for a in answers], [(a & 2) > 0 for a in answers], [(a & 1) > 0 for a in answers]
        starts = np.append(0, ends[:-1])
        doc = np.repeat(np.arange(len(ends), dtype=np.int32), ends - starts)
        p = [totals.word(count[0])]  # probabilities of the n-grams seen in training
        rows, waiting = [], []
        score = np.log10(p[0])[local]  # of each token, by the longest n-gram that was seen
        for order in range(2, orders + 1):
            g, below = found[order - 1], found[order - 2]
            total = count[order - 2][g.context]
            p.append(totals.discounted(order, count[order - 1]) / np.maximum(total, 1))
            lower = p[-2][below.place[g.at]]
            mine, n = own[order - 1], len(below.keys)
            sum_q, sum_p = (np.bincount(g.context[mine], x[mine], n) for x in (p[-1], lower))
            classes = _classes(g.context[mine], count[order - 1][mine], n)
            others = shared[order - 2]
            at = np.flatnonzero(g.place >= 0)
            of = g.place[at]
            seen = count[order - 1][of] > 0
            score[at[seen]] = np.log10(p[-1][of[seen]])
            at, context = at[~seen], g.context[of[~seen]]
            logs = np.where(others, 0.0, weight(sum_q, sum_p))  # of a context without n-grams: 1
            score[at] += logs[context]
            open_ = others[context] & (count[order - 2][context] > 0)
            asks, which = np.unique(context[open_], return_inverse=True)
            asked = np.zeros(n, bool)
            asked[asks] = True
            send = np.flatnonzero(others & (asked | (sum_q > 0)))
            keys, total, rest = below.keys[send], count[order - 2][send], (sum_p[send].view(np.uint64) & _SPARED).view(np.float64)
            rows += [("sum", order, k, row["block"], pack_sorted(keys[s]), pack_planes(total[s]), pack_planes(classes[:, send[s]].ravel()), pack_planes(rest[s]), pack(np.packbits(asked[send[s]]))) + (None,) * 7 for k, s in _filled(keys, buckets)]
            waiting += [pack(doc[at[open_]]), pack(which.astype(np.int32))]
        known = count[0] > 0
        base = np.log10((count[0] + 1) / (totals.tokens + totals.words + 1))
        sums = [np.add.reduceat(x, starts) for x in (known[local].astype(np.int64), base[local], score)]
        rows.append(("state", 0, 0, row["block"], None, None, None, None, None, row["doc_ids"], row["held"], pack(ends - starts), *map(pack, sums), waiting))
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.binary())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _STATE.split(", ")])

    return run


def _weighed(totals: Totals):
    def run(sums: pa.Table) -> pa.Table:
        """A bucket's contexts: (order, bucket, block, logs), the weights each block asked for."""
        sums = sums.sort_by("block")
        order = sums.column("order")[0].as_py()
        parts = [unpack_sorted(x) for x in sums.column("keys").to_pylist()]
        cuts = np.cumsum([0, *map(len, parts)])
        keys, of, sample = distinct(np.concatenate(parts))
        total = np.concatenate([unpack_planes(x, np.int64) for x in sums.column("total").to_pylist()])[sample]
        classes = np.concatenate([unpack_planes(x, np.int64).reshape(CUT + 1, -1) for x in sums.column("classes").to_pylist()], axis=1)
        freed = [*(d * r for r, d in enumerate(totals.discounts[order - 1], 1)), 1.0]
        q = sum(w * np.bincount(of, classes[r], len(keys)) for r, w in enumerate(freed)) / np.maximum(total, 1)
        p = np.bincount(of, np.concatenate([unpack_planes(x, np.float64) for x in sums.column("p").to_pylist()]), len(keys))
        logs = weight(q, p)
        asked = [np.unpackbits(unpack(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(sums.column("asked").to_pylist(), parts, strict=True)]
        out = [pack(logs[of[cuts[i] : cuts[i + 1]][a]]) for i, a in enumerate(asked)]
        return pa.table({"order": sums.column("order"), "bucket": sums.column("bucket"), "block": sums.column("block"), "logs": pa.array(out, pa.binary())})

    return run


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _finished(totals: Totals, orders: int):
    def run(key: tuple, state: pa.Table, weights: pa.Table) -> pa.Table:
        del key
        row = state.slice(0, 1).to_pylist()[0]
        score = unpack(row["score"], np.float64).copy()
        weights = weights.sort_by([("order", "ascending"), ("bucket", "ascending")])
        for order in range(2, orders + 1):
            logs = [unpack(x, np.float64) for o, x in zip(weights.column("order").to_pylist(), weights.column("logs").to_pylist(), strict=True) if o == order]
            doc, which = (unpack(x, np.int32) for x in row["waiting"][2 * (order - 2) : 2 * (order - 1)])
            if len(doc):
                score += np.bincount(doc, np.concatenate(logs)[which], len(score))
        n_tokens, n_known, base = unpack(row["n_tokens"], np.int64), unpack(row["n_known"], np.int64), unpack(row["base"], np.float64)
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(unpack(row["held"], bool)), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(score), totals.tokens)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=[c.split()[0] for c in _SCORES.split(", ")])

    return run


def score_corpus(docs: DataFrame, held_out: int = 7, remainder: int = 2, orders: int = 3, block_tokens: int = 1_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Rows with crc32(doc_id as text) modulo held_out = remainder are scored only; the others are learnt from as well. Tokens:
    A-Z lower-cased words, then one end. base_score: add-one unigram log10 probability; score: the model's. Null and
    empty texts are the end token alone; null and repeated ids are rows of their own. Nothing to learn from: every token
    has the unseen mass 1. An empty table has no rows.
    """
    out = crc_mod(F.col("doc_id"), held_out) == remainder
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", (~out).alias("trained"), out.alias("held_out"))
    blocks = _blocks(base, block_tokens).withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(TURNS)).cast("int"))
    blocks = stored(blocks, "blocks", partition_by=("turn",))
    # as many buckets as full blocks, nearly: a bucket then takes about as much memory as a block, at any size of input
    length = base.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = max(1, -(-int(length / 6) // block_tokens))
    steps = [(list(range(1, min(orders, 2) + 1)), 0, 1), *(([k], t, COUNT_TURNS) for k in range(3, orders + 1) for t in range(COUNT_TURNS))]
    model = [stored(_ask(blocks, of, buckets, t, n).groupBy("order", "bucket").applyInArrow(_counted, _ROWS), "model", partition_by=("kind",)) for of, t, n in steps]
    kind = lambda k: reduce(DataFrame.unionByName, [m.where(F.col("kind") == k).toDF(*m.columns) for m in model])
    totals = _totals(kind("size"), orders)
    replies = kind("reply").select("order", "bucket", "block", "y")
    # each turn drops its blocks
    evaluated = []
    for t in range(TURNS):
        of_turn = blocks.where(F.col("turn") == t).drop("turn")
        mine = replies.where(F.pmod(F.xxhash64("block"), F.lit(TURNS)) == t)
        evaluated.append(stored(of_turn.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_evaluated(totals, orders, buckets), _STATE), "evaluated", partition_by=("kind",)))
        discard(blocks, f"turn={t}")
    for m in model:
        discard(m, "kind=reply")
    told = reduce(DataFrame.unionByName, evaluated)
    sums = told.where("kind = 'sum'").select("order", "bucket", "block", "keys", "total", "classes", "p", "asked")
    weights = stored(sums.groupBy("order", "bucket").applyInArrow(_weighed(totals), "order int, bucket int, block bigint, logs binary"), "weights")
    for e in evaluated:
        discard(e, "kind=sum")
    states = told.where("kind = 'state'").select("block", "doc_ids", "held", "n_tokens", "n_known", "base", "score", "waiting")
    return states.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(_finished(totals, orders), _SCORES)
