"""Substring dedup with compressed FM-indexes, one for each shard.

A window is `length` consecutive words. Windows are dealt to shards by content: a window's minimiser is the smallest
hash among its `gram`-word grams, and a run of windows with one minimiser forms a segment. Equal windows have equal
minimisers, hence meet in one shard, and the windows of a minimiser that has one segment in the corpus, and there one
place, cannot repeat: that segment is dropped before any text moves. Tasks combine segments of equal bytes, each with its
earliest place, before they are moved.

A shard's distinct segments, in the order of their earliest places, are indexed by an FM-index (wavelet matrix over the BWT
of word numbers) with a bit vector that marks where neighbouring suffixes agree on fewer than `length` words. The
segments are then streamed through it: each backward-search step extends the match by a word, and the bit vector shrinks
it to the threshold, so the statistics of all windows cost one step a word. The shard answers, for each segment, where it
is first and which of its windows are in an interval with an earlier start. A document's windows are repeats unless
an answer says that they are first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class _Hashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = max(0, len(h) - width + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc = acc * _MIX + h[j : j + n]
    return _mixed(acc)


def segments(h: np.ndarray, ends: np.ndarray, length: int, gram: int, longest: int = 32) -> tuple[np.ndarray, ...]:
    """(document, minimiser, start, windows) of each segment of documents given by their word hashes, one after another, and
    where each document ends. A run of more than `longest` windows, of periodic text, is cut."""
    starts = np.concatenate(([0], ends[:-1]))
    n = len(h) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none.astype(np.uint64), none, none
    low, have, span = gram_hashes(h, gram), 1, length - gram + 1
    while 2 * have <= span:  # the smallest of 2, 4, 8 ... grams
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: have - span], low[span - have :])
    of = np.repeat(np.arange(len(ends)), ends - starts)
    at = np.flatnonzero(of[:n] == of[length - 1 :])  # windows inside one document
    if not len(at):
        return none, none.astype(np.uint64), none, none
    value, of, at = low[at], of[at], at - starts[of[at]]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])))
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(since % longest == 0)
    return of[first], value[first], at[first], np.diff(np.append(first, len(at)))


def recurring(h: np.ndarray, begin: np.ndarray, minimiser: np.ndarray, windows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which segments, beginning at these places of h, hold the gram of their minimiser more than once. No other segment can
    hold equal windows, for each of them has that gram at a place of its own."""
    grams, found = gram_hashes(h, gram), np.zeros(len(begin), bool)
    for lo in range(0, len(begin), 10_000):  # each gram lies in some three segments: little memory at a time
        part = slice(lo, lo + 10_000)
        size = windows[part] + length - gram
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(begin[part] - first, size)
        found[part] = np.add.reduceat(grams[at] == np.repeat(minimiser[part], size), first, dtype=np.int64) > 1
    return found


# --- FM-index ------------------------------------------------------------------------------------------------------


class Bits:
    """Bit vector with constant-time rank: packed 64-bit words and their running popcounts."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)
        self.total = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        block = i >> 6
        low = self.words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank of a symbol in a prefix of a sequence of numbers below 2**depth."""

    def __init__(self, values: np.ndarray, depth: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in reversed(range(depth)):
            ones = (values >> bit & 1).astype(bool)
            bits = Bits(ones)
            self.levels.append((bit, bits, len(values) - bits.total))
            values = np.concatenate((values[~ones], values[ones]))
        self.begin = self._down(np.arange(1 << depth), np.zeros(1 << depth, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            rank = bits.rank(i)
            i = np.where(one, zeros + rank, i - rank)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before i."""
        return self._down(symbol, i) - self.begin[symbol]


class FMIndex:
    """Index of a sequence of symbols >= 0 (0 separates segments) for patterns of at most `length` symbols."""

    def __init__(self, text: np.ndarray, length: int):
        n = len(text)
        rank, ranks, h = text.astype(np.int64), {}, 1
        while h < length + 1:  # prefix doubling, to the depth that patterns need
            ranks[h] = rank
            order, rank = self._doubled(rank, rank, h)
            h *= 2
        self.suffix = order
        agree, h, have = np.zeros(n, np.int64), 0, None
        for p in sorted(ranks, reverse=True):  # classes of suffixes that agree on exactly `length` symbols
            if length - h >= p:
                have = ranks[p] if have is None else self._doubled(have, ranks[p], h)[1]
                h += p
        agree = have[self.suffix]
        self.group = np.cumsum(np.concatenate(([0], agree[1:] != agree[:-1])))
        self.first_row = np.flatnonzero(np.concatenate(([True], agree[1:] != agree[:-1])))
        self.end_row = np.append(self.first_row[1:], n)
        self.earliest = np.minimum.reduceat(self.suffix, self.first_row)
        counts = np.bincount(text)
        self.less = np.concatenate(([0], np.cumsum(counts)))
        self.bwt = WaveletMatrix(text[self.suffix - 1], max(1, int(text.max()).bit_length()))
        self.length, self.n = length, n

    @staticmethod
    def _doubled(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
        """Order and dense ranks by (left[i], right[i + h])."""
        shifted = np.zeros(len(left), np.int64)
        shifted[: len(left) - h] = right[h:] + 1
        key = left * (int(right.max()) + 2) + shifted
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(len(left), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        return order, rank

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + pattern from those of the patterns."""
        less = self.less[symbol]
        both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return less + both[: len(lo)], less + both[len(lo) :]

    def shrink(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns' first `length` symbols."""
        return self.first_row[self.group[lo]], self.end_row[self.group[hi - 1]]


def repeated_windows(symbols: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the segments occur earlier. symbols: the words of the segments, in the order of documents and places,
    each segment followed by a 0; starts: where each begins. Returns a flag for each window, segment after segment."""
    index = FMIndex(symbols, length)
    size = windows + length - 1
    first = np.concatenate(([0], np.cumsum(windows)))
    flags = np.zeros(first[-1], bool)
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), index.n, np.int64)
    for k in range(int(size.max())):  # k words from the end
        live = np.flatnonzero(size > k)
        at = starts[live] + size[live] - 1 - k
        lo[live], hi[live] = index.step(symbols[at], lo[live], hi[live])
        if k >= length - 1:
            lo[live], hi[live] = index.shrink(lo[live], hi[live])
            w = size[live] - 1 - k
            flags[first[live] + w] = index.earliest[index.group[lo[live]]] < at
    return flags


# --- operator ------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.withColumn("same", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("kind", F.xxhash64("text"))


def _minimisers(base: DataFrame, length: int, gram: int) -> DataFrame:
    """(minimiser, same, kind, start, windows, recurs) of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                same, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
                words = [np.array([hashes[w] for w in words_of(t)], dtype=np.uint64) for t in b.column(2).to_pylist()]
                h, ends = np.concatenate(words), np.cumsum([len(w) for w in words])
                of, minimiser, start, windows = segments(h, ends, length, gram)
                recurs = recurring(h, np.concatenate(([0], ends))[of] + start, minimiser, windows, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(minimiser.view(np.int64)), pa.array(same[of]), pa.array(kind[of]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(recurs)],
                    names=["minimiser", "same", "kind", "start", "windows", "recurs"],
                )

    return base.select("same", "kind", "text").mapInArrow(run, "minimiser bigint, same bigint, kind bigint, start int, windows int, recurs boolean")


#: Bytes of distinct segments that a task keeps before it sends them on.
COMBINED = 32 << 20


def _contents(with_text: DataFrame, length: int) -> DataFrame:
    """(deal, same, kind, start, windows, words): the candidate segments' distinct bytes in a task, or in what it kept at a time,
    with their earliest place. Segments of a hot minimiser are dealt window by window, by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple] = {}
        size, types = 0, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        digest = xxhash.xxh64_intdigest

        def sent() -> Iterator[pa.RecordBatch]:
            rows = list(kept.items())
            for lo in range(0, len(rows), 20_000):
                part = rows[lo : lo + 20_000]
                columns = zip(*[v for _, v in part], strict=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array([w for w, _ in part], pa.binary())], names=["same", "kind", "start", "windows", "deal", "words"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                listed = b.column(3)
                edge, fields = np.asarray(listed.offsets) - listed.offsets[0].as_py(), listed.flatten()
                starts, windows, minimisers, hots = (fields.field(c).to_pylist() for c in ("start", "windows", "minimiser", "hot"))
                for i, (same, kind, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                    words = words_of(text)
                    joined = b" ".join(words)
                    ends = np.cumsum([len(w) + 1 for w in words])
                    begin, ends = [0, *ends.tolist()], ends.tolist()
                    for k in range(edge[i], edge[i + 1]):
                        start, n, deal = starts[k], windows[k], minimisers[k]
                        for s, m in [(start + j, 1) for j in range(n)] if hots[k] else [(start, n)]:
                            content = joined[begin[s] : ends[s + m + length - 2] - 1]
                            first = kept.get(content)
                            if first is None:
                                size += len(content) + 200
                            elif first[:3] <= (same, kind, s):
                                continue
                            kept[content] = (same, kind, s, m, (digest(content) if hots[k] else deal) & 0x7FFFFFFFFFFFFFFF)
                    if size > COMBINED:
                        yield from sent()
                        kept.clear()
                        size = 0
        yield from sent()

    return with_text.select("same", "kind", "text", "segments").mapInArrow(run, "same bigint, kind bigint, start int, windows int, deal bigint, words binary")


def _answers(shard_rows: pa.Table, length: int) -> pa.Table:
    """One shard: index its distinct segments and stream them; (same, kind, start, flags), for each its first place and a byte for
    each window, 1 if it occurs earlier."""
    same, kind, start = (np.asarray(shard_rows.column(c)) for c in ("same", "kind", "start"))
    words, first = shard_rows.column("words").to_pylist(), {}
    for i in np.lexsort((start, kind, same)).tolist():
        first.setdefault(words[i], i)
    order = np.fromiter(first.values(), np.int64, len(first))
    same, kind, start = same[order], kind[order], start[order]
    windows = np.asarray(shard_rows.column("windows"))[order].astype(np.int64)
    numbers: dict[bytes, int] = {}
    symbols = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for content in first for w in (*content.split(b" "), b"")), np.int64)
    symbols[symbols == numbers[b""]] = 0  # no word is empty: the end of a segment
    size = windows + length - 1
    flags = repeated_windows(symbols, np.concatenate(([0], np.cumsum(size + 1)[:-1])), windows, length)
    edges = np.concatenate(([0], np.cumsum(windows)))
    raw = flags.tobytes()
    return pa.table({"same": pa.array(same), "kind": pa.array(kind), "start": pa.array(start), "flags": pa.array([raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())})


def _intervals(found: DataFrame, length: int) -> DataFrame:
    """(same, kind, spans) of documents with candidate segments and the answers for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for segs, told in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                repeated = np.zeros(max(s["start"] + s["windows"] for s in segs), bool)
                for s in segs:
                    repeated[s["start"] : s["start"] + s["windows"]] = True
                for a in told or ():
                    repeated[a["start"] : a["start"] + len(a["flags"])] = np.frombuffer(a["flags"], bool)
                hit = np.flatnonzero(repeated)
                cut = np.flatnonzero(np.diff(hit) > length)
                ends = zip(hit[np.append(0, cut + 1)].tolist(), (hit[np.append(cut, len(hit) - 1)] + length).tolist(), strict=True) if len(hit) else ()
                spans.append([{"begin": x, "end": y} for x, y in ends])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], names=["same", "kind", "spans"])

    return found.select("same", "kind", "segments", "told").mapInArrow(run, "same bigint, kind bigint, spans array<struct<begin: int, end: int>>").where(F.size("spans") > 0)


def repeats(docs: DataFrame, length: int = 20, gram: int = 5, shard_segments: int = 40_000) -> DataFrame:
    """(same, kind, spans): word intervals [begin, end) covered by windows that also start earlier; only documents with any.

    same, kind identify the document: its id (null: the smallest long) and its text's hash.
    """
    base = _keyed(docs)
    places = stored(_minimisers(base, length, gram), "places")
    counts = stored(places.groupBy("minimiser").agg(F.count("*").alias("n"), F.bool_or("recurs").alias("again")).where("n > 1 or again").drop("again"), "counts")
    candidates = places.join(counts, "minimiser").withColumn("hot", F.col("n") > shard_segments // 4)
    grouped = stored(candidates.groupBy("same", "kind").agg(F.collect_set(F.struct("start", "windows", "minimiser", "hot")).alias("segments")), "candidates")
    contents = stored(_contents(base.join(grouped.hint("merge"), ["same", "kind"]), length), "contents")
    shards = max(1, -(-contents.count() // shard_segments))
    dealt = contents.withColumn("shard", F.pmod("deal", F.lit(shards))).drop("deal")
    answers = stored(dealt.groupBy("shard").applyInArrow(lambda t: _answers(t, length), "same bigint, kind bigint, start int, flags binary"), "answers")
    told = answers.groupBy("same", "kind").agg(F.collect_list(F.struct("start", "flags")).alias("told"))
    return _intervals(grouped.select("same", "kind", F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["windows"].alias("windows"))).alias("segments")).join(told, ["same", "kind"], "left"), length)


def remove_repeats(docs: DataFrame, length: int = 20, gram: int = 5, shard_segments: int = 40_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256), one row for each row of docs.

    A word goes if a window that covers it also starts earlier: in a smaller doc_id, or in the same document before. Kept
    words are joined by one space. Null, empty and short texts have no windows. A null doc_id comes before all others.
    Rows of one doc_id with different texts count as documents ordered by text hash; equal rows as one document, each of
    them reported.
    """
    spans = stored(repeats(docs, length, gram, shard_segments), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, gone = words_of(text), 0
                if found:
                    keep = np.ones(len(words), bool)
                    for s in found:
                        keep[s["begin"] : s["end"]] = False
                    gone = len(words) - int(keep.sum())
                    words_kept = [words[i] for i in np.flatnonzero(keep)]
                else:
                    words_kept = words
                kept = b" ".join(words_kept)
                for column, v in zip(out, (len(words), gone, kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, types)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    joined = _keyed(docs).join(spans.hint("merge"), ["same", "kind"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
