"""Concatenate and cut: documents become one stream of token ids that is cut into fixed windows.

Pass 1 tokenises each input partition once and stores the ids with the partition's number and running offset. The
partitions' token totals (one number each) give exclusive prefix sums; pass 2 adds a partition's global offset and
cuts its documents at window boundaries. No row is shuffled.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal, stored

_LOADED: dict[str, object] = {}


def encoder(path: str):
    """text -> ids of the byte-level BPE at `path` (tokenizers' JSON), end-of-text strings included.

    tiktoken runs the same vocabulary from the .tiktoken file beside the JSON, which gives the ids of `tokenizers` (tests
    compare them over a whole table and odd strings) in a quarter of the time. One encoder for each path and process.
    """
    if path not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        import public_tokenizers

        end = "<|endoftext|>"
        own = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})
        _LOADED[path] = lambda text: own.encode_to_numpy(text, allowed_special={end})
    return _LOADED[path]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, seq, before, doc_id, n, ids): ids little-endian 32-bit with end_id last; `before` counts the partition's
    earlier tokens. Null text: empty, so its only id is end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids = [np.append(encode(t or ""), end_id).astype("<u4") for t in b.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                first = before + np.cumsum(n) - n
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(seq, seq + k)), pa.array(first), b.column(0), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["part", "seq", "before", "doc_id", "n", "ids"],
                )
                seq, before = seq + k, before + int(n.sum())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "part int, seq bigint, before bigint, doc_id bigint, n bigint, ids binary")


def windows(total: int, length: int) -> list[tuple[int, int]]:
    """The tail of a stream of `total` tokens as (start, length): what is left after whole windows, cut into powers of two,
    which need no padding."""
    at, tail = total - total % length, []
    for bit in reversed(range(length.bit_length())):
        if total % length >> bit & 1:
            tail.append((at, 1 << bit))
            at += 1 << bit
    return tail


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), one row for each; ids are
    little-endian 32-bit numbers, null unless with_ids.

    Documents follow each other in the order of the input's partitions. Sequence k holds tokens [k*length, (k+1)*length)
    of the stream; the remainder is cut into sequences whose lengths are powers of two, so nothing is padded. Repeated
    and null doc_ids are documents of their own. An empty table has no pieces.
    """
    tokens = stored(tokenized(docs, tokenizer, end_id), "tokens")
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number for each partition
    parts = sorted(totals)
    offsets = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0), strict=False))
    total = sum(totals.values())
    whole, tail = total // length, windows(total, length)
    bounds = [start for start, _ in tail]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [*[pa.int64()] * 7, pa.binary()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(lo, 512).to_pylist():
                    first = offsets[r["part"]] + r["before"]
                    at, end, ids = first, first + r["n"], memoryview(r["ids"])
                    while at < end:
                        if at < whole * length:
                            seq = at // length
                            begin, stop = seq * length, (seq + 1) * length
                        else:
                            k = int(np.searchsorted(bounds, at, "right")) - 1
                            seq, begin, stop = whole + k, tail[k][0], sum(tail[k])
                        stop = min(stop, end)
                        piece = ids[4 * (at - first) : 4 * (stop - first)]
                        out.append((r["doc_id"], at - first, stop - at, zlib.crc32(piece), r["n"], seq, at - begin, bytes(piece) if with_ids else None))
                        at = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return tokens.select("part", "before", "doc_id", "n", "ids").mapInArrow(frugal(run), schema)
