"""Chunk and vector writers and providers of embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as T
from .store import Store, bucket_of, upsert_replace


class Provider(Protocol):
    """Vectors of texts. Called on executors, so it must pickle; a model is loaded in `embed`, once a process."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Vectors from the digest of a text, for tests: up to eight values in [-1, 1], then zeros."""

    def __init__(self, dimensions: int):
        self.name, self.dimensions = "sha256", dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, t in zip(out, texts, strict=True):
            bits = np.frombuffer(hashlib.sha256(t.encode()).digest(), "<u4")[: self.dimensions]
            row[: len(bits)] = bits.astype(np.float32) / np.float32(2**32 - 1) * 2 - 1
        return out.tolist()


class OnnxProvider:
    """Refuses: no model is shipped."""

    def __init__(self, path: str):
        raise RuntimeError(f"no embedding model at {path}: models are not shipped")


def embedded(chunks: DataFrame, provider: Provider, text: str = "content") -> DataFrame:
    """chunks with the provider's vector of column `text`; a null text has none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list = [None] * len(b)
            there = [i for i, t in enumerate(b) if t is not None]
            for i, v in zip(there, provider.embed([b.iloc[i] for i in there]) if there else (), strict=True):
                out[i] = v
            yield pd.Series(out, index=b.index)

    return chunks.withColumn("embedding", run(F.col(text)))


def decoded(blob: Column) -> Column:
    """Little-endian 32-bit floats to an array; null if the length is no multiple of four."""

    @F.pandas_udf("array<float>")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))

    return run(blob)


def encoded(vector: Column) -> Column:
    """The reverse."""

    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(vector)


def chunk_rows(items: DataFrame, limit: int = 512, overlap: int = 64) -> DataFrame:
    """(source_id, chunk_idx, content, token_count) of each path's prose, its messages joined by blank lines in order."""
    said = items.where(F.col("content_type") != "tool").groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("said"))
    whole = F.array_join(F.transform("said", lambda s: s["text"]), "\n\n")
    return said.select(F.col("source_path").alias("source_id"), F.posexplode(chunking.chunks(whole, limit, overlap)).alias("chunk_idx", "content")).withColumn("token_count", T.token_count(F.col("content")))


def write_chunks(store: Store, chunks: DataFrame) -> int:
    """Replace the chunks of the sources among `chunks` (source_id, chunk_idx, content, token_count, and embedding or none)."""
    if "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    with store.lock():
        sources = chunks.select("source_id").distinct()
        buckets = [r["b"] for r in sources.select(bucket_of(F.col("source_id")).alias("b")).distinct().collect()]
        old = store.table("chunks", buckets)
        rows = chunks.withColumn("chunk_idx", F.col("chunk_idx").cast("int")).select(*old.columns)
        return store.commit({"chunks": old.join(sources, "source_id", "left_anti").select(*old.columns).unionByName(rows)}, buckets, store.version)


def write_vectors(store: Store, vectors: DataFrame, model: str, dimensions: int) -> int:
    """Set the vectors (source_id, chunk_idx, embedding) of stored chunks and note the model of each."""
    with store.lock():
        buckets = [r["b"] for r in vectors.select(bucket_of(F.col("source_id")).alias("b")).distinct().collect()]
        new = vectors.select("source_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("embedding").alias("new"))
        old = store.table("chunks", buckets)
        chunks = old.join(new, ["source_id", "chunk_idx"], "left").withColumn("embedding", F.coalesce("new", "embedding")).select(*old.columns)
        named = new.join(old.select("source_id", "chunk_idx"), ["source_id", "chunk_idx"], "left_semi").select(F.concat_ws("#", "source_id", F.col("chunk_idx").cast("string")).alias("chunk_id"), F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), F.current_timestamp().alias("created_at"))
        return store.commit({"chunks": chunks, "embedding_metadata": upsert_replace(store.table("embedding_metadata"), named, ["chunk_id", "model"], [F.desc("created_at")])}, buckets, store.version)


def embed_store(store: Store, provider: Provider, limit: int = 512, overlap: int = 64) -> int:
    """Chunk all stored prose, embed the chunks and store both."""
    write_chunks(store, chunk_rows(store.table("items"), limit, overlap))
    return write_vectors(store, embedded(store.table("chunks"), provider).select("source_id", "chunk_idx", "embedding"), provider.name, provider.dimensions)


def chunk_items(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks with the messages of their source, all of them."""
    return chunks.join(items, F.col("source_id") == F.col("source_path"))
