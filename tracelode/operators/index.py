"""Stored full-text indexes: postings of stemmed prose and of trigrams of tool text.

An index is a set of immutable segments, one for each commit, sorted by term, so that a query reads the row groups of its own
terms only. Rows of messages that were deleted since stay in their segments until `merged` and are left out by the join
with the live messages, whose ids are the postings' ids. The number of messages and their lengths, which BM25 needs, are
kept for each bucket of the store and added up without a job.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem
from . import search

PROSE, TOOL = "postings", "grams"
SCHEMAS = {PROSE: "term string, id bigint, positions array<int>, dl int", TOOL: "term string, id bigint, dl int"}


def stems(words: DataFrame) -> DataFrame:
    """(word, term) for the distinct words of column `word`: each is stemmed once."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(stem)

    return words.select("word").distinct().withColumn("term", run("word"))


def prose_postings(items: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, id, positions, dl) of the prose among items (id, text, content_type)."""
    rows = items.where(F.col("content_type").isin(search.PROSE)).select("id", search.prose_tokens(F.col("text")).alias("tokens"))
    words = rows.select("id", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("at", "word"))
    words = words.join(stems(words), "word") if stemmed else words.withColumn("term", F.col("word"))
    return words.groupBy("term", "id", "dl").agg(F.sort_array(F.collect_list("at")).alias("positions")).select("term", "id", "positions", "dl")


def tool_grams(items: DataFrame, content_types: tuple[str, ...] = ("tool",)) -> DataFrame:
    """(term, id, dl): the distinct trigrams of lower-cased tool text. Texts of fewer than three characters have none."""
    low = F.lower("text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))
    rows = items.where(F.col("content_type").isin(*content_types) & (F.char_length(low) >= 3))
    return rows.select(F.explode(grams).alias("term"), "id", (F.char_length(low) - 2).cast("int").alias("dl"))


def lengths(items: DataFrame) -> DataFrame:
    """(kind, n, total): number and summed lengths of the messages that each index covers."""
    low = F.char_length(F.lower("text"))
    prose = items.where(F.col("content_type").isin(search.PROSE)).agg(F.count("*").alias("n"), F.sum(F.size(search.prose_tokens(F.col("text"))).cast("long")).alias("total")).withColumn("kind", F.lit(PROSE))
    tool = items.where("content_type = 'tool'").agg(F.count("*").alias("n"), F.sum(F.greatest(low - 2, F.lit(0)).cast("long")).alias("total")).withColumn("kind", F.lit(TOOL))
    return prose.unionByName(tool).select("kind", "n", F.coalesce("total", F.lit(0)).alias("total"))


def merged(segments: DataFrame, live: DataFrame) -> DataFrame:
    """All segments as one: rows of live messages (id), each once."""
    return segments.dropDuplicates(["term", "id"]).join(live.select("id"), "id", "left_semi").select(*segments.columns)


def _idf(n: int, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf)


def _scored(hits: list[DataFrame], n: int, total: int) -> DataFrame:
    """(id, score): BM25 over phrases' hits (id, tf, dl); every phrase must occur. Lower is better."""
    mean = total / n if n else 1.0
    parts = []
    for i, hit in enumerate(hits):
        df = hit.agg(F.count("*").alias("df"))
        tf = F.col("tf").cast("double")
        part = _idf(n, F.col("df")) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("dl") / mean))
        parts.append(hit.crossJoin(F.broadcast(df)).select("id", part.alias("part"), F.lit(i).alias("phrase")))  # a single row
    all_parts = reduce(DataFrame.unionByName, parts)
    return all_parts.groupBy("id").agg((-F.sum("part")).alias("score"), F.count("*").alias("phrases")).where(F.col("phrases") == len(hits)).select("id", "score")


def search_prose(postings: DataFrame, live: DataFrame, n: int, total: int, query: str, stopwords: frozenset[str] = frozenset(), stemmed: bool = True, prefix: bool = True) -> DataFrame:
    """(id, score) of live messages (id) that hold every phrase of the query."""
    hits = []
    for tokens, pre in search.query_phrases(query, set(stopwords), stemmed, prefix):
        found = None
        for j, token in enumerate(tokens):
            last = pre and j == len(tokens) - 1
            rows = postings.where(F.col("term").startswith(token) if last else F.col("term") == token).dropDuplicates(["term", "id"])
            at = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("at"), F.first("dl").alias("dl"))
            at = at.withColumn("at", F.transform("at", _back(j)))
            found = at if found is None else found.join(at.select("id", F.col("at").alias("next")), "id").withColumn("at", F.array_intersect("at", "next")).drop("next")
        hits.append(found.where(F.size("at") > 0).join(live.select("id"), "id", "left_semi").select("id", F.size("at").alias("tf"), "dl"))
    return _scored(hits, n, total)


def _back(j: int):
    return lambda p: p - j


def search_tool(grams: DataFrame, items: DataFrame, n: int, total: int, query: str, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """(id, score) of live messages (id, text) with every token of three characters or more as a case-insensitive substring.
    Trigrams tell the candidates; their texts tell how often a token occurs, overlaps included."""
    tokens = [w.lower() for w in query.split() if w.lower() not in stopwords] or query.lower().split()
    tokens = [t for t in tokens if len(t) >= 3]
    if not tokens:
        return items.sparkSession.createDataFrame([], "id bigint, score double")
    hits = []
    for t in tokens:
        needed = sorted({t[i : i + 3] for i in range(len(t) - 2)})
        candidates = grams.where(F.col("term").isin(needed)).dropDuplicates(["term", "id"]).groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") == len(needed))
        low = F.lower("text")
        held = items.join(candidates, "id", "left_semi").select("id", F.regexp_count(low, F.lit(f"(?={re.escape(t)})")).alias("tf"), F.greatest(F.char_length(low) - 2, F.lit(0)).alias("dl"))
        hits.append(held.where("tf > 0"))
    return _scored(hits, n, total)
