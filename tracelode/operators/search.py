"""Retrieval: BM25 over stemmed prose and over substrings, reciprocal rank fusion, vectors, snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.porter import stem

K1, B = 1.2, 0.75
PROSE = ["text", "code", "reasoning"]


@dataclass
class SearchRequest:
    """Bag-of-words search. content_type routes: tool to substrings, others to prose, none to both and fusion."""

    query: str
    project: str | None = None
    source: str | None = None
    source_path: str | None = None
    role: str | None = None
    content_type: str | None = None
    after: str | None = None
    before: str | None = None
    tag: str | None = None
    limit: int = 20
    offset: int = 0
    similarity_threshold: float = 0.3
    compat_order: bool = False

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("a query is required")
        if self.content_type not in (None, "", "text", "code", "tool", "reasoning"):
            raise ValueError(f"unknown content type {self.content_type!r}")
        for value in (self.after, self.before):
            if value and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
                raise ValueError(f"{value!r} is not YYYY-MM-DD")
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset are not negative")


class SearchEngine(Protocol):
    """What answers a request: the store does."""

    def search(self, request: SearchRequest) -> DataFrame: ...


def filtered(items: DataFrame, r: SearchRequest, tags: DataFrame | None = None) -> DataFrame:
    """The request's predicates; dates are exclusive at both ends, a path with * or % is a pattern."""
    out, source = items, T.source_filter(r.source)
    for column, value in (("source", source), ("project", r.project), ("role", r.role), ("content_type", r.content_type)):
        out = out.where(F.col(column) == value) if value else out
    if r.source_path:
        out = out.where(F.col("source_path").ilike(T.glob_to_like(r.source_path)) if re.search(r"[*%]", r.source_path) else F.col("source_path") == r.source_path)
    out = out.where(F.col("timestamp") > F.lit(r.after).cast("timestamp")) if r.after else out
    out = out.where(F.col("timestamp") < F.lit(r.before).cast("timestamp")) if r.before else out
    return out.join(tags.where(F.col("tag") == r.tag).select("source_path"), "source_path", "left_semi") if r.tag else out


def prose_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, diacritics folded."""
    folded = F.translate(F.lower(text), "áàâäãåéèêëíìîïóòôöõúùûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync")
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def _stemmed(tokens: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batch.map(lambda ws: [known.get(w) or known.setdefault(w, stem(w)) for w in ws])

    return run(tokens)


def query_phrases(query: str, stopwords: set[str], stemmed: bool, prefix: bool) -> list[tuple[list[str], bool]]:
    """Phrases of the query and whether their last token is a prefix; stop words go unless all words are."""
    words = [w for w in query.split() if w.lower() not in stopwords] or query.split()
    out = []
    for w in words:
        tokens = [t for t in re.split(r"[\W_]+", w.lower()) if t]
        tokens = [t.translate(str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync")) for t in tokens]
        if tokens:
            out.append(([stem(t) if stemmed else t for t in tokens], prefix))
    return out


def _bm25(scored: DataFrame, corpus: DataFrame, phrases: int) -> DataFrame:
    """Rows with tf_0.. and dl to -BM25; statistics are the whole index's, before any filter."""
    sums = corpus.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(phrases)])
    joined = scored.crossJoin(F.broadcast(sums))  # one row
    score = F.lit(0.0)
    for i in range(phrases):
        idf = F.log((F.col("n_docs") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5))
        tf = F.col(f"tf_{i}").cast("double")
        score = score - F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    for i in range(phrases):
        joined = joined.where(F.col(f"tf_{i}") > 0)
    return joined.withColumn("score", score)


def _phrase_count(tokens: list[str], prefix: bool) -> Column:
    """How often a phrase occurs in column tokens. Shifted copies are zipped, so that the lambda sees one element and never
    the column, which the optimizer would otherwise compute again for every element."""
    words = F.col("tokens")
    last = len(tokens) - 1
    same = lambda x, j: F.startswith(x, F.lit(tokens[j])) if prefix and j == last else x == tokens[j]
    if not last:
        return F.size(F.filter(words, lambda x: same(x, 0)))
    shifted = [F.slice(words, j + 1, F.greatest(F.size(words), F.lit(1))).alias(f"t{j}") for j in range(len(tokens))]

    def hit(z: Column) -> Column:
        ok = F.lit(True)
        for j in range(len(tokens)):
            ok = ok & same(z[f"t{j}"], j)
        return F.coalesce(ok, F.lit(False))

    return F.size(F.filter(F.arrays_zip(*shifted), hit))


def search_prose(items: DataFrame, query: str, stopwords: set[str] = frozenset(), stemmed: bool = True, prefix: bool = True) -> DataFrame:
    """items of prose with score (negative, lower is better); every phrase must occur."""
    rows = items.where(F.col("content_type").isin(PROSE)).withColumn("tokens", prose_tokens(F.col("text")))
    if stemmed:
        rows = rows.withColumn("tokens", _stemmed(F.col("tokens")))
    rows = rows.withColumn("dl", F.size("tokens"))
    phrases = query_phrases(query, set(stopwords), stemmed, prefix)
    for i, (tokens, pre) in enumerate(phrases):
        rows = rows.withColumn(f"tf_{i}", _phrase_count(tokens, pre))
    return _bm25(rows, rows, len(phrases)).drop("tokens", "dl", "n_docs", "avgdl", *[f"{x}_{i}" for x in ("tf", "df") for i in range(len(phrases))])


def search_tool(items: DataFrame, query: str, stopwords: set[str] = frozenset(), content_types: list[str] | None = None) -> DataFrame:
    """items with every token of three characters or more as a case-insensitive substring; tf counts overlaps."""
    tokens = [w.lower() for w in query.split() if w.lower() not in stopwords] or query.lower().split()
    tokens = [t for t in tokens if len(t) >= 3]
    rows = items.where(F.col("content_type").isin(content_types or ["tool"])).withColumn("low", F.lower("text")).withColumn("dl", F.greatest(F.char_length("low") - 2, F.lit(0)))
    for i, t in enumerate(tokens):
        spread = F.regexp_count(F.col("low"), F.lit(f"(?={re.escape(t)})"))  # an empty look-ahead match at each place counts overlaps
        rows = rows.withColumn(f"tf_{i}", spread)
    if not tokens:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False)).drop("low", "dl")
    return _bm25(rows, rows, len(tokens)).drop("low", "dl", "n_docs", "avgdl", *[f"{x}_{i}" for x in ("tf", "df") for i in range(len(tokens))])


def ranked(hits: DataFrame, limit: int = 100, offset: int = 0, compat_order: bool = False) -> DataFrame:
    """Best first; compat_order gives the worst first."""
    order = F.desc("score") if compat_order else F.asc("score")
    out = hits.orderBy(order, "id")
    return (out.offset(offset) if offset else out).limit(limit or 100)


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, score with lower better): (id, rrf), ties by id as a string.
    Each list is at most a few hundred rows, so one window over it is one small sort."""
    parts = []
    for one in lists:
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("score", "id"))
        parts.append(one.select("id", (1.0 / (k + rank)).alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.sum("part").alias("rrf")).orderBy(F.desc("rrf"), F.col("id").cast("string"))


def dynamic_stopwords(items: DataFrame, top: int = 1000) -> DataFrame:
    """Terms of prose by the number of documents that hold them."""
    terms = items.where(F.col("content_type").isin(PROSE)).select(F.explode(F.array_distinct(prose_tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "term").limit(top)


def vocabulary(items: DataFrame) -> DataFrame:
    """(term, doc, cnt) of prose."""
    terms = items.where(F.col("content_type").isin(PROSE)).select("id", F.explode(prose_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.countDistinct("id").alias("doc"), F.count("*").alias("cnt"))


def search(items: DataFrame, r: SearchRequest, tags: DataFrame | None = None, stopwords: set[str] = frozenset()) -> DataFrame:
    """Routed search; without a content type both indexes give 200 candidates each, fused."""
    if r.content_type == "tool":
        return ranked(filtered(search_tool(items, r.query, stopwords), r, tags), r.limit, r.offset, r.compat_order)
    if r.content_type:
        return ranked(filtered(search_prose(items, r.query, stopwords), r, tags), r.limit, r.offset, r.compat_order)
    both = [ranked(filtered(f(items, r.query, stopwords), r, tags), 200, 0, r.compat_order) for f in (search_prose, search_tool)]
    fused = fuse(both)
    out = fused.join(items, "id").withColumnRenamed("rrf", "score").orderBy(F.desc("score"), F.col("id").cast("string"))
    return (out.offset(r.offset) if r.offset else out).limit(r.limit or 100)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def vector_search(chunks: DataFrame, query: list[float], top: int, threshold: float | None = None) -> DataFrame:
    """Best similarity of each source, positive ones only, highest first. Vectors of other dimensions are skipped."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.where(F.size("embedding") == len(query)).withColumn("sim", cosine(F.col("embedding"), literal))
    best = scored.groupBy("source_id").agg(F.max("sim").alias("sim")).where("sim > 0")
    best = best.where(F.col("sim") >= threshold) if threshold is not None else best
    return best.orderBy(F.desc("sim"), "source_id").limit(top)


def hybrid(lexical: DataFrame, vectors: DataFrame, k: int = 60) -> DataFrame:
    """Fusion of a lexical page (id, score) and vector hits (id, sim) that keeps lexical ids only."""
    fused = fuse([lexical.select("id", "score"), vectors.select("id", (-F.col("sim")).alias("score"))], k)
    return fused.join(lexical.select("id"), "id", "left_semi").orderBy(F.desc("rrf"), F.col("id").cast("string"))


def snippet(text: str, phrases: list[str], width: int = 32) -> str:
    """The window of `width` tokens with most hits, hits in <b>, ellipses where text is left out."""
    tokens = text.split()
    hits = [any(stem(re.sub(r"[\W_]+", "", t.lower())).startswith(p) for p in phrases) for t in tokens]
    starts = range(max(1, len(tokens) - width + 1))
    at = max(starts, key=lambda i: (sum(hits[i : i + width]), -i), default=0)
    shown = [f"<b>{t}</b>" if h else t for t, h in zip(tokens[at : at + width], hits[at : at + width], strict=True)]
    return ("..." if at else "") + " ".join(shown) + ("..." if at + width < len(tokens) else "")


def with_snippets(page: DataFrame, query: str) -> DataFrame:
    """Snippets for the rows of one result page."""
    phrases = [t for tokens, _ in query_phrases(query, set(), True, True) for t in tokens]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, phrases))

    return page.withColumn("snippet", run("text"))


def budgeted(page: DataFrame, max_tokens: int, order: list[Column]) -> DataFrame:
    """Whole results of a ranked page while their running cost, a quarter of their characters, fits."""
    cost = F.sum(F.ceil(F.char_length("text") / 4)).over(Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("cost", cost).where(F.col("cost") <= max_tokens).drop("cost")
