"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and unlabelled text are all it sees: rows labelled 0 are never used as negatives. A
small network minimises the non-negative unbiased risk  pi R+(1) + max(0, R-u(0) - pi R-p(0))  with the logistic loss, so
that its sigmoid estimates the probability of the positive class.

The class prior pi comes from two positive-against-unlabelled fits, each judged on the half of the documents that it has not
seen, by the best-bin estimator. The lower confidence bound is taken: with a prior above the true one the risk of negatives
reaches zero before they are learnt, and with one below it the scores of positives only shrink in proportion.

Statistics of texts (never their id, language, source or label) are the inputs. Their means, their spreads and the prior
come from all rows that may be learnt from; the weights are fitted on at most `sample` positives and `sample` unlabelled rows,
those with the smallest hashes of their ids, so that runs agree. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import crc_mod, frugal, stored

#: Single bytes whose shares are inputs, beside the shares of byte classes.
MARKS = b"|#$%&*@<>{}[]()/\\_=+-~^.,;:!?'\"\t\n"
_CLASS = np.zeros((256, 6 + len(MARKS)))
for _b in range(256):
    _CLASS[_b, :6] = [97 <= _b <= 122, 65 <= _b <= 90, 48 <= _b <= 57, _b in b" \t\n\x0b\x0c\r", 33 <= _b < 127 and not chr(_b).isalnum(), _b >= 128]
    for _i, _m in enumerate(MARKS):
        _CLASS[_b, 6 + _i] = _b == _m
FEATURES = _CLASS.shape[1] + 12


def features(text: str | None) -> np.ndarray:
    """Shares of bytes and statistics of words and lines; zeros but for the bias of an empty text."""
    raw = (text or "").encode()
    out = np.zeros(FEATURES)
    words = raw.split()
    n = len(words)
    if not n:
        out[-1] = 1
        return out
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw)
    out[: len(shares)] = np.sqrt(shares)
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = sum(w[-1] in b".!?" for w in words)
    # distinct words fall with length in any text; windows of 100 words make the shares comparable
    windows = [len(set(words[i : i + 100])) / len(words[i : i + 100]) for i in range(0, max(1, n - 50), 100)]
    capital = sum(65 <= w[0] <= 90 for w in words) / n
    out[len(shares) :] = [
        np.log1p(n) / 10, len(distinct) / n, np.mean(windows), min(windows), len(set(lines)) / len(lines), np.log1p(len(lines)) / 10,
        lengths.mean() / 10, lengths.std() / 10, ends / n, capital, np.log1p(n / len(lines)) / 10, 1,
    ]
    return out


@dataclass(frozen=True)
class Network:
    """Standardised inputs, one hidden layer of rectified units, one output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, steps: int = 600, hidden: int = 24, rate: float = 3e-3, decay: float = 1e-3) -> list[np.ndarray]:
    """Adam with full batches on the non-negative PU risk, or (prior None) on plain positive-against-unlabelled logistic loss."""
    rng = np.random.default_rng(seed)
    n, d = p.shape
    x = np.concatenate([p, u]).astype(np.float32)
    theta = [rng.normal(0, d**-0.5, (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        h = np.maximum(x @ theta[0] + theta[1], 0)
        g = h @ theta[2] + theta[3]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        if prior is None:
            dg = np.concatenate([(s[:n] - 1) / n, s[n:] / len(u)]) / 2
        elif _soft(g[n:]).mean() >= prior * _soft(g[:n]).mean():
            dg = np.concatenate([np.full(n, -prior / n), s[n:] / len(u)])
        else:  # the estimated negative risk went below zero: step back on it
            dg = np.concatenate([prior * s[:n] / n, -s[n:] / len(u)])
        dg = dg.astype(np.float32)
        dh = np.outer(dg, theta[2]) * (h > 0)
        grads = [x.T @ dh + decay * theta[0], dh.sum(0), h.T @ dg + decay * theta[2], np.array([dg.sum()])]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            theta[i] = theta[i] - rate * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return [t.astype(float) for t in theta]


#: Cells of a histogram of margins from -30 to 30.
CELLS = 6_000


def _cell(margin: np.ndarray) -> np.ndarray:
    return np.clip((margin + 30) * (CELLS / 60), 0, CELLS - 1).astype(np.int32)


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Lower confidence bound of the share of positives among the unlabelled, from histograms of their margins: over top bins, the
    bin with the smallest upper bound gives the share, less its slack."""
    n, k = positive.sum(), unlabelled.sum()
    qp, qu = (np.cumsum(x[::-1]) / x.sum() for x in (positive, unlabelled))
    slack = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * k))
    qp, qu = qp[qp > 0.05], qu[qp > 0.05]
    best = np.argmin((qu + slack) / qp)
    return float(np.clip(qu[best] / qp[best] - slack, 0.05, 0.98))


def _network(mean: np.ndarray, scale: np.ndarray, theta: list[np.ndarray], prior: float) -> Network:
    return Network(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior)


def indifferent() -> Network:
    """Scores every text 0.5."""
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)


def judges(mean: np.ndarray, scale: np.ndarray, p: np.ndarray, p_half: np.ndarray, u: np.ndarray, u_half: np.ndarray) -> list[Network] | None:
    """For each half of the documents a network that tells positives from unlabelled rows, fitted on the other half."""
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    if not all((p_half == k).any() and (u_half == k).any() for k in (0, 1)):
        return None
    return [_network(mean, scale, _fit(z(p[p_half != k]), z(u[u_half != k]), None, 7 + k, 200), 0.5) for k in (0, 1)]


def fit(mean: np.ndarray, scale: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> Network:
    """The network of least non-negative PU risk on feature rows; without positives or unlabelled rows all scores are 0.5."""
    if not len(p) or not len(u):
        return indifferent()
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    return _network(mean, scale, _fit(z(p), z(u), prior, 8), prior)


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, order, half, x): each row's features, the hash that samples go by and the half that its id is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                x = np.array([features(t) for t in b.column(3).to_pylist()], dtype=np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], names=["doc_id", "order", "half", "x"])

    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", F.xxhash64(F.lit(11), "doc_id", text).alias("order"), F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(2)).cast("int").alias("half"), text.alias("text"))
    return keyed.mapInArrow(frugal(run), "doc_id bigint, order bigint, half int, x array<float>")


def _histograms(rows: DataFrame, networks: list[Network]) -> dict[tuple[int, bool], np.ndarray]:
    """By half and whether trusted: how many of all rows (half, trusted, x) have a margin in each cell."""
    nets = rows.sparkSession.sparkContext.broadcast(networks)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, CELLS), np.int64)
        for b in batches:
            half, trusted, x = np.asarray(b.column(0)), np.asarray(b.column(1).cast(pa.int8())), np.asarray(b.column(2).flatten()).reshape(-1, FEATURES)
            for k in (0, 1):
                cell = _cell(nets.value[k].margin(x[half == k]))
                counts[k, 0] += np.bincount(cell, minlength=CELLS)
                counts[k, 1] += np.bincount(cell[trusted[half == k] == 1], minlength=CELLS)
        k, t, c = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(t == 1), pa.array(c.astype(np.int32)), pa.array(counts[k, t, c])], names=["half", "trusted", "cell", "n"])

    got = rows.select("half", "trusted", "x").mapInArrow(run, "half int, trusted boolean, cell int, n bigint").groupBy("half", "trusted", "cell").agg(F.sum("n").alias("n"))
    out = {(k, t): np.zeros(CELLS) for k in (0, 1) for t in (False, True)}
    for r in got.collect():  # 4 x CELLS rows at most
        out[r["half"], r["trusted"]][r["cell"]] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample: int = 8_000) -> Network:
    """Fit on rows whose crc32(doc_id as text) modulo held_out is not 0. A null doc_id is never a positive; rows of a repeated id are
    rows of their own, all positives if the id is. Without any positive every score is 0.5."""
    learnt = lambda df: df.where(crc_mod(F.col("doc_id"), held_out) != 0)
    trusted = learnt(labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))).distinct().withColumn("trusted", F.lit(True))
    made = _feature_rows(learnt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    rows = stored(made.join(trusted.hint("merge"), "doc_id", "left").select("order", "half", F.coalesce("trusted", F.lit(False)).alias("trusted"), "x"), "features")
    sums = rows.agg(*[a for i in range(FEATURES) for a in (F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i]))]).collect()[0]
    if sums[0] is None:
        return indifferent()
    mean, scale = np.array(sums[::2], dtype=float), np.maximum(np.array(sums[1::2], dtype=float), 1e-3)

    def sampled(some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = some.select("half", "x", "order").orderBy("order", "x").limit(sample).toArrow()
        return np.asarray(got.column("x").combine_chunks().flatten()).astype(float).reshape(-1, FEATURES), np.asarray(got.column("half"))

    (p, p_half), (u, u_half) = sampled(rows.where("trusted")), sampled(rows)
    networks = judges(mean, scale, p, p_half, u, u_half)
    if networks is None:  # too few positives to hold some back
        return fit(mean, scale, p, u, 0.5)
    of = _histograms(rows, networks)
    return fit(mean, scale, p, u, min(best_bin_prior(of[k, True], of[k, False]) for k in (0, 1)))


def score(docs: DataFrame, network: Network, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs' doc_id (or the columns `keep`) with score (0 to 1) and predicted (1 if score >= threshold), a row for each row.
    Null and empty texts get the score of an empty text; repeated and null ids are scored like any other."""
    keep = keep or ["doc_id"]
    net = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    kept = docs.select(*keep, F.col("text").cast("string").alias("scored_text"))
    schema = StructType([*kept.schema.fields[:-1], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                scores = net.value.score(np.array([features(t) for t in b.column(b.num_columns - 1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], names=[*b.schema.names[:-1], "score"])

    return kept.mapInArrow(frugal(run), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
