"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from tracelode.llm import chat, decontamination, fingerprint, html_text, katz, line_dedup, near_copies, packing, quality, simhash, substring_dedup
from tracelode.llm.queries import tokenizer_path

LINE = "This line is long enough to count as a repeated one."


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["The", "é", "\x00"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 15, 40, 90]))) for _ in range(30)]
    passage = " ".join(rng.choices(words, k=35))
    texts += [None, "", "  \n ", texts[0], texts[0], texts[1] + " tail", "a b " + passage, passage + " c", f"x\n{LINE}\ny", "long " * 30_000]
    texts += [f"{i}\n  {LINE.upper()}" for i in range(5)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names an operator might use itself."""
    rows = [(i, t, "x", i, i) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, same string, kind int, fp bigint").repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(None, "a b c"), (1, None), (1, None), (1, "a b c d"), (2, "a b c")], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


class Katz:
    """The model by dictionaries."""

    def __init__(self, rows, orders):
        self.tokens = {k: [*(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(rows)}
        train = [self.tokens[k] for k, (i, _) in enumerate(rows) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
        self.orders, self.count = orders, [collections.Counter(g for ws in train for g in self.grams(ws, n)) for n in range(1, orders + 1)]
        of = [collections.Counter(c.values()) for c in self.count]
        self.d = [katz.good_turing({r: o[r] for r in range(1, 7)}) for o in of]
        self.n, self.v = sum(self.count[0].values()), len(self.count[0])
        self.unseen = sum((1 - self.d[0][r - 1]) * r * of[0][r] for r in range(1, 6)) / self.n
        self.after = [collections.defaultdict(list) for _ in range(orders + 1)]
        for n in range(2, orders + 1):
            for g in self.count[n - 1]:
                self.after[n][g[:-1]].append(g[-1])

    def grams(self, ws, n):
        """The first token's context is the edge; longer contexts need tokens to hold them."""
        padded = [None, *ws]
        return [tuple(padded[i - n + 2 : i + 2]) for i in range(len(ws)) if i >= n - 2] if n > 1 else [(w,) for w in ws]

    def discounted(self, n, c):
        return (self.d[n - 1][c - 1] if c <= 5 else 1) * c

    def p(self, gram):
        n = len(gram)
        c = self.count[n - 1][gram]
        if n == 1:
            return self.discounted(1, c) / self.n if c else self.unseen
        if c:
            return self.discounted(n, c) / self.count[n - 2][gram[:-1]]
        return self.alpha(gram[:-1]) * self.p(gram[1:])

    def alpha(self, context):
        words = self.after[len(context) + 1][context]
        if not words:
            return 1
        return max(1 - sum(self.p((*context, w)) for w in words), 1e-12) / max(1 - sum(self.p((*context[1:], w)) for w in words), 1e-12)

    def score(self, ws):
        padded = [None, *ws]
        return sum(math.log10(self.p(tuple(padded[max(0, i + 2 - self.orders) : i + 2]))) for i in range(len(ws)))


@pytest.mark.parametrize("orders,block", [(2, 300), (3, 300), (3, 100_000), (4, 700)])
def test_katz(docs, none, orders, block):
    got = {r["doc_id"]: r for r in katz.score_corpus(docs, orders=orders, block_tokens=block).collect()}
    want = Katz(corpus(), orders)
    for i, ws in want.tokens.items():
        assert got[i]["score"] == pytest.approx(want.score(ws)) and got[i]["train_tokens"] == want.n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((want.count[0][w,] + 1) / (want.n + want.v + 1)) for w in ws))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["held_out"]) == (len(ws), sum((w,) in want.count[0] for w in ws), zlib.crc32(str(i).encode()) % 7 == 2)
    assert katz.score_corpus(none, orders=orders).count() == 0
    for n in range(2, orders + 1):  # exactly normalised over seen words and the unseen mass
        for context in list(want.after[n])[:40]:
            total = sum(want.p((*context, w)) for (w,) in want.count[0]) + want.alpha(context) * want.p((*context[1:], b"never seen"))
            assert n > 2 or total == pytest.approx(1)


def test_katz_of_odd_rows_and_the_query(spark, odd, tmp_path):
    from tracelode.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = Katz(rows, 3)
    scores = lambda df: sorted((r["doc_id"] or 0, r["n_tokens"], round(r["score"], 9)) for r in df.collect())
    assert scores(katz.score_corpus(odd)) == sorted((i or 0, len(want.tokens[k]), round(want.score(want.tokens[k]), 9)) for k, (i, _) in enumerate(rows))
    spark.createDataFrame(corpus(), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Katz(corpus(), 3)
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in queries.op1(spark, str(tmp_path)).collect()} == {i: want.score(ws) for i, ws in want.tokens.items()}
    held = [i for i in want.tokens if zlib.crc32(str(i).encode()) % 7 == 2]  # n-grams seen once are in the model
    assert any(want.count[2][g] == 1 for i in held for g in want.grams(want.tokens[i], 3))
    alone = spark.createDataFrame([(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {(r["score"], r["train_tokens"]) for r in katz.score_corpus(alone).collect()} == {(0.0, 0)}  # nothing to learn from


def test_substring_dedup(docs, odd, none):
    length, seen, want = 20, set(), {}
    for i, t in corpus():
        words = (t or "").encode().split()
        gone = set()
        for s in range(len(words) - length + 1):
            w = tuple(words[s : s + length])
            if w in seen:
                gone.update(range(s, s + length))
            seen.add(w)
        want[i] = (len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())
    for size in (40_000, 40):  # the small one splits hot minimisers
        got = substring_dedup.remove_repeats(docs, shard_segments=size).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    # null id first; equal rows are one document; rows of one id by their texts' hash
    kinds = {r["doc_id"]: r["h"] for r in odd.selectExpr("doc_id", "xxhash64(text) h").collect()}
    assert len(kinds) == 3
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(odd, length=3, gram=2).collect())
    assert got == collections.Counter([(None, 3, 0, "a b c"), (1, 0, 0, ""), (1, 0, 0, ""), (1, 4, 3, "d"), (2, 3, 3, "")])
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_segments_cover_each_window_once():
    rng = np.random.default_rng(2)
    sizes = [0, 5, 19, 20, 21, 300, 0, 90, 20]
    h = rng.integers(0, 7, sum(sizes)).astype(np.uint64)
    h[40:300] = 3  # periodic
    of, minimiser, start, windows = substring_dedup.segments(h, np.cumsum(sizes), 20, 5)
    seen = sorted((d, s + i) for d, s, n in zip(of.tolist(), start.tolist(), windows.tolist(), strict=True) for i in range(n))
    assert seen == [(d, i) for d, n in enumerate(sizes) for i in range(n - 19)] and windows.max() <= 32
    by = {}
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for d, m, s, n in zip(of.tolist(), minimiser.tolist(), start.tolist(), windows.tolist(), strict=True):
        for i in range(s, s + n):
            by.setdefault(h[begin[d] + i : begin[d] + i + 20].tobytes(), set()).add(m)
    assert all(len(x) == 1 for x in by.values())  # equal windows meet


def test_substring_dedup_of_hostile_texts(spark):
    """A passage in most rows, periodic texts, texts that contain each other, one very long text."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*rng.choices(["a", "b", "c", "d"], k=rng.randrange(40)), *passage, *rng.choices(["a", "b"], k=rng.randrange(30))]) for _ in range(120)]
    texts += ["x y " * k for k in (5, 40, 41)] + [" ".join(passage * 3), "same " * 5000, " ".join(f"n{i % 977}" for i in range(60_000))]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        words, gone = t.split(), set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        want[i] = (len(words), len(gone))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    for size in (40_000, 50):
        assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs, shard_segments=size).collect()} == want


def test_substring_dedup_of_texts_that_repeat_only_themselves(spark, tmp_path):
    """One segment in the corpus holds all windows that repeat: the query against its SQL."""
    from tracelode.llm import queries

    texts = ["one " * 25, "x y z " * 8, "l e f t " * 6 + "right " * 30, " ".join(f"v{i % 19}" for i in range(45)), "once " * 20, " ".join(f"n{i}" for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op2_substring_dedup"]).fetchall())
    assert [r[2] for r in want] == [24, 21, 49, 26, 0, 0]
    assert sorted(map(tuple, queries.op2(spark, str(tmp_path)).collect())) == want


def test_substring_dedup_of_random_rows(spark):
    """Periods of 1 to 25 words, shared and own passages, all separators, characters that are none, ids in any order."""
    rng = random.Random(9)
    words, spaces = ["a", "B", "b", "é", "\x00", "\x85", "\x1c", "\xa0", "\u3000x"] + [f"w{i}" for i in range(90)], [" ", " ", "\n", "\t", "\r\n", "\x0b", "\x0c", "  "]
    passages, texts = [rng.choices(words, k=60) for _ in range(8)], [None, "", " \n", "q " * 20, "q " * 21]
    for i in range(250):
        parts = []
        for j in range(rng.randrange(1, 5)):
            own = [f"u{i}-{j}-{k}" for k in range(rng.randrange(1, 26))]
            at = rng.randrange(40)
            parts += rng.choice([(own * 60)[: rng.randrange(1, 60)], rng.choices(words, k=rng.randrange(40)), rng.choice(passages)[at : at + rng.randrange(60)]])
        texts.append("".join(w + rng.choice(spaces) for w in parts))
    rows = list(zip(rng.sample(range(-(10**12), 10**12), len(texts)), texts, strict=True))
    seen, want = set(), {}
    for i, t in sorted(rows):
        ws, gone = (t or "").encode().split(), set()
        for s in range(len(ws) - 19):
            w = tuple(ws[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        want[i] = (len(ws), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(ws) if k not in gone)).hexdigest())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for size in (40_000, 30):
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, shard_segments=size).collect()} == want


def test_substring_dedup_of_batches_of_few_words(spark):
    """Every number of words that a task's only text may have, around those of a gram and a window."""
    texts = [None, *(" ".join(f"w{j}" for j in range(k)) for k in range(44))]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        ws, gone = (t or "").split(), set()
        for s in range(len(ws) - 19):
            w = tuple(ws[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        want[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest())
    alone = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), len(texts)), "doc_id bigint, text string")
    got = substring_dedup.remove_repeats(alone).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_quality_prior_and_fit():
    rng = np.random.default_rng(0)
    d = quality.FEATURES
    good, bad = rng.normal(0, 1, (3000, d)), rng.normal(0, 1, (900, d)) + 1.5 * rng.choice([-1, 1], d)
    p, u = good[:1000], np.concatenate([good[1000:], bad])  # 69 % of the unlabelled are positives
    half = lambda x: np.arange(len(x)) % 2
    mean, scale = u.mean(0), u.std(0)
    networks = quality.judges(mean, scale, p, half(p), u, half(u))
    cells = lambda k, x: np.bincount(quality._cell(networks[k].margin(x[half(x) == k])), minlength=quality.CELLS)
    priors = [quality.best_bin_prior(cells(k, p), cells(k, u)) for k in (0, 1)]
    assert all(0.5 < prior < 0.72 for prior in priors)
    net = quality.fit(mean, scale, p, u, min(priors))
    assert (net.score(good) >= 0.3).mean() > 0.99 and (net.score(bad) < 0.3).mean() > 0.95
    assert np.isfinite(quality.features(None)).all() and quality.fit(mean, scale, p[:0], u, 0.5).score(good)[0] == 0.5


def test_quality_of_held_out_rows(spark):
    """Nearly all held-out positives pass, nearly all held-out negatives do not; equal runs agree; labels and ids are no inputs."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    network = quality.train(docs, labels)
    again = quality.train(docs.repartition(5), labels.repartition(3))
    held = quality.score(docs, network).join(labels, "doc_id").where(quality.crc_mod(quality.F.col("doc_id"), 5) == 0)
    passed = {r["quality"]: r["share"] for r in held.groupBy("quality").agg(quality.F.avg("predicted").alias("share")).collect()}
    assert passed[1] >= 0.99 and passed[0] <= 0.05
    assert np.allclose(network.w1, again.w1) and abs(network.prior - again.prior) < 1e-9
    moved = quality.score(docs.selectExpr("doc_id + 7 doc_id", "text", "'z' lang", "'z' source"), network)
    assert moved.selectExpr("doc_id - 7 doc_id", "score s").join(quality.score(docs, network), "doc_id").where("s <> score").count() == 0


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (1, 1)], "doc_id bigint, quality int")
    for docs, marks in ((odd, labels), (odd, labels.limit(0)), (none, labels), (none, labels.limit(0))):
        network = quality.train(docs, marks)
        got = quality.score(docs, network).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    clash = odd.selectExpr("doc_id", "text", "1 score", "2 predicted", "3 trusted", "4 half", "5 x")
    network = quality.train(clash, labels.selectExpr("*", "'a' text", "1 trusted"))
    got = quality.score(clash, network).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 3  # null and empty are one text, equal texts have one score
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "")], "doc_id bigint, text string")
    assert quality.score(long, network).count() == 2


def test_line_dedup(docs, odd, none):
    holders, last = collections.Counter(), {}
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).encode().lower().decode()
    for i, t in corpus():
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k] += 1
            last[k] = i
    want = {}
    for i, t in corpus():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and holders[key(x)] >= 5 and last[key(x)] != i)]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) == 5
    assert line_dedup.dedup_lines(none).count() == 0
    # a null id is a document, smaller than all; rows of one id are one document, and each keeps a row
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(odd, min_chars=3, min_docs=2).collect())
    assert got == collections.Counter([(None, 1, 1, ""), (1, 1, 0, ""), (1, 1, 0, ""), (1, 1, 0, "a b c d"), (2, 1, 0, "a b c")])


def test_runs_admit_what_is_new_and_join_without_a_shuffle(spark):
    rng, seen = random.Random(9), {}
    runs = line_dedup.LineRuns(spark, fanout=2)
    for _ in range(6):
        rows = [(rng.randrange(1000), k if (k := rng.randrange(60)) else None, 7) for _ in range(rng.randrange(60))]
        want = {}
        for d, k, _ in rows:
            if k is not None and k not in seen:
                want[k] = min(d, want.get(k, d))
        got = line_dedup.first_lines(runs, spark.createDataFrame(rows, "doc_id bigint, k1 bigint, k2 bigint"))
        assert {r["k1"]: r["doc"] for r in got.collect()} == want
        seen |= want
        assert len(runs.runs()) <= 3
    assert {r["k1"]: r["doc"] for r in runs.all().collect()} == seen
    batch = runs.write(spark.createDataFrame([(1, 7, 3)], "k1 bigint, k2 bigint, doc bigint"))
    plan = batch.join(runs.runs()[0].select(*line_dedup.KEY).hint("merge"), line_dedup.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


def test_line_dedup_of_a_line_in_most_documents(spark):
    """The frequent line is found without a shuffle, others by the join."""
    rng = random.Random(6)
    common = [f"line number {i} that many documents hold in common" for i in range(30)]
    texts = ["\n".join([LINE, *rng.sample(common, 3), f"own line {i} of this document, which no other one has"][: rng.randrange(1, 6)]) for i in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)]
    holders = collections.Counter(x for t in texts for x in set(t.split("\n")))
    last = {x: i for i, t in docs for x in t.split("\n")}
    want = {i: "\n".join(x for x in t.split("\n") if holders[x] < 5 or last[x] == i) for i, t in docs}
    for batches in (1, 3, 7):
        assert {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), batches=batches).collect()} == want


def test_simhash(docs, odd, none):
    def print_of(t):
        w = (t or "").encode().lower().split()
        k = min(3, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = {i: print_of(t) for i, t in corpus()}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], root[i]) for i in prints}
    assert simhash.near_duplicates(none).count() == 0
    # the null id joins its component and does not name it; null text: zero, alone here
    got = collections.Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    of = lambda t: print_of(t)
    near = (of("a b c") ^ of("a b c d")).bit_count() <= 2
    assert not near and got == collections.Counter([(None, of("a b c"), 2), (1, 0, 1), (1, 0, 1), (1, of("a b c d"), 1), (2, of("a b c"), 2)])


def test_simhash_of_a_text_longer_than_two_chunks():
    words = [f"{i * 2654435761 % 1_000_003:x}" for i in range(140_003)]
    digests = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], dtype="<u8")
    for n in range(131_070, len(digests) + 1, 97):  # a lost shingle shows where a bit is near half
        ones = np.unpackbits(digests[:n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        if (abs(2 * ones.astype(int) - n) <= 1).any():
            break
    assert simhash.simhash(" ".join(words[: n + 2])) == sum(1 << b for b in range(64) if 2 * int(ones[b]) > n)


def test_hot_shards_split_exactly(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(20) for j in range(20)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 2, max_shard=50)
    found = {r["node"]: r["root"] for r in simhash.components(got).collect()}
    assert len({found[s] for s in signed if s in found}) == 3 and all(found[v - (1 << 64) if v >> 63 else v] for v in base if (v - (1 << 64) if v >> 63 else v) in found)


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def test_canonical_text_equals_unicodedata(spark):
    """Every code point that Unicode assigns, and random sequences of marks, jamo and letters with a final form."""
    rng = random.Random(11)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["\u0651", "\u064e", "\u1161", "\u11a8", "\u03c2", "\u03a3", "\u2003", "\x1f"]
    texts = [f"a{chr(c)} {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts += ["".join(rng.choice("aeoA\xe9\u1100\u03a3\u039f ") + "".join(rng.choices(marks, k=rng.randrange(5))) for _ in range(4)) for _ in range(5000)]
    texts += ["\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2", "", "  ", "Stra\xdfe", "\ufb01 A\xa0\u2028b"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint.canonical(fingerprint.F.col("t")).alias("c")).collect()
    assert [(r["t"], r["c"]) for r in out if r["c"] != canon(r["t"])] == []


@pytest.mark.parametrize("digest_bits", [128, 6])  # the few bits make digests of different texts collide
def test_fingerprints(spark, docs, odd, none, digest_bits):
    rows = corpus()
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs, cells=8, digest_bits=digest_bits).collect()}
    prints = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == float(canon(t) == canon(edited)) and got[i]["near_next"] == float(canon(t) == canon(after))
        prints.setdefault(canon(t), set()).add(got[i]["fingerprint"])
        prints.setdefault(canon(edited), set()).add(got[i]["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    assert fingerprint.fingerprint_documents(none, digest_bits=digest_bits).count() == 0
    # null ids first, rows of one id by their texts' hash: values, not only the number of rows
    order = sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"], r["h"], r["doc_id"], r["t"]) for r in odd.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()))
    want = collections.Counter()
    for k, (_, _, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest(), float(t == after)] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in fingerprint.fingerprint_documents(odd, digest_bits=digest_bits).collect()) == want


def test_fingerprints_of_one_id_are_dealt_to_many_cells(spark):
    rows = [(7, f"text {i % 50}") for i in range(400)] + [(i, f"other {i}") for i in range(300)] + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    base = df.selectExpr("doc_id", "text", "coalesce(doc_id, -9223372036854775808L) key", "xxhash64(text) tie")
    placed = base.select("key", "tie", fingerprint._cells(base, 40).alias("cell")).collect()
    assert len({r["cell"] for r in placed if r["key"] == 7}) > 8
    ordered = sorted((r["key"], r["tie"], r["cell"]) for r in placed)
    assert [c for _, _, c in ordered] == sorted(c for _, _, c in ordered)
    order = sorted((r["key"], r["tie"], r["text"]) for r in base.collect())
    want = collections.Counter((len(t), float(t == order[(k + 1) % len(order)][2])) for k, (_, _, t) in enumerate(order))
    assert collections.Counter((r["n_chars"], r["near_next"]) for r in fingerprint.fingerprint_documents(df, cells=40).collect()) == want


def test_decontamination(spark, docs, odd, none):
    items = [(1, corpus()[2][1]), (2, "w1"), (None, "nothing-of-this occurs"), (3, None), (1, "é w2")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    import re

    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    wins = {}
    for item, t in items:
        w = words_of(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + k]), set()).add("" if item is None else str(item))
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, bench).collect()}
    for i, t in corpus():
        w, hit, ids = words_of(t), set(), set()
        for win, named in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids |= named
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(hit), len(ids))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest() and got[i]["contaminated"] == bool(hit)
    assert decontamination.contamination(none, bench).count() == 0
    rows = lambda b: collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.contamination(odd, b).collect())
    assert rows(bench.limit(0)) == collections.Counter([(None, 3, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (1, 4, 0, 0), (2, 3, 0, 0)])
    short = spark.createDataFrame([(9, "B"), (8, "b c"), (8, "c d"), (7, "a b c d e")], "item_id bigint, text string")
    assert rows(short) == collections.Counter([(None, 3, 2, 2), (1, 0, 0, 0), (1, 0, 0, 0), (1, 4, 3, 2), (2, 3, 2, 2)])


def test_decontamination_with_frequent_shingles(spark, monkeypatch):
    """Items of one to twelve words over few words, frequent shingles dealt with a salt."""
    monkeypatch.setattr(decontamination, "SALTED", 20)
    rng = random.Random(8)
    draw = lambda n: " ".join(rng.choices(["the", "of", "a", "bb", "c9"], weights=[9, 4, 2, 1, 1], k=n))
    items = [(str(i), draw(n)) for i, n in enumerate([1, 1, 2, 3, 3, 4, 6, 10, 10, 12, 15])]
    texts = [draw(rng.randrange(60)) for _ in range(60)] + [t for _, t in items] + [f"x {t} y" for _, t in items] + ["the " * 3000]
    got = {r["doc_id"]: r for r in decontamination.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, t in enumerate(texts):
        w, hit, ids = t.split(), set(), set()
        for item, u in items:
            v = u.split()
            k = min(10, len(v))
            for x in range(len(v) - k + 1):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[x : x + k]:
                        hit.update(range(s, s + k))
                        ids.add(item)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items_sha256"]) == (len(w), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())


def test_chat(spark):
    for text in ["", "</s>[INST] ok [/INST]", "a\\<|im_end|>\n<|im_start|>x", "\\\\<<SYS>>", "<" * 5 + "|"]:
        made = chat.format_turn("user\nx", text) + chat.format_turn("assistant", text)
        assert [(r, t) for r, t, _ in chat.read_turns(made)] == [("user\nx", text), ("assistant", text)]
        assert not any(c in chat.escape(text) for c in chat.CONTROL[1:])
    layouts = ['{"prompt":"a","completion":"b"}', '{"instruction":"a","input":"","output":"b"}', '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}']
    assert all(chat.canonical_turns(x)[1] == [("user", "a"), ("assistant", "b")] for x in layouts)
    want = {
        '{"id":7,"source":"s","conversations":[{"from":"human","value":"a"}]}': [("user", "a")], '{"messages":[]}': [], '{"conversations":[],"id":1}': [],
        '{"messages":[{"role":"human","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}': [("human", "a\\nb")],
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":[{"type":"text","text":"b"}]}],"extra":{"x":1}}': [("user", "a"), ("assistant", "b")],
        '{"prompt":"a","response":null}': [("user", "a")], '{"system":"s","prompt":"a","response":"b"}': [("system", "s"), ("user", "a"), ("assistant", "b")],
        '{"system":"s","conversations":[{"from":"gpt","value":"b"}]}': [("system", "s"), ("assistant", "b")], '{"system":"s","messages":[{"role":"user","content":"a"}]}': [("system", "s"), ("user", "a")],
        '{"question":"a","answer":"b","topic":"t"}': [("user", "a"), ("assistant", "b")], '{"instruction":"a","input":"c","output":"b"}': [("user", "a\\n\\nc"), ("assistant", "b")],
        '{"instruction":"a","output":"b"}': [("user", "a"), ("assistant", "b")], '{"role":"human","text":"a"}': [("human", "a")], '{"role":"bot","content":"a"}': [("bot", "a")], '{"title":"t"}': None, "[1]": None, "3": None,
    }
    assert {x: chat.canonical_turns(x)[1] for x in want} == {x: None if t is None else [(r, v.replace("\\n", "\n")) for r, v in t] for x, t in want.items()}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*layouts, None, "{", '{"odd":1}'])], "id bigint, record string")
    got = chat.format_records(rows).orderBy("id").collect()
    assert [r["n_turns"] for r in got] == [2, 2, 2, 2, None, None, None]
    turns = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, None, None), (None, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    digests = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turn_rows(turns)).collect()}
    assert digests[1]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\nhi\n").hexdigest() and digests[1]["loss_chars"] == 2 and len(digests) == 2
    assert chat.conversation_digests(chat.format_turn_rows(turns.limit(0))).count() == 0
    same = [(5, 0, "human", "a", "x"), (5, 0, "human", "a", "x"), (5, 1, "assistant", "</s>\\ <|im_end|>\n" + "long " * 200_000, "y")]  # ties, roles that layouts rename, a very long text
    clash = spark.createDataFrame(same, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = chat.conversation_digests(chat.format_turn_rows(clash)).first()
    assert got["n_turns"] == 3 and got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t, _ in same).encode()).hexdigest()
    assert got["loss_chars"] == len(same[2][3]) and got["loss_sha256"] == hashlib.sha256(same[2][3].encode()).hexdigest()


def test_html(spark):
    page = "<html><body><header>Top</header><nav><a href=x>Menu</a></nav><div class='content'><h1>Title</h1><p>First, long enough &amp; fine<br>text.<p>Second <b>bold</b>\n text</div><div class=comments><p>I, reader, say much, much more, than others</p></div><script>var a='<p>no</p>'</script><footer>end</footer>"
    assert html_text.main_text(page) == "Title\nFirst, long enough & fine text.\nSecond bold text"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == "" and html_text.main_text("<p>" * 3000 + "a<b") != ""
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id bigint, url string, html string")
    assert sorted(r["n_chars"] for r in html_text.extract(rows).collect())[0] == 0 and html_text.extract(rows.limit(0)).count() == 0


def test_packing(docs, odd, none):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(tokenizer_path())
    want = {i: [*hf.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus()}
    pieces = packing.pack_documents(docs, tokenizer_path(), length=64).collect()
    back, seqs = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        back[r["doc_id"]][r["start"]] = ids
        seqs[r["sequence_id"]][r["offset"]] = len(ids)
    assert {i: sum((x for _, x in sorted(p.items())), []) for i, p in back.items()} == want
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s.items()):
            assert offset == at
            at += n
        assert at & (at - 1) == 0 and at <= 64
    odd_ids = hf.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert packing.encoder(tokenizer_path())("a <|endoftext|> b").tolist() == odd_ids
    short = packing.pack_documents(odd, tokenizer_path()).collect()  # the tail's powers of two may cut a document
    assert sum(r["length"] for r in short) == sum(r["doc_tokens"] for r in short if r["start"] == 0) and sum(r["start"] == 0 for r in short) == 5
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_near_copies_equal_brute_force(spark):
    """Edits that operator 5's radius misses, a large group of copies that differ among each other, a shared passage."""
    import corpus_pipeline

    rng = random.Random(3)
    fresh = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passage, base, texts = fresh(30), fresh(150), []
    for _ in range(40):
        w = [*base]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    for _ in range(30):
        own = fresh(rng.choice([8, 30, 60, 200])) + passage
        texts.append(" ".join(own))
        own[rng.randrange(len(own))] = "Changed"
        texts.append(" ".join([*own, "tail"]))
    texts += [None, "", " \n", "a b", "A  b", "a b c", texts[0], texts[45]]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root, pairs = list(range(len(texts))), [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == dict(enumerate(root))
    rows = docs.selectExpr("doc_id", "text", "'x' lang", "'y' source", "1L n_chars")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect()} == set(root)
