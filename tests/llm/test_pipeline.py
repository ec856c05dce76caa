"""Each stage of the pipeline against brute force, on a whole small table and on odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from tracelode.llm import quality
from tracelode.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
LINE = "This line is long enough to count as a repeated one."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Null and repeated ids, null and empty texts, ties, a benchmark passage, repeated lines, a very long text."""
    passage = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("text is not null").first()["text"]
    rows = [(None, "alone without an id", None, None, None), (None, passage, "x", "y", 1), (1, "first copy of it", "x", "y", 1), (2, "first copy of it", "x", "y", 1), (3, None, "x", "y", None), (3, passage, "x", "y", 1), (3, "another text of that id", "x", "y", 1), (4, "", "x", "y", 0)]
    rows += [(10 + i, f"own words number {i}\n{LINE}\nmore own words {i * 7} of this one here", "x", "y", 1) for i in range(6)] + [(30, "long " * 100_000 + "end", "x", "y", 1)]
    return spark.createDataFrame(rows, docs.schema)


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def same(got, want):
    return collections.Counter(pairs(got)) == collections.Counter(want)


def without_lines(rows):
    strip, holders, last = " \t\n\x0b\x0c\r", collections.defaultdict(set), {}
    key = lambda x: x.strip(strip).encode().lower().decode()
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(low(i))
                last[key(x)] = max(last.get(key(x), low(i)), low(i))
    gone = lambda i, x: len(holders.get(key(x), ())) >= 5 and last[key(x)] != low(i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows]


def without_copies(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    smallest = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        smallest[i].append(least.get(find(k)))
    return [(i, t) for i, t in rows if i is None or not max(smallest[i]) < i]


def without_benchmark(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    windows = collections.defaultdict(set)
    for t in items:
        w = words(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[k].add(tuple(w[s : s + k]))

    def held(t):
        w = words(t)
        return any(tuple(w[s : s + k]) in of for k, of in windows.items() for s in range(len(w) - k + 1))

    return [(i, t) for i, t in rows if not held(t)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_stages_equal_brute_force(spark, request, which):
    table = request.getfixturevalue(which)
    rows = pairs(table.collect())
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = corpus_pipeline.drop_repeated_lines(spark, table, FOLDER)
    assert got.columns == table.columns and same(got.collect(), without_lines(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    got = corpus_pipeline.drop_near_copies(spark, table, FOLDER)
    assert got.columns == table.columns and same(got.collect(), without_copies(rows))
    got = corpus_pipeline.drop_contaminated(spark, table, FOLDER)
    assert got.columns == table.columns and same(got.collect(), without_benchmark(rows, items))
    got = corpus_pipeline.quality_filter(spark, table, FOLDER)
    network = quality.train(table, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = [(i, t) for i, t in rows if network.score(np.array([quality.features(t)]))[0] >= 0.3]
    assert got.columns == table.columns and same(got.collect(), want)


def test_packing_keeps_every_token(spark, odd):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter(tuple([*hf.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in odd.collect())
    pieces = corpus_pipeline.pack(spark, odd, FOLDER).collect()
    stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))])
    starts = [k for k, r in enumerate(sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))) if r["start"] == 0]
    sizes = [r["length"] for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))]
    at = np.concatenate(([0], np.cumsum(sizes)))
    ends = [*starts[1:], len(sizes)]
    assert collections.Counter(tuple(stream[at[a] : at[b]].tolist()) for a, b in zip(starts, ends, strict=True)) == want


def test_packing_ids_equal_the_tokenizer_on_a_whole_table(docs):
    from tokenizers import Tokenizer

    from tracelode.llm import packing

    hf, own = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    texts = [r["text"] or "" for r in docs.collect()]
    texts += ["", " ", "\n\n", "a\u00a0b", "\U0001f600" * 5, "x" * 3000, "1234567890" * 50, "don't we'll I'M", "<|endoftext|>", "\u0301e\u0301", "\t\t x  y   z\r\n", "\u4f60\u597d", "caf\u00e9"]
    for t in texts:
        assert own(t).tolist() == hf.encode(t, add_special_tokens=False).ids, hashlib.sha256(t.encode()).hexdigest()


def test_empty_tables_and_the_whole_run(spark, docs, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, odd.limit(0), FOLDER).count()
    out = corpus_pipeline.run(spark, FOLDER)
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count() and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_every_stage_bounds_its_batches_without_run(spark, odd):
    import pyarrow as pa

    keys = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    for name, stage in corpus_pipeline.STAGES:
        for key in keys:
            spark.conf.unset(key)
        stage(spark, odd.limit(0), FOLDER)
        for length in (1, 10_000):
            got = spark.range(0, 5_000, 1, 1).selectExpr(f"repeat('x', {length}) AS text").mapInArrow(sizes, "rows bigint, bytes bigint").collect()
            assert sum(r["rows"] for r in got) == 5_000, name
            assert max(r["rows"] for r in got) <= 2_000 and max(r["bytes"] for r in got) < 9_000_000, name
