"""The store: commits by bucket, locks, lineage, recovery, derivation, indexes, embeddings, the ingest driver, requests."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tracelode.operators import census, embeddings, index, lineage, requests, search, sync
from tracelode.operators import store as store_module
from tracelode.operators.store import Store, bucket_of
from tracelode.sources.discover import InputDefinition

MESSAGES = "source_path string, ordinal int, role string, text string, timestamp timestamp, uuid string, content_type string, cwd string, tool_name string, command_head string, is_error boolean, exit_code int, was_interrupted boolean"


def messages(spark, rows):
    full = [(p, i, role, text, None, uuid, kind, "/w/app", tool, None, error, None, False) for p, i, role, text, uuid, kind, tool, error in rows]
    return spark.createDataFrame(full, MESSAGES)


def listed(spark, paths, hash="h"):
    return spark.createDataFrame([(p, hash, 1, None) for p in paths], "path string, hash string, file_size bigint, file_mtime timestamp")


def talk(path, n, tag=""):
    return [(path, i, "user" if i % 2 == 0 else "assistant", f"message {i} of {path} about compiling kernels{tag}", f"{path}{tag}-{i}", "text", None, None) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"))
    paths = [f"p{i}" for i in range(6)]
    out.ingest(messages(spark, [r for p in paths for r in talk(p, 3)]), listed(spark, paths))
    return out


def test_a_commit_writes_the_buckets_that_it_touches(spark, store):
    before = store.manifest()["tables"]["items"]
    store.ingest(messages(spark, talk("p0", 4)), listed(spark, ["p0"], "h2"))
    after = store.manifest()["tables"]["items"]
    own = str(spark.createDataFrame([("p0",)], "p string").select(bucket_of(F.col("p")).alias("b")).first()["b"])
    assert {b for b in after if before.get(b) != after[b]} == {own}
    assert store.table("items").count() == 19 and store.table("files").where("path = 'p0'").first()["hash"] == "h2"
    assert store.restore(1) == 3 and store.table("items").count() == 18
    pinned = store.snapshot()
    store.annotate("note", "x", uuid="p1-1")
    store.vacuum()
    assert store.versions() == [4] and store.files.exists(pinned) and store.table("items").count() == 18


def test_paths_with_and_without_uuids(spark, tmp_path):
    out = Store(spark, str(tmp_path / "s"))
    bare = [("q", i, "user", f"text {i}", None, "text", None, None) for i in range(3)]
    for rows, want in ((bare, 3), (bare[:2], 2), (talk("q", 2), 2), (talk("q", 2) + bare, 2)):  # reloaded, reloaded, replaced, kept
        out.ingest(messages(spark, rows), listed(spark, ["q"]))
        assert out.table("items").count() == want
    out.ingest(messages(spark, [("r", 0, "user", "again", "q-0", "text", None, None)]), listed(spark, ["r"]))
    assert out.table("items").count() == 2  # another file's uuid


def test_locks_are_waited_for_and_taken_over(spark, store):
    with store.lock():
        with pytest.raises(TimeoutError):
            with store.lock(wait=0.2):
                pass
    store.files.create("LOCK", json.dumps({"owner": "dead", "until": time.time() - 1}))
    with store.lock(wait=0.5):
        assert store.files.exists("LOCK")
    assert not store.files.exists("LOCK")
    with pytest.raises(RuntimeError):
        store.commit({"stopwords": store.table("stopwords")}, expect=store.version - 1)


def test_recovery_is_all_or_nothing(spark, store, tmp_path):
    other = Store(spark, str(tmp_path / "other"))
    other.ingest(messages(spark, talk("p0", 3) + talk("new", 2)), listed(spark, ["p0", "new"]))
    assert store.recover([other.root], dry_run=True) == {"rows": 20, "conflicts": 0} and store.version == 1
    assert store.recover([other.root])["rows"] == 20
    assert {r["path"]: r["hash"] for r in store.table("files").collect()} == {f"p{i}": "h" for i in range(6)} | {"new": "recovered"}
    assert store.search(search.SearchRequest("kernel", limit=50)).count() == 20  # the indexes follow
    bad = Store(spark, str(tmp_path / "bad"))
    bad.ingest(messages(spark, [("p0", 0, "user", "something else", "p0-0", "text", None, None)]), listed(spark, ["p0"]))
    before = store.fingerprint()
    with pytest.raises(ValueError):
        store.recover([bad.root])
    with pytest.raises(ValueError):
        store.recover([other.root], strict=True)  # these identities are no uuids
    assert store.fingerprint() == before and not store.files.exists("LOCK")
    moved = Store(spark, str(tmp_path / "moved"))
    moved.ingest(messages(spark, talk("late", 1)), listed(spark, ["late"]))
    real = store._read

    def moving(*args):  # another writer commits to an input while the union is written
        moved.restore(1)
        return real(*args)

    store._read, before = moving, store.fingerprint()
    try:
        with pytest.raises(RuntimeError):
            store.recover([moved.root])
    finally:
        del store._read
    assert store.fingerprint() == before
    a, b = store.table("items"), store.table("items").where("ordinal > 0")
    assert store_module.differences(a, b) and not store_module.differences(a, a)


def test_older_layouts_are_upgraded_and_others_refused(spark, store, tmp_path):
    def write(root, version, tables):
        old = Store(spark, str(root))
        manifest = {"signature": lineage.signature(lineage.LAYOUTS[version]), "tables": {}, "segments": {}, "lengths": {}}
        for name, rows in tables.items():
            rows.select(*lineage.columns(lineage.LAYOUTS[version][name])).write.parquet(f"{root}/data/old/{name}")
            manifest["tables"][name] = {"0": f"data/old/{name}"}
        old.files.publish("manifest-1.json", json.dumps(manifest))
        return old

    tables = {n: store.table(n) for n in lineage.LAYOUTS[11]}
    twice = tables["items"].unionByName(tables["items"].withColumn("id", F.col("id") + 1))
    old = write(tmp_path / "v11", 11, tables | {"items": twice})
    assert old.lineage() == 11 and old.table("items").count() == 18 and old.table("items").columns == lineage.columns(lineage.SCHEMAS["items"])
    with pytest.raises(RuntimeError):
        old.commit({"stopwords": old.table("stopwords")})
    old.migrate()
    assert old.lineage() == 14 and old.table("items").count() == 18 and old.files.exists("snapshot-1.json") and old.migrate() == old.version
    assert old.search(search.SearchRequest("kernels", limit=30)).count() == 18
    event = lambda code: (("p", 0, "u", "Bash", "ls", True, code, 1))
    for rows, fails in (([event(1), event(1)], False), ([event(1), event(2)], True)):
        bad = write(tmp_path / f"d{fails}", 11, tables | {"tool_events": spark.createDataFrame(rows, lineage.SCHEMAS["tool_events"])})
        if fails:
            with pytest.raises(lineage.Duplicates):
                bad.migrate()
            assert bad.lineage() == 11
        else:
            bad.migrate()
            assert bad.table("tool_events").count() == 1
    strange = Store(spark, str(tmp_path / "strange"))
    strange.files.publish("manifest-1.json", json.dumps({"signature": "0" * 64, "tables": {}, "segments": {}, "lengths": {}}))
    with pytest.raises(lineage.UnsupportedLineage):
        strange.table("items")


def test_derived_data_of_files_that_are_gone(spark, store):
    rows = [("gone", 0, "assistant", "Bash command=A=1 make all", "g0", "tool", None, None), ("gone", 1, "user", "error: cannot open 12 of 13", "g1", "tool", None, None), ("gone", 2, "user", "that is wrong, you see", "g2", "text", None, None)]
    store.ingest(messages(spark, rows), listed(spark, ["gone"]))
    assert store.table("template_matches").count() == 0 and store.table("tool_events").count() == 0  # nothing said that it failed
    store.commit({"files": store.table("files").where("path <> 'gone'")})
    assert store.backfill() == 1
    event = store.table("tool_events").first()
    assert (event["tool_name"], event["command_head"], event["extraction_version"], event["message_uuid"]) == ("Bash", "make", 0, None)
    assert [r["template_text"] for r in store.table("templates").collect()] == ["error: cannot open <*> of <*>"] and store.table("correction_signals").where("source_path = 'gone'").count() == 1
    assert store.backfill() == 0  # nothing is left to do
    old = store.table("templates").withColumn("normalization_version", F.lit(1)).unionByName(spark.createDataFrame([("x", "stale", 1)], lineage.SCHEMAS["templates"]))
    matches = store.table("template_matches").unionByName(spark.createDataFrame([("p1", 0, "x", None)], lineage.SCHEMAS["template_matches"]))
    store.commit({"templates": old, "template_matches": matches})
    assert store.backfill() == 2 and [(r["template_text"], r["normalization_version"]) for r in store.table("templates").collect()] == [("error: cannot open <*> of <*>", 2)]
    assert store.table("template_matches").count() == 1
    store.commit({"correction_signals": store.table("correction_signals").withColumn("extraction_version", F.lit(1)).withColumn("detector", F.lit("old"))})
    superseded = store.table("correction_signals").select("source_path").distinct().count()
    assert store.rederive() == superseded and store.rederive() == 0
    assert {(r["detector"], r["extraction_version"]) for r in store.table("correction_signals").where("source_path = 'gone'").collect()} == {("lexicon", store_module.EXTRACTION_VERSION)}
    assert store.table("correction_signals").where("detector = 'old'").count() == 0
    assert store.resolve_projects(F.when(F.col("source_path") == "gone", "found"), only_unknown=False) == 1
    assert {r["project"] for r in store.table("items").where("source_path = 'gone'").collect()} == {"found"}
    store.rebuild(F.lit("unknown"))
    assert store.validate() == {"version": store.version, "missing": ["annotations", "chunks", "embedding_metadata", "stopwords"], "missing_indexes": [], "orphan_paths": 1, "loose": {"tool_events": 0, "template_matches": 0, "annotations": 0}}


def test_stored_index_equals_a_scan(spark, store):
    extra = [("t", i, "assistant", x, f"t{i}", "tool", None, None) for i, x in enumerate(["make kernel-7 KERNEL", "ls /etc", "ab", "kernelkernel"])] + [("t", 9, "user", "Compiled compilers: kernels compile, caf\xe9 of-the night of-the day", "t9", "text", None, None)]
    store.ingest(messages(spark, extra), listed(spark, ["t"]))
    store.ingest(messages(spark, talk("p3", 3, "!")), listed(spark, ["p3"]))
    items = store.table("items")
    live, hits = items.select("id"), lambda df: {r["id"]: pytest.approx(r["score"]) for r in df.select("id", "score").collect()}
    for again in (False, True):
        for words in ("compiling", "kernel comp", "caf\xe9", "of-the", "nothing here", "message 1"):
            got = index.search_prose(store.segment(index.PROSE), live, *store.lengths(index.PROSE), words)
            assert hits(got) == hits(search.search_prose(items, words)), words
        for words in ("kernel", "KERNEL make", "l", "l kernel", "zzz"):
            got = index.search_tool(store.segment(index.TOOL), items, *store.lengths(index.TOOL), words)
            assert hits(got) == hits(search.search_tool(items, words)), words
        if not again:
            store.purge("1999-01-01")
            store.optimize()
            assert all(len(s) == 1 for s in store.manifest()["segments"].values())
    page = store.search(search.SearchRequest("kernel", limit=4, offset=1))
    scan = search.search(items, search.SearchRequest("kernel", limit=4, offset=1))
    assert [r["id"] for r in page.collect()] == [r["id"] for r in scan.collect()]
    assert store.search(search.SearchRequest("kernel", content_type="tool")).count() == 2 and store.search(search.SearchRequest("kernel", content_type="text", role="user", source="sessions", project="app")).count() > 0
    store.refresh_stopwords()
    assert "of" in store.stopwords() and store.search(search.SearchRequest("of kernel", limit=50)).count() > 5


def test_chunks_and_vectors(spark, store):
    provider = embeddings.HashProvider(5)
    assert provider.embed(["a"])[0] == provider.embed(["a"])[0] != provider.embed(["b"])[0] and all(-1 <= x <= 1 for x in provider.embed(["a"])[0])
    assert embeddings.HashProvider(10).embed(["a"])[0][8:] == [0.0, 0.0]
    embeddings.embed_store(store, provider, limit=20, overlap=4)
    chunks = store.table("chunks")
    assert chunks.where("embedding is null").count() == 0 and chunks.select("source_id").distinct().count() == 6
    assert store.table("embedding_metadata").count() == chunks.count()
    one = chunks.first()
    best = search.vector_search(chunks, one["embedding"], 1).first()
    assert best["source_id"] == one["source_id"] and best["sim"] == pytest.approx(1)
    embeddings.write_chunks(store, spark.createDataFrame([("p0", 0, "only", 2)], "source_id string, chunk_idx int, content string, token_count bigint"))
    assert store.table("chunks").where("source_id = 'p0'").count() == 1 and store.table("chunks").count() < chunks.count() + 1
    back = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select("v", embeddings.encoded(F.col("v")).alias("b")).select("v", embeddings.decoded(F.col("b")).alias("w")).collect()
    assert [r["v"] for r in back] == [r["w"] for r in back]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(embeddings.decoded(F.col("b")).alias("w")).first()["w"] is None
    with pytest.raises(RuntimeError):
        embeddings.OnnxProvider("model.onnx")


def test_the_ingest_driver_reads_what_changed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    record = lambda u, text: json.dumps({"uuid": u, "cwd": "/w/shop", "type": "user", "message": {"role": "user", "content": text}})
    for name in "ab":
        (folder / f"{name}.jsonl").write_text(record(name + "1", f"hello from {name}") + "\n")
        os.utime(folder / f"{name}.jsonl", (1_700_000_000, 1_700_000_000))
    store, inputs = Store(spark, str(tmp_path / "store")), [InputDefinition("x", roots=[str(folder)])]
    first = sync.sync(store, inputs)
    assert (first.listed, first.hashed, first.parsed) == (2, 2, 2) and {r["project"] for r in store.table("items").collect()} == {"shop"}
    second = sync.sync(store, inputs)
    assert (second.hashed, second.parsed, second.stale) == (0, 0, 0)
    with open(folder / "a.jsonl", "a") as f:
        f.write(record("a2", "more from a") + "\n")
    os.utime(folder / "b.jsonl")  # another time, the same contents
    third = sync.sync(store, inputs)
    assert (third.hashed, third.parsed) == (2, 1) and store.table("items").count() == 3
    os.utime(folder / "a.jsonl", (1_700_000_100, 1_700_000_100))
    sync.sync(store, inputs)
    store.commit({"items": store.table("items").withColumn("extraction_version", F.lit(1))})
    assert sync.sync(store, inputs, stale_cap=1).stale <= 1
    (folder / "b.jsonl").unlink()
    store.commit({"files": store.table("files").where("path not like '%b.jsonl'")})
    assert sync.sync(store, inputs).backfilled == 1 and "hello" in store.stopwords()


def test_requests_are_checked_and_pages_formatted(spark, store, tmp_path, monkeypatch):
    for bad in (dict(kind="novels"), dict(kind="templates", trend=True), dict(kind="commands", project="a", all_projects=True), dict(kind="commands", limit=-1)):
        with pytest.raises(ValueError):
            requests.PatternRequest(**bad)
    with pytest.raises(ValueError):
        requests.ListRequest(order="size")
    assert requests.PatternRequest("corrections", batch=7).limit == 7 and requests.PatternRequest("corrections", batch=7, limit=3).limit == 3 and requests.PatternRequest("commands", batch=7).limit == 20
    assert requests.default_project("a", False) == "a" and requests.default_project("a", True) is None and requests.default_project(None, False, cwd="/w/Shop") == "shop" and requests.default_project(None, False, cwd="/") is None
    for kind in requests.KINDS:
        assert requests.pattern_page(store, requests.PatternRequest(kind, tag="none")).count() == 0
    shown = json.loads(requests.search_page(store, search.SearchRequest("kernels", limit=2))[0])
    assert len(shown) == 2 and set(shown[0]) == set(requests.MINIMAL) and "<b>kernels</b>" in shown[0]["text"]
    assert set(json.loads(requests.search_page(store, search.SearchRequest("kernels", limit=1), "full")[0])[0]) == set(requests.FULL)
    robot = requests.search_page(store, search.SearchRequest("kernels", limit=2), format="robot")
    assert len(robot) == 10 and robot[0].startswith("result_0_source_path=") and requests.robot("a\n\\b") == "a\\n\\\\b"
    text = requests.search_page(store, search.SearchRequest("kernels", limit=5), format="text", max_tokens=80)
    assert 0 < len([x for x in text if x.startswith("---")]) < 5
    with pytest.raises(ValueError):
        requests.search_page(store, search.SearchRequest("kernels"), "some")
    told = requests.report(store, [InputDefinition("x", roots=["/a"])])
    assert told["inputs"] == [("x", "claude", ["/a"])] and told["status"]["items"] == 18 and told["status"]["lineage"] == 14
    assert requests.hints(0, "ab", "tool") and requests.hints(3) == []
    assert [r["source_path"] for r in requests.sessions(store.table("items"), store.table("tags"), requests.ListRequest(limit=2, offset=1)).collect()] == ["p1", "p2"]
    signals = store.table("items").select("source_path", "ordinal", F.lit("lexicon").alias("detector"), F.lit(0.8).alias("confidence")).where("ordinal = 1")
    sample = census.calibration(signals, store.table("items"), store.table("annotations"), store.table("tags"), 3, 1)
    census.write_calibration(sample, str(tmp_path / "csv"))
    lines = [x for n in os.listdir(tmp_path / "csv") if n.endswith(".csv") for x in open(tmp_path / "csv" / n, encoding="utf-8").read().splitlines()]
    assert len(lines) == 4 and lines[0].startswith("uuid,kind,label,detector,confidence")


def test_first_bytes_keep_characters_whole(spark):
    texts = ["a\xe9\u20acb", "\U0001f600x", "plain", ""]
    rows = spark.createDataFrame([(t, n) for t in texts for n in range(1, 9)], "t string, n int")
    for n in range(1, 9):
        for r in rows.where(F.col("n") == n).select("t", census.first_bytes(F.col("t"), n).alias("x")).collect():
            want = r["t"].encode()[:n].decode("utf-8", "ignore")
            assert r["x"] == want
