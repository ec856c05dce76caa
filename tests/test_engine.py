"""The engine against DuckDB, its readers, store and algorithms."""

import json
import os
import random
import sqlite3
from itertools import combinations

import duckdb
import pytest

from pyspark.sql import functions as F

from tracelode.functions import chunking
from tracelode.functions import text as T
from tracelode.functions.porter import stem
from tracelode.functions.projects import Project, identify
from tracelode.operators import mining, search
from tracelode.operators.store import Store
from tracelode.plans import catalog
from tracelode.sources import readers
from tracelode.sources.discover import InputDefinition, discover, glob_regex

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, values):
    """Sorted rows as text, columns by name; not through pandas, which turns integers with nulls into floats on one side only."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: str(round(v, 9)) if isinstance(v, float) else str(bytes(v)) if isinstance(v, bytearray) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_prefix_span_equals_brute_force(spark):
    rng = random.Random(42)
    seqs = [[rng.choice("ABCD") for _ in range(rng.randint(1, 6))] for _ in range(8)]
    want = {}
    for s in seqs:
        for p in {c for n in (2, 3) for c in combinations(s, n)}:
            want[" ".join(p)] = want.get(" ".join(p), 0) + 1
    got = mining.prefix_span(spark.createDataFrame([(s,) for s in seqs], "seq array<string>"), 3, 2, 3).collect()
    assert {r["items"]: r["support"] for r in got} == {k: v for k, v in want.items() if v >= 3}


def test_small_functions():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "falling", "happy")] == ["caress", "poni", "relat", "hop", "fall", "happi"]
    assert identify("/x/shop", [Project("op", suffixes=("op",))]) == "shop" and identify("/home/a/work/x", [Project("w", roots=("/home/a/work",))]) == "w"
    assert glob_regex("**/*.jsonl").match("a/b/c.jsonl") and not glob_regex("*.jsonl").match("a/b.jsonl")
    with pytest.raises(ValueError):
        search.SearchRequest(" ")


def test_ingest_search_purge_and_recover(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "subagents").mkdir(parents=True)
    record = lambda **k: json.dumps(k)
    lines = [
        record(uuid="u1", timestamp="2024-01-01T10:00:00Z", cwd="/w/app", type="user", message={"role": "user", "content": "please <caveat>x</caveat> run the tests"}),
        record(uuid="u2", timestamp="2024-01-01T10:01:00Z", type="assistant", message={"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "A=1 pytest -q"}}]}),
        record(uuid="u3", timestamp="2024-02-01T10:02:00Z", type="user", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": "line 1\nerror: exit code 2 at /tmp/x"}]}),
        record(uuid="u4", type="progress", message={"role": "user", "content": "noise"}), "not json", "",
    ]
    (folder / "a.jsonl").write_text("\n".join(lines))
    (folder / "subagents" / "b.jsonl").write_text(lines[0])
    found = discover(InputDefinition("x", roots=[str(folder)], exclude=["**/subagents/**", "subagents/**"]))
    assert [os.path.basename(p) for p in found] == ["a.jsonl"]
    messages = readers.reader_for("")(spark, found)
    got = messages.orderBy("ordinal").collect()
    assert [(r["role"], r["content_type"], r["text"]) for r in got][:3] == [("user", "text", "please run the tests"), ("assistant", "text", "ok"), ("assistant", "tool", "Bash command=A=1 pytest -q")]
    # the call has the outcome and is the only event; the result has its prefix
    assert (got[2]["tool_name"], got[2]["command_head"], got[2]["is_error"], got[2]["exit_code"]) == ("Bash", "pytest", True, 2)
    assert got[3]["tool_name"] is None and got[3]["is_error"] and got[3]["text"] == "error: line 1\nerror: exit code 2 at /tmp/x"
    files = spark.createDataFrame([(found[0], "h", 1, None)], "path string, hash string, file_size bigint, file_mtime timestamp")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # again: nothing is added
        store.ingest(messages, files)
    assert store.table("items").count() == 4 and {r["template_text"] for r in store.table("templates").collect()} == {"error: line <*>", "error: exit code <*> at <*>"}
    assert [tuple(r) for r in store.table("tool_events").select("tool_name", "command_head", "is_error", "exit_code").collect()] == [("Bash", "pytest", True, 2)]
    assert {r["tag"] for r in store.table("tags").collect()} >= {"testing", "debugging"}
    hits = search.search(store.table("items"), search.SearchRequest("tests", content_type="text")).collect()
    assert [h["text"] for h in hits] == ["please run the tests"]
    store.annotate("note", "a", uuid="u1")
    store.annotate("note", "b", uuid="u1")
    assert [r["label"] for r in store.table("annotations").collect()] == ["b"]
    other = Store(spark, str(tmp_path / "other"))
    other.ingest(messages, files)
    assert store.purge("2024-01-15") == 3 and store.table("items").count() == 1
    with pytest.raises(LookupError):
        store.annotate("note", "c", uuid="u1")
    assert store.recover([str(tmp_path / "other")])["conflicts"] == 0
    assert store.table("items").count() == 4
    for name in ("tool_events", "tags", "templates", "template_matches", "correction_signals", "annotations"):  # all tables come back
        theirs, mine = (sorted(map(str, x.table(name).drop("created_at").collect())) for x in (other, store))
        assert set(theirs) <= set(mine), name
    assert {r["hash"] for r in store.table("files").collect()} == {"h", "recovered"} and store.validate()["loose"]["tool_events"] == 0


def test_sqlite_and_markdown(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.db")
    db.executescript("CREATE TABLE message(id, session_id, data, time_created, time_updated); CREATE TABLE part(id, message_id, data)")
    db.execute("INSERT INTO message VALUES ('m', 's', '{\"role\":\"user\"}', 1704067200000, 5)")
    for i, p in enumerate([{"type": "text", "text": "hello"}, {"type": "text", "text": "there"}, {"type": "tool", "tool": "Read", "state": {"input": {"f": "x"}, "output": "done"}}]):
        db.execute("INSERT INTO part VALUES (?, 'm', ?)", (f"p{i}", json.dumps(p)))
    db.commit()
    got = readers.opencode(spark, [str(tmp_path / "s.db")]).orderBy("ordinal").collect()
    assert [r["text"] for r in got] == ["hello\nthere", "Read f=x", "done"] and [r["content_type"] for r in got] == ["text", "tool", "tool"] and readers.watermark(str(tmp_path / "s.db")) != "empty"
    (tmp_path / "n.md").write_text("---\nid: note\n---\nintro\n## One\na\n## Two\nb\n")
    got = readers.markdown(spark, [str(tmp_path / "n.md")], "rule", True).orderBy("ordinal").collect()
    assert [(r["id"], r["text"]) for r in got] == [("note-1", "## One\na"), ("note-2", "## Two\nb")]


def chunked(spark, texts, limit, overlap=0):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["c"] for r in rows.select("i", chunking.chunks(F.col("t"), limit, overlap).alias("c")).orderBy("i").collect()]


def test_chunks(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    para = f"{words(0, 30)}\n\n{words(30, 60)}\n\n{words(60, 90)}"
    assert chunked(spark, [None, "", " \n ", " a b "], 5) == [[], [], [], ["a b"]] and chunked(spark, ["some text"], 0) == [["some text"]]
    assert chunked(spark, [para], 80) == [[f"{words(0, 30)} {words(30, 60)}", words(60, 90)]]  # paragraphs of 40 tokens
    assert chunked(spark, [para], 40) == [[words(0, 30), words(30, 60), words(60, 90)]]
    sentences = "One two three. Four five six! Seven eight nine? Ten"
    assert chunked(spark, [sentences], 8) == [["One two three. Four five six!", "Seven eight nine? Ten"]]
    assert chunked(spark, [words(0, 10)], 8) == [[words(0, 4), words(4, 8), words(8, 10)]]  # a word counts two tokens alone
    # three words of overlap begin the next chunk; a chunk of the outer level goes on with its own tail
    assert chunked(spark, [words(0, 10)], 8, 2) == [[words(0, 4), words(3, 7), words(6, 10)]]
    mixed = f"a b\n\n{words(0, 8)}\n\nc d"
    assert chunked(spark, [mixed], 8) == [["a b", words(0, 4), words(4, 8), "c d"]]
    texts = [" ".join(f"x{i}{'.' if i % 7 == 6 else ''}" for i in range(n)) + "\n\ntail" for n in (5, 50, 500, 3000)]
    for text, got in zip(texts, chunked(spark, texts, 40), strict=True):
        assert " ".join(got).split() == text.split() and all((len(c.split()) * 4 + 2) // 3 <= 40 for c in got)


def test_lines_are_trimmed_of_blanks_only(spark):
    rows = spark.createDataFrame([("error: job of 0\n1 exit code 1\n  FAIL  x 2 ",)], "t string")
    got = rows.select(T.error_lines(F.col("t")).alias("a"), T.lines_that_tell(F.lit("Go"), F.col("t")).alias("b")).first()
    assert got["a"] == ["error: job of 0", "FAIL  x 2"] and got["b"] == ["FAIL  x 2"]


def test_chat_exports_are_no_corrections(spark):
    say = "that is wrong "
    texts = [say + "[10:11] Ann: a [10:12] Bo Li: b [3:06 p.m., 2/7] Cy: c", say + "Ann: [10:11 a Bo: [10:12 b Cy: [10:13 c", say + "at [10:11] Ann: once", say]
    items = spark.createDataFrame([(f"p{i}", 0, "user", t, "text", False) for i, t in enumerate(texts)], "source_path string, ordinal int, role string, text string, content_type string, was_interrupted boolean")
    assert sorted(r["source_path"] for r in mining.detect_corrections(items).collect()) == ["p2", "p3"]
    tool = items.withColumn("content_type", F.lit("tool"))
    assert mining.detect_corrections(tool).count() == 0 and mining.detect_corrections(tool, prose_only=False).count() == 2
    mining.register_detector("short", lambda: (F.char_length("text") < 16, 0.1))
    try:
        assert {r["detector"] for r in mining.detect_corrections(items).where("source_path = 'p3'").collect()} == {"lexicon", "short"}
    finally:
        del mining.DETECTORS["short"]


def test_other_readers(spark, tmp_path):
    lines = lambda *records: "\r\n".join(map(json.dumps, records)) + "\n"
    (tmp_path / "pi.jsonl").write_text(lines(
        {"type": "session", "cwd": "/w/app"}, {"type": "message", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "thinking", "text": "hm"}, {"type": "toolCall", "name": "Bash", "arguments": {"command": "ls"}}]}},
        {"type": "custom", "customType": "note", "data": {"b": 1, "a": "x"}}, {"type": "message", "message": {"role": "system", "content": "no"}},
    ))
    read = readers.reader_for("pi")
    got = read(spark, [str(tmp_path / "pi.jsonl")], True).orderBy("ordinal").collect()
    assert [(r["role"], r["text"], r["content_type"]) for r in got] == [("assistant", "hi", "text"), ("reasoning", "hm", "reasoning"), ("assistant", "Bash command=ls", "tool"), ("tool", 'note {"b":1,"a":"x"}', "tool")]
    assert {r["cwd"] for r in got} == {"/w/app"} and not any(r["tool_name"] or r["uuid"] for r in got)
    (tmp_path / "old.jsonl").write_text(lines({"message": {"role": "user", "content": "a"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "tool_use", "name": "x"}]}}, {"isMeta": True, "message": {"role": "user", "content": "no"}}))
    got = readers.reader_for("legacy")(spark, [str(tmp_path / "old.jsonl")]).orderBy("ordinal").collect()
    assert [(r["text"], r["content_type"]) for r in got] == [("a", "text"), ("b", "tool")]
    (tmp_path / "p.md").write_text("no heading")
    (tmp_path / "q.md").write_text("## One\na\n## Two\nb")
    assert [(r["title"], r["body"]) for r in readers.plans(spark, [str(tmp_path / "p.md"), str(tmp_path / "q.md")]).orderBy("source_path", "section").collect()] == [("Untitled", "no heading"), ("One", "## One\na"), ("Two", "## Two\nb")]
    docs = readers.documents(spark, {"ke": [str(tmp_path / "p.md")], "rule": [str(tmp_path / "q.md")], "spec": []})
    assert sorted((r["source"], r["ordinal"]) for r in docs.collect()) == [("ke", 0), ("rule", 0), ("rule", 1)]
    with pytest.raises(ValueError):
        readers.documents(spark, {"novel": ["x"]})
    with pytest.raises(ValueError):
        readers.register("claude", read)


def test_rules_hints_and_registries(spark, tmp_path):
    from tracelode.functions import projects

    (tmp_path / "rules.toml").write_text('version = 2\n[[rule]]\ntool = "Read"\ncategory = "R"\n[[rule]]\npattern = "^Bash git"\ncategory = "G"\n')
    (tmp_path / "old.toml").write_text("version = 1\n")
    rules = mining.load_rules(str(tmp_path / "rules.toml"))
    assert mining.load_rules(str(tmp_path / "old.toml")) == mining.load_rules() == mining.CATEGORY_RULES
    rows = spark.createDataFrame([("Read", None), ("Bash", "git"), ("Other", None)], "t string, h string").select(mining.category(F.col("t"), F.col("h"), rules).alias("c"))
    assert [r["c"] for r in rows.collect()] == ["R", "G", "Other"]
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / ".project-id").write_text("named\nmore")
    assert projects.read_hint(str(deep)) == "named" and projects.read_hint("/nowhere/at/all", levels=1) is None
    registry = [projects.Project("shop", roots=("/w/shop",))]
    paths = spark.createDataFrame([("/w/shop/s.jsonl",), ("/w/other/s.jsonl",)], "source_path string")
    assert [r["p"] for r in paths.select(projects.registry_project(registry, F.col("source_path")).alias("p")).collect()] == ["shop", None]


def test_streams(spark, tmp_path):
    from tracelode.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda u: json.dumps({"uuid": u, "type": "user", "message": {"role": "user", "content": f"text {u}"}})
    (folder / "a.jsonl").write_text(line("1"))
    store = Store(spark, str(tmp_path / "store"))
    for more in ("b", "c"):
        ingest.watch(spark, str(folder), store, str(tmp_path / "check")).awaitTermination()
        (folder / f"{more}.jsonl").write_text(line(more) + "\n" + line("1"))
    ingest.watch(spark, str(folder), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["uuid"] for r in store.table("items").collect()) == ["1", "b", "c"]
    events = spark.createDataFrame([("2024-01-01 10:00:00", "x"), ("2024-01-07 23:00:00", "x"), ("2024-01-08 00:00:00", "y")], "t string, tool_name string").select(F.to_timestamp("t").alias("timestamp"), "tool_name")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    ingest.weekly_counts(stream).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r["week_start"]), r["tool_name"], r["cnt"]) for r in spark.table("weeks").collect()) == [("2024-01-01 00:00:00", "x", 2), ("2024-01-08 00:00:00", "y", 1)]


def test_discovery(tmp_path):
    from tracelode.sources.discover import active_inputs, load_inputs

    (tmp_path / "a.inputs.toml").write_text('[[inputs]]\nid = "a"\nunknown = 1\n[inputs.discover]\nroots = ["~/x"]\n[[inputs]]\nid = "off"\nactive = false\n')
    assert [d.id for d in load_inputs(str(tmp_path))] == ["a"] and [d.id for d in active_inputs(str(tmp_path), ["/s"])] == ["a"]
    assert [d.roots for d in active_inputs(str(tmp_path / "none"), ["/s"])] == [["/s"]] and active_inputs(str(tmp_path / "none")) == []
    root = tmp_path / "root"
    (root / "d" / "e").mkdir(parents=True)
    for name in ("x.jsonl", "d/y.jsonl", "d/e/z.jsonl", "d/e/z.txt"):
        (root / name).write_text("")
    (root / "loop").symlink_to(root)
    (root / "out").symlink_to(tmp_path)
    names = lambda **k: [os.path.relpath(p, root) for p in discover(InputDefinition("i", roots=[str(root), str(root)], **k))]
    assert names() == ["d/e/z.jsonl", "d/y.jsonl", "x.jsonl"] == names(follow_symlinks=True)
    assert names(include=["d/*"]) == ["d/y.jsonl"] and names(include=["**/e/**"]) == ["d/e/z.jsonl", "d/e/z.txt"] and names(exclude=["**/e/**"]) == ["d/y.jsonl", "x.jsonl"]
