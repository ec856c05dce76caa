"""Registered queries of what works on a store: ingest, stored indexes, requests, derivation, lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projects
from ..functions import text as T
from ..operators import census, embeddings, index, lineage, mining, requests, search, store
from ..operators.sync import _named
from ..sources import readers
from . import views as V
from .catalog import _FIELDS, _TALK, E, I, TG, _bm25_sql, _list_sql, _prose_rows, _scored, _substring_rows, _talk, query

# --- ingest --------------------------------------------------------------------------------------------------------


def folder(s: SparkSession) -> str:
    """A fresh folder: below spark.checkpoint.dir, or a local one where the master is local."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def sessions_of_events(s: SparkSession, d: str, where: str) -> list[str]:
    """Every event as a session's records: a call, but for views its result, after purchases a text; 16 files, users dealt to them."""
    e = s.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    text = lambda x: F.col(x).cast("string")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    call = F.struct(F.lit("tool_use").alias("type"), text("event_id").alias("id"), F.when(F.col("event_type") == "error", "Bash").otherwise(F.col("event_type")).alias("name"), F.struct(F.concat(F.lit("A=1 k"), text("k"), F.lit(" --x")).alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), text("event_id").alias("tool_use_id"), (F.col("event_type") == "error").alias("is_error"), F.concat(F.lit("job of "), text("user_id"), F.lit("\nexit code "), text("k")).alias("content"))
    record = lambda kind, role, block: F.to_json(F.struct(F.concat(F.lit(kind), text("event_id")).alias("uuid"), at.alias("timestamp"), F.concat(F.lit("/w/p"), (F.col("user_id") % 5).cast("string")).alias("cwd"), F.struct(F.lit(role).alias("role"), F.array(block).alias("content")).alias("message")))
    said = F.struct(F.lit("text").alias("type"), F.concat(F.lit("k"), text("k"), F.lit(" item"), text("user_id")).alias("text"))
    spoken = F.to_json(F.struct(F.concat(F.lit("s"), text("event_id")).alias("uuid"), at.alias("timestamp"), F.concat(F.lit("/w/p"), (F.col("user_id") % 5).cast("string")).alias("cwd"), F.struct(F.lit("user").alias("role"), F.array(said).alias("content")).alias("message")))
    both = F.array(record("c", "assistant", call), F.when(F.col("event_type") != "view", record("r", "user", result)), F.when(F.col("event_type") == "purchase", spoken))
    lines = e.select((F.col("user_id") % 16).alias("f"), "ts", "event_id", F.posexplode(both).alias("i", "line")).where("line is not null")
    lines.repartition("f").sortWithinPartitions("f", "ts", "event_id", "i").select("f", "line").write.partitionBy("f").text(where)
    listed = s.read.text(where).select(F.col("_metadata.file_path").alias("p")).distinct().collect()  # 16 names
    return [r["p"] for r in listed]


def ingested(s: SparkSession, d: str) -> store.Store:
    base = folder(s)
    paths = sessions_of_events(s, d, f"{base}/in")
    files = s.createDataFrame([(p, "h", 1, None) for p in paths], "path string, hash string, file_size bigint, file_mtime timestamp").withColumn("path", _named("path"))
    out = store.Store(s, f"{base}/store")
    out.ingest(readers.reader_for("claude")(s, paths).withColumn("source_path", _named("source_path")), files)
    return out


_BUILT: dict[tuple[str, str], store.Store] = {}


def built(s: SparkSession, d: str) -> store.Store:
    """One ingested store for each application and folder, for queries that only read it."""
    key = (s.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = ingested(s, d)
    return _BUILT[key]


_CALLS = "calls AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'Bash' ELSE event_type END AS tool_name, 'k' || k AS command_head, CASE WHEN event_type <> 'view' THEN event_type = 'error' END AS is_error, CASE WHEN event_type = 'error' THEN k END AS exit_code, ts FROM (SELECT *, (props::JSON ->> '$.k')::INTEGER AS k FROM events))"


@query(f"WITH {_CALLS} SELECT tool_name, command_head, count(*) AS cnt FROM calls GROUP BY ALL")
def ingest_commands(s, d):
    """One event a call, over a store."""
    return requests.pattern_page(built(s, d), requests.PatternRequest("commands", limit=0))


_OF_P2 = "user_id % 16 IN (SELECT f FROM firsts WHERE p = 2)"


@query(f"WITH firsts AS (SELECT user_id % 16 AS f, arg_min(user_id % 5, (ts, event_id)) AS p FROM events GROUP BY 1), {_CALLS} SELECT tool_name, exit_code, count(*) AS cnt, (SELECT count(is_error) FROM calls WHERE {_OF_P2}) AS coverage FROM calls WHERE is_error AND {_OF_P2} GROUP BY ALL")
def ingest_failures(s, d):
    """A file's project is that of its first working directory."""
    return requests.pattern_page(built(s, d), requests.PatternRequest("failures", project="p2", limit=0))


@query(f"WITH {_CALLS} SELECT message_uuid, is_error, exit_code FROM (SELECT 'c' || event_id || '#t0' AS message_uuid, is_error, exit_code FROM calls)")
def ingest_outcomes(s, d):
    """Outcomes of results, told on the calls."""
    return built(s, d).table("tool_events").select("message_uuid", "is_error", "exit_code")


@query(f"WITH {_CALLS} SELECT template_text, count(DISTINCT event_id) AS cnt FROM (SELECT event_id, unnest(['error: job of <*>', 'exit code <*>']) AS template_text FROM calls WHERE is_error) GROUP BY 1")
def ingest_templates(s, d):
    st = built(s, d)
    return st.table("template_matches").join(st.table("templates"), "signature").groupBy("template_text").agg(F.count("*").alias("cnt"))


_SAID = f"""{_CALLS}, texts AS (SELECT 's' || event_id AS uuid, 'k' || k || ' item' || user_id AS text, 'text' AS kind, 'user' AS role, user_id, event_id, ts, 2 AS i FROM (SELECT *, (props::JSON ->> '$.k')::INTEGER AS k FROM events) WHERE event_type = 'purchase'
  UNION ALL SELECT 'c' || event_id || '#t0', tool_name || ' command=A=1 ' || command_head || ' --x', 'tool', 'assistant', user_id, event_id, ts, 0 FROM calls
  UNION ALL SELECT 'r' || event_id || '#r0', CASE WHEN is_error THEN 'error: ' ELSE '' END || 'job of ' || user_id || chr(10) || 'exit code ' || substr(k, 2), 'tool', 'user', user_id, event_id, ts, 1 FROM (SELECT *, command_head AS k FROM calls) WHERE is_error IS NOT NULL)"""


@query(f"WITH {_SAID} SELECT uuid, text, role, kind AS content_type, (row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id, i) - 1)::INTEGER AS ordinal, date_trunc('second', ts)::TIMESTAMP AS timestamp FROM texts")
def ingest_messages(s, d):
    """Texts, roles, types, times and the order of the messages in their files."""
    return built(s, d).table("items").select("uuid", "text", "role", "content_type", "ordinal", "timestamp")


def _store_hits(st: store.Store, r: search.SearchRequest) -> DataFrame:
    return st.search(r).select("uuid", F.round("score", 6).alias("score"))


@query(f"WITH {_SAID}, v_items AS (SELECT *, uuid AS id FROM texts WHERE kind = 'tool'), {_bm25_sql(_substring_rows(['exit', 'job']), ['a', 'b'])}".replace("SELECT id, round(0.0", "SELECT id AS uuid, round(0.0"))
def store_search_tool(s, d):
    """Tool text through the stored index."""
    return _store_hits(built(s, d), search.SearchRequest("Exit job", content_type="tool", limit=10_000_000))


@query(f"WITH {_SAID}, r AS (SELECT uuid, user_id, 2 AS dl, (split_part(text, ' ', 1) LIKE 'k7%')::INTEGER AS tf FROM texts WHERE kind = 'text'), st AS (SELECT count(*) AS n, sum(tf) AS df FROM r), firsts AS (SELECT user_id % 16 AS f, arg_min(user_id % 5, (ts, event_id)) AS p FROM events GROUP BY 1) SELECT uuid, round(0.0 - (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2), 6) AS score FROM r, st WHERE tf > 0 AND user_id % 16 IN (SELECT f FROM firsts WHERE p = 1)")
def store_search_prose(s, d):
    """Prose through the stored index, of one project, role and tag; statistics are those of all prose."""
    r = search.SearchRequest("k7", project="p1", role="user", source="sessions", content_type="text", tag="debugging", limit=10_000_000)
    return _store_hits(built(s, d), r)


@query(f"WITH {_SAID}, kept AS (SELECT * FROM texts WHERE ts::TIMESTAMP >= TIMESTAMP '2024-01-15') SELECT 'items' AS name, count(*) AS n FROM kept UNION ALL SELECT 'tool_events', count(*) FROM kept WHERE uuid LIKE 'c%' UNION ALL SELECT 'files', count(DISTINCT user_id % 16) FROM kept")
def store_purge(s, d):
    st = ingested(s, d)
    st.purge("2024-01-15")
    return s.createDataFrame([(n, st.table(n).count()) for n in ("items", "tool_events", "files")], "name string, n bigint")


@query(f"WITH {_SAID} SELECT uuid, CASE WHEN user_id % 16 % 2 = 0 THEN 'h' ELSE 'recovered' END AS hash FROM texts")
def store_recover(s, d):
    """Every other file's store lost: what another store has is taken from there and marked."""
    other = built(s, d)
    st = store.Store(s, folder(s))
    even = (F.regexp_extract("path", "f=([0-9]+)/", 1).cast("int") % 2) == 0
    files = other.table("files").where(even)
    mine = files.select(F.col("path").alias("source_path"))
    st.commit({"items": other.table("items").join(mine, "source_path", "left_semi"), "files": files})
    st.recover([other.root])
    return st.table("items").join(st.table("files"), F.col("source_path") == F.col("path")).select("uuid", "hash")


# --- other readers -------------------------------------------------------------------------------------------------


def _jsonl(s: SparkSession, d: str, record) -> list[str]:
    """conversations as JSON lines, one record a turn, dealt to eight files."""
    c = s.read.parquet(f"{d}/conversations.parquet").withColumn("f", F.col("conv_id") % 8)
    where = folder(s)
    c.repartition("f").sortWithinPartitions("f", "conv_id", "turn").select("f", F.to_json(record).alias("line")).write.partitionBy("f").text(where)
    return [r["p"] for r in s.read.text(where).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]


_CLEAN_TEXT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"WITH c AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM conversations WHERE role IN ('user', 'assistant')) SELECT role, clean AS text, 'text' AS content_type, count(*) AS n FROM c WHERE clean <> '' GROUP BY ALL UNION ALL SELECT 'tool', 'note turn ' || turn, 'tool', count(*) FROM conversations GROUP BY turn UNION ALL SELECT role, 'Read path=' || conv_id, 'tool', count(*) FROM c GROUP BY ALL")
def read_pi(s, d):
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<path:string>").alias("arguments")),
        F.struct(F.lit("toolCall").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Read").alias("name"), F.struct(F.col("conv_id").cast("string").alias("path")).alias("arguments")),
    )
    message = F.struct(F.lit("message").alias("type"), F.lit(None).cast("string").alias("customType"), F.lit(None).cast("string").alias("data"), F.struct("role", parts.alias("content")).alias("message"))
    note = F.struct(F.lit("custom").alias("type"), F.lit("note").alias("customType"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("data"), F.lit(None).cast(f"struct<role:string,content:{_PI}>").alias("message"))
    where = folder(s)
    c = s.read.parquet(f"{d}/conversations.parquet")
    c.select(F.explode(F.array(F.to_json(message), F.to_json(note))).alias("line")).write.text(where)
    paths = [r["p"] for r in s.read.text(where).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]
    return readers.reader_for("pi")(s, paths).groupBy("role", "text", "content_type").agg(F.count("*").alias("n"))


_PI = "array<struct<type:string,text:string,name:string,arguments:struct<path:string>>>"


@query(r"SELECT role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CASE WHEN turn % 2 = 1 THEN 'tool' ELSE 'text' END AS content_type, count(*) AS n FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' GROUP BY ALL")
def read_legacy(s, d):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.when(F.col("turn") % 2 == 1, F.array(block("text", F.col("text")), block("tool_use", F.lit(None).cast("string")))).otherwise(F.array(block("text", F.col("text"))))
    paths = _jsonl(s, d, F.struct(F.struct("role", content.alias("content")).alias("message")))
    return readers.reader_for("legacy")(s, paths).groupBy("role", "text", "content_type").agg(F.count("*").alias("n"))


@query("SELECT 'conv-' || conv_id || '-' || turn AS id, 'rule' AS source, 'document' AS role, '## Turn ' || turn || chr(10) || role AS text FROM conversations UNION ALL SELECT 'conv-' || conv_id, 'memory', 'document', '---' || chr(10) || 'id: conv-' || conv_id || chr(10) || '---' || chr(10) || string_agg('## Turn ' || turn || chr(10) || role, chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id")
def read_documents(s, d):
    """Markdown files, whole and by section."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("role")).alias("text"))))
    body = c.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("body"))
    where = folder(s)
    body.select("conv_id", F.concat(F.lit("---\nid: conv-"), F.col("conv_id").cast("string"), F.lit("\n---\n"), "body").alias("value")).repartition(8).write.partitionBy("conv_id").option("lineSep", "\n").text(where)
    got = readers.documents(s, {"rule": [f"{where}/conv_id=*"], "memory": [f"{where}/conv_id=*"]})
    turn = F.regexp_extract("text", r"^## Turn (\d+)", 1)
    name = F.when(F.col("source") == "rule", F.concat(F.regexp_replace("id", "-[0-9]+$", ""), F.lit("-"), turn)).otherwise(F.col("id"))
    return got.select(name.alias("id"), "source", "role", F.regexp_replace("text", r"\n+$", "").alias("text"))


@query(r"SELECT role, text AS text, count(*) AS n FROM (SELECT role, trim(text) AS text FROM conversations) WHERE text <> '' GROUP BY ALL")
def read_databases(s, d):
    """Session databases, one for each eighth of the conversations, read in parallel."""
    import json
    import os
    import sqlite3

    where = folder(s).removeprefix("file:")
    os.makedirs(where)
    paths = [f"{where}/{k}.db" for k in range(8)]
    c = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")

    def write(rows) -> None:
        """One task writes each database; on a cluster the folder is shared."""
        db = None
        for r in rows:
            if db is None:
                db = sqlite3.connect(paths[r["conv_id"] % 8])
                db.executescript("CREATE TABLE message(id, session_id, data, time_created, time_updated); CREATE TABLE part(id, message_id, data)")
            name = f"{r['conv_id']}-{r['turn']}"
            db.execute("INSERT INTO message VALUES (?, ?, ?, ?, ?)", (name, str(r["conv_id"]), json.dumps({"role": r["role"]}), 1_704_067_200_000 + r["turn"], 5))
            db.execute("INSERT INTO part VALUES (?, ?, ?)", (f"p{name}", name, json.dumps({"type": "text", "text": r["text"]})))
        if db is not None:
            db.commit()
            db.close()

    for k in range(8):
        c.where(F.col("conv_id") % 8 == k).coalesce(1).foreachPartition(write)
    return readers.opencode(s, [p for p in paths if os.path.exists(p)]).groupBy("role", "text").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) AS t(name)")
def discover_tables(s, d):
    """The folder's tables by discovery: a manifest, a recursive glob, an exclusion."""
    import os
    import tempfile
    from pathlib import Path

    from ..sources.discover import active_inputs, discover

    with tempfile.TemporaryDirectory() as config:
        Path(config, "x.inputs.toml").write_text(f'[[inputs]]\nid = "t"\n[inputs.discover]\nroots = ["{d}"]\ninclude = ["**/*.parquet", "**/part-*"]\nexclude = ["**/*.json"]\n[[inputs]]\nid = "off"\nactive = false\n', encoding="utf-8")
        (found,) = active_inputs(config)
    names = {os.path.relpath(p, os.path.realpath(d)).split(os.sep)[0].removesuffix(".parquet") for p in discover(found)}
    return s.createDataFrame([(n,) for n in names], "name string")


# --- more functions ------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'plain ' || user_id WHEN 1 THEN 'a=' || user_id || ' b=x' WHEN 2 THEN 'one' || chr(10) || event_type WHEN 3 THEN user_id::VARCHAR ELSE '[1,2]' END AS text FROM events")
def serialize_values(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 5
    value = F.when(k == 0, F.concat(F.lit('"  plain '), u, F.lit(' "'))).when(k == 1, F.concat(F.lit('{"b":"x","a":'), u, F.lit("}"))).when(k == 2, F.concat(F.lit('[{"text":"one"},{"id":1},{"text":"'), F.col("event_type"), F.lit('"}]'))).when(k == 3, u).otherwise("[1,2]")
    return e.select("event_id", T.serialize_value(value).alias("text"))


@query("SELECT event_id, event_id % 3 = 0 AS is_input, event_id % 3 = 1 AND event_type = 'error' AS mined FROM events")
def input_or_output(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Bash command="), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("it said "), F.col("event_type"))).otherwise("")
    kind = F.when(F.col("event_id") % 3 == 2, "text").otherwise("tool")
    return e.select("event_id", T.is_input_serialization(line).alias("is_input"), T.should_mine(kind, F.col("event_type") == "error", line).alias("mined"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts::TIMESTAMP WHEN 1 THEN date_trunc('day', ts)::TIMESTAMP END AS at FROM events")
def parse_times(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, "yesterday")
    return e.select("event_id", T.parse_time(text).alias("at"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'shop' WHEN 1 THEN 'shop' WHEN 2 THEN 'tree' WHEN 3 THEN 'ops' WHEN 4 THEN regexp_replace(lower('My.' || event_type), '[^a-z0-9_-]', '', 'g') ELSE 'unknown' END AS project, CASE event_id % 6 WHEN 5 THEN 'app' END AS decoded FROM events")
def project_paths(s, d):
    """Exact root, below a root, worktree, suffix, fallback, and a session folder that stands for a path."""
    e = s.read.parquet(f"{d}/events.parquet")
    registry = [projects.Project("shop", roots=("/w/shop",)), projects.Project("tree", worktrees=("/trees/*",)), projects.Project("ops", suffixes=("ops/live",))]
    cwd = F.element_at(F.array(F.lit("/w/shop/"), F.concat(F.lit("/w/shop/"), F.col("event_type")), F.concat(F.lit("/trees/"), F.col("event_type")), F.lit("/srv/ops/live"), F.concat(F.lit("/x/My."), F.col("event_type")), F.lit("")), (F.col("event_id") % 6 + 1).cast("int"))
    found = F.pandas_udf(lambda c: c.map(lambda p: projects.identify(p, registry)), "string")
    session = F.when(F.col("event_id") % 6 == 5, "/home/u/.claude/projects/-w-team-app-/s.jsonl").otherwise(F.col("event_type"))
    return e.select("event_id", found(cwd).alias("project"), projects.decode_project_dir(session).alias("decoded"))


@query(f"WITH {I} SELECT ordinal, role, text, uuid FROM v_items WHERE source_path = 'conv/1'")
def messages_of_path(s, d):
    return census.messages_of(V.items(s, d), "conv/1").select("ordinal", "role", "text", "uuid")


@query(f"WITH {E} SELECT signature FROM (VALUES ('a'), ('b')) t(signature)")
def templates_unmatched(s, d):
    """Templates that nothing matches."""
    mined, matches = mining.mine_templates(V.tool_events(s, d).where("is_error"))
    more = s.createDataFrame([("a", "x", 2), ("b", "y", 2)], "signature string, template_text string, normalization_version int")
    return store.unmatched_templates(mined.unionByName(more), matches).select("signature")


# --- stored indexes ------------------------------------------------------------------------------------------------


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Items of which every third is tool text."""
    return V.items(s, d).withColumn("content_type", F.when(F.col("id") % 3 == 0, "tool").otherwise("text"))


_MIXED = f"{I}, mixed AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'tool' ELSE 'text' END AS content_type) FROM v_items)"


def _lengths(items: DataFrame, kind: str) -> tuple[int, int]:
    r = index.lengths(items).where(F.col("kind") == kind).first()
    return r["n"], r["total"]


def _prose_hits(items: DataFrame, words: str, prefix: bool = True) -> DataFrame:
    return index.search_prose(index.prose_postings(items, stemmed=False), items.select("id"), *_lengths(items, index.PROSE), words, stemmed=False, prefix=prefix)


def _tool_hits(items: DataFrame, words: str) -> DataFrame:
    return index.search_tool(index.tool_grams(items), items.select("id", "text"), *_lengths(items, index.TOOL), words)


def _of(rows: str, kind: str) -> str:
    return rows.replace("v_items", f"(SELECT * FROM mixed WHERE content_type = '{kind}')")


@query(f"WITH {_MIXED}, {_bm25_sql(_of(_prose_rows([(['the'], True), (['an'], True)]), 'text'), ['a', 'b'])}")
def indexed_prose(s, d):
    return _scored(_prose_hits(_mixed(s, d), "the an"))


@query(f"WITH {_MIXED}, {_bm25_sql(_of(_prose_rows([(['of', 'the'], False)]), 'text'), ['a'])}")
def indexed_phrase(s, d):
    return _scored(_prose_hits(_mixed(s, d), "of-the", prefix=False))


@query(f"WITH {_MIXED}, {_bm25_sql(_of(_substring_rows(['the', 'tion']), 'tool'), ['a', 'b'])}")
def indexed_tool(s, d):
    return _scored(_tool_hits(_mixed(s, d), "THE tion"))


@query(f"WITH {_MIXED}, a AS {_list_sql(_of(_prose_rows([(['the'], True)]), 'text'), 1)}, b AS {_list_sql(_of(_substring_rows(['the']), 'tool'), 1)} SELECT id, round(sum(1.0 / (60 + rk)), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def indexed_routed(s, d):
    m = _mixed(s, d)
    return search.fuse([search.ranked(_scored(h), 200) for h in (_prose_hits(m, "the"), _tool_hits(m, "the"))]).select("id", F.round("rrf", 6).alias("rrf"))


@query(f"WITH {_MIXED} SELECT term, count(*) AS ids FROM (SELECT DISTINCT id, substr(lower(text), i, 3) AS term FROM (SELECT *, unnest(range(1, length(text) - 1)) AS i FROM mixed WHERE content_type = 'tool')) GROUP BY 1")
def index_grams(s, d):
    return index.tool_grams(_mixed(s, d)).groupBy("term").agg(F.count("*").alias("ids"))


@query(f"WITH {_MIXED} SELECT 'grams' AS kind, count(*) AS n, sum(length(text) - 2)::BIGINT AS total FROM mixed WHERE content_type = 'tool'")
def index_lengths(s, d):
    return index.lengths(_mixed(s, d)).where("kind = 'grams'")


# --- requests ------------------------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT tool_name, command_head, count(*) AS cnt FROM v_events GROUP BY ALL ORDER BY cnt DESC, tool_name, command_head LIMIT 7 OFFSET 3")
def patterns_paged(s, d):
    return requests.patterns(_tables(s, d), requests.PatternRequest("commands", limit=7, offset=3))


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """A store's tables from events."""
    e = V.tool_events(s, d)
    mined, matches = mining.mine_templates(e.where("is_error"))
    items = e.select("source_path", "ordinal", "timestamp", "project", "text", F.col("item_uuid").alias("uuid"))
    tags = e.where("tool_name = 'purchase'").select("source_path", F.lit("buyer").alias("tag")).distinct()
    signals = e.where("is_error").select("source_path", "ordinal", F.lit("denial").alias("detector"), F.lit(0.7).alias("confidence"))
    annotations = e.where("is_error and exit_code = 1").select("source_path", "ordinal", F.lit("correction").alias("kind"))
    return {"items": items, "tool_events": e.drop("timestamp", "project"), "tags": tags, "templates": mined, "template_matches": matches, "correction_signals": signals, "annotations": annotations}


_WINDOW = "timestamp > TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20'"


@query(f"WITH {E} SELECT 'error: job exit code <*> at <*>' AS template_text, count(*) AS cnt, count(DISTINCT project) AS projects FROM v_events WHERE is_error AND {_WINDOW} AND project = 'p1' HAVING count(*) >= 3")
def patterns_templates(s, d):
    r = requests.PatternRequest("templates", project="p1", after="2024-01-05", before="2024-01-20")
    return requests.patterns(_tables(s, d), r).select("template_text", "cnt", "projects")


@query(f"""WITH {E}, p AS (SELECT source_path, ordinal, tool_name AS c FROM v_events WHERE {_WINDOW} AND source_path IN (SELECT source_path FROM v_events WHERE tool_name = 'purchase')),
l1 AS (SELECT source_path, c AS items, min(ordinal) AS at FROM p GROUP BY 1, 2),
l2 AS (SELECT source_path, items || ' ' || c AS items, min(p.ordinal) AS at FROM l1 JOIN p USING (source_path) WHERE p.ordinal > l1.at GROUP BY 1, 2)
SELECT items, count(*) AS support, format('{{:.1f}}%', count(*) * 100.0 / (SELECT count(DISTINCT source_path) FROM p)) AS share FROM l2 GROUP BY 1 HAVING count(*) >= 5 ORDER BY support DESC, items LIMIT 8 OFFSET 2""")
def patterns_sequences(s, d):
    r = requests.PatternRequest("sequences", tag="buyer", after="2024-01-05", before="2024-01-20", min_support=5, max_length=2, limit=8, offset=2)
    return requests.patterns(_tables(s, d), r, rules=[])


@query(f"WITH {E} SELECT source_path, ordinal, 0.7::DOUBLE AS confidence, 'denial' AS detectors, text FROM v_events WHERE is_error AND exit_code <> 1 ORDER BY source_path, ordinal LIMIT 30 OFFSET 5")
def patterns_corrections(s, d):
    r = requests.PatternRequest("corrections", pending=True, batch=30, offset=5)
    return requests.patterns(_tables(s, d), r).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"WITH {I}, {TG}, l AS (SELECT source_path, project, max(timestamp) AS last_at FROM v_items GROUP BY 1, 2) SELECT l.*, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM v_tags t WHERE t.source_path = l.source_path), '') AS tags FROM l ORDER BY last_at, source_path LIMIT 10 OFFSET 4")
def list_oldest(s, d):
    return requests.sessions(V.items(s, d), V.tags(s, d), requests.ListRequest(order="timestamp:asc", limit=10, offset=4))


@query(f"WITH {I}, {TG}, l AS (SELECT source_path, project, max(timestamp) AS last_at FROM v_items GROUP BY 1, 2) SELECT l.*, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM v_tags t WHERE t.source_path = l.source_path), '') AS tags FROM l ORDER BY last_at DESC, source_path LIMIT 20")
def list_latest(s, d):
    return requests.sessions(V.items(s, d), V.tags(s, d), requests.ListRequest())


_AROUND = "max_by(left(b.text, 50), b.ordinal) FILTER (b.role = 'assistant' AND b.ordinal < a.ordinal) AS window_before, min_by(left(b.text, 50), b.ordinal) FILTER (b.role = 'user' AND b.ordinal > a.ordinal) AS window_after"


@query(f"""WITH {_TALK}, o AS (SELECT *, row_number() OVER (PARTITION BY detector, source_path ORDER BY sha256(source_path || '|' || ordinal || '|' || detector), source_path, ordinal) AS a FROM sig),
q AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY sha256(source_path || '|' || ordinal || '|' || detector), source_path, ordinal) AS n FROM o WHERE a <= 1),
w2 AS (SELECT a.source_path, a.ordinal, a.detector, {_AROUND} FROM q a LEFT JOIN talk b ON b.source_path = a.source_path AND length(b.text) >= 20 WHERE a.n <= 10 GROUP BY 1, 2, 3)
SELECT source_path, ordinal, detector, window_before, window_after FROM w2""")
def calibration_windows(s, d):
    t = _talk(s, d)
    none = t.limit(0).select("source_path", "ordinal", F.lit("").alias("kind"), F.lit("").alias("label"))
    return census.calibration(mining.detect_corrections(t), t, none, V.tags(s, d), 10, 1).select("source_path", "ordinal", "detector", "window_before", "window_after")


# --- derivation and lineage ----------------------------------------------------------------------------------------


def _derived(s: SparkSession, d: str) -> dict[str, DataFrame]:
    i = V.items(s, d)
    ends = lambda x: F.endswith("source_path", F.lit(x))
    paths = i.select("source_path").distinct()
    return {
        "items": i, "files": paths.where(~ends("3")).select(F.col("source_path").alias("path"), F.when(ends("7"), "recovered").otherwise("x").alias("hash")),
        "template_matches": paths.where(~ends("13")).select("source_path", F.lit(0).alias("ordinal"), F.when(ends("1"), "old").otherwise("new").alias("signature")),
        "templates": s.createDataFrame([("old", "t", 1), ("new", "u", 2)], "signature string, template_text string, normalization_version int"),
        "correction_signals": paths.where(~ends("23")).select("source_path", F.lit(0).alias("ordinal"), F.when(ends("5"), 2).when(ends("6"), F.lit(None)).otherwise(3).cast("int").alias("extraction_version")),
        "tool_events": paths.where(~ends("7")).select("source_path", F.lit(0).alias("ordinal"), F.lit(0).alias("extraction_version")),
    }


@query(f"""WITH {I}, p AS (SELECT DISTINCT source_path AS path, source FROM v_items)
SELECT path, source FROM p WHERE right(path, 1) = '7' OR (right(path, 1) = '3' AND (right(path, 2) IN ('13', '23')))
UNION ALL SELECT path, 'session' FROM p WHERE right(path, 1) = '1' AND right(path, 2) <> '13'""")
def backfill_work(s, d):
    return store.backfill_paths(_derived(s, d))


@query(f"WITH {I} SELECT DISTINCT source_path AS path FROM v_items WHERE right(source_path, 1) = '1'")
def stale_templates(s, d):
    t = _derived(s, d)
    return store.stale_template_paths(t["template_matches"], t["templates"])


@query(f"WITH {I} SELECT DISTINCT source_path AS path FROM v_items WHERE right(source_path, 1) IN ('5', '6')")
def superseded_signals(s, d):
    return store.superseded_paths(_derived(s, d)["correction_signals"])


@query(f"WITH {I} SELECT min(id) AS id, u AS uuid FROM (SELECT id, split_part(uuid, '-', 1) AS u FROM v_items) GROUP BY u")
def first_by_uuid(s, d):
    return lineage.first_by_uuid(V.items(s, d).withColumn("uuid", F.split_part("uuid", F.lit("-"), F.lit(1)))).select("id", "uuid")


@query(f"WITH {I} SELECT u AS message_uuid, count(DISTINCT (role, text)) AS payloads FROM (SELECT split_part(uuid, '-', 1) AS u, role, text FROM v_items) GROUP BY 1 HAVING count(DISTINCT (role, text)) > 1")
def duplicate_audit(s, d):
    return lineage.duplicate_events(V.items(s, d).select(F.split_part("uuid", F.lit("-"), F.lit(1)).alias("message_uuid"), "role", "text"))


@query(f"WITH {I} SELECT path FROM (SELECT DISTINCT source_path AS path FROM v_items) WHERE right(path, 1) IN ('1', '2', '3', '7')")
def undecided_files(s, d):
    """New files, files of another size or time, files changed within two seconds of their indexing, recovered ones."""
    paths = V.items(s, d).select(F.col("source_path").alias("path")).distinct()
    ends = lambda x: F.endswith("path", F.lit(x))
    t = lambda x: F.to_timestamp(F.lit(x))
    listing = paths.select("path", F.lit(5).cast("bigint").alias("file_size"), F.when(ends("1"), t("2024-01-31 23:59:59")).otherwise(t("2024-01-01")).alias("file_mtime"))
    files = listing.where(~ends("3")).select("path", F.when(ends("7"), "recovered").otherwise("h").alias("hash"), t("2024-02-01").alias("last_indexed"), F.when(ends("2"), 6).otherwise(5).cast("bigint").alias("file_size"), "file_mtime")
    st = store.Store(s, folder(s))
    st.commit({"files": files})
    return st.undecided(listing).select("path")


@query(f"WITH {I}, {V.V_CHUNKS} SELECT c.chunk_idx, i.id FROM v_chunks c JOIN v_items i ON i.source_path = c.source_id")
def chunks_with_items(s, d):
    return embeddings.chunk_items(V.chunks(s, d), V.items(s, d)).select("chunk_idx", "id")


@query(f"SELECT conv_id, turn, len({_FIELDS.format('text')})::BIGINT AS words, (len({_FIELDS.format('text')}) * 4 + 2) // 3 <= 64 AS one FROM conversations")
def chunk_words(s, d):
    """Chunks without overlap hold all words; a text that fits is one chunk."""
    from ..functions import chunking

    c = s.read.parquet(f"{d}/conversations.parquet").withColumn("chunks", chunking.chunks(F.col("text"), 64))
    fits = F.forall("chunks", lambda x: T.token_count(x) <= 64) & ((F.size("chunks") == 1) == (T.token_count(F.col("text")) <= 64))
    return c.select("conv_id", "turn", F.size(T.fields(F.array_join("chunks", " "))).cast("long").alias("words"), F.when(fits, T.token_count(F.col("text")) <= 64).alias("one"))
