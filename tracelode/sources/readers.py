"""Readers: files of a format to canonical message rows, parsed on the executors.

A message row: source_path, ordinal, role, text, timestamp, uuid, content_type, cwd, tool_name, command_head, is_error,
exit_code, was_interrupted. Malformed lines are skipped.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T

#: said: the texts of prose, each cleaned by itself; raw: a tool's output; kind: prose, plain (not cleaned), reasoning, use (a
#: call that is an event), call (one that is not), result, custom, or none for records that only tell the working directory.
COLUMNS = "role string, said array<string>, raw string, ts string, uuid string, kind string, cwd string, tool_id string, tool_name string, arguments string, is_error boolean, was_interrupted boolean"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _blocks(content) -> list[dict]:
    if isinstance(content, str):
        return [{"type": "text", "text": content}]
    return [b if isinstance(b, dict) else {} for b in content] if isinstance(content, list) else []


def _flat(value) -> str:
    """Text of a tool result's content."""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and any(isinstance(v, dict) and "text" in v for v in value):
        return "\n".join(str(v["text"]) for v in value if isinstance(v, dict) and "text" in v)
    return "" if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _arguments(value) -> str:
    """Sorted k=v pairs of tool input; nested values as compact JSON."""
    if isinstance(value, dict):
        return json.dumps({k: v.strip() if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for k, v in sorted(value.items())}, ensure_ascii=False)
    return "{}"


def _row(r: dict, kind: str, role: str = "", uuid: str | None = None, **given) -> tuple:
    """A parsed row of a record."""
    row = dict.fromkeys(_NAMES) | {"role": role, "ts": r.get("timestamp"), "uuid": uuid, "kind": kind, "cwd": r.get("cwd") or None} | given
    return tuple(row[n] for n in _NAMES)


def _said(r: dict, role: str, uuid: str | None, texts: list[str]) -> Iterator[tuple]:
    if any(texts):
        yield _row(r, "prose", role, uuid, said=texts, was_interrupted=any("Request interrupted" in t for t in texts))


def claude_record(r: dict, index_reasoning: bool = False) -> Iterator[tuple]:
    """Rows of one record of the block format: its text, then one a tool block."""
    message = r.get("message") if isinstance(r.get("message"), dict) else {}
    role, uuid, blocks = message.get("role"), r.get("uuid") or None, _blocks(message.get("content"))
    if r.get("isMeta") or r.get("type") in T.NOISE_TYPES or not role:
        yield _row(r, "none")
        return
    yield from _said(r, role, uuid, [str(b.get("text") or "") for b in blocks if b.get("type") == "text"])
    for i, b in enumerate(blocks):
        if b.get("type") == "tool_use":
            yield _row(r, "use", role, f"{uuid}#t{i}" if uuid else None, tool_id=b.get("id"), tool_name=b.get("name") or "", arguments=_arguments(b.get("input")))
        elif b.get("type") == "tool_result":
            yield _row(r, "result", role, f"{uuid}#r{i}" if uuid else None, tool_id=b.get("tool_use_id"), raw=_flat(b.get("content")), is_error=b.get("is_error"))


def pi_record(r: dict, index_reasoning: bool = False) -> Iterator[tuple]:
    """Rows of one record of the message tree format, whose messages have no identity and whose calls are no events."""
    message = r.get("message") if isinstance(r.get("message"), dict) else {}
    role, blocks = message.get("role"), _blocks(message.get("content"))
    if r.get("type") == "custom":
        yield _row(r, "custom", "tool", tool_name=r.get("customType") or None, raw=_flat(r.get("data")))
    elif r.get("type") != "message" or role not in ("user", "assistant"):
        yield _row(r, "none")
    else:
        yield from _said(r, role, None, [str(b.get("text") or "") for b in blocks if b.get("type") == "text"])
        for b in blocks:
            if b.get("type") == "toolCall":
                yield _row(r, "call", role, tool_name=b.get("name") or "", arguments=_arguments(b.get("arguments")))
            elif b.get("type") == "thinking" and index_reasoning:
                yield _row(r, "reasoning", "reasoning", said=[str(b.get("text") or "")])


def legacy_record(r: dict, index_reasoning: bool = False) -> Iterator[tuple]:
    """The old session format: texts only; tool blocks give no rows, but text beside a call is of type tool."""
    message = r.get("message") if isinstance(r.get("message"), dict) else None
    if message is None or r.get("isMeta") or r.get("type") in T.NOISE_TYPES:
        return
    blocks = _blocks(message.get("content"))
    texts = [str(b.get("text") or "") for b in blocks if b.get("type") == "text"]
    called = any(b.get("type") in ("tool_use", "toolCall", "tool_use_id") for b in blocks)
    if any(texts):
        yield _row(r, "called" if called else "prose", message.get("role") or "", None, said=texts)


def json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, block, line, json) of every line that is not blank. Files are split at lines like any text, however long
    they are; block and line, ascending, give the order in a file and are no line numbers."""
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("json"))
    return read.where(F.trim("json") != "")


def _jsonl(parse: Callable) -> Callable:
    def read(spark: SparkSession, paths: list[str], index_reasoning: bool = False) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for path, block, line, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    try:
                        record = json.loads(text)
                    except ValueError:
                        continue
                    if isinstance(record, dict):
                        out += [(path, block, line, i, *m) for i, m in enumerate(parse(record, index_reasoning))]
                columns = list(zip(*out, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        layout = f"source_path string, block bigint, line bigint, part int, {COLUMNS}"
        schema = to_arrow_schema(StructType.fromDDL(layout))
        return messages(json_lines(spark, paths).mapInArrow(run, layout))

    return read


def messages(rows: DataFrame) -> DataFrame:
    """Canonical rows from parsed ones: texts cleaned, empty ones dropped. A tool's outcome is told on the message that called it
    (the last one with the id): whether it failed, and for Bash its exit code. Results keep no tool name."""
    order = Window.partitionBy("source_path").orderBy("block", "line", "part")
    given = F.from_json("arguments", "map<string,string>")
    said = F.array_join(F.filter(F.transform("said", T.clean_content), lambda t: t != ""), " ")
    output = F.left(F.trim("raw"), F.lit(4000))
    text = (
        F.when(F.col("kind").isin("use", "call"), T.serialize_tool(F.col("tool_name"), given))
        .when(F.col("kind") == "result", F.concat(F.when(F.col("is_error"), "error: ").otherwise(""), output))
        .when((F.col("kind") == "custom") & (output != ""), F.concat_ws(" ", "tool_name", output))
        .when(F.col("kind") == "plain", F.array_join(F.filter(F.transform("said", lambda x: F.trim(x)), lambda t: t != ""), "\n"))
        .otherwise(said)
    )
    first_cwd = F.first("cwd", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = rows.withColumn("cwd", first_cwd).withColumn("text", text).where("kind <> 'none' and trim(text) <> ''")
    at = F.struct("block", "line", "part")
    called = kept.where("kind = 'use' and tool_id <> '' and tool_name <> ''").groupBy("source_path", "tool_id").agg(F.max(at).alias("use_at"))
    code = T.exit_code(F.col("raw"))
    ends = kept.where("kind = 'result' and tool_id <> ''").groupBy("source_path", "tool_id").agg(
        F.max_by("is_error", F.when(F.col("is_error").isNotNull(), at)).alias("failed"), F.max_by(code, F.when(code.isNotNull(), at)).alias("code")
    )
    outcome = called.join(ends, ["source_path", "tool_id"]).select("source_path", F.col("use_at.block").alias("block"), F.col("use_at.line").alias("line"), F.col("use_at.part").alias("part"), "failed", "code")
    told = kept.join(outcome, ["source_path", "block", "line", "part"], "left")
    is_use = (F.col("kind") == "use") & (F.col("tool_name") != "")
    prose = F.when((F.col("kind") == "called") & ~F.contains(F.col("text"), F.lit("```")), "tool").otherwise(T.classify_content(F.col("text")))
    return told.select(
        "source_path", (F.row_number().over(order) - 1).alias("ordinal"), "role", "text", T.parse_time(F.col("ts")).alias("timestamp"), "uuid",
        F.when(F.col("kind").isin("use", "call", "result", "custom"), "tool").when(F.col("kind") == "reasoning", "reasoning").when(F.col("kind") == "plain", "text").otherwise(prose).alias("content_type"), "cwd",
        F.when(is_use, F.col("tool_name")).alias("tool_name"), F.when(is_use, T.command_head(F.coalesce(given["command"], F.lit("")))).alias("command_head"),
        F.coalesce("is_error", "failed").alias("is_error"), F.when(F.col("kind") == "result", code).when(F.col("tool_name") == "Bash", F.col("code")).alias("exit_code"), F.coalesce("was_interrupted", F.lit(False)).alias("was_interrupted"),
    )


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs split at `## ` headings (columns section, title, body); a preamble goes if there is a heading, a text without
    one is one section with a null title."""
    ids = [c for c in docs.columns if c != text]
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), "\r\n", "\n")
    parts = F.split(marked, "\n(?=## )")
    kept = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    exploded = docs.select(*ids, F.posexplode(kept).alias("section", "body"))
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    title = F.nullif(F.regexp_extract("body", r"^## ([^\n]*)", 1), F.lit(""))
    return exploded.select(*ids, "section", F.trim(title).alias("title"), body.alias("body"))


def front_matter_id(text, kind: str):
    """First id: or name: between --- fences, else `<kind>-default`."""
    fence = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    found = F.trim(F.regexp_extract(fence, r"(?m)^(?:id|name):\s*(.+?)\s*$", 1))
    return F.when(found != "", F.btrim(found, F.lit("\"'"))).otherwise(f"{kind}-default")


def markdown(spark: SparkSession, paths: list[str], kind: str = "ke", by_section: bool = False) -> DataFrame:
    """One row a file, or one a section: (source_path, ordinal, id, source, role, text, timestamp)."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("timestamp"), F.col("value").alias("text"))
    named = files.withColumn("id", front_matter_id(F.col("text"), kind))
    if by_section:
        body = sections(named).withColumn("id", F.concat_ws("-", "id", (F.col("section") + 1).cast("string"))).withColumnRenamed("section", "ordinal").withColumnRenamed("body", "text")
    else:
        body = named.withColumn("ordinal", F.lit(0)).withColumn("text", F.trim("text"))
    return body.select("source_path", "ordinal", "id", F.lit(kind).alias("source"), F.lit("document").alias("role"), "text", "timestamp")


#: Kinds of documents and whether each is one item a section; others are whole.
SECTIONED = {"ke": False, "memory": False, "decision": True, "rule": True, "spec": True, "backlog": True}


def documents(spark: SparkSession, sources: dict[str, list[str]]) -> DataFrame:
    """Items of documents of several kinds ({kind: paths})."""
    unknown = set(sources) - set(SECTIONED)
    if unknown:
        raise ValueError(f"unknown kinds of documents: {sorted(unknown)}")
    parts = [markdown(spark, paths, kind, SECTIONED[kind]) for kind, paths in sources.items() if paths]
    if not parts:
        return spark.createDataFrame([], "source_path string, ordinal int, id string, source string, role string, text string, timestamp timestamp")
    return reduce(DataFrame.unionByName, parts)


def plans(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, section, title, body) of plan files; a file without headings is one section named Untitled."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return sections(files).withColumn("title", F.coalesce("title", F.when(F.col("body").startswith("## "), "").otherwise("Untitled")))


class _Database(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])

    def partitions(self) -> list[InputPartition]:
        return [_Database(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        query = "SELECT m.id, m.session_id, m.data, m.time_created, m.time_updated, p.id, p.data FROM message m JOIN part p ON p.message_id = m.id ORDER BY m.time_created, p.id"
        for row in db.execute(query):
            yield (partition.path, *row)
        db.close()


class SqliteSessions(DataSource):
    """Spark source over session databases of message and part tables, a partition each; option paths: their list as JSON."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_sessions"

    def schema(self) -> str:
        return "database string, message_id string, session_id string, message string, time_created bigint, time_updated bigint, part_id string, part string"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


def opencode(spark: SparkSession, paths: list[str], index_reasoning: bool = False) -> DataFrame:
    """Text parts of a message joined by newlines; a tool part gives its input and its output."""
    spark.dataSource.register(SqliteSessions)
    raw = spark.read.format("sqlite_sessions").option("paths", json.dumps(list(paths))).load()
    j = F.get_json_object
    rows = raw.select(
        F.col("database").alias("source_path"), "message_id", "time_created", "part_id", F.coalesce(j("message", "$.role"), F.lit("")).alias("role"), j("part", "$.type").alias("type"),
        j("part", "$.text").alias("text"), F.coalesce(j("part", "$.ignored"), F.lit("false")).alias("ignored"), j("part", "$.tool").alias("tool"), j("part", "$.state.input").alias("given"), j("part", "$.state.output").alias("got"),
    )
    spoken = rows.where("type = 'text' and ignored <> 'true'").groupBy("source_path", "message_id", "role", "time_created").agg(F.array_sort(F.collect_list(F.struct("part_id", "text"))).alias("parts"))
    plain = spoken.select("source_path", "time_created", "message_id", F.lit("").alias("part_id"), F.lit(0).alias("part"), "role", F.transform("parts", lambda s: s["text"]).alias("said"), F.lit("plain").alias("kind"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("part"), F.lit("call").alias("kind")), F.struct(F.lit(2).alias("part"), F.lit("result").alias("kind"))))
    tools = rows.where("type = 'tool'").select("*", both.alias("x")).select(
        "source_path", "time_created", "message_id", "part_id", "x.part", "role", "x.kind", F.when(F.col("x.kind") == "result", F.col("got")).alias("raw"),
        F.when(F.col("x.kind") == "call", F.col("tool")).alias("tool_name"), F.when(F.col("x.kind") == "call", F.coalesce("given", F.lit("{}"))).alias("arguments"),
    )
    every = plain.unionByName(tools, allowMissingColumns=True)
    order = Window.partitionBy("source_path").orderBy("time_created", "message_id", "part_id", "part")
    full = every.select("source_path", F.lit(0).cast("bigint").alias("block"), F.row_number().over(order).cast("bigint").alias("line"), "part", F.date_format(F.timestamp_millis("time_created"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"), *[c for c in _NAMES if c in every.columns])
    missing = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in COLUMNS.split(", ")) if n not in full.columns]
    return messages(full.select("*", *missing))


def watermark(path: str) -> str:
    """Hash of a session database's latest update; "empty" without one."""
    import hashlib

    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    (latest,) = db.execute("SELECT max(time_updated) FROM message").fetchone()
    db.close()
    return "empty" if latest is None else hashlib.sha256(str(latest).encode()).hexdigest()


def _markdown_messages(by_section: bool) -> Callable:
    def read(spark: SparkSession, paths: list[str], index_reasoning: bool = False) -> DataFrame:
        rows = markdown(spark, paths, by_section=by_section)
        nothing = {c: F.lit(None).cast(t) for c, t in (("cwd", "string"), ("tool_name", "string"), ("command_head", "string"), ("is_error", "boolean"), ("exit_code", "int"), ("was_interrupted", "boolean"))}
        return rows.select("source_path", "ordinal", "role", "text", "timestamp", F.col("id").alias("uuid"), F.lit("text").alias("content_type"), *[v.alias(k) for k, v in nothing.items()])

    return read


READERS: dict[str, Callable] = {
    "claude": _jsonl(claude_record), "pi": _jsonl(pi_record), "legacy": _jsonl(legacy_record), "opencode": opencode, "markdown_document": _markdown_messages(False), "markdown_sections": _markdown_messages(True),
}


def reader_for(name: str | None) -> Callable:
    return READERS[name or "claude"]


def register(name: str, read: Callable) -> None:
    """Add a reader (spark, paths, index_reasoning) -> message rows; a name is taken once."""
    if name in READERS:
        raise ValueError(f"reader {name!r} exists")
    READERS[name] = read
