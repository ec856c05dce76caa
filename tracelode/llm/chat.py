"""Chat formatting by schema fingerprints.

A record is JSON in one of many layouts. The sorted set of its nested field paths, as far as any layout knows them, is hashed;
the hash selects a declarative mapping (a list of rules that say where roles and texts are found), which yields canonical
(role, text) turns. Fields that no layout knows, as ids and sources, do not matter. Turns are then written in one template whose control strings are escaped, reversibly, inside texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Strings that this or other common templates read as control strings.
CONTROL = ["\\", "<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE_END = re.compile(r"(?:[^\\\n]|\\.)*", re.S)


def escape(text: str) -> str:
    """A backslash goes after the first character of each control string (before it, if it is a backslash)."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape(role).replace('\n', '\\\n')}\n{escape(text)}{STOP}"


def read_turns(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """(role, text, span of the escaped text) of each turn in formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        role = _ROLE_END.match(formatted, at + len(START))
        begin = role.end() + 1
        end = formatted.index(STOP, begin)  # cannot occur inside escaped text
        turns.append((unescape(role[0]), unescape(formatted[begin:end]), (begin, end)))
        at = end + len(STOP)
    return turns


# --- layouts -------------------------------------------------------------------------------------------------------


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths; list items share the path with [] and a scalar ends one."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) or {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Rule:
    """One source of turns: for each item of `each` (or the record itself) a role, constant or from a field, and the
    text fields that are joined by a blank line, empty ones left out. A text may be a list of parts, whose texts are
    joined by newlines. `renamed`: the layout has names of its own for the roles."""

    texts: tuple[str, ...]
    role: str = ""
    role_field: str = ""
    each: str = ""
    renamed: bool = False


#: Names that layouts with names of their own have for the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_PARTS = ["messages[].content[].type", "messages[].content[].text"]
_TOLD = Rule(("content",), role_field="role", each="messages")
_SHARED = Rule(("value",), role_field="from", each="conversations", renamed=True)
#: Layouts: field paths and rules. A list that is empty has a path of its own.
LAYOUTS: list[tuple[list[str], tuple[Rule, ...]]] = [
    (["role", "text"], (Rule(("text",), role_field="role"),)),
    (["role", "content"], (Rule(("content",), role_field="role"),)),
    (["messages[].role", "messages[].content"], (_TOLD,)),
    (["messages[].role", *_PARTS], (_TOLD,)),
    (["messages[].role", "messages[].content", *_PARTS], (_TOLD,)),
    (["messages[]"], ()),
    (["system", "messages[].role", "messages[].content"], (Rule(("system",), "system"), _TOLD)),
    (["conversations[].from", "conversations[].value"], (_SHARED,)),
    (["conversations[]"], ()),
    (["system", "conversations[].from", "conversations[].value"], (Rule(("system",), "system"), _SHARED)),
    (["prompt", "completion"], (Rule(("prompt",), "user"), Rule(("completion",), "assistant"))),
    (["prompt", "response"], (Rule(("prompt",), "user"), Rule(("response",), "assistant"))),
    (["system", "prompt", "response"], (Rule(("system",), "system"), Rule(("prompt",), "user"), Rule(("response",), "assistant"))),
    (["question", "answer"], (Rule(("question",), "user"), Rule(("answer",), "assistant"))),
    (["instruction", "output"], (Rule(("instruction",), "user"), Rule(("output",), "assistant"))),
    (["instruction", "input", "output"], (Rule(("instruction", "input"), "user"), Rule(("output",), "assistant"))),
]
MAPPINGS: dict[str, tuple[Rule, ...]] = {fingerprint(paths): rules for paths, rules in LAYOUTS}
KNOWN = frozenset(p for paths, _ in LAYOUTS for p in paths)


@lru_cache(4096)
def _fingerprint_of(paths: frozenset[str]) -> str:
    return fingerprint(paths & KNOWN)


def _text(value) -> str:
    if isinstance(value, list):
        return "\n".join(_text(v.get("text") if isinstance(v, dict) else v) for v in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(value: dict, mappings: dict[str, tuple[Rule, ...]] = MAPPINGS) -> tuple[str, list[tuple[str, str]] | None]:
    """A record's fingerprint and its turns; turns are None for an unknown layout."""
    key = _fingerprint_of(frozenset(field_paths(value)))
    if key not in mappings:
        return key, None
    turns = []
    for rule in mappings[key]:
        for item in value[rule.each] if rule.each else [value]:
            texts = [_text(item.get(f)) for f in rule.texts]
            text = "\n\n".join(t for t in texts if t) if len(texts) > 1 else texts[0]
            role = rule.role or str(item.get(rule.role_field) or "")
            if rule.role_field or text:
                turns.append((ROLES.get(role, role) if rule.renamed else role, text))
    return key, turns


def canonical_turns(record: str | None, mappings: dict[str, tuple[Rule, ...]] = MAPPINGS) -> tuple[str, list[tuple[str, str]] | None]:
    """The same of a JSON record. Turns are None for a null, unparsable or unknown one."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        return "", None
    return record_turns(value, mappings) if isinstance(value, dict) else ("", None)


def format_records(df: DataFrame, record: str = "record", key: str = "id") -> DataFrame:
    """JSON records of any known layout to formatted chats: (key, fingerprint, n_turns, formatted, loss_spans).

    loss_spans are the [start, end) code points of assistant texts in `formatted`. A null or malformed record and an
    unknown layout keep their row with null n_turns, formatted and loss_spans (the fingerprint tells which layouts lack
    a mapping). Repeated keys are separate rows; an empty table gives an empty one.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for r in b.column(1).to_pylist():
                print_, turns = canonical_turns(r)
                text = None if turns is None else "".join(format_turn(*t) for t in turns)
                spans = None if turns is None else [list(s) for role, _, s in read_turns(text) if role == "assistant"]
                for column, v in zip(out, (print_, None if turns is None else len(turns), text, spans), strict=True):
                    column.append(v)
            types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, types)], names=["key", "fingerprint", "n_turns", "formatted", "loss_spans"])

    schema = f"key {kind}, fingerprint string, n_turns bigint, formatted string, loss_spans array<array<bigint>>"
    return df.select(F.col(key).alias("key"), F.col(record).alias("record")).mapInArrow(run, schema).withColumnRenamed("key", key)


def format_turn_rows(df: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) with `formatted`, the turn in the template; null role or text: empty.

    Each row is a record of its own, whose fingerprint selects its mapping as that of any other record; a conversation's
    formatted text is its rows' in the order of turns, so that no task ever needs a whole conversation to format it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = [record_turns(item)[1] for item in b.select(["role", "text"]).to_pylist()]
            out = ["".join(format_turn(*t) for t in found) for found in turns]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["conv_id", "turn", "formatted"])

    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, formatted string")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back and digest each conversation; see queries.op8 for the columns.

    Rows are dealt by conversation and sorted, then streamed: digests are updated turn by turn, so a conversation of any
    length needs constant memory. Turns that share a number are ordered by their formatted text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, begun = None, False

        def closed(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            done = []
            for conv, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or state[0] != conv:
                    if begun:
                        done.append(closed(state))
                    state, begun = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, said, _ in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                    if role == "assistant":
                        state[3] += len(said)
                        state[4].update(said.encode())
                state[5] += len(text)
            if done:
                yield table(done)
        if begun:
            yield table([closed(state)])

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, schema)
