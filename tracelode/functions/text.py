"""Scalar text functions: Column to Column, no Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags removed with their contents, in this order.
NOISE_TAGS = ["system-reminder", "task-notification", "caveat", "local-command-caveat", "command", "local-command-stdout", "command-name", "command-message", "command-args", "teammate-message"]
#: Record types that carry no conversation.
NOISE_TYPES = ["system-reminder", "task-notification", "command", "command-result", "local-command-caveat", "progress"]
#: Topic tags and the patterns that set them.
TAG_PATTERNS = {
    "debugging": "(?i)(error|bug|fix|debug|panic|crash|traceback|exception)",
    "refactoring": "(?i)(refactor|restructur|reorganiz|cleanup|clean up|rewrite)",
    "feature": "(?i)(implement|add feature|new feature|create|build|develop)",
    "testing": "(?i)(test|spec|assert|mock|coverage|jest|pytest)",
    "docs": "(?i)(document|readme|comment|explain|description)",
    "config": "(?i)(config|setup|configure|install|deploy|ci|yaml|toml)",
}
#: Words that say nothing about a topic.
COMMON_WORDS = (
    "this that with from have will been were they them their what when where which more also some than into your there here would could should about then"
).split()
#: Characters stripped from words, the pattern of exit codes, and those of lines that tell an error.
PUNCTUATION = ".,!?;:\"'()[]{}*/\\-_"
EXIT_CODE = r"(?i)(?:exit(?:\s+code)?|returned|exited)\s*[:=]?\s*(\d+)"
ERROR_LINE = "(?i)(error|fail|panic|denied|fatal)"
GO_ERROR_LINE = r"(---\s+FAIL:|:\s*error:|FAIL\s+|panic\()"


def clean_content(text: Column) -> Column:
    """Noise tags go with their contents, an unmatched opening tag alone; the interruption marker goes; space is folded."""
    for tag in NOISE_TAGS:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
        text = F.regexp_replace(text, f"(?s)^(.*?)<{tag}>", "$1")
    text = F.regexp_replace(text, "^Caveat: ", "")
    text = F.replace(text, F.lit("Request interrupted"), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def classify_content(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("```")), "code").otherwise("text")


def fields(text: Column) -> Column:
    """White-space separated tokens."""
    return F.array_remove(F.split(text, r"\s+"), "")


def exit_code(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, EXIT_CODE, 1), F.lit("")), F.lit("999999999")).cast("int")


def command_head(command: Column) -> Column:
    """First token that is no variable assignment; null if there is none."""
    return F.get(F.filter(fields(command), lambda t: ~F.contains(t, F.lit("="))), F.lit(0))


def serialize_tool(name: Column, arguments: Column, limit: int = 4000) -> Column:
    """`name k=v ...` from a map of arguments, keys sorted, values trimmed, cut to limit characters."""
    pairs = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(e["key"], F.lit("="), F.trim(e["value"])))
    return F.left(F.concat_ws(" ", name, pairs), F.lit(limit))


def serialize_value(value: Column) -> Column:
    """A JSON value as text: strings trimmed, arrays of objects with `text` joined by newlines, objects as sorted k=v, other
    values as they stand."""
    texts = F.from_json(value, "array<struct<text:string>>")
    as_map = F.from_json(value, "map<string,string>")
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(as_map)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return (
        F.when(F.startswith(value, F.lit("[")) & F.exists(texts, lambda t: t["text"].isNotNull()), F.array_join(F.transform(texts, lambda t: t["text"]), "\n"))
        .when(F.startswith(value, F.lit("{")), pairs)
        .when(F.startswith(value, F.lit('"')), F.trim(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")))
        .otherwise(F.trim(value))
    )


def parse_serialized_tool(text: Column) -> tuple[Column, Column]:
    """(tool name, command head) read back from serialised input; nulls if it is none."""
    tokens = fields(text)
    name = F.get(tokens, F.lit(0))
    ok = is_tool_name(name) & ((F.size(tokens) == 1) | F.contains(F.get(tokens, F.lit(1)), F.lit("=")))
    command = F.regexp_extract(text, r"(?s)\bcommand=(.*)$", 1)
    return F.when(ok, name), F.when(ok & (command != ""), command_head(command))


def is_tool_name(token: Column) -> Column:
    """Title case, or lower case with an underscore; letters, digits, `_` and `-`; a lower-case letter at least."""
    return token.rlike(r"^[A-Za-z0-9_-]+$") & token.rlike("[a-z]") & (token.rlike("^[A-Z]") | (token.rlike("^[a-z]") & F.contains(token, F.lit("_"))))


def is_input_serialization(text: Column) -> Column:
    return F.coalesce(parse_serialized_tool(text)[0].isNotNull(), F.lit(False))


def should_mine(content_type: Column, is_error: Column, text: Column) -> Column:
    return (content_type == "tool") & F.coalesce(is_error, F.lit(False)) & ~is_input_serialization(text)


def error_lines(text: Column) -> Column:
    """Lines that look like errors, then the last non-empty line if it is not among them."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.filter(lines, lambda x: x.rlike(ERROR_LINE))
    last = F.slice(lines, -1, 1)
    return F.when(F.size(lines) == 0, F.array().cast("array<string>")).when(F.arrays_overlap(found, last), found).otherwise(F.concat(found, last))


def go_error_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(GO_ERROR_LINE))


def lines_that_tell(tool: Column, text: Column) -> Column:
    """The lines of a tool's output that are mined: by Go's marks for go, else by the general ones."""
    return F.when(tool == "Go", go_error_lines(text)).otherwise(error_lines(text))


#: A token that varies between occurrences of one message: a number, quoted, a path, with a colon, or a long identifier.
VARIABLE = r"""^(?:-?\+?(?:0[xX][0-9a-fA-F].*|[0-9.]*[0-9][0-9.]*|\.\.+)|".*"|"|'.*'|'|.*[/\\:].*|[.~].*|(?=.{20,}$)(?:[0-9a-fA-F]+|.*-.*))$"""


def normalize_template(line: Column) -> Column:
    """The first two tokens stay; later ones that vary become <*>."""
    return F.array_join(F.transform(fields(line), lambda t, i: F.when((i >= 2) & t.rlike(VARIABLE), "<*>").otherwise(t)), " ")


def template_signature(template: Column) -> Column:
    return F.sha2(template, 256)


def strip_punctuation(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def tags_of(text: Column) -> Column:
    """Sorted tags whose patterns occur."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in sorted(TAG_PATTERNS.items())]), lambda t: t.isNotNull())


def escape_robot(text: Column) -> Column:
    """One line: backslash, carriage return and newline escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def week_label(ts: Column) -> Column:
    """Year and Monday-based week, 00 before the first Monday."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def parse_time(text: Column) -> Column:
    """RFC 3339 or a date; null if it is neither."""
    return F.try_to_timestamp(text)


def token_count(text: Column) -> Column:
    return F.floor((F.size(fields(text)) * 4 + 2) / 3).cast("long")


def glob_to_like(pattern: str) -> str:
    return pattern.replace("*", "%")


def source_filter(name: str | None) -> str | None:
    """Normalised source name; None means all."""
    name = (name or "").strip().lower()
    return {"sessions": "session", "plans": "plan", "all": None, "": None}.get(name, name)


def project_id(name: Column) -> Column:
    """Fallback project id: lower case, only letters, digits, - and _."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "")
