"""Templates, corrections, frequent sequences, categories and tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Phrases of correction, Spanish then English.
LEXICON = [
    "no, te pedí", "te pedí", "eso no", "otra vez", "te dije", "es mentira", "no era eso", "de nuevo", "eso no es",
    "not what i asked", "what i asked", "i said", "you ignored", "wrong file", "this is wrong", "that's wrong", "that is wrong",
]
#: Words left out of the rephrase comparison.
REPHRASE_STOPWORDS = "a an and are as at be but by for if in into is it no not of on or that the to was with el la de que y es en un una o".split()
#: Fixed value: the sender marks of pasted chats, either `[12:34 ...] name:` or `name: [12:34`; three make a text a chat export.
CHAT_EXPORT = r"\[\d{1,2}:\d{2}[^\]]*\]\s+[^:\]\n]{1,40}:|[^:\]\n]{1,40}:\s+\[\d{1,2}:\d{2}"
MIN_INTERRUPT, MIN_JACCARD = 20, 0.6


def mine_templates(rows: DataFrame, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """(templates, matches) of error output rows (source_path, ordinal, item_uuid, text, and tool_name if it is known); one match for
    each template and place."""
    lines_of = T.lines_that_tell(F.col("tool_name"), F.col("text")) if "tool_name" in rows.columns else T.error_lines(F.col("text"))
    lines = rows.select("source_path", "ordinal", "item_uuid", F.explode(lines_of).alias("line"))
    found = lines.withColumn("template_text", T.normalize_template(F.col("line"))).withColumn("signature", T.template_signature(F.col("template_text"))).where("template_text <> ''")
    matches = found.groupBy("source_path", "ordinal", "signature").agg(F.min("item_uuid").alias("item_uuid"))
    mined = found.select("signature", "template_text").distinct().withColumn("normalization_version", F.lit(version))
    return mined, matches


def failed_rows(items: DataFrame, failed: Column) -> DataFrame:
    """The tool rows of items whose output is mined: failed ones that are no serialised input."""
    return items.where(T.should_mine(F.col("content_type"), failed, F.col("text"))).select("source_path", "ordinal", F.col("uuid").alias("item_uuid"), "text")


def stored_failures(items: DataFrame, events: DataFrame) -> DataFrame:
    """The same from stored items, which tell a failure by the prefix of their text or by an event at their place."""
    at = events.where("is_error").select("source_path", "ordinal").distinct().withColumn("event_failed", F.lit(True))
    return failed_rows(items.join(at, ["source_path", "ordinal"], "left"), F.lower(F.trim("text")).startswith("error: ") | F.coalesce("event_failed", F.lit(False)))


def rephrase_tokens(text: Column) -> Column:
    words = F.transform(T.fields(F.lower(text)), T.strip_punctuation)
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(REPHRASE_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


#: Detectors by name: a function of the columns that `correction_context` adds to a condition and a confidence.
DETECTORS: dict[str, Callable[[], tuple[Column, float]]] = {}


def register_detector(name: str, build: Callable[[], tuple[Column, float]]) -> None:
    """Add a detector, or replace one: build() gives (condition, confidence) over text, role, was_interrupted, tokens,
    before_role, before_text and before_user."""
    DETECTORS[name] = build


def _lexicon() -> tuple[Column, float]:
    said = F.lit(False)
    for phrase in LEXICON:
        said = said | F.contains(F.lower("text"), F.lit(phrase))
    return said & (F.regexp_count(F.col("text"), F.lit(CHAT_EXPORT)) < 3), 0.8


def _interrupt() -> tuple[Column, float]:
    return F.coalesce("was_interrupted", F.lit(False)) & (F.char_length("text") >= MIN_INTERRUPT), 0.5


def _denial() -> tuple[Column, float]:
    denied = F.contains(F.lower("before_text"), F.lit("denied")) | F.contains(F.lower("before_text"), F.lit("rechaza"))
    return F.col("before_role").isin("assistant", "tool") & denied, 0.4


def _rephrase() -> tuple[Column, float]:
    return jaccard(F.col("tokens"), F.col("before_user")) >= MIN_JACCARD, 0.6


for _name, _build in (("lexicon", _lexicon), ("interrupt", _interrupt), ("denial", _denial), ("rephrase", _rephrase)):
    register_detector(_name, _build)


def correction_context(items: DataFrame) -> DataFrame:
    """items with what detectors look at; windows run over one path in order of ordinals."""
    if "was_interrupted" not in items.columns:
        items = items.withColumn("was_interrupted", F.lit(False))
    order = Window.partitionBy("source_path").orderBy("ordinal")
    said = F.when(F.col("role") == "user", F.col("tokens"))
    return items.withColumn("tokens", rephrase_tokens(F.col("text"))).withColumns(
        {
            "before_role": F.lag("role").over(order), "before_text": F.lag("text").over(order),
            "before_user": F.last(said, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )


def detect_corrections(items: DataFrame, prose_only: bool = True) -> DataFrame:
    """(source_path, ordinal, detector, confidence) of user messages by all registered detectors; prose_only leaves out tool output,
    which users' records carry as well."""
    found = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("detector"), F.lit(c).alias("confidence"))) for n, (ok, c) in ((n, b()) for n, b in sorted(DETECTORS.items()))])
    users = correction_context(items).where(F.col("role") == "user")
    users = users.where(F.col("content_type").isin("text", "code")) if prose_only else users
    return users.select("source_path", "ordinal", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s")).select("source_path", "ordinal", "s.detector", "s.confidence")


def sequences(events: DataFrame, category: Column) -> DataFrame:
    """(source_path, seq): ordered categories of each path."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", category.alias("category"))))
    return events.groupBy("source_path").agg(F.transform(pairs, lambda p: p["category"]).alias("seq"))


def prefix_span(seqs: DataFrame, min_support: int, min_length: int = 2, max_length: int = 6) -> DataFrame:
    """(items, support) of subsequences with gaps; support counts sequences. Order: support desc, then items joined by spaces."""
    from pyspark.ml.fpm import PrefixSpan

    total = seqs.count()
    if total < max(1, min_support):  # nothing can have that support, and Spark refuses a share over 1
        return seqs.sparkSession.createDataFrame([], "items string, support bigint")
    boxed = seqs.select(F.transform("seq", lambda x: F.array(x)).alias("sequence"))
    span = PrefixSpan(minSupport=max(0.0, (min_support - 0.5) / total), maxPatternLength=max_length, sequenceCol="sequence")
    found = span.findFrequentSequentialPatterns(boxed).where(F.size("sequence") >= min_length)
    return found.select(F.array_join(F.flatten("sequence"), " ").alias("items"), F.col("freq").alias("support")).orderBy(F.desc("support"), "items")


def share(support: Column, total: Column) -> Column:
    return F.format_string("%.1f%%", support * 100.0 / total)


def with_share(patterns: DataFrame, seqs: DataFrame) -> DataFrame:
    """Patterns with the share of all sequences that hold them."""
    total = seqs.agg(F.count("*").alias("total"))
    return patterns.crossJoin(F.broadcast(total)).withColumn("share", share(F.col("support"), F.col("total"))).drop("total").orderBy(F.desc("support"), "items")  # one row


#: Ordered category rules (tool, pattern, category); the first match wins and an unmatched tool is its own category.
CATEGORY_RULES = [
    ("Bash", "^Bash (cd)", "NAV"),
    ("Bash", "^Bash (rg|grep|fd|find)", "SEARCH"),
    ("Bash", "^Bash (eza|ls|bat|cat|wc|head|tail)", "FILE_INSPECT"),
    ("Bash", "^Bash (sd|sed|awk|jq)", "TEXT_TRANSFORM"),
    ("Bash", "^Bash sqlite3", "DB"),
    ("Bash", "^Bash gentle-ai", "REVIEW_TOOL"),
    ("Bash", "^Bash just", "TASK_RUNNER"),
    ("Bash", "^Bash (echo|printf|export|set)", "SHELL_STATE"),
    ("Bash", "^Bash (mktemp|mkdir|mv|cp|rm)", "FS_OP"),
    (None, "^(go|Bash) (test|vet|build|mod|get|fmt|generate|install|run)", "GO_EXEC"),
    ("Bash", "^Bash (git|gh)", "GIT"),
    (None, "^(Bash|Shell) (pytest|npm test|cargo test|./test|make test)", "TEST_EXEC"),
    (None, "^(Bash|npm|pip|cargo|Homebrew) (install|add|remove|update|publish)", "PKG"),
    ("Read", None, "FILE_READ"),
    ("Glob", None, "FILE_READ"),
    ("Grep", None, "FILE_READ"),
    ("Edit", None, "FILE_WRITE"),
    ("Write", None, "FILE_WRITE"),
    (None, "^Bash", "SHELL_OTHER"),
]


def load_rules(path: str | None = None, version: int = 2) -> list[tuple[str | None, str | None, str]]:
    """Category rules from a TOML file ([[rule]] tool, pattern, category); an older version gives the built-in rules."""
    if path is None:
        return CATEGORY_RULES
    import tomllib

    with open(path, "rb") as f:
        found = tomllib.load(f)
    if found.get("version", 0) < version:
        return CATEGORY_RULES
    return [(r.get("tool"), r.get("pattern"), r["category"]) for r in found.get("rule", [])]


def category(tool: Column, head: Column, rules: list[tuple[str | None, str | None, str]] = CATEGORY_RULES) -> Column:
    line = F.concat_ws(" ", tool, head)
    out = None
    for name, pattern, label in rules:
        ok = F.lit(True)
        ok = ok & (tool == name) if name else ok
        ok = ok & line.rlike(pattern) if pattern else ok
        out = F.when(ok, label) if out is None else out.when(ok, label)
    return tool if out is None else out.otherwise(tool)


def session_tags(items: DataFrame) -> DataFrame:
    """(source_path, tag) over all messages of a path."""
    return items.select("source_path", F.explode(T.tags_of(F.col("text"))).alias("tag")).distinct()
