"""Census aggregations over tool events, templates, corrections and sessions.

Tables: items (id, source, source_path, ordinal, role, text, timestamp, uuid, project, content_type), tool_events (source_path, ordinal,
tool_name, command_head, is_error, exit_code), tags (source_path, tag). All filters are semi joins or predicates that reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PLACE = ["source_path", "ordinal"]


def scoped_events(events: DataFrame, items: DataFrame, tags: DataFrame | None = None, project: str | None = None, tag: str | None = None, start=None, end=None) -> DataFrame:
    """Events with their item's timestamp; filters: project, tag, start <= timestamp < end. Items are one a place."""
    at = items.groupBy(*PLACE).agg(F.min("timestamp").alias("timestamp"), F.min("project").alias("project"))
    out = events.join(at, PLACE)
    if project is not None:
        out = out.where(F.col("project") == project)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("timestamp") < F.lit(end).cast("timestamp"))
    if tag is not None:
        out = out.join(tags.where(F.col("tag") == tag).select("source_path"), "source_path", "left_semi")
    return out


def commands(events: DataFrame) -> DataFrame:
    return events.groupBy("tool_name", "command_head").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "tool_name", "command_head")


def commands_trend(events: DataFrame) -> DataFrame:
    dated = events.where("timestamp is not null").withColumn("week", T.week_label(F.col("timestamp")))
    return dated.groupBy("week", "tool_name", "command_head").agg(F.count("*").alias("cnt")).orderBy(F.desc("week"), F.desc("cnt"), "tool_name", "command_head")


def undated(events: DataFrame) -> DataFrame:
    """How many events a trend leaves out for want of a timestamp."""
    return events.agg(F.count_if(F.col("timestamp").isNull()).alias("excluded"))


def failures(events: DataFrame) -> DataFrame:
    """Failures by tool and exit code; coverage is the number of events whose outcome is known, a single row."""
    known = events.agg(F.count("is_error").alias("coverage"))
    failed = events.where("is_error").groupBy("tool_name", "exit_code").agg(F.count("*").alias("cnt"))
    return failed.crossJoin(F.broadcast(known)).orderBy(F.desc("cnt"), "tool_name", "exit_code")


def failures_trend(events: DataFrame) -> DataFrame:
    """Weekly failures; coverage is over all weeks."""
    known = events.agg(F.count("is_error").alias("coverage"))
    failed = events.where("is_error and timestamp is not null").withColumn("week", T.week_label(F.col("timestamp")))
    return failed.groupBy("week", "tool_name", "exit_code").agg(F.count("*").alias("cnt")).crossJoin(F.broadcast(known)).orderBy(F.desc("week"), F.desc("cnt"), "tool_name", "exit_code")


def templates(mined: DataFrame, matches: DataFrame, items: DataFrame, min_support: int = 3) -> DataFrame:
    """Templates by number of matches, with distinct projects and the first three uuids."""
    at = items.groupBy(*PLACE).agg(F.min("project").alias("project"))
    joined = matches.join(at, PLACE, "left").groupBy("signature").agg(
        F.count("*").alias("cnt"), F.countDistinct("project").alias("projects"), F.slice(F.sort_array(F.collect_set("item_uuid")), 1, 3).alias("uuids")
    )
    least = min_support if min_support >= 1 else 3
    return mined.select("signature", "template_text").join(joined, "signature").where(F.col("cnt") >= least).orderBy(F.desc("cnt"), "template_text")


def corrections(signals: DataFrame, items: DataFrame, annotations: DataFrame | None = None, min_confidence: float = 0.6) -> DataFrame:
    """Corrections by place: highest confidence, sorted detectors, text. With annotations: only places that have none."""
    if annotations is not None:
        signals = signals.join(annotations.select(*PLACE), PLACE, "left_anti")
    grouped = signals.groupBy(*PLACE).agg(F.max("confidence").alias("confidence"), F.array_join(F.sort_array(F.collect_set("detector")), ",").alias("detectors"))
    texts = items.groupBy(*PLACE).agg(F.min("text").alias("text"))
    return grouped.where(F.col("confidence") >= min_confidence).join(texts, PLACE).orderBy(F.desc("confidence"), *PLACE)


def sessions(items: DataFrame, tags: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Sessions by latest timestamp, with their sorted tags if given."""
    rows = items if source is None else items.where(F.col("source") == source)
    out = rows.groupBy("source_path", "project").agg(F.max("timestamp").alias("last_at"))
    if tags is not None:
        out = out.join(tags.groupBy("source_path").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags")), "source_path", "left").fillna({"tags": ""})
    return out.orderBy(F.desc("last_at"), "source_path")


def stats(items: DataFrame, files: DataFrame, chunks: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row of totals; recovered files do not count."""
    listed = F.col("hash") != "recovered"
    last = F.max(F.when(listed, F.col("last_indexed"))) if "last_indexed" in files.columns else F.lit(None).cast("timestamp")
    a = files.agg(F.count_if(listed).alias("files"), last.alias("last_indexed"))
    b = items.agg(F.count_if(F.col("source") == "session").alias("messages"), F.max("timestamp").alias("last_at"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))
    d = (metadata if metadata is not None else chunks.limit(0)).agg(F.count("*").alias("metadata"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # four single rows


def topics(items: DataFrame, limit: int = 50) -> DataFrame:
    """Most frequent words of session texts: at least four bytes, no common ones."""
    words = items.where(F.col("source") == "session").select(F.explode(T.fields(F.lower("text"))).alias("w")).select(T.strip_punctuation(F.col("w")).alias("term"))
    return words.where((F.octet_length("term") >= 4) & ~F.col("term").isin(T.COMMON_WORDS)).groupBy("term").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "term").limit(limit)


def page(df: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Offset and limit of an ordered result; limit 0 is none, an offset works alone."""
    df = df.offset(offset) if offset > 0 else df
    return df.limit(limit) if limit > 0 else df


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes of a text, less a character that they would cut."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, n)
    whole = F.when(F.octet_length(text) <= n, text)
    # a character has at most three bytes after its first: drop up to three until the rest is valid
    shorter = [F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, max(0, n - k)).cast("string")) for k in range(4)]
    return F.coalesce(whole, *shorter, cut.cast("string"))


def records(items: DataFrame, project: str | None = None, source: str | None = None, start=None, end=None, max_bytes: int = 0) -> DataFrame:
    """Canonical records in order, start inclusive and end exclusive."""
    out = items
    for column, value in (("project", project), ("source", source)):
        out = out.where(F.col(column) == value) if value is not None else out
    out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp")) if start is not None else out
    out = out.where(F.col("timestamp") < F.lit(end).cast("timestamp")) if end is not None else out
    return out.withColumn("text", first_bytes(F.col("text"), max_bytes) if max_bytes else F.col("text")).select("source", "source_path", "ordinal", "role", "text", "timestamp", "project", "content_type").orderBy("source_path", "ordinal")


def messages_of(items: DataFrame, path: str) -> DataFrame:
    """The messages of one path in order."""
    return items.where(F.col("source_path") == path).orderBy("ordinal")


def resolve_path(items: DataFrame, wanted: str) -> DataFrame:
    """The path that is meant: exact, else containing, else by uuid; the best kind of match only."""
    kind = F.when(F.col("source_path") == wanted, 1).when(F.contains("source_path", F.lit(wanted)), 2).when(F.col("uuid") == wanted, 3)
    found = items.select("source_path", kind.alias("match")).where("match is not null").groupBy("source_path").agg(F.min("match").alias("match"))
    best = found.agg(F.min("match").alias("match"))
    return found.join(F.broadcast(best), "match").select("source_path", "match").orderBy("source_path")


def stratified_sample(signals: DataFrame, quota: int, per_session: int) -> DataFrame:
    """At most per_session rows of a session and quota of a detector, in order of hashes of their places."""
    from pyspark.sql import Window

    order = [F.sha2(F.concat_ws("|", "source_path", F.col("ordinal").cast("string"), "detector"), 256), F.col("source_path"), F.col("ordinal")]
    first = signals.withColumn("in_session", F.row_number().over(Window.partitionBy("detector", "source_path").orderBy(*order))).where(F.col("in_session") <= per_session)
    return first.withColumn("in_detector", F.row_number().over(Window.partitionBy("detector").orderBy(*order))).where(F.col("in_detector") <= quota).drop("in_session")


def calibration(signals: DataFrame, items: DataFrame, annotations: DataFrame, tags: DataFrame, quota: int, per_session: int, least: int = 20, shown: int = 50) -> DataFrame:
    """A stratified sample of signals for labelling, with the last assistant's and the next user's message around each (no tool text,
    at least `least` characters), all texts cut to `shown`."""
    from pyspark.sql import Window

    order = Window.partitionBy("source_path").orderBy("ordinal")
    tells = (F.col("content_type") != "tool") & (F.char_length("text") >= least)
    said = lambda role: F.when((F.col("role") == role) & tells, F.left("text", F.lit(shown)))
    around = items.select(
        *PLACE, "uuid", F.left("text", F.lit(shown)).alias("text_preview"), F.last(said("assistant"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("window_before"),
        F.first(said("user"), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("window_after"),
    )
    label = annotations.groupBy(*PLACE).agg(F.min("kind").alias("kind"), F.min("label").alias("label"))
    tag = tags.groupBy("source_path").agg(F.min("tag").alias("session_tag"))
    picked = stratified_sample(signals, quota, per_session).drop("in_detector")
    return picked.join(around, PLACE).join(label, PLACE, "left").join(tag, "source_path", "left").select(
        "uuid", "kind", "label", "detector", F.format_string("%.1f", "confidence").alias("confidence"), *PLACE, "session_tag", "text_preview", "window_before", "window_after"
    )


def write_calibration(sample: DataFrame, path: str) -> None:
    """A calibration sample as CSV with a header, in order."""
    sample.fillna("").orderBy("detector", *PLACE).coalesce(1).write.mode("overwrite").csv(path, header=True)  # bounded by its quotas
