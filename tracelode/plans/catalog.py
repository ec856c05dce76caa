"""Registered queries of the engine's operators and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, projects
from ..functions import text as T
from ..operators import census, embeddings, mining, search, store
from ..sources import readers
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


E, I, TG = V.V_EVENTS, V.V_ITEMS, V.tags_sql()


# --- census --------------------------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT tool_name, command_head, count(*) AS cnt FROM v_events GROUP BY ALL")
def commands_census(s, d):
    return census.commands(V.tool_events(s, d))


@query(f"WITH {E} SELECT tool_name, command_head, count(*) AS cnt FROM v_events WHERE project = 'p2' GROUP BY ALL")
def commands_project(s, d):
    e = V.tool_events(s, d)
    return census.commands(census.scoped_events(e.drop("timestamp", "project"), e.select("source_path", "ordinal", "timestamp", "project"), project="p2"))


@query(f"WITH {E} SELECT tool_name, command_head, count(*) AS cnt FROM v_events WHERE source_path IN (SELECT source_path FROM v_events WHERE tool_name = 'purchase' AND command_head = 'k1') GROUP BY ALL")
def commands_tag(s, d):
    e = V.tool_events(s, d)
    tags = e.where("tool_name = 'purchase' and command_head = 'k1'").select("source_path", F.lit("buyer").alias("tag")).distinct()
    return census.commands(census.scoped_events(e.drop("timestamp", "project"), e.select("source_path", "ordinal", "timestamp", "project"), tags, tag="buyer"))


@query(f"WITH {E} SELECT tool_name, command_head, count(*) AS cnt FROM v_events WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15' GROUP BY ALL")
def commands_window(s, d):
    e = V.tool_events(s, d)
    return census.commands(census.scoped_events(e.drop("timestamp", "project"), e.select("source_path", "ordinal", "timestamp", "project"), start="2024-01-08", end="2024-01-15"))


@query(f"WITH {E} SELECT strftime(timestamp, '%Y-W%W') AS week, tool_name, command_head, count(*) AS cnt FROM v_events GROUP BY ALL")
def commands_trend(s, d):
    return census.commands_trend(V.tool_events(s, d))


@query(f"WITH {E} SELECT count(*) FILTER (timestamp IS NULL) AS excluded FROM (SELECT CASE WHEN tool_name <> 'click' THEN timestamp END AS timestamp FROM v_events)")
def trend_excluded_nulls(s, d):
    return census.undated(V.tool_events(s, d).withColumn("timestamp", F.when(F.col("tool_name") != "click", F.col("timestamp"))))


@query(f"WITH {E} SELECT tool_name, exit_code, count(*) AS cnt, (SELECT count(is_error) FROM v_events) AS coverage FROM v_events WHERE is_error GROUP BY tool_name, exit_code")
def failures_census(s, d):
    return census.failures(V.tool_events(s, d))


@query(f"WITH {E} SELECT strftime(timestamp, '%Y-W%W') AS week, tool_name, exit_code, count(*) AS cnt, (SELECT count(is_error) FROM v_events) AS coverage FROM v_events WHERE is_error GROUP BY 1, 2, 3")
def failures_trend(s, d):
    return census.failures_trend(V.tool_events(s, d))


@query(f"WITH {I} SELECT source_path, project, max(timestamp) AS last_at FROM v_items GROUP BY ALL")
def list_sessions(s, d):
    return census.sessions(V.items(s, d))


@query(f"WITH {I} SELECT source_path, project, max(timestamp) AS last_at FROM v_items WHERE source = 'session' GROUP BY ALL ORDER BY last_at DESC, source_path LIMIT 20")
def list_recent(s, d):
    return census.page(census.sessions(V.items(s, d), source="session"), limit=20)


@query(f"WITH {I} SELECT source_path, project, max(timestamp) AS last_at FROM v_items GROUP BY ALL ORDER BY last_at DESC, source_path OFFSET 30")
def list_offset_only(s, d):
    return census.page(census.sessions(V.items(s, d)), offset=30)


@query(f"WITH {I}, {TG}, t AS (SELECT source_path, string_agg(tag, ',' ORDER BY tag) AS tags FROM v_tags GROUP BY 1) SELECT source_path, project, max(timestamp) AS last_at, coalesce(any_value(tags), '') AS tags FROM v_items LEFT JOIN t USING (source_path) GROUP BY ALL")
def list_with_tags(s, d):
    return census.sessions(V.items(s, d), V.tags(s, d))


@query(f"WITH {I}, {V.V_CHUNKS} SELECT (SELECT count(*) FROM (SELECT DISTINCT source_path FROM v_items) WHERE right(source_path, 1) <> '7') AS files, count(*) FILTER (source = 'session') AS messages, max(timestamp) AS last_at, (SELECT count(*) FROM v_chunks) AS chunks, (SELECT count(embedding) FROM v_chunks) AS vectors, (SELECT count(DISTINCT source_id) FROM v_chunks) AS metadata, (SELECT max(ts)::TIMESTAMP FROM events) AS last_indexed FROM v_items")
def index_stats(s, d):
    i = V.items(s, d)
    files = i.select("source_path").distinct().withColumn("hash", F.when(F.endswith("source_path", F.lit("7")), "recovered").otherwise("x"))
    last = s.read.parquet(f"{d}/events.parquet").agg(F.max("ts").cast("timestamp").alias("last_indexed"))  # one row
    chunks = V.chunks(s, d)
    return census.stats(i, files.crossJoin(last), chunks, chunks.select("source_id").distinct())


_COMMON = ", ".join(f"'{w}'" for w in T.COMMON_WORDS)
_FIELDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
_PUNCT = ".,!?;:\"''()[]{}*/\\-_"


@query(f"WITH {I} SELECT term, count(*) AS cnt FROM (SELECT trim(unnest({_FIELDS.format('lower(text)')}), '{_PUNCT}') AS term FROM v_items) WHERE strlen(term) >= 4 AND term NOT IN ({_COMMON}) GROUP BY 1 ORDER BY cnt DESC, term LIMIT 50")
def topics_top50(s, d):
    return census.topics(V.items(s, d))


_FOLD = "translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüýÿñç', 'aaaaaaeeeeiiiiooooouuuuyync')"
_TOKENS = rf"list_filter(regexp_split_to_array({_FOLD}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(f"WITH {I} SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct({_TOKENS})) AS term FROM v_items) GROUP BY 1 ORDER BY docs DESC, term LIMIT 100")
def stopwords_top(s, d):
    return search.dynamic_stopwords(V.items(s, d), 100)


@query(f"WITH {I} SELECT term, count(DISTINCT id) AS doc, count(*) AS cnt FROM (SELECT id, unnest({_TOKENS}) AS term FROM v_items) GROUP BY 1")
def vocabulary(s, d):
    return search.vocabulary(V.items(s, d))


#: The longest prefix of at most 80 bytes.
_BYTES = "left(text, coalesce(list_max(list_filter(range(0, least(length(text), 80) + 1), lambda k: strlen(left(text, k)) <= 80)), 0)::INTEGER)"


@query(f"WITH {I} SELECT source, source_path, ordinal, role, {_BYTES} AS text, timestamp, project, content_type FROM v_items WHERE project = 'p1' AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-03-01'")
def records_window(s, d):
    return census.records(V.items(s, d), project="p1", start="2024-01-10", end="2024-03-01", max_bytes=80)


@query(f"WITH {I}, m AS (SELECT source_path, min(CASE WHEN source_path = 'conv/1' THEN 1 WHEN contains(source_path, 'conv/1') THEN 2 WHEN uuid = 'conv/1' THEN 3 END)::INTEGER AS match FROM v_items GROUP BY 1) SELECT source_path, match FROM m WHERE match = (SELECT min(match) FROM m)")
def resolve_path(s, d):
    return census.resolve_path(V.items(s, d), "conv/1")


# --- retrieval -----------------------------------------------------------------------------------------------------


def _bm25_sql(rows: str, terms: list[str], where: str = "true") -> str:
    """rows: CTE body with id, dl, tf_0..; the score of rows with all terms."""
    stats = ", ".join(f"count(*) FILTER (tf_{i} > 0) AS df_{i}" for i in range(len(terms)))
    score = " ".join(f"- (CASE WHEN ln((n - df_{i} + 0.5) / (df_{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df_{i} + 0.5) / (df_{i} + 0.5)) END) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    both = " AND ".join(f"tf_{i} > 0" for i in range(len(terms)))
    return f"r AS ({rows}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM r) SELECT id, round(0.0 {score}, 6) AS score FROM r, st WHERE {both} AND {where}"


def _substring_rows(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, {len(t)}) = '{t}')) AS tf_{k}" for k, t in enumerate(terms))
    return f"SELECT *, greatest(length(text) - 2, 0) AS dl, {tf} FROM v_items"


def _prose_rows(phrases: list[tuple[list[str], bool]]) -> str:
    out = []
    for k, (tokens, prefix) in enumerate(phrases):
        ok = " AND ".join(f"starts_with(coalesce(toks[i + {j}], ''), '{t}')" if prefix and j == len(tokens) - 1 else f"coalesce(toks[i + {j}], '') = '{t}'" for j, t in enumerate(tokens))
        out.append(f"len(list_filter(range(1, len(toks) + 1), lambda i: {ok})) AS tf_{k}")
    return f"SELECT *, len(toks) AS dl, {', '.join(out)} FROM (SELECT *, {_TOKENS} AS toks FROM v_items)"


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {I}, {_bm25_sql(_substring_rows(['tion']), ['tion'])}")
def search_tool_substring(s, d):
    return _scored(search.search_tool(V.items(s, d), "tion", content_types=["text"]))


@query(f"WITH {I}, {_bm25_sql(_substring_rows(['the', 'ing']), ['the', 'ing'])}")
def search_tool_multi(s, d):
    return _scored(search.search_tool(V.items(s, d), "the ING ab", content_types=["text"]))


@query(f"WITH {I}, {_bm25_sql(_prose_rows([(['and'], True), (['of'], True)]), ['a', 'b'])}")
def search_prose_bm25(s, d):
    return _scored(search.search_prose(V.items(s, d), "and of", stemmed=False))


@query(f"WITH {I}, {_bm25_sql(_prose_rows([(['of', 'the'], False)]), ['a'])}")
def search_phrase(s, d):
    return _scored(search.search_prose(V.items(s, d), "of-the", stemmed=False, prefix=False))


@query(f"WITH {I}, {_bm25_sql(_prose_rows([(['ther'], True)]), ['a'])}")
def search_prefix(s, d):
    return _scored(search.search_prose(V.items(s, d), "ther", stemmed=False))


@query(f"WITH {I}, {_bm25_sql(_prose_rows([(['the'], True)]), ['a'], chr(10) + "role = 'user' AND source = 'session' AND source_path ILIKE 'CONV/1%' AND timestamp > TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-06-01'")}")
def search_filters(s, d):
    r = search.SearchRequest("the", source=" Sessions", role="user", source_path="CONV/1*", after="2024-01-05", before="2024-06-01")
    return _scored(search.filtered(search.search_prose(V.items(s, d), "the", stemmed=False), r))


@query()
def search_prose_stemmed(s, d):
    return _scored(search.ranked(search.search_prose(V.items(s, d), "retitioning that"), 50))


def _list_sql(rows: str, n: int) -> str:
    return f"(SELECT id, row_number() OVER (ORDER BY score, id) AS rk FROM (WITH {_bm25_sql(rows, ['x'] * n)}) ORDER BY score, id LIMIT 200)"


@query(f"WITH {I}, a AS {_list_sql(_prose_rows([(['the'], True)]), 1)}, b AS {_list_sql(_substring_rows(['the']), 1)} SELECT id, round(sum(1.0 / (60 + rk)), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def search_rrf_unfiltered(s, d):
    i = V.items(s, d)
    lists = [search.ranked(_scored(h), 200) for h in (search.search_prose(i, "the", stemmed=False), search.search_tool(i, "the", content_types=["text"]))]
    return search.fuse(lists).select("id", F.round("rrf", 6).alias("rrf"))


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return s.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").first()["embedding"]


_SIM = "sims AS (SELECT source_id, max(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) AS sim FROM v_chunks GROUP BY 1)"


@query(f"WITH {V.V_CHUNKS}, {_SIM} SELECT source_id, round(sim, 6) AS sim FROM sims WHERE sim > 0 ORDER BY sims.sim DESC, source_id LIMIT 20")
def vector_topk(s, d):
    return search.vector_search(V.chunks(s, d), _query_vector(s, d), 20).select("source_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {V.V_CHUNKS}, {_SIM} SELECT source_id, round(sim, 6) AS sim FROM sims WHERE sim >= 0.2 ORDER BY sims.sim DESC, source_id LIMIT 100")
def vector_threshold(s, d):
    return search.vector_search(V.chunks(s, d), _query_vector(s, d), 100, 0.2).select("source_id", F.round("sim", 6).alias("sim"))


@query(f"""WITH {I}, {V.V_CHUNKS}, {_SIM}, lex AS {_list_sql(_prose_rows([(['the'], True)]), 1).replace('LIMIT 200', 'LIMIT 40')},
v AS (SELECT i.id, row_number() OVER (ORDER BY -sim, i.id) AS rk FROM (SELECT * FROM sims WHERE sim > 0 ORDER BY sim DESC, source_id LIMIT 80) x JOIN v_items i ON i.source_path = x.source_id)
SELECT id, round(sum(1.0 / (60 + rk)), 6) AS rrf FROM (SELECT * FROM lex UNION ALL SELECT * FROM v) WHERE id IN (SELECT id FROM lex) GROUP BY id""")
def hybrid_rrf(s, d):
    i = V.items(s, d)
    lexical = search.ranked(_scored(search.search_prose(i, "the", stemmed=False)), 40)
    hits = search.vector_search(V.chunks(s, d), _query_vector(s, d), 80)
    vectors = embeddings.chunk_items(hits, i).select("id", "sim")
    return search.hybrid(lexical, vectors).select("id", F.round("rrf", 6).alias("rrf"))


@query(f"SELECT doc_id, ((len({_FIELDS.format('text')}) * 4 + 2) // 3)::BIGINT AS tokens FROM documents")
def chunk_tokens(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query()
def chunk_text(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(chunking.chunks(F.col("text"), 256, 32)).alias("chunk_idx", "content"))


# --- text functions ------------------------------------------------------------------------------------------------


@query(f"WITH {I}, {TG} SELECT source_path, tag FROM v_tags")
def tag_sessions(s, d):
    return V.tags(s, d)


@query("WITH v AS (SELECT doc_id AS id, text AS source_path, text FROM documents) SELECT id, list_aggregate(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for t, p in sorted(T.TAG_PATTERNS.items())) + "], lambda x: x IS NOT NULL)), 'string_agg', ',') AS tags FROM v")
def tag_documents(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.nullif(F.array_join(T.tags_of(F.col("text")), ","), F.lit("")).alias("tags"))


def _clean_sql(x: str) -> str:
    for t in T.NOISE_TAGS:
        x = f"regexp_replace(regexp_replace({x}, '<{t}>.*?</{t}>', '', 'gs'), '^(.*?)<{t}>', '\\1', 's')"
    return f"trim(regexp_replace(replace(regexp_replace({x}, '^Caveat: ', ''), 'Request interrupted', ''), '\\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {_clean_sql("'Caveat: <command>ls ' || turn || chr(10) || '</command> ' || coalesce(text, '') || ' <caveat>tail  Request interrupted '")} AS cleaned FROM conversations")
def clean_content(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", T.clean_content(F.concat(F.lit("Caveat: <command>ls "), F.col("turn").cast("string"), F.lit("\n</command> "), F.coalesce("text", F.lit("")), F.lit(" <caveat>tail  Request interrupted "))).alias("cleaned"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def strip_markup(s, d):
    p = s.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN contains(x, '```') THEN 'code' ELSE 'text' END AS kind FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN text || '```' ELSE text END AS x FROM conversations)")
def classify_type(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", T.classify_content(F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("```"))).otherwise(F.col("text"))).alias("kind"))


@query(f"WITH {E} SELECT source_path, ordinal, try_cast(nullif(regexp_extract(text, '(?i)(?:exit(?:\\s+code)?|returned|exited)\\s*[:=]?\\s*(\\d+)', 1), '') AS INTEGER) AS code FROM v_events")
def exit_code(s, d):
    return V.tool_events(s, d).select("source_path", "ordinal", T.exit_code(F.col("text")).alias("code"))


@query(f"SELECT event_id, list_filter({_FIELDS.format("'A=1 B=' || user_id || ' ' || event_type || ' --x'")}, lambda x: NOT contains(x, '='))[1] AS head FROM events")
def command_head(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", T.command_head(F.concat(F.lit("A=1 B="), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" --x"))).alias("head"))


@query("SELECT event_id, left('Bash command=' || event_type || ' user=' || user_id || ' z=1', 4000) AS line FROM events")
def tool_serialize(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", T.serialize_tool(F.lit("Bash"), F.create_map(F.lit("z"), F.lit(" 1 "), F.lit("user"), F.col("user_id").cast("string"), F.lit("command"), F.col("event_type"))).alias("line"))


@query("SELECT event_id, 'Bash' AS tool, CASE WHEN event_id % 2 = 0 THEN event_type END AS head FROM events")
def tool_reverse_parse(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Bash command=X=1 "), F.col("event_type"), F.lit(" -v"))).otherwise("Bash")
    tool, head = T.parse_serialized_tool(line)
    return e.select("event_id", tool.alias("tool"), head.alias("head"))


_MINED = f"""{E}, lines AS (SELECT source_path, ordinal, item_uuid, project, text FROM v_events WHERE is_error),
tpl AS (SELECT *, 'error: job exit code <*> at <*>' AS template_text FROM lines)"""


@query(f"WITH {_MINED} SELECT DISTINCT template_text, sha256(template_text) AS signature, 2 AS normalization_version FROM tpl")
def template_signature(s, d):
    return mining.mine_templates(V.tool_events(s, d).where("is_error"))[0]


@query(f"WITH {_MINED} SELECT sha256(template_text) AS signature, template_text, count(*) AS cnt, count(DISTINCT project) AS projects, array_to_string(list_sort(list_distinct(list(item_uuid)))[1:3], ',') AS uuids FROM tpl GROUP BY template_text")
def template_census(s, d):
    e = V.tool_events(s, d)
    mined, matches = mining.mine_templates(e.where("is_error"))
    return census.templates(mined, matches, e.select("source_path", "ordinal", "project")).withColumn("uuids", F.array_join("uuids", ","))


@query(r"""SELECT doc_id, line_no, array_to_string(list_transform(toks, lambda t, i: CASE WHEN i >= 3 AND regexp_matches(t, '^(-?\+?[0-9.]*[0-9][0-9.]*|".*"|"|''.*''|''|.*[/\\:].*|[.~].*)$') OR (i >= 3 AND strlen(t) >= 20 AND length(t) >= 20 AND regexp_matches(t, '^([0-9a-fA-F]+|.*-.*)$')) THEN '<*>' ELSE t END), ' ') AS template FROM (SELECT doc_id, """ + _FIELDS.format("lines[i]") + " AS toks, (i - 1)::INTEGER AS line_no FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))")
def template_normalize(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", T.normalize_template(F.col("line")).alias("template"))


def _talk(s: SparkSession, d: str) -> DataFrame:
    """Items with planted phrases, interruptions, denials and rephrasings."""
    i = V.items(s, d)
    text = F.when((F.col("role") == "user") & (F.col("id") % 7 == 0), F.concat(F.lit("That is WRONG, "), F.col("text"))).when((F.col("role") == "assistant") & (F.col("id") % 5 == 0), "access Denied").when((F.col("role") == "user") & (F.col("id") % 4 == 0), "run the same tests again please").otherwise(F.col("text"))
    return i.withColumn("text", text).withColumn("was_interrupted", F.col("id") % 6 == 0)


_TALK = f"""{I}, talk AS (SELECT id, source_path, ordinal, role, content_type, id % 6 = 0 AS was_interrupted, CASE WHEN role = 'user' AND id % 7 = 0 THEN 'That is WRONG, ' || text WHEN role = 'assistant' AND id % 5 = 0 THEN 'access Denied' WHEN role = 'user' AND id % 4 = 0 THEN 'run the same tests again please' ELSE text END AS text FROM v_items),
tok AS (SELECT *, list_distinct(list_filter(list_transform({_FIELDS.format('lower(text)')}, lambda w: trim(w, '{_PUNCT}')), lambda w: w <> '' AND NOT list_contains([{', '.join(f"'{w}'" for w in mining.REPHRASE_STOPWORDS)}], w))) AS tokens FROM talk),
w AS (SELECT *, lag(role) OVER o AS br, lag(text) OVER o AS bt, last_value(CASE WHEN role = 'user' THEN tokens END IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bu FROM tok WINDOW o AS (PARTITION BY source_path ORDER BY ordinal)),
sig AS (
  SELECT source_path, ordinal, 'lexicon' AS detector, 0.8::DOUBLE AS confidence FROM w WHERE role = 'user' AND ({' OR '.join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in mining.LEXICON)})
  UNION ALL SELECT source_path, ordinal, 'interrupt', 0.5::DOUBLE FROM w WHERE role = 'user' AND was_interrupted AND length(text) >= 20
  UNION ALL SELECT source_path, ordinal, 'denial', 0.4::DOUBLE FROM w WHERE role = 'user' AND br IN ('assistant', 'tool') AND (contains(lower(bt), 'denied') OR contains(lower(bt), 'rechaza'))
  UNION ALL SELECT source_path, ordinal, 'rephrase', 0.6::DOUBLE FROM w WHERE role = 'user' AND bu IS NOT NULL AND CASE WHEN len(list_distinct(list_concat(tokens, bu))) = 0 THEN true ELSE len(list_intersect(tokens, bu)) / len(list_distinct(list_concat(tokens, bu))) >= 0.6 END)"""


@query(f"WITH {_TALK} SELECT * FROM sig")
def corrections_detect(s, d):
    return mining.detect_corrections(_talk(s, d))


@query(f"WITH {_TALK} SELECT source_path, ordinal, max(confidence) AS confidence, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, any_value(text) AS text FROM sig JOIN talk USING (source_path, ordinal) GROUP BY 1, 2 HAVING max(confidence) >= 0.6")
def corrections_census(s, d):
    t = _talk(s, d)
    return census.corrections(mining.detect_corrections(t), t)


@query(f"WITH {_TALK} SELECT source_path, ordinal, max(confidence) AS confidence, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, any_value(text) AS text FROM sig JOIN talk USING (source_path, ordinal) WHERE (source_path, ordinal) NOT IN (SELECT 'conv/' || doc_id, 0 FROM labels) GROUP BY 1, 2 HAVING max(confidence) >= 0.5")
def corrections_pending(s, d):
    t = _talk(s, d)
    return census.corrections(mining.detect_corrections(t), t, V.annotations(s, d), 0.5)


def _spans_sql(longest: int) -> str:
    """Earliest ends of every pattern in every path, a step a length."""
    steps = [f"l{k} AS (SELECT l.source_path, items || ' ' || c AS items, n.at FROM l{k - 1} l JOIN n ON n.source_path = l.source_path AND n.since = l.at)" for k in range(2, longest + 1)]
    return ", ".join(steps), " UNION ALL ".join(f"SELECT items FROM l{k}" for k in range(2, longest + 1))


@query(f"""WITH {E}, p AS (SELECT source_path, ordinal, tool_name AS c FROM v_events), cs AS (SELECT DISTINCT source_path, c FROM p),
n AS (SELECT a.source_path, a.ordinal AS since, b.c, min(b.ordinal) AS at FROM p a JOIN p b ON a.source_path = b.source_path AND b.ordinal > a.ordinal GROUP BY ALL),
l1 AS (SELECT source_path, c AS items, min(ordinal) AS at FROM p GROUP BY 1, 2), {_spans_sql(6)[0]}
SELECT items, count(*) AS support FROM ({_spans_sql(6)[1]}) GROUP BY 1 HAVING count(*) >= 20""")
def sequences_prefixspan(s, d):
    seqs = mining.sequences(V.tool_events(s, d), F.col("tool_name"))
    return mining.prefix_span(seqs, 20, 2, 6)


_CASE = " ".join("WHEN " + " AND ".join(([f"tool = '{t}'"] if t else []) + ([f"regexp_matches(concat_ws(' ', tool, head), '{p}')"] if p else [])) + f" THEN '{c}'" for t, p, c in mining.CATEGORY_RULES)
_HEADS = ["cd", "rg x", "cat", "git", "npm test", "install", "zzz", "sqlite3"]


@query(f"SELECT event_id, CASE {_CASE} ELSE tool END AS category FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Custom' ELSE 'Bash' END AS tool, {_HEADS}[(event_id // 4) % 8 + 1] AS head FROM events)")
def category_map(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    tool = F.when(F.col("event_id") % 4 == 0, "Read").when(F.col("event_id") % 4 == 1, "Custom").otherwise("Bash")
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.floor(F.col("event_id") / 4) % 8).cast("int"))
    return e.select("event_id", mining.category(tool, head).alias("category"))


# --- maintenance ---------------------------------------------------------------------------------------------------


def _files(s, d):
    i = V.items(s, d)
    return i.select(F.col("source_path").alias("path")).distinct().where("right(path, 1) <> '3'").withColumn("hash", F.when(F.endswith("path", F.lit("7")), "recovered").otherwise("x")).withColumn("last_indexed", F.to_timestamp(F.lit("2024-02-01")))


@query(f"WITH {I} SELECT source_path, ordinal, timestamp FROM v_items WHERE NOT timestamp < TIMESTAMP '2024-02-15'")
def purge_effect(s, d):
    return store.purged({"items": V.items(s, d)}, "2024-02-15")[0]["items"].select("source_path", "ordinal", "timestamp")


@query(f"WITH {I}, {TG} SELECT * FROM v_tags WHERE source_path IN (SELECT source_path FROM v_items WHERE timestamp >= TIMESTAMP '2024-02-15')")
def purge_tags(s, d):
    return store.purged({"items": V.items(s, d), "tags": V.tags(s, d)}, "2024-02-15")[0]["tags"]


@query(f"WITH {I} SELECT DISTINCT source_path AS path FROM v_items WHERE right(source_path, 1) IN ('3', '7')")
def expired_backfill_paths(s, d):
    return store.expired_paths(V.items(s, d), _files(s, d))


@query(f"WITH {I} SELECT DISTINCT source_path FROM v_items WHERE right(source_path, 1) = '3'")
def orphan_check(s, d):
    return store.orphans(V.items(s, d), _files(s, d))


@query(f"WITH {I}, p AS (SELECT DISTINCT source_path AS path FROM v_items WHERE (id // 1000) % 2 = 0) SELECT path, CASE WHEN right(path, 1) <> '3' THEN TIMESTAMP '2024-02-01' END AS last_indexed FROM p ORDER BY last_indexed NULLS FIRST, path LIMIT 200")
def stale_paths(s, d):
    i = V.items(s, d).withColumn("extraction_version", F.when(F.floor(F.col("id") / 1000) % 2 == 0, 2).otherwise(3))
    return store.stale_paths(i, _files(s, d)).select("path", "last_indexed")


@query("WITH old AS (SELECT 'conv/' || doc_id AS source_path, 0 AS ordinal, 'correction' AS kind, quality::VARCHAR AS label FROM labels), new AS (SELECT DISTINCT 'conv/' || (doc_id // 2 * 2) AS source_path, 0 AS ordinal, 'correction' AS kind, 'checked' AS label FROM labels) SELECT * FROM new UNION ALL SELECT * FROM old WHERE source_path NOT IN (SELECT source_path FROM new)")
def annotate_upsert(s, d):
    old = V.annotations(s, d)
    new = s.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit("conv/"), (F.floor(F.col("doc_id") / 2) * 2).cast("string")).alias("source_path"), F.lit(0).alias("ordinal"), F.lit("correction").alias("kind"), F.lit("checked").alias("label"))
    return store.upsert_replace(old, new, ["source_path", "ordinal", "kind"], [F.desc("label")])


@query(f"WITH {I}, old AS (SELECT uuid, role FROM v_items WHERE ordinal = 0), new AS (SELECT uuid, min(role || '!') AS role FROM v_items WHERE ordinal <= 1 GROUP BY 1) SELECT * FROM old UNION ALL SELECT * FROM new WHERE uuid NOT IN (SELECT uuid FROM old)")
def upsert_ignore(s, d):
    i = V.items(s, d)
    return store.upsert_ignore(i.where("ordinal = 0").select("uuid", "role"), i.where("ordinal <= 1").select("uuid", F.concat("role", F.lit("!")).alias("role")), ["uuid"], [F.col("role")])


@query(f"WITH {I} SELECT DISTINCT uuid, source_path, ordinal, role FROM v_items")
def recover_union(s, d):
    i = V.items(s, d)
    return store.recovery_plan([i.where("ordinal < 3"), i.where("ordinal > 0")])[0].select("uuid", "source_path", "ordinal", "role")


@query(f"WITH {I} SELECT uuid AS key, 2::BIGINT AS payloads FROM v_items WHERE ordinal = 1 AND role = 'assistant'")
def recover_conflicts(s, d):
    i = V.items(s, d)
    return store.recovery_plan([i, i.where("ordinal = 1").withColumn("role", F.when(F.col("role") == "assistant", "bot").otherwise(F.col("role")))])[1]


@query(f"""WITH {_TALK}, o AS (SELECT *, row_number() OVER (PARTITION BY detector, source_path ORDER BY sha256(source_path || '|' || ordinal || '|' || detector), source_path, ordinal) AS a FROM sig),
q AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY sha256(source_path || '|' || ordinal || '|' || detector), source_path, ordinal) AS in_detector FROM o WHERE a <= 1) SELECT source_path, ordinal, detector, confidence, in_detector::INTEGER AS in_detector FROM q WHERE in_detector <= 10""")
def stratified_sample(s, d):
    return census.stratified_sample(mining.detect_corrections(_talk(s, d)), 10, 1)


@query(r"""WITH x AS (SELECT doc_id, string_split(chr(10) || replace(text, chr(10) || 'The', chr(10) || '## The'), chr(10) || '## ') AS parts FROM documents)
SELECT doc_id, i::INTEGER AS section, CASE WHEN len(parts) > 1 THEN nullif(trim(string_split(parts[i + 2], chr(10))[1], ' '), '') END AS title, regexp_replace(CASE WHEN len(parts) > 1 THEN '## ' || parts[i + 2] ELSE parts[1] END, '^\s+|\s+$', '', 'g') AS body
FROM (SELECT *, unnest(range(greatest(len(parts) - 1, 1))) AS i FROM x)""")
def markdown_sections(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.replace("text", F.lit("\nThe"), F.lit("\n## The")).alias("text"))
    return readers.sections(docs)


@query("SELECT event_id, regexp_replace(lower('Proj ' || event_type || '.' || user_id), '[^a-z0-9_-]', '', 'g') AS project FROM events")
def project_ids(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", T.project_id(F.concat(F.lit("Proj "), F.col("event_type"), F.lit("."), F.col("user_id").cast("string"))).alias("project"))


@query(f"WITH {I} SELECT uuid, CASE WHEN right(source_path, 1) = '1' THEN 'conv' ELSE project END AS project FROM v_items")
def projects_resolved(s, d):
    i = V.items(s, d).withColumn("project", F.when(F.endswith("source_path", F.lit("1")), "unknown").otherwise(F.col("project")))
    return projects.resolve(i, [projects.Project("conv", roots=("conv",))]).select("uuid", "project")


@query(f"WITH {I}, r AS (SELECT id, text, timestamp, sum(ceil(length(text) / 4)) OVER (ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS cost FROM (SELECT * FROM v_items ORDER BY timestamp, id LIMIT 50)) SELECT id FROM r WHERE cost <= 2000")
def token_budget(s, d):
    page = V.items(s, d).orderBy("timestamp", "id").limit(50)
    return search.budgeted(page, 2000, [F.col("timestamp"), F.col("id")]).select("id")


@query(r"SELECT conv_id, turn, replace(replace(replace(text, '\', '\\'), chr(13), '\r'), chr(10), '\n') AS line FROM conversations")
def robot_escape(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", T.escape_robot(F.col("text")).alias("line"))


from . import catalog_store  # noqa: E402, F401  registers its queries here
