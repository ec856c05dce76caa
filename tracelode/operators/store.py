"""Versioned store: immutable files, a manifest for each version, and the operations that lead from one to the next.

A table is a set of folders, one for each bucket of its paths; a commit writes the buckets that it touches and a manifest that
names these and the others' old folders. The newest manifest is the store: readers never see half a change, a writer that
dies leaves files that no manifest names, and every version stays until vacuum. Writers hold a lock with a lease.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import index, lineage, mining, search
from .files import Files
from .lineage import BUCKETED, KEYS, SCHEMAS

SCHEMA_VERSION = lineage.VERSION
RECOVERED = "recovered"
EXTRACTION_VERSION, NORMALIZATION_VERSION = 3, 2
BUCKETS = 32
PLACE = ["source_path", "ordinal"]


def upsert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Insert, first wins: rows of new whose key old lacks, one for each key by order."""
    first = new.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank = 1").drop("rank")
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def upsert_replace(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Insert, last wins."""
    last = new.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank = 1").drop("rank")
    return old.join(last.select(*key), key, "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # --- versions -------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-"))

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{signature, tables: {name: {bucket: folder}}, segments: {index: [folders]}, lengths: {bucket: {index: [n, total]}}}."""
        version = self.version if version is None else version
        if not version:
            return {"signature": lineage.signature(SCHEMAS), "tables": {}, "segments": {}, "lengths": {}}
        return json.loads(self.files.read(f"manifest-{version}.json"))

    def fingerprint(self) -> tuple:
        """What changes if anyone commits."""
        return self.version, json.dumps(self.manifest(), sort_keys=True)

    def lineage(self) -> int:
        """The layout's version; a layout that is not known is refused."""
        return lineage.version_of(self.manifest()["signature"])

    def lock(self, wait: float = 5.0, lease: float = 3600.0):
        return self.files.lock(wait=wait, lease=lease)

    def _read(self, manifest: dict, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in manifest["tables"].get(name, {}).items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets, in the newest layout."""
        manifest, version = self.manifest(), self.lineage()
        if version == lineage.VERSION:
            return self._read(manifest, name, SCHEMAS[name], buckets if name in BUCKETED else None)
        old = {n: self._read(manifest, n, s) for n, s in lineage.LAYOUTS[version].items()}
        return lineage.upgraded(old, version).get(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def segment(self, name: str) -> DataFrame:
        """All segments of an index, rows of deleted messages included."""
        folders = self.manifest()["segments"].get(name, [])
        return self.spark.read.schema(index.SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], index.SCHEMAS[name])

    def lengths(self, name: str) -> tuple[int, int]:
        """Number and summed lengths of the messages that an index covers."""
        kept = [b[name] for b in self.manifest()["lengths"].values() if name in b]
        return sum(n for n, _ in kept), sum(t for _, t in kept)

    def commit(self, changed: dict[str, DataFrame], buckets: list[int] | None = None, expect: int | None = None, segments: dict[str, DataFrame] | None = None, replace_segments: bool = False, verify: Callable[[dict], None] | None = None) -> int:
        """The next version: `buckets` (or all) of the changed tables hold these rows, other buckets and tables what they held.
        Fails if the version is not `expect` any more. segments are added to the indexes, or replace theirs. verify is called
        with the manifest when all is written and before anyone sees it."""
        manifest, now = self.manifest(), self.version
        if expect is not None and now != expect:
            raise RuntimeError("the store changed meanwhile")
        base = f"data/{now + 1}-{uuid.uuid4().hex[:8]}"
        upgrade = self.lineage() != lineage.VERSION
        if upgrade and set(changed) != set(SCHEMAS):
            raise RuntimeError("migrate first")
        for name, rows in changed.items():
            rows = rows.select(*lineage.columns(SCHEMAS[name]))
            folder = f"{base}/{name}"
            if name in BUCKETED:
                rows.withColumn("bucket", bucket_of(F.col(BUCKETED[name]))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
                old = {b: f for b, f in manifest["tables"].get(name, {}).items() if buckets is not None and int(b) not in buckets}
                manifest["tables"][name] = old | {n[7:]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("bucket=")}
            else:
                rows.coalesce(1).write.parquet(f"{self.root}/{folder}")  # small by nature
                manifest["tables"][name] = {"0": folder}
        for name, rows in (segments or {}).items():
            rows.select(*lineage.columns(index.SCHEMAS[name])).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.root}/{base}/{name}")
            manifest["segments"][name] = ([] if replace_segments else manifest["segments"].get(name, [])) + [f"{base}/{name}"]
        manifest["signature"] = lineage.signature(SCHEMAS)
        if "items" in changed:
            manifest["lengths"] = self._lengths(manifest, buckets)
        if verify is not None:
            verify(manifest)
        self.files.publish(f"manifest-{now + 1}.json", json.dumps(manifest))
        return now + 1

    def _lengths(self, manifest: dict, buckets: list[int] | None) -> dict:
        """Lengths by bucket; only those of the changed buckets are counted anew."""
        items = self._read(manifest, "items", SCHEMAS["items"], buckets)
        low = F.greatest(F.char_length(F.lower("text")) - 2, F.lit(0))
        kind = F.when(F.col("content_type") == "tool", index.TOOL).when(F.col("content_type").isin(search.PROSE), index.PROSE)
        size = F.when(F.col("content_type") == "tool", low).otherwise(F.size(search.prose_tokens(F.col("text"))))
        rows = items.select(bucket_of(F.col("source_path")).alias("b"), kind.alias("kind"), size.cast("long").alias("size")).where("kind is not null").groupBy("b", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        out = {b: v for b, v in manifest["lengths"].items() if buckets is not None and int(b) not in buckets}
        for r in rows.collect():  # two rows for each bucket
            out.setdefault(str(r["b"]), {})[r["kind"]] = [r["n"], r["total"]]
        return out

    def snapshot(self) -> str:
        """Pin the current version, before a change that is not to be lost track of; vacuum keeps it."""
        name = f"snapshot-{self.version}.json"
        if not self.files.exists(name):
            self.files.publish(name, json.dumps(self.manifest()))
        return name

    def restore(self, version: int) -> int:
        """The next version is what an old one was."""
        with self.lock():
            manifest, now = self.manifest(version), self.version
            self.files.publish(f"manifest-{now + 1}.json", json.dumps(manifest))
            return now + 1

    def migrate(self) -> int:
        """Bring an older layout to the newest, with a snapshot before; the steps check what they need and stop otherwise."""
        with self.lock():
            version = self.lineage()
            if version == lineage.VERSION:
                return self.version
            self.snapshot()
            manifest = self.manifest()
            old = {n: self._read(manifest, n, s) for n, s in lineage.LAYOUTS[version].items()}
            new = lineage.upgraded(old, version)
            return self.commit(new | {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in new}, expect=self.version, segments=self._indexed(new["items"]), replace_segments=True)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last `keep` versions and pinned ones, and folders that none of these names."""
        old = [v for v in self.versions()[:-keep]]
        kept = [self.manifest(v) for v in self.versions()[-keep:]] + [json.loads(self.files.read(n)) for n in self.files.names() if n.startswith("snapshot-")]
        named = {f.split("/")[1] for m in kept for f in [*[f for t in m["tables"].values() for f in t.values()], *[f for s in m["segments"].values() for f in s]]}
        for v in old:
            self.files.delete(f"manifest-{v}.json")
        for folder in self.files.names("data"):
            if folder not in named:
                self.files.delete(f"data/{folder}")

    # --- ingest ---------------------------------------------------------------------------------------------------

    @staticmethod
    def _indexed(items: DataFrame) -> dict[str, DataFrame]:
        return {index.PROSE: index.prose_postings(items), index.TOOL: index.tool_grams(items)}

    def ingest(self, messages: DataFrame, files: DataFrame, source: str = "session", project=None) -> int:
        """Index parsed files: session files are appended by uuid where every message has one or stored ones have, else wiped and
        reloaded; events, tags, templates, signals, indexes and stop words follow. files: (path, hash, file_size, file_mtime).
        Only the buckets of these files are read and written, but for the stored uuids."""
        with self.lock():
            before = self.version
            new = messages.withColumn("source", F.lit(source)).withColumn("project", project if project is not None else F.coalesce(F.element_at(F.split("cwd", "/"), -1), F.lit("unknown")))
            new = new.withColumn("extraction_version", F.lit(EXTRACTION_VERSION)).persist()
            try:
                touched = files.select(F.col("path").alias("source_path")).unionByName(new.select("source_path")).distinct()
                buckets = [r["b"] for r in touched.select(bucket_of(F.col("source_path")).alias("b")).distinct().collect()]  # BUCKETS at most
                now = lambda name: self.table(name, buckets)
                items = now("items")
                state = new.groupBy("source_path").agg(F.bool_and(F.coalesce(F.col("uuid") != "", F.lit(False))).alias("all_uuid")).join(
                    items.where("uuid is not null").select("source_path").distinct().withColumn("had_uuid", F.lit(True)), "source_path", "left"
                )
                state = state.select("source_path", (F.lit(source == "session") & (F.col("all_uuid") | F.coalesce("had_uuid", F.lit(False)))).alias("grows"))
                with_state = lambda df: df.join(state, "source_path", "left")
                kept = with_state(items).where("grows is null or (grows and uuid is not null)").drop("grows")
                incoming = with_state(new).where("not grows or uuid <> ''").drop("grows")
                known = self.table("items").where("uuid is not null").join(state.where("not grows"), "source_path", "left_anti").select("uuid")
                once = F.row_number().over(Window.partitionBy("uuid").orderBy("source_path", "ordinal"))
                named = incoming.where("uuid <> ''").withColumn("once", once).where("once = 1").drop("once").join(known, "uuid", "left_anti")
                fresh = incoming.where("coalesce(uuid, '') = ''").withColumn("uuid", F.lit(None).cast("string")).unionByName(named)
                fresh = fresh.withColumn("id", F.xxhash64("source_path", "ordinal", "uuid", "text")).persist()
                all_items = kept.select(*items.columns).unionByName(fresh.select(*items.columns))
                used = fresh.where("tool_name is not null").select(*PLACE, F.col("uuid").alias("message_uuid"), "tool_name", "command_head", "is_error", "exit_code", "extraction_version")
                events = with_state(now("tool_events")).where("grows is null or (grows and message_uuid is not null)").drop("grows")
                errors = mining.failed_rows(fresh, F.col("is_error"))
                mined, matches = mining.mine_templates(errors, NORMALIZATION_VERSION)
                old_matches = with_state(now("template_matches")).where("grows is null or grows").drop("grows")
                session = all_items.join(touched, "source_path", "left_semi")
                derived = lambda name, rows: now(name).join(touched, "source_path", "left_anti").unionByName(rows)
                signals = mining.detect_corrections(session).withColumn("extraction_version", F.lit(EXTRACTION_VERSION))
                changed = {
                    "items": all_items, "tool_events": upsert_ignore(events, used, PLACE, [F.col("message_uuid")]), "tags": derived("tags", mining.session_tags(session)),
                    "templates": upsert_ignore(self.table("templates"), mined, ["signature"], [F.col("template_text")]), "template_matches": upsert_ignore(old_matches, matches, KEYS["template_matches"], [F.col("item_uuid")]),
                    "correction_signals": derived("correction_signals", signals), "files": upsert_replace(now("files"), files.withColumn("last_indexed", F.current_timestamp()), ["path"], [F.desc("last_indexed")]),
                }
                unseen = fresh.join(items.select("id"), "id", "left_anti")
                version = self.commit(changed, buckets, before, self._indexed(unseen))
                fresh.unpersist()
            finally:
                new.unpersist()
            return version

    def refresh_stopwords(self, top: int = 1000) -> int:
        """The terms that most messages hold, from the live postings of words."""
        with self.lock():
            return self.commit({"stopwords": search.dynamic_stopwords(self.table("items"), top)}, expect=self.version)

    def stopwords(self) -> frozenset[str]:
        return frozenset(r["term"] for r in self.table("stopwords").collect())  # a thousand rows

    def search(self, request: search.SearchRequest) -> DataFrame:
        """Routed search over the stored indexes: (id, score) of the best hits with their messages and snippets' texts."""
        items, tags, stop = self.table("items"), self.table("tags"), self.stopwords()
        live = items.select("id")
        prose = lambda: index.search_prose(self.segment(index.PROSE), live, *self.lengths(index.PROSE), request.query, stop)
        tool = lambda: index.search_tool(self.segment(index.TOOL), items, *self.lengths(index.TOOL), request.query, stop)
        found = lambda hits: search.filtered(items.join(hits, "id"), request, tags)
        if request.content_type:
            return search.ranked(found(tool() if request.content_type == "tool" else prose()), request.limit, request.offset, request.compat_order)
        lists = [search.ranked(found(h()), 200, 0, request.compat_order) for h in (prose, tool)]
        out = items.join(search.fuse(lists).withColumnRenamed("rrf", "score"), "id").orderBy(F.desc("score"), F.col("id").cast("string"))
        return (out.offset(request.offset) if request.offset else out).limit(request.limit or 100)

    def optimize(self) -> int:
        """Merge the indexes' segments into one each."""
        with self.lock():
            live = self.table("items").select("id")
            return self.commit({}, expect=self.version, segments={n: index.merged(self.segment(n), live) for n in (index.PROSE, index.TOOL)}, replace_segments=True)

    def rebuild_index(self) -> int:
        """Both indexes anew from the messages."""
        with self.lock():
            return self.commit({}, expect=self.version, segments=self._indexed(self.table("items")), replace_segments=True)

    # --- changes --------------------------------------------------------------------------------------------------

    def annotate(self, kind: str, label: str, uuid: str | None = None, path: str | None = None, ordinal: int = -1, source: str = "agent") -> int:
        """One annotation for each place and kind; the place is given by uuid or by path and ordinal, and must exist."""
        rows = self.table("items").where(F.col("uuid") == uuid if uuid else (F.col("source_path") == path) & (F.col("ordinal") == ordinal))
        if uuid and path:
            rows = rows.where((F.col("source_path") == path) & ((F.col("ordinal") == ordinal) | F.lit(ordinal < 0)))
        found = rows.limit(1).collect()
        if not found:
            raise LookupError("no such message")
        at = found[0]
        new = self.spark.createDataFrame([(at["source_path"], at["ordinal"], kind, label, source, at["uuid"])], "source_path string, ordinal int, kind string, label string, source string, item_uuid string").withColumn("created_at", F.current_timestamp())
        bucket = new.select(bucket_of(F.col("source_path")).alias("b")).collect()[0]["b"]
        with self.lock():
            return self.commit({"annotations": upsert_replace(self.table("annotations", [bucket]), new, KEYS["annotations"], [F.desc("created_at")])}, [bucket], self.version)

    def purge(self, before: str) -> int:
        """Delete messages older than a date with what hangs on them; returns how many. Files left empty go with tags and chunks."""
        with self.lock():
            now = self.version
            old = self.table("items").where(F.col("timestamp") < F.lit(before).cast("timestamp"))
            buckets = [r["b"] for r in old.select(bucket_of(F.col("source_path")).alias("b")).distinct().collect()]
            if not buckets:
                return 0
            changed, n = purged({name: self.table(name, buckets) for name in SCHEMAS if name != "templates"}, before)
            count = n.collect()[0][0]
            changed["templates"] = self.table("templates").join(self.table("template_matches").join(old.select(*PLACE), PLACE, "left_anti").select("signature"), "signature", "left_semi")
            self.commit({k: v for k, v in changed.items() if k != "stopwords"}, buckets, now)
            return count

    def resolve_projects(self, resolver: Column, only_unknown: bool = True) -> int:
        """Give messages (of no known project, or all) the project that `resolver`, a column over source_path, finds; null and
        unknown leave them. Only buckets with such a message are written."""
        with self.lock():
            now, items = self.version, self.table("items")
            found = resolver.alias("found")
            target = F.col("project").isNull() | (F.col("project") == "unknown") if only_unknown else F.lit(True)
            paths = items.where(target).select("source_path").distinct().select("source_path", found).where("found is not null and found <> 'unknown'")
            buckets = [r["b"] for r in paths.select(bucket_of(F.col("source_path")).alias("b")).distinct().collect()]
            if not buckets:
                return 0
            changed = self.table("items", buckets).join(paths, "source_path", "left").withColumn("project", F.when(target & F.col("found").isNotNull(), F.col("found")).otherwise(F.col("project")))
            self.commit({"items": changed}, buckets, now)
            return paths.count()

    # --- derived data ---------------------------------------------------------------------------------------------

    def backfill(self, limit: int | None = None) -> int:
        """Derive templates, signals and events of files that cannot be parsed again (expired or recovered, and short of one of
        the three) or whose templates are of an older normalisation; returns the number of files."""
        with self.lock():
            now = self.version
            work = backfill_paths({n: self.table(n) for n in SCHEMAS})
            work = work.orderBy("path").limit(limit) if limit else work
            buckets = [r["b"] for r in work.select(bucket_of(F.col("path")).alias("b")).distinct().collect()]
            if not buckets:
                return 0
            changed = backfilled({n: self.table(n, buckets if n != "templates" else None) for n in SCHEMAS}, work, self.table("template_matches"))
            n = work.count()
            self.commit(changed, buckets, now)
            return n

    def rederive(self, limit: int = 200) -> int:
        """Signals of an older extraction are deleted and derived anew, a batch of paths at a time; returns how many paths."""
        with self.lock():
            now, signals = self.version, self.table("correction_signals")
            paths = superseded_paths(signals).limit(limit)
            buckets = [r["b"] for r in paths.select(bucket_of(F.col("path")).alias("b")).distinct().collect()]
            if not buckets:
                return 0
            these = paths.withColumnRenamed("path", "source_path")
            again = mining.detect_corrections(self.table("items", buckets).join(these, "source_path", "left_semi")).withColumn("extraction_version", F.lit(EXTRACTION_VERSION))
            n = paths.count()
            self.commit({"correction_signals": self.table("correction_signals", buckets).join(these, "source_path", "left_anti").unionByName(again)}, buckets, now)
            return n

    def rebuild(self, resolver: Column | None = None) -> int:
        """Indexes anew, then what can be derived again, then projects that are not known."""
        self.rebuild_index()
        with self.lock():
            items = self.table("items")
            mined, matches = mining.mine_templates(mining.stored_failures(items, self.table("tool_events")), NORMALIZATION_VERSION)
            signals = mining.detect_corrections(items).withColumn("extraction_version", F.lit(EXTRACTION_VERSION))
            self.commit({"tags": mining.session_tags(items), "templates": mined, "template_matches": matches, "correction_signals": signals}, expect=self.version)
        self.backfill()
        if resolver is not None:
            self.resolve_projects(resolver)
        return self.version

    # --- reports --------------------------------------------------------------------------------------------------

    def validate(self) -> dict[str, object]:
        """Tables and indexes that are missing, paths without a file, and rows whose message is gone."""
        manifest, items = self.manifest(), self.table("items")
        orphans = items.select("source_path").distinct().join(self.table("files").select(F.col("path").alias("source_path")), "source_path", "left_anti").count()
        loose = {n: self.table(n).join(items.select(*PLACE), PLACE, "left_anti").count() for n in ("tool_events", "template_matches", "annotations")}
        return {"version": self.version, "missing": [n for n in SCHEMAS if n not in manifest["tables"]], "missing_indexes": [n for n in index.SCHEMAS if not manifest["segments"].get(n)], "orphan_paths": orphans, "loose": loose}

    def status(self) -> dict[str, object]:
        """Rows of each table, the version, its layout and the indexes' sizes."""
        return {n: self.table(n).count() for n in SCHEMAS} | {"version": self.version, "lineage": self.lineage(), "indexes": {n: self.lengths(n) for n in index.SCHEMAS}}

    def undecided(self, listing: DataFrame, racy_seconds: int = 2) -> DataFrame:
        """Files whose content must be hashed: new ones, of other size or time, changed too close to their indexing, recovered."""
        known = self.table("files").where(F.col("hash") != RECOVERED).select("path", "last_indexed", F.col("file_size").alias("size0"), F.col("file_mtime").alias("mtime0"))
        clean = (F.col("size0") == F.col("file_size")) & (F.col("mtime0") == F.col("file_mtime")) & (F.col("file_mtime") <= F.col("last_indexed") - F.expr(f"interval {racy_seconds} seconds"))
        return listing.join(known, "path", "left").where(~F.coalesce(clean, F.lit(False))).select(*listing.columns)

    # --- recovery -------------------------------------------------------------------------------------------------

    def recover(self, others: list[str], dry_run: bool = False, strict: bool = False) -> dict[str, int]:
        """Union other stores, of any known layout, into this one. Under the lock: all are read, the union is planned, written,
        compared with the plan, and published only if none of the stores moved meanwhile. A message with different contents,
        or (strict) an identity that is no uuid, rejects all. Files that only others had are marked recovered."""
        stores = [self, *[Store(self.spark, o) for o in others]]
        with self.lock():
            marks = [s.fingerprint() for s in stores]
            inputs = [{n: s.table(n) for n in SCHEMAS} for s in stores]
            union, conflicts = recovery_plan([t["items"] for t in inputs])
            n = conflicts.count()
            if n:
                raise ValueError(f"{n} identities have different contents")
            if strict and not (bad := malformed_ids(union)).isEmpty():
                raise ValueError(f"{bad.count()} identities are no uuids")
            if dry_run:
                return {"rows": union.count(), "conflicts": 0}
            changed = {"items": union} | {name: reduce(lambda a, b, k=key: upsert_ignore(a, b, k, [F.lit(0)]), [t[name] for t in inputs]) for name, key in KEYS.items()}
            mine = inputs[0]["files"].select("path")
            listed = changed["files"].join(mine.withColumn("mine", F.lit(True)), "path", "left").withColumn("hash", F.when(F.col("mine"), F.col("hash")).otherwise(RECOVERED)).drop("mine")
            unlisted = union.select(F.col("source_path").alias("path")).distinct().join(listed.select("path"), "path", "left_anti")
            nothing = [F.lit(RECOVERED).alias("hash"), F.current_timestamp().alias("last_indexed"), F.lit(None).cast("bigint").alias("file_size"), F.lit(None).cast("timestamp").alias("file_mtime")]
            changed["files"] = listed.unionByName(unlisted.select("path", *nothing))

            def verify(manifest: dict) -> None:
                """What was written is the plan's rows, under their indexes, and no store moved."""
                written = self._read(manifest, "items", SCHEMAS["items"])
                if differences(union, written):
                    raise RuntimeError("the recovered messages differ from their plan")
                covered = written.where(F.col("content_type").isin(search.PROSE) & (F.size(search.prose_tokens(F.col("text"))) > 0)).select("id")
                folders = [f"{self.root}/{f}" for f in manifest["segments"][index.PROSE]]
                indexed = self.spark.read.schema(index.SCHEMAS[index.PROSE]).parquet(*folders).select("id").distinct()
                if differences(covered.distinct(), indexed):
                    raise RuntimeError("the recovered index differs from its messages")
                if [s.fingerprint() for s in stores] != marks:
                    raise RuntimeError("a store changed meanwhile")

            self.snapshot()
            self.commit(changed, expect=marks[0][0], segments=self._indexed(union), replace_segments=True, verify=verify)
            return {"rows": self.table("items").count(), "conflicts": 0}


def purged(tables: dict[str, DataFrame], before: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without messages older than `before`, and the count of those."""
    items = tables["items"]
    is_old = F.coalesce(F.col("timestamp") < F.lit(before).cast("timestamp"), F.lit(False))
    old, keep = items.where(is_old), items.where(~is_old)
    gone, paths = old.select(*PLACE).distinct(), keep.select("source_path").distinct()
    out = {"items": keep}
    for name in ("template_matches", "tool_events", "correction_signals", "annotations"):
        if name in tables:
            out[name] = tables[name].join(gone, PLACE, "left_anti").select(*tables[name].columns)
    emptied = old.select("source_path").distinct().join(paths, "source_path", "left_anti")
    for name, column in (("files", "path"), ("tags", "source_path"), ("chunks", "source_id")):
        if name in tables:
            out[name] = tables[name].join(emptied.withColumnRenamed("source_path", column), column, "left_anti").select(*tables[name].columns)
    if "templates" in tables:
        out["templates"] = tables["templates"].join(out["template_matches"].select("signature"), "signature", "left_semi").select(*tables["templates"].columns)
    return out, old.agg(F.count("*").alias("n"))


def orphans(items: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of messages that no file has."""
    return items.select("source_path").distinct().join(files.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def identity() -> Column:
    """uuid, else path and ordinal."""
    return F.coalesce("uuid", F.concat_ws("#", "source_path", F.col("ordinal").cast("string")))


def malformed_ids(items: DataFrame) -> DataFrame:
    """uuids that are none, a block's suffix aside."""
    return items.where("uuid is not null").where(~F.col("uuid").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(#[a-z][0-9]+)?$")).select("uuid")


def recovery_plan(inputs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(union, conflicts): one row for each identity, of the earliest input; identities with more than one payload."""
    columns = inputs[0].columns
    payload = F.sha2(F.to_json(F.struct(*[c for c in columns if c != "id"]), {"ignoreNullFields": "false"}), 256)
    numbered = reduce(DataFrame.unionByName, [d.withColumn("input", F.lit(i)) for i, d in enumerate(inputs)]).withColumn("key", identity()).withColumn("payload", payload)
    conflicts = numbered.groupBy("key").agg(F.countDistinct("payload").alias("payloads")).where("payloads > 1")
    first = numbered.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("input", "source_path", "ordinal"))).where("r = 1").select(*columns)
    return first, conflicts


def differences(a: DataFrame, b: DataFrame) -> bool:
    """Whether the rows of two tables differ."""
    b = b.select(*a.columns)
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def stale_paths(items: DataFrame, files: DataFrame, version: int = EXTRACTION_VERSION, limit: int = 200) -> DataFrame:
    """Paths with items of an older extraction, longest unindexed first; limit is the batch that one sync takes."""
    old = items.where("extraction_version is null or extraction_version < %d" % version).select(F.col("source_path").alias("path")).distinct()
    return old.join(files.select("path", "last_indexed"), "path", "left").orderBy(F.asc_nulls_first("last_indexed"), "path").limit(limit)


def expired_paths(items: DataFrame, files: DataFrame) -> DataFrame:
    """Paths without a file, or with one that was recovered."""
    left = items.select(F.col("source_path").alias("path")).distinct().join(files.select("path", "hash"), "path", "left")
    return left.where(F.col("hash").isNull() | (F.col("hash") == RECOVERED)).select("path")


def stale_template_paths(matches: DataFrame, templates: DataFrame, version: int = NORMALIZATION_VERSION) -> DataFrame:
    """Paths with a match of a template of an older normalisation."""
    return matches.join(templates.where(F.col("normalization_version") < version).select("signature"), "signature").select(F.col("source_path").alias("path")).distinct()


def unmatched_templates(templates: DataFrame, matches: DataFrame) -> DataFrame:
    """Templates that no message matches."""
    return templates.join(matches.select("signature"), "signature", "left_anti")


def superseded_paths(signals: DataFrame, version: int = EXTRACTION_VERSION) -> DataFrame:
    """Paths with signals of an older or unknown extraction, in order."""
    return signals.where(F.coalesce("extraction_version", F.lit(-1)) < version).select(F.col("source_path").alias("path")).distinct().orderBy("path")


def backfill_paths(t: dict[str, DataFrame]) -> DataFrame:
    """(path, source) to derive from stored messages: expired files that lack matches, signals or reconstructed events, and
    files with stale templates, which count as sessions unless they are expired as well."""
    has = lambda name, flag, where="true": t[name].where(where).select(F.col("source_path").alias("path"), F.lit(True).alias(flag)).distinct()
    expired = expired_paths(t["items"], t["files"]).join(has("template_matches", "m"), "path", "left").join(has("correction_signals", "s"), "path", "left").join(has("tool_events", "e", "extraction_version = 0"), "path", "left")
    short = expired.where("m is null or s is null or e is null").select("path")
    of = t["items"].groupBy(F.col("source_path").alias("path")).agg(F.min("source").alias("source"))
    stale = stale_template_paths(t["template_matches"], t["templates"]).join(short, "path", "left_anti")
    return short.join(of, "path").unionByName(stale.withColumn("source", F.lit("session")))


def backfilled(t: dict[str, DataFrame], work: DataFrame, all_matches: DataFrame) -> dict[str, DataFrame]:
    """The derived tables with what the stored messages of `work` (path) tell. Matches of older templates go with the templates that
    nothing else matches; all_matches: those of the whole store."""
    paths = work.select(F.col("path").alias("source_path"))
    items = t["items"].join(paths, "source_path", "left_semi")
    mined, matches = mining.mine_templates(mining.stored_failures(items, t["tool_events"]), NORMALIZATION_VERSION)
    old = t["templates"].where(F.col("normalization_version") < NORMALIZATION_VERSION)
    renewed = old.join(mined.select("signature"), "signature", "left_anti")  # what was not found again stays old
    gone = t["template_matches"].join(paths, "source_path", "left_semi").join(renewed.select("signature"), "signature", "left_semi").select(*KEYS["template_matches"])
    new_matches = upsert_ignore(t["template_matches"].join(gone, KEYS["template_matches"], "left_anti").select(*t["template_matches"].columns), matches, KEYS["template_matches"], [F.col("item_uuid")])
    still = all_matches.join(gone, KEYS["template_matches"], "left_anti").select("signature").distinct()
    templates = upsert_replace(t["templates"], mined, ["signature"], [F.col("template_text")])
    templates = templates.where(F.col("normalization_version") >= NORMALIZATION_VERSION).unionByName(templates.where(F.col("normalization_version") < NORMALIZATION_VERSION).join(still, "signature", "left_semi"))
    tool, head = T.parse_serialized_tool(F.col("text"))
    nothing = {"message_uuid": "string", "is_error": "boolean", "exit_code": "int"}
    events = items.where("content_type = 'tool'").select(*PLACE, tool.alias("tool_name"), head.alias("command_head"), F.lit(0).alias("extraction_version"), *[F.lit(None).cast(v).alias(k) for k, v in nothing.items()]).where("tool_name is not null")
    signals = mining.detect_corrections(items).withColumn("extraction_version", F.lit(EXTRACTION_VERSION))
    return {
        "templates": templates, "template_matches": new_matches, "tool_events": upsert_ignore(t["tool_events"], events, PLACE, [F.col("tool_name")]),
        "correction_signals": t["correction_signals"].join(paths, "source_path", "left_anti").unionByName(signals),
    }


#: Kept under its old name: the audit is a step of the lineage.
audit_duplicates = lineage.duplicate_events
