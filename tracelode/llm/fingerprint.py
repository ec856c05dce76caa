"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

The canonical form is NFKC, then full case folding, then NFKC again, with white space folded. Spark has no function for the
first two, but its own class path holds ICU, whose static methods the SQL function java_method calls inside the JVM. The
digest is 128 bits of xxhash. Inside buckets of equal digests the canonical bytes are compared; a bucket whose texts differ
gets its digests widened by sha-256, so equal fingerprints mean equal canonical texts.

Each text is made canonical once, and its edited text once. Only members of buckets of two or more are made canonical again,
to be compared: a bitmap of fixed size tells them from the others without a join, and a wrong positive of the bitmap is a
bucket of one, which does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bitmap, in_bitmap, stored

#: What Unicode calls white space once NFKC has made the other kinds blanks.
_SPACE = "\\x09-\\x0D\\x1C-\\x1F\\x85\\u1680\\u2028\\u2029"


def canonical(text: Column) -> Column:
    """Unicode normalised, case- and white-space-folded text; null: empty. Texts of ASCII alone need no tables.

    The expression counts as non-deterministic, so Spark computes it where it stands and never twice.
    """
    text = F.coalesce(text, F.lit(""))
    composed = lambda t: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    any_case = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(composed(folded))
    # single blanks, most white space, match nothing and are not copied one by one
    return F.trim(F.regexp_replace(any_case, f"[{_SPACE}][{_SPACE} ]*| [{_SPACE} ]+", " "))


def _digested(df: DataFrame, text: str, a: str, b: str, bits: int) -> DataFrame:
    """df with the digest of column `text` as longs a and b, the lowest `bits` bits of each half."""
    df = df.withColumn("canon", canonical(F.col(text)))
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    return df.withColumns({a: F.xxhash64("canon").bitwiseAND(mask), b: F.xxhash64(F.lit(0x5BD1E995), "canon").bitwiseAND(mask)}).drop("canon")


def _tree(value: Column, bounds: list[int], lo: int, hi: int) -> Column:
    """Number of bounds <= value, by nested comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value < bounds[mid], _tree(value, bounds, lo, mid)).otherwise(_tree(value, bounds, mid + 1, hi))


def _cells(base: DataFrame, cells: int) -> Column:
    """A cell number for each row, ascending with (key, tie): quantiles cut the keys, equal steps cut between quantiles, and
    a key that spans quantiles is cut by steps of its ties, which are hashes."""
    coarse = min(128, cells)
    got = base.agg(F.percentile_approx("key", [i / coarse for i in range(coarse + 1)], 10_000).alias("q")).collect()[0]["q"] or [0]
    bounds = sorted(set(got))
    starts, spans, parts, points = [], [], [], []
    fine = max(1, -(-cells // len(bounds)))
    for i, b in enumerate(bounds):
        times = got.count(b)
        if times > 1:
            starts.append(b), spans.append(1.0), parts.append(fine * times), points.append(True)
        if i + 1 < len(bounds) or times == 1:
            starts.append(b + (times > 1)), spans.append(float(max(1, bounds[min(i + 1, len(bounds) - 1)] - b))), parts.append(fine), points.append(False)
    firsts = [sum(parts[:i]) for i in range(len(parts))]
    at = _tree(F.col("key"), starts[1:], 0, len(starts) - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at + 1)
    within = F.when(pick(points), F.col("tie").cast("double") / 2.0**64 + 0.5).otherwise((F.col("key").cast("double") - pick([float(s) for s in starts])) / pick(spans))
    return (pick(firsts) + F.least(F.greatest(F.floor(within * pick(parts)), F.lit(0)), pick(parts) - 1)).cast("int")


def _told(docs: DataFrame, cells: int, bits: int) -> DataFrame:
    """A row for each row: its digest (a, b), the next document's (na, nb) and the edited text's (ea, eb), with the hashes of
    the texts that they come from (kind, nkind, ekind)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    cell = _cells(base, cells)
    firsts = stored(base.select("key", "tie", cell.alias("cell")).groupBy("cell").agg(F.min(F.struct("key", "tie")).alias("first")), "firsts")
    # each cell's first document is copied to the cell before it, that of the first cell to the last
    order = sorted((r["cell"], *r["first"]) for r in firsts.collect())  # one row for each cell
    copies = spark.createDataFrame([(key, tie, order[i - 1][0], int(i == 0)) for i, (_, key, tie) in enumerate(order)], "key bigint, tie bigint, cell int, wrap int")
    borrowed = base.join(F.broadcast(copies), ["key", "tie"]).groupBy("key", "tie", "cell", "wrap").agg(F.first("text").alias("text"))
    borrowed = borrowed.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", "tie", "cell", "wrap", F.lit(True).alias("copy"))
    rows = base.select("doc_id", "text", "key", "tie", cell.alias("cell"), F.lit(0).alias("wrap"), F.lit(False).alias("copy")).unionByName(borrowed)
    rows = _digested(rows, "text", "a", "b", bits)
    after = Window.partitionBy("cell").orderBy("wrap", "key", "tie", "copy")
    half = F.floor(F.char_length("text") / 2).cast("int")
    paired = rows.withColumns({"next_text": F.lead("text").over(after), "na": F.lead("a").over(after), "nb": F.lead("b").over(after), "nkind": F.lead("tie").over(after)}).where(~F.col("copy"))
    edited = F.concat(F.left(F.col("text"), F.char_length("text") - half), F.left(F.col("next_text"), half))
    done = paired.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "a", "b", F.col("tie").alias("kind"), "na", "nb", "nkind", edited.alias("edited"))
    done = _digested(done, "edited", "ea", "eb", bits)
    return stored(done.withColumn("ekind", F.xxhash64("edited")).withColumn("edited_sha256", F.sha2("edited", 256)), "told", compression="zstd")


def _collided(docs: DataFrame, told: DataFrame, bits: int) -> DataFrame:
    """(a, b, kind, sha): digests that different canonical texts share, with the sha-256 of each such text; empty but for a miracle.

    Buckets are counted by digests alone. The members of buckets of two or more are then compared as bytes: a smallest and
    a largest text for each task, so that a bucket of any size costs one row a task.
    """
    digests = told.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("ea").alias("a"), F.col("eb").alias("b")))).alias("d")).select("d.*")
    shared = bitmap(digests.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("a", "b").alias("h")))
    originals = in_bitmap(told.select("kind", F.xxhash64("a", "b").alias("h")), "h", shared)
    kinds = bitmap(originals.select(F.col("kind").alias("h")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = in_bitmap(docs.select(text.alias("text"), F.xxhash64(text).alias("kind")), "kind", kinds)
    edited = in_bitmap(told.select(F.col("edited").alias("text"), F.col("ekind").alias("kind"), F.xxhash64("ea", "eb").alias("h")), "h", shared).select("text", "kind")
    members = _digested(again.unionByName(edited).withColumn("canon_text", canonical(F.col("text"))), "canon_text", "a", "b", bits)
    ends = members.groupBy("a", "b").agg(F.min("canon_text").alias("low"), F.max("canon_text").alias("high"))
    found = stored(ends.where("low <> high").select("a", "b"), "collided")
    if found.isEmpty():
        return found.withColumns({"kind": F.lit(0).cast("long"), "sha": F.lit("")})
    return stored(members.join(found, ["a", "b"]).select("a", "b", "kind", F.sha2("canon_text", 256).alias("sha")).distinct(), "longer")


def _hex(a: str, b: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)]))


def fingerprint_documents(docs: DataFrame, cells: int | None = None, digest_bits: int = 128) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in ascending doc_id; the last document's next is the first. Likeness is 1.0 for equal fingerprints, else 0.0: the digest
    is exact. Null texts are empty. Null ids come first; rows of one id are ordered by a hash of their text. A single row is
    its own next; an empty table gives an empty one. Rows equal in id and text share a cell, which is streamed.

    A fingerprint is 32 hex digits; 64 of sha-256 follow where canonical texts differ and their digests do not. Fewer
    `digest_bits` make that happen on purpose.
    """
    spark = docs.sparkSession
    bits = digest_bits // 2
    told = _told(docs, cells or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), bits)
    longer = _collided(docs, told, bits)
    columns = {"fingerprint": ("a", "b", "kind"), "edited_fingerprint": ("ea", "eb", "ekind"), "next": ("na", "nb", "nkind")}
    out = told.drop("edited")
    if longer.isEmpty():
        out = out.withColumns({name: _hex(a, b) for name, (a, b, _) in columns.items()})
    else:
        for name, (a, b, kind) in columns.items():
            more = longer.select(F.col("a").alias(a), F.col("b").alias(b), F.col("kind").alias(kind), F.col("sha").alias(f"sha_{name}"))
            out = out.join(more, [a, b, kind], "left").withColumn(name, F.concat(_hex(a, b), F.coalesce(f"sha_{name}", F.lit(""))))
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next").alias("near_next"))
