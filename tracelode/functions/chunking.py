"""Chunks of at most a number of tokens as a column expression: a stream of events is built from the text and folded.

Paragraphs that fit are atoms of level 0. One that does not is told as its sentences, atoms of level 1, and a sentence that
does not fit as its words, atoms of level 2. Each level gathers a chunk of its own. What a level has gathered is given out when
the next atom would overflow it, when a part that is too large begins inside it, and when its part ends; a tail of its
words is then the beginning of the level's next chunk, but nothing is carried out of a part that has ended.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

ATOM, GIVE, END = 0, 1, 2


def _trimmed(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _events(kind: int, level: int, texts: Column | None = None) -> Column:
    event = lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), t.alias("text"), T.token_count(t).alias("size"))
    return F.array(event(F.lit(""))) if texts is None else F.transform(texts, event)


def _told(pieces: Column, level: int, limit: int, finer) -> Column:
    """Events of a level's pieces: an atom for each that fits, else the events that `finer` makes of it."""
    return F.flatten(F.transform(pieces, lambda p: F.when(T.token_count(p) <= limit, _events(ATOM, level, F.array(p))).otherwise(F.concat(_events(GIVE, level), finer(p), _events(END, level + 1)))))


def _tail(chunk: Column, overlap: int) -> Column:
    """The words that the next chunk begins with: three for four tokens of overlap, half of them if that is all."""
    words = T.fields(chunk)
    keep = F.when(F.size(words) > overlap * 3 // 4, overlap * 3 // 4).otherwise(F.floor(F.size(words) / 2)).cast("int")
    return F.when(keep > 0, F.array_join(F.slice(words, F.size(words) - keep + 1, keep), " ")).otherwise("")


def chunks(text: Column, limit: int, overlap: int = 0) -> Column:
    """Array of chunks, words never split, joined by blanks. A limit of 0 gives the text as it stands; null and blank texts have
    no chunks; a text that fits is one."""
    if limit <= 0:
        return F.array(text)
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    sentences = lambda p: _trimmed(F.split(p, r"(?<=[.!?])(?=[ \n])|(?<=\n)"))
    by_word = lambda s: _events(ATOM, 2, T.fields(s))
    stream = F.concat(_told(_trimmed(F.split(whole, "\n\n")), 0, limit, lambda p: _told(sentences(p), 1, limit, by_word)), _events(END, 0))

    def step(state: Column, e: Column) -> Column:
        """state: done chunks, then for each level what it has gathered and its size in tokens."""
        at = e["level"] + 1
        now, size = F.element_at(state["now"], at), F.element_at(state["size"], at)
        gives = (now != "") & ((e["kind"] != ATOM) | (size + e["size"] > limit))
        rest = F.when(gives, _tail(now, overlap) if overlap > 0 else F.lit("")).otherwise(now)
        rest = F.when(e["kind"] == END, "").otherwise(rest)
        held = F.when(rest == now, size).otherwise(T.token_count(rest))
        atom = e["kind"] == ATOM
        grown = F.when(atom & (rest != ""), F.concat(rest, F.lit(" "), e["text"])).when(atom, e["text"]).otherwise(rest)
        put = lambda values, value, kind: F.transform(values, lambda v, i: F.when(i == e["level"], value).otherwise(v).cast(kind))
        done = F.when(gives, F.concat(state["done"], F.array(now))).otherwise(state["done"])
        return F.struct(done.alias("done"), put(state["now"], grown, "string").alias("now"), put(state["size"], held + F.when(atom, e["size"]).otherwise(0), "bigint").alias("size"))

    begin = F.struct(F.array().cast("array<string>").alias("done"), F.array(*[F.lit("")] * 3).alias("now"), F.array(*[F.lit(0).cast("bigint")] * 3).alias("size"))
    folded = F.aggregate(stream, begin, step, lambda s: s["done"])
    return F.when(whole == "", F.array().cast("array<string>")).when(T.token_count(whole) <= limit, F.array(whole)).otherwise(folded)
