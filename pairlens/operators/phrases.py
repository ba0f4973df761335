"""Which of many phrases and words stand in which of many texts, without holding each against each.

Phrases of ``HELD`` characters in all are one automaton, with which every text is read once. Of more phrases, those with a
blank are looked up by keys: a blank with up to three characters on either side is a key that every text with the phrase
has too. Keys of texts that no phrase has leave at once; a phrase is looked up by its rarest key, and only if all its keys
occur; a text then meets its own candidates once. The commonest phrases, whose keys half the texts may have, and phrases
without a blank are automata again, so no key of many texts is ever joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import writers as W

#: Characters on each side of a blank; keys that are broadcast at most (8 bytes each); characters of the phrases of one
#: automaton, which every task builds (some 100 bytes each).
SIDE, FEW, HELD = 3, 1_000_000, 500_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _save(df: DataFrame) -> DataFrame:
    return W.snapshot(df, W.shared_path(df.sparkSession, "phrases"))


def _key(before: Column, a: Column, after: Column, b: Column) -> Column:
    return F.xxhash64(F.concat(F.right(before, a), F.lit(" "), F.left(after, b)))


def _automaton(phrases: list[tuple]):
    """An automaton of (pid, phrase) whose values are the ids of a phrase."""
    import ahocorasick

    look = ahocorasick.Automaton()
    for pid, q in phrases:
        look.add_word(q, look.get(q, ()) + (pid,))
    look.make_automaton()
    return look


def _standing(look, text: str) -> set[tuple]:
    hits, distinct = set(), len(look)
    for _, ids in look.iter(text) if distinct else ():
        hits.add(ids)
        if len(hits) == distinct:
            break
    return hits


def _pairs(found: set[tuple], ids: pa.Schema) -> pa.RecordBatch:
    pids, ofs = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(pids, ids.field(0).type), pa.array(ofs, ids.field(1).type)], schema=ids)


def _held(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits of phrases of ``HELD`` characters at most, each once for a batch of texts; the phrases are read into the
    driver and sent to the tasks."""
    listed = [(r.pid, r.q) for r in phrases.select("pid", "q").collect()]
    everywhere = [p for p, q in listed if q == ""]
    schema = T.StructType([phrases.schema["pid"], T.StructField("of", texts.schema["of"].dataType)])
    ids = to_arrow_schema(schema)
    sent = phrases.sparkSession.sparkContext.broadcast([(p, q) for p, q in listed if q != ""])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = None
        for batch in batches:
            look = _automaton(sent.value) if look is None else look
            found = set()
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((p, of) for p in everywhere)
                found.update((p, of) for ids in _standing(look, text) for p in ids)
            yield _pairs(found, ids)

    return texts.select("of", "t").mapInArrow(read, schema)


def _by_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, of) of the candidates (id, phrase) that stand in their text."""
    for batch in batches:
        found = set()
        for of, text, cand in zip(*(batch.column(c).to_pylist() for c in range(3))):
            found.update((p, of) for ids in _standing(_automaton([(c["pid"], c["q"]) for c in cand]), text) for p in ids)
        yield _pairs(found, pa.schema([("pid", batch.column(2).type.value_type.field("pid").type), ("of", batch.column(0).type)]))


def phrase_hits(phrases: DataFrame, texts: DataFrame, of: str = "tid") -> DataFrame:
    """(pid, ``of``) of every phrase ``q`` of (pid, q) that stands verbatim in a text ``t`` of (tid, t), each pair once.

    ``of`` names the column of ``texts`` to return: their own id, or a group of theirs, which then is a row only once.
    Ids (string, int or long) are unique. Null phrases and texts hit nothing; an empty phrase stands in every text.
    """
    phrases = _save(phrases.where("q is not null").select("pid", "q"))
    texts = texts.where("t is not null").select("tid", "t", F.col(of).alias("of"))
    blank = "q like '% %'"
    size = F.coalesce(F.sum(F.length("q") + 1), F.lit(0))
    few, many = phrases.agg(size, F.coalesce(F.sum(F.when(~F.expr(blank), F.length("q") + 1)), F.lit(0))).first()
    if few <= HELD:
        out = _held(phrases, texts)
    else:
        parts = [*_by_keys(phrases.where(blank), texts)]
        blocks = -(-many // (HELD // 2))  # twice as many as would do, as hashes do not cut evenly
        for k in range(blocks):
            parts.append(_save(_held(phrases.where(~F.expr(blank)).where(F.pmod(F.xxhash64("pid"), F.lit(blocks)) == k), texts)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
    out = out.withColumnRenamed("of", of)
    return out if of == "tid" else out.distinct()


def _by_keys(phrases: DataFrame, texts: DataFrame) -> list[DataFrame]:
    own = F.split("q", " ", -1)
    cut = lambda w, i: F.struct(F.least(F.length(F.get(w, i - 1)), F.lit(SIDE)).alias("a"), F.least(F.length(F.get(w, i)), F.lit(SIDE)).alias("b"), F.get(w, i - 1).alias("x"), F.get(w, i).alias("y"))
    cuts = phrases.select("pid", F.explode(F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda i: cut(own, i))).alias("c"))
    cuts = _save(cuts.select("pid", "c.a", "c.b", _key(F.col("c.x"), F.col("c.a"), F.col("c.y"), F.col("c.b")).alias("h")).distinct())
    sides = sorted((r.a, r.b) for r in cuts.select("a", "b").distinct().collect())  # 16 at most
    if not sides:
        return []
    w = F.split("t", " ", -1)

    def keys(i: Column) -> Column:
        x, y = F.get("w", i - 1), F.get("w", i)
        return F.array(*[F.when((F.length(x) >= a) & (F.length(y) >= b), _key(x, F.lit(a), y, F.lit(b))) for a, b in sides])

    found = texts.where("t like '% %'").select("tid", w.alias("w"))
    found = found.select("tid", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), keys)))).alias("h"))
    seen = _save(found.join(_few(cuts.select("h").distinct()), "h"))
    n = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = cuts.join(n, "h", "left").groupBy("pid").agg(F.min(F.struct("n", "h")).alias("m"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all")
    rarest = _save(rarest.select("pid", F.col("m.h").alias("h"), F.floor(F.log2("m.n")).cast("int").alias("scale")).join(phrases, "pid"))
    # The commonest phrases, whole powers of two at a time, as long as one automaton holds them.
    scales = sorted(((r.scale, r.size) for r in rarest.groupBy("scale").agg(F.sum(F.length("q") + 1).alias("size")).collect()), reverse=True)
    common, size = None, 0
    for scale, more in scales:  # 63 at most
        size += more
        if size > HELD:
            break
        common = scale
    rare = rarest if common is None else rarest.where(F.col("scale") < common)
    cand = seen.join(_few(rare.select("pid", "h")), "h").select("tid", "pid").join(phrases, "pid").groupBy("tid").agg(F.collect_list(F.struct("pid", "q")).alias("cand"))
    schema = T.StructType([phrases.schema["pid"], T.StructField("of", texts.schema["of"].dataType)])
    out = [texts.join(_save(cand), "tid").select("of", "t", "cand").mapInArrow(_by_candidates, schema)]
    return out if common is None else [*out, _held(rarest.where(F.col("scale") >= common), texts)]


#: A word of letters, digits and underscores, as a pattern for what lies between words.
NO_WORD = r"[^\p{L}\p{N}_]+"


def word_hits(words: DataFrame, texts: DataFrame, of: str = "tid") -> DataFrame:
    """(pid, ``of``) of every word ``q`` of (pid, q) that stands in a text ``t`` of (tid, t) as a whole word, each pair once.

    ``of`` as in :func:`phrase_hits`.
    """
    found = texts.where("t is not null").select(of, F.explode(F.array_distinct(F.split("t", NO_WORD, -1))).alias("q")).where("q <> ''")
    out = found.join(_few(words.where("q <> ''").select("pid", "q")), "q").select("pid", of)
    return out if of == "tid" else out.distinct()
