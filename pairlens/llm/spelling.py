"""Spelling variants: words one edit apart, found by dense tiles of prefix and suffix lengths.

1. Runs of letters are counted as words, all in DataFrame functions; equal words meet as partial counts.
2. Two words of which the longer has m code points differ by one insertion, deletion or replacement exactly if their
   common prefix and suffix together reach m - 1. The edit lies in one of ``SEGMENTS`` stretches of the longer word, so
   both words agree in everything before and after that stretch. Each word is dealt to a group for each stretch, as the
   longer and as the shorter one; words that share a group may be a pair, others cannot.
3. A tile holds whole small groups, or two blocks of a large one. Its words become matrices of code points, padded at the
   right for prefixes and at the left for suffixes; comparing the blocks gives all prefix and suffix lengths at once. A
   pair counts only in the group of the stretch where its prefix ends, so it counts once. A tile returns for each word
   the number of near words and the best of them, never pairs.
4. A word's form is its best near word, if frequent enough. Forms are followed to the last by doubling the steps; counts
   grow along a chain by ``factor`` at least, so a few rounds do.

Groups over ``GROUP`` words are cut into blocks and each pair of blocks is a tile of its own, so a stretch that very many
words share is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed value: letters of a word, after the contract.
LETTERS = r"[A-Za-zÀ-ÿ]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stretches of a word; words of a group that is not cut and of a block; cells of a comparison (pairs by width) at most.
SEGMENTS, GROUP, CELLS = 4, 256, 4_000_000
_TILE = "word string, n_near long, best_n long, best string"
_NAMES = ["word", "n_near", "best_n", "best"]


def typed_words(docs: DataFrame, id_col: str, text_col: str, typo_one_in: int) -> DataFrame:
    """(word) of every run of letters; where ``typo_one_in`` divides the run's checksum with its document, one code point
    is deleted. Null text has no runs; a null id is written as nothing."""
    text, lower = F.col(text_col).cast("string"), F.translate("run", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), lower).otherwise(F.col("run")).alias("run"))
    if not typo_one_in:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    typo = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    return runs.withColumn("h", h).select(F.when(F.col("h") % typo_one_in == 0, typo).otherwise(F.col("run")).alias("word"))


def _groups(words: DataFrame) -> DataFrame:
    """(g, m, seg, word, n): each word in the groups of its stretches, as one of length m or as one shorter."""
    longer = F.col("m")
    start = lambda i: (longer * i / SEGMENTS).cast("int")
    rows = words.withColumn("size", F.length("word")).withColumn("m", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    rows = rows.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    first, after = start(F.col("seg")), longer - start(F.col("seg") + 1)
    # What lies outside the stretch; the numbers of both parts are told by m and seg.
    outside = F.xxhash64("m", "seg", F.col("word").substr(F.lit(1), first), F.col("word").substr(F.col("size") - after + 1, after))
    return rows.where((first <= F.col("size")) & (after <= F.col("size"))).select(outside.alias("g"), F.col("m").cast("int").alias("m"), F.col("seg").cast("int").alias("seg"), "word", "n")


def one_edit(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each left and right word (positions in ``words``): whether they are one edit apart, and where their common
    prefix ends (at most before the last code point of the longer)."""
    width = max(1, words.dtype.itemsize // 4)
    codes = np.ascontiguousarray(words).view(np.uint32).reshape(len(words), width)
    size = np.char.str_len(words)
    place = np.arange(width)[None, :] - (width - size)[:, None]
    back = np.where(place >= 0, np.take_along_axis(codes, np.maximum(place, 0), 1), 0)[:, ::-1]
    common = []
    for m in (codes, back):
        differ = np.ones((len(left), len(right), width + 1), bool)
        np.not_equal(m[left][:, None, :], m[right][None, :, :], out=differ[:, :, :width])
        common.append(differ.argmax(2))
    a, b = size[left][:, None], size[right][None, :]
    longer, shorter = np.maximum(a, b), np.minimum(a, b)
    prefix, suffix = np.minimum(common[0], shorter), np.minimum(common[1], shorter)
    same = (a == b) & (prefix == a)
    return (longer - shorter <= 1) & (prefix + suffix >= longer - 1) & ~same, np.minimum(prefix, longer - 1)


def _side(width: int) -> int:
    return max(1, min(GROUP, int((CELLS / max(1, width)) ** 0.5)))


def _found(words: np.ndarray, n: np.ndarray, g: np.ndarray, m: np.ndarray, seg: np.ndarray, left: np.ndarray, right: np.ndarray, out: dict) -> None:
    """Adds to ``out`` (position: number, best position) what the right words are to the left ones."""
    near, at = one_edit(words, left, right)
    size = np.char.str_len(words)
    longer = np.maximum(size[left][:, None], size[right][None, :])
    # The stretch of ``at`` is the last that starts at or before it: floor(longer * i / SEGMENTS) <= at.
    starts = longer[..., None] * np.arange(SEGMENTS) // SEGMENTS
    mine = (starts <= at[..., None]).sum(-1) - 1
    near &= (g[left][:, None] == g[right][None, :]) & (longer == m[left][:, None]) & (mine == seg[left][:, None])
    rank = np.lexsort((words, -n))
    order = np.empty(len(words), np.int64)
    order[rank] = np.arange(len(words))
    best = np.where(near, order[right][None, :], len(words)).min(1)
    for i, k, b in zip(left, near.sum(1), best):
        if k:
            was = out.get(i, (0, len(words)))
            out[i] = (was[0] + k, min(was[1], b))


def _tile(rows: pa.Table) -> pa.RecordBatch | None:
    """Rows of whole groups, or of the two blocks of one; words of one block are compared with each other only if the
    tile is that block's own."""
    words = np.array(rows["word"].to_pylist())
    n, g, m, seg = (rows[c].to_numpy() for c in ("n", "g", "m", "seg"))
    i, j, part = (rows[c].to_numpy() for c in ("i", "j", "part"))
    out: dict[int, tuple[int, int]] = {}
    step = _side(words.dtype.itemsize // 4)
    first, second = (np.arange(len(words)),) * 2 if i[0] == j[0] else (np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0]))
    for x in range(0, len(first), step):
        for y in range(0, len(second), step):
            a, b = first[x : x + step], second[y : y + step]
            _found(words, n, g, m, seg, a, b, out)
            if i[0] != j[0]:
                _found(words, n, g, m, seg, b, a, out)
    if not out:
        return None
    best = np.lexsort((words, -n))[[b for _, b in out.values()]]
    return pa.RecordBatch.from_arrays([pa.array(words[list(out)].tolist()), pa.array([k for k, _ in out.values()], pa.int64()), pa.array(n[best], pa.int64()), pa.array(words[best].tolist())], names=_NAMES)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by width and group; small groups share a tile, groups never meet half."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        keys = np.stack([table[c].to_numpy() for c in ("m", "g", "i", "j")])
        at = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, len(table)]
        own = (keys[2] != keys[3]) | (table["parts"].to_numpy() > 1)  # tiles of cut groups stand alone
        done, start = [], 0
        for k in range(1, len(at) - (not last)):
            alone = own[at[k - 1]] or (k + 1 < len(at) and own[at[k]])
            if alone or at[k] - start >= min(64, _side(int(keys[0, at[k] - 1]))):
                done.append(table.slice(start, at[k] - start))
                start = at[k]
        if last and start < len(table):
            done.append(table.slice(start))
            start = len(table)
        return done, table.slice(start)

    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= 4096:
            tiles, rest = cut(pa.Table.from_batches(held), False)
            held = rest.to_batches()
            yield from filter(None, map(_tile, tiles))
    if sum(len(x) for x in held):
        yield from filter(None, map(_tile, cut(pa.Table.from_batches(held), True)[0]))


def _last(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): forms followed to the end, twice as many steps each round."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = scratch.save(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")))
        if not longer.where("more").limit(1).count():
            return now
        now = longer.drop("more")


def group_variants(words: DataFrame, scratch: Scratch, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of different words with their numbers (word, n)."""
    dealt = scratch.save(_groups(words))
    large = scratch.save(dealt.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > GROUP))
    if large.limit(1).count():
        few = large.count() <= 500_000  # 16 bytes a row
        placed = dealt.join(F.broadcast(large) if few else large, "g", "left")
        parts = F.coalesce(F.ceil(F.col("members") / GROUP), F.lit(1)).cast("int")
        placed = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        placed = dealt.withColumns({"parts": F.lit(1), "part": F.lit(0), "other": F.lit(0)})
    tiles = placed.select("m", "g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "parts", "seg", "word", "n")
    tiles = tiles.repartition("m", "g", "i", "j").sortWithinPartitions("m", "g", "i", "j")
    near = tiles.mapInArrow(_tiles, _TILE).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
    near = scratch.save(near)
    full = words.join(near, "word", "left")
    ok = -F.col("b.n") >= factor * F.col("n")
    full = scratch.save(full.select("word", F.when(ok, F.col("b.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, -F.col("b.n")).alias("form_n")))
    roots = _last(full.where("form is not null"), scratch)
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 6,
    least_count: int = 5,
    factor: int = 5,
    typo_one_in: int = 0,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least_length`` code points and ``least_count`` occurrences.

    Words are runs of letters, A to Z in lower case. ``form``: the most frequent word one edit away (ties: smallest in
    code-point order) if it occurs ``factor`` times as often, else null; ``root``: the last word that forms lead to, the
    word itself without. ``typo_one_in`` plants deletions (see ``typed_words``). Null and empty texts have no words; rows
    with equal ids or texts each count; an empty table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = typed_words(docs, id_col, text_col, typo_one_in).where(F.length("word") >= least_length)
    words = scratch.save(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))
    return group_variants(words, scratch, factor)
