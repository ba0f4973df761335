"""SentencePiece encoding and decoding with a table of each prefix's last token.

For a merge-type (BPE) vocabulary the encoding of a prefix of a text ends in exactly one token: the one that matches
there and may stand after the last token of the prefix before it. An Aho-Corasick automaton gives the matches at each
position, longest first; whether two tokens may stand side by side is found once for each pair, from the pieces at the
border while the two are merged, and remembered. The table is filled from left to right and the ids are read from it
backwards, so a text of any length takes time in proportion to it. Runs of two or more word-start marks, whose pieces in
such vocabularies are not in merge order, are merged directly.

Text is cut where no piece can reach across: before a word-start mark, around line ends, and before signs at the end of
a word. Chunks and pairs are remembered up to a fixed number, and those that come again outlive the others. Nothing else
is kept, and rows never meet, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks and pairs of tokens that a worker remembers at most.
CACHE, PAIRS = 300_000, 1_000_000


class Memory:
    """Values by key, the last ``size`` at least: when the young half is full it becomes the old one, and what is asked
    for again comes back from there, so frequent keys stay and rare ones go."""

    def __init__(self, size: int) -> None:
        self.half, self.young, self.old = size // 2, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value


class PieceModel:
    """Vocabulary of a SentencePiece BPE model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.length = [len(p) for p in self.pieces]
        self.text = [str(i) for i in range(n)]
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.marked = [not s and p.startswith(MARK) for s, p in zip(special, self.pieces)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece reaches across words or lines; this vocabulary cannot be cut there")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.known = {p for p in self.ids if len(p) == 1}
        #: Neighbouring characters inside pieces: between any others no piece can reach across.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.signs = "".join(c for c in self.known if not c.isalnum() and c != MARK)
        self.pairs, self.chunks = Memory(PAIRS), Memory(CACHE)
        self.edges: dict[int, tuple | None] = {}
        self.odd = re.compile("[^" + "".join(map(re.escape, sorted(self.known))) + "]")
        self.cut = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

    def merge(self, s: str, seen=None) -> list[str]:
        """Pieces of a string by merging the best-ranked neighbours first, leftmost at a tie; each merge is told to
        ``seen`` as rank, start and end of the two, and the two."""
        parts: list[str | None] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if after[i] < len(s) and (r := self.rank.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, both))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            r, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(s) or parts[j] is None or parts[i] + parts[j] != both:
                continue
            if seen:
                seen(r, i, i + len(both), parts[i], parts[j])
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(s):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _edges(self, i: int) -> tuple | None:
        """The pieces at the left and at the right end of a token while it is merged, each with the rank of the merge
        that uses it up (none for the token itself); None if the token's text is not encoded as this one token."""
        if i not in self.edges:
            s = self.pieces[i]
            left, right = [], []

            def seen(r: float, start: int, end: int, a: str, b: str) -> None:
                if start == 0:
                    left.append((a, r))
                if end == len(s):
                    right.append((b, r))

            whole = self.merge(s, seen) == [s]
            self.edges[i] = (left + [(s, math.inf)], right + [(s, math.inf)]) if whole else None
        return self.edges[i]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' text is the two tokens.

        While both are merged side by side, the pieces that meet at the border stay apart as long as each is used up
        by its own token's next merge before they would merge with each other; at a tie the merge further left is first.
        """
        a, b = self._edges(left), self._edges(right)
        if a is None or b is None:
            return False
        i = k = 0
        while True:
            (x, until_x), (y, until_y) = a[1][i], b[0][k]
            r = self.rank.get(x + y)
            if r is not None and r < until_x and r <= until_y:
                return False
            if until_x <= until_y:
                if until_x == math.inf:
                    return True
                i += 1
            else:
                k += 1

    def _known(self, s: str) -> list[int]:
        if s[:1] == MARK == s[1:2]:
            return [self.ids[p] for p in self.merge(s)]
        ids = self.ids
        if (whole := ids.get(s)) is not None and self._edges(whole):
            return [whole]
        # Single characters are not matched: one stands where nothing longer fits.
        last = [-1] * len(s)
        pairs, get = self.pairs, self.pairs.young.get
        for end, (i, n) in self.automaton.iter(s):
            if last[end] < 0:
                at = end - n
                if at >= 0:
                    before = last[at]
                    if before < 0:
                        before = last[at] = ids[s[at]]
                    ok = get(key := before << 20 | i)
                    if ok is None:
                        ok = pairs.put(key, self.fits(before, i) if (was := pairs.old.get(key)) is None else was)
                        get = pairs.young.get
                    if not ok:
                        continue
                last[end] = i
        out, at, length = [], len(s) - 1, self.length
        while at >= 0:
            i = last[at]
            if i < 0:
                i = ids[s[at]]
            out.append(i)
            at -= length[i]
        return out[::-1]

    def _chunk(self, s: str) -> tuple[int, ...]:
        out: list[int] = []
        at = 0
        for m in self.odd.finditer(s):
            if m.start() > at:
                out += self._known(s[at : m.start()])
            out += [self.byte[b] for b in m[0].encode()] if self.byte else [self.unknown]
            at = m.end()
        if at < len(s):
            out += self._known(s[at:])
        return tuple(out)

    def _remember(self, key: str, s: str) -> tuple[int, ...]:
        """Ids of a chunk. Signs at its end go apart if no piece reaches across, so that what is kept are words."""
        chunks = self.chunks
        if (found := chunks.young.get(key)) is not None:
            return found
        if (found := chunks.old.get(key)) is not None:
            return chunks.put(key, found)
        k = len(key.rstrip(self.signs))
        if 0 < k < len(key) and key[0] != "\0" and key[k - 1 : k + 1] not in self.joined:
            return self._remember(key[:k], s[: k - len(key)]) + self._remember("\0" + key[k:], key[k:])
        return chunks.put(key, self._chunk(s))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text as the library's encode() gives them; none for null or empty text."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or "\0" in text:
            parts = self.cut.findall(MARK + text.replace(" ", MARK))
            return list(chain.from_iterable(self._remember(MARK + p, p) for p in parts))
        # A key is a word after one mark, or a line end and the word right after it.
        parts = text.replace("\n", " \n").split(" ")
        found = list(map(self.chunks.young.get, parts))
        if None in found:
            for k, p in enumerate(parts):
                if found[k] is None:
                    found[k] = self._remember(p, p if p[:1] == "\n" else MARK + p)
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library's decode() gives it."""
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if self.raw[i]), None)
        return out[1:] if first is not None and self.marked[first] else out


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(text: Column, path: str) -> Column:
    """Column of ids (array of int) for a column of texts; empty for null or empty text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([m.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def decode_ids(ids: Column, path: str) -> Column:
    """Column of texts for a column of ids; empty for null."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([m.decode(x or []) for x in lists.to_pylist()], pa.string())

    return texts(ids)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; texts are encoded and decoded in one pass.

    Null text counts as empty: no ids, digests of the empty string. Ids may be null and repeat; other columns are
    ignored, whatever their names. An empty table gives an empty table.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = m.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(m.text.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
