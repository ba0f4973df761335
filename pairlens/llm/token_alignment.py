"""Cross-tokenizer alignment with Arrow tables: which tokens of two vocabularies cover the same bytes of a text.

1. A task closes a chunk after ``CHUNK_BYTES`` of text. The token ids of a chunk are list arrays; flattened, with parent
   indices, their byte lengths give ends by a segmented cumulative sum. Documents whose tokens do not give back the
   text have no tokens. A hash join of both sides on document-end keys (full outer) has one row for each stretch of bytes
   between neighbouring ends: exactly one overlapping pair of tokens, so these rows are the links. Ends on both sides cut
   the groups.
2. ``Table.group_by`` counts each pair once for each document, then the documents of each pair in the chunk. A chunk is
   one row: the pairs with their partial counts, and what its documents need later as a compressed Arrow stream.
3. Spark adds up the partial counts (a pair has one row for each chunk, however often it occurs), takes each A id's
   highest, and sends the sums back to the chunks, which finish their documents. Nothing is tokenized twice.

A table of A ids is broadcast: it has one row for each A token at most, so the vocabulary bounds it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Text bytes after which a chunk is closed, and documents in a chunk at most.
CHUNK_BYTES, CHUNK_DOCS = 2 << 20, 50_000
#: Fixed value: how the byte-level vocabulary splits a text before it merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with such a run of white space go to the slower encoder, which needs no stack for it.
BLANK = re.compile(r"\s{10000}")
CHUNKS = "chunk long, pair array<bigint>, docs array<int>, body binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level BPE vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model.get("added_tokens", [])}
        letters, merges = byte_alphabet(), model["model"]["merges"]
        ids = model["model"]["vocab"]
        raw = {i: bytes(letters[c] for c in t) for t, i in ids.items() if i not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        if any(ids[a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
            raise ValueError("ids of this vocabulary are not in merge order")
        self.bytes = pa.array([raw.get(i, b"") for i in range(max(ids.values()) + 1)], pa.binary())
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={})
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        if not BLANK.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)


class PieceVocabulary:
    """A SentencePiece vocabulary that sets a space before the text; U+2581 stands for a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = pa.array([piece(i) for i in range(sp.get_piece_size())], pa.binary())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.sp.encode(text), np.int32)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32()))


def _gives(ids: pa.ListArray, raw: pa.Array, want: pa.Array) -> pa.Array:
    """Whether the bytes of each document's tokens are the wanted ones."""
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, raw.take(ids.values)), b"")
    return pc.equal(joined, want)


def _ends(ids: pa.ListArray, raw: pa.Array, name: str) -> pa.Table:
    """(key, name) of each token: document and end within it in one number, and the id."""
    flat, parent = ids.flatten(), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.binary_length(raw).take(flat).cast(pa.int64()))
    # What all documents before have; documents without tokens are not here.
    first = np.r_[0, np.flatnonzero(np.diff(parent.to_numpy())) + 1] if len(flat) else np.empty(0, np.int64)
    before = np.r_[0, upto.to_numpy()[first[1:] - 1]] if len(flat) else first
    own = pc.subtract(upto, pa.array(before, pa.int64()).take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent.cast(pa.int64()), 36), own), name: flat})


def _cut(values: pa.Array, last: np.ndarray) -> pa.ListArray:
    """Lists of neighbouring values, each ending where ``last`` is true."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.flatnonzero(last) + 1].astype(np.int32)), values)


def _joined_ids(ids: pa.Array, names: pa.Array, last: np.ndarray) -> pa.Array:
    return pc.binary_join(_cut(names.take(ids), last), ",")


def align(a: pa.ListArray, b: pa.ListArray, raw_a: pa.Array, raw_b: pa.Array) -> dict:
    """Links and groups of documents with tokens on both sides (none empty).

    ``pair`` and ``docs``: each id pair (A id times 2^32 plus B id) with the number of documents that hold it linked;
    ``doc``, ``at``, ``times``: for each document its pairs (positions in ``pair``) and how often they are linked;
    ``groups``: number and text of each document's groups; ``links``: their number.
    """
    left, right = _ends(a, raw_a, "a"), _ends(b, raw_b, "b")
    links = left.join(right, "key", join_type="full outer", use_threads=False)
    # The join gives rows of the left side in order, then the rest: few runs, which a stable sort merges.
    links = links.take(pa.array(np.argsort(np.asarray(links["key"]), kind="stable"))).combine_chunks()
    has_a, has_b = (links[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in "ab")
    doc = pc.shift_right(links["key"], 36)
    # A stretch that ends inside a token belongs to it: the next end on that side, which lies in the same document.
    pair = pc.add(pc.shift_left(pc.fill_null_backward(links["a"]).cast(pa.int64()), 32), pc.fill_null_backward(links["b"]).cast(pa.int64()))
    each = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    each = each.take(pa.array(np.argsort(np.asarray(each["doc"]), kind="stable")))
    total = each.group_by("pair", use_threads=False).aggregate([([], "count_all")])
    both_a, both_b = has_b[has_a], has_a[has_b]  # of each token: whether the other side ends there too
    name = pa.array([str(i) for i in range(max(len(raw_a), len(raw_b)))])
    text = pc.binary_join_element_wise(_joined_ids(a.values, name, both_a), _joined_ids(b.values, name, both_b), "|")
    at = np.asarray(doc)[has_a & has_b]
    groups = pc.binary_join(_cut(text, np.r_[at[1:] != at[:-1], True]), ";")
    return {
        "pair": total["pair"].combine_chunks(), "docs": total["count_all"].combine_chunks().cast(pa.int32()),
        "doc": np.asarray(each["doc"]), "at": pc.index_in(each["pair"].combine_chunks(), total["pair"].combine_chunks()), "times": each["count_all"].combine_chunks().cast(pa.int32()),
        "n_groups": np.bincount(at, minlength=len(a)), "groups": groups, "n_links": np.bincount(np.asarray(doc), minlength=len(a)),
    }


def _chunk(number: int, ids: list, texts: list[str], a: ByteVocabulary, b: PieceVocabulary) -> pa.RecordBatch:
    live = [i for i, t in enumerate(texts) if t]
    la, lb = _lists([a.encode(" " + texts[i]) for i in live]), _lists([b.encode(texts[i]) for i in live])
    want = pa.array([b" " + texts[i].encode() for i in live], pa.binary())
    good = pc.and_(_gives(la, a.bytes, want), _gives(lb, b.bytes, want))
    live = np.array(live, np.int64)[good.to_numpy(zero_copy_only=False)]
    la, lb = la.filter(good), lb.filter(good)
    n = len(ids)
    cols = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    sha, offsets = [""] * n, np.zeros(n + 1, np.int32)
    pair, docs, at, times = pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.int32())
    if len(live):
        found = align(la, lb, a.bytes, b.bytes)
        pair, docs, at, times = found["pair"], found["docs"], found["at"], found["times"]
        cols["n_a"][live], cols["n_b"][live] = pc.list_value_length(la).to_numpy(), pc.list_value_length(lb).to_numpy()
        cols["n_groups"][live], cols["n_links"][live] = found["n_groups"], found["n_links"]
        offsets[1:] = np.cumsum(np.bincount(live[found["doc"]], minlength=n))
        for i, g in zip(live, found["groups"]):
            sha[i] = hashlib.sha256(g.as_buffer()).hexdigest()
    lists = {"at": at, "times": times}
    body = pa.table({"doc_id": pa.array(ids, pa.int64()), **cols, "groups_sha256": sha, **{k: pa.ListArray.from_arrays(pa.array(offsets), v) for k, v in lists.items()}})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(body)
    one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(t))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(pair, pa.int64()), one(docs, pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "pair", "docs", "body"])


def finish(body: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of a chunk with n_best and count_sum; ``counts``: position of a pair, and its corpus-wide count times 2,
    plus 1 where that is its A id's highest."""
    docs = pa.ipc.open_stream(body["body"][0].as_buffer()).read_all().combine_chunks()
    known = np.zeros(len(counts), np.int64)
    known[np.asarray(counts["k"])] = np.asarray(counts["count"])
    at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
    parent, times, value = pc.list_parent_indices(at).to_numpy(), times.flatten().to_numpy().astype(np.int64), known[at.flatten().to_numpy()]
    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(best, parent, times * (value & 1))
    np.add.at(total, parent, times * (value >> 1))
    out = docs.drop_columns(["at", "times"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))
    return out.select(_RESULT.names).cast(_RESULT)


_VOCABULARIES: dict[tuple[str, str], tuple[ByteVocabulary, PieceVocabulary]] = {}


def vocabularies(path_a: str, path_b: str) -> tuple[ByteVocabulary, PieceVocabulary]:
    if (path_a, path_b) not in _VOCABULARIES:
        _VOCABULARIES[path_a, path_b] = ByteVocabulary(path_a), PieceVocabulary(path_b)
    return _VOCABULARIES[path_a, path_b]


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Texts that are null or empty, or that either vocabulary does not give back byte by byte, have zeros and an empty
    digest. Each row is a document, also where ids are null or repeat. Other columns are ignored. An empty table gives
    an empty table.
    """
    scratch = Scratch(docs.sparkSession, "alignment")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabularies(path_a, path_b)
        part, k, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                    yield _chunk((part << 32) | k, ids, texts, a, b)
                    k, size, ids, texts = k + 1, 0, [], []
        if ids:
            yield _chunk((part << 32) | k, ids, texts, a, b)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunked = scratch.save(rows.mapInArrow(chunks, CHUNKS))
    pairs = chunked.select("chunk", F.posexplode(F.arrays_zip("pair", "docs")).alias("k", "x")).select("chunk", "k", F.col("x.pair").alias("pair"), F.col("x.docs").alias("n"))
    summed = scratch.save(pairs.withColumn("total", F.sum("n").over(Window.partitionBy("pair"))).drop("n"))
    first = F.shiftright("pair", 32).cast("int")
    top = summed.groupBy(first.alias("a")).agg(F.max("total").alias("top"))
    counts = summed.withColumn("a", first).join(F.broadcast(top), "a").select("chunk", "k", (2 * F.col("total") + (F.col("total") == F.col("top")).cast("int")).alias("count"))
    return chunked.select("chunk", "body").groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(finish, RESULT)
