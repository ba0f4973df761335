import hashlib
from collections import Counter

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairlens.llm.queries import op13_token_alignment
from pairlens.llm.token_alignment import ByteVocabulary, align_tokenizers, byte_alphabet

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoders():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, encoders):
    """The contract, token by token."""
    t, sp = encoders
    letters = byte_alphabet()
    out, links = [], []
    for i, text in rows:
        a = b = ()
        if text:
            ia, ib = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ba = [bytes(letters[c] for c in t.id_to_token(x)) for x in ia]
            bb = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in ib]
            if b"".join(ba) == b"".join(bb) == b" " + text.encode():
                a, b = list(zip(ia, ba)), list(zip(ib, bb))
        spans = []
        for side in (a, b):
            at, s = 0, []
            for x, raw in side:
                s.append((at, at + len(raw), x))
                at += len(raw)
            spans.append(s)
        both = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups = []
        for side in spans:
            g, now = [], []
            for _, e, x in side:
                now.append(str(x))
                if e in both:
                    g.append(",".join(now))
                    now = []
            groups.append(g)
        text = ";".join(f"{x}|{y}" for x, y in zip(*groups))
        linked, j = [], 0
        for s, e, x in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                linked.append((x, spans[1][k][2]))
                k += 1
        links.append(linked)
        out.append([i, len(a), len(b), len(both), len(linked), 0, 0, hashlib.sha256(text.encode()).hexdigest() if a else ""])
    count = Counter(p for x in links for p in set(x))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    for row, x in zip(out, links):
        row[5], row[6] = sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x)
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, "plain words and more words"), (3, "plain words and more words"), (None, "no id"), (4, "a <|endoftext|> b <s> </s> <unk> <0x41>"), (5, "▁ mark"),
    (6, "  two  spaces\n\n\tand lines "), (7, "日本語 🙂‍🙂 é\u0000 x"), (8, "x" * 30_000), (9, " " * 20_000 + "end"), (10, " "), (11, "word " * 20_000),
]


def test_odd_texts(spark, encoders):
    df = spark.createDataFrame([(*r, 7) for r in ODD], SCHEMA + ", n_a int").repartition(3)
    assert got(align_tokenizers(df, A, B)) == brute(ODD, encoders)


def test_small_chunks_give_the_same(spark, encoders, monkeypatch):
    import pairlens.llm.token_alignment as m

    monkeypatch.setattr(m, "CHUNK_BYTES", 20)
    rows = [(i, f"the {'same' if i % 3 else 'other'} words, number {i % 4}") for i in range(40)]
    assert got(align_tokenizers(spark.createDataFrame(rows, SCHEMA).repartition(7), A, B)) == brute(rows, encoders)


def test_empty(spark):
    assert got(align_tokenizers(spark.createDataFrame([], SCHEMA), A, B)) == []


def test_whole_table(spark, sf, encoders):
    t = pq.read_table(f"{sf}/documents.parquet")
    assert got(op13_token_alignment(spark, sf)) == brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())), encoders)


def test_ids_are_the_libraries(encoders):
    v = ByteVocabulary(A)
    for x in (" it's 12'th x   y", " \n\n a", " ÀÉ ß ﬁ ٣ ½", " a" + "​" * 5 + "\x85 b"):
        assert v.encode(x).tolist() == encoders[0].encode(x, add_special_tokens=False).ids


def test_no_document_has_tokens(spark, encoders):
    rows = [(1, None), (2, ""), (3, "▁"), (None, None)]
    assert got(align_tokenizers(spark.createDataFrame(rows, SCHEMA).repartition(2), A, B)) == brute(rows, encoders)
