import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.llm.sentencepiece_bpe import PieceModel, decode_ids, encode_texts, token_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
OURS, THEIRS = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(text):
    ids = THEIRS.encode(text)
    assert OURS.encode(text) == ids, repr(text)
    assert OURS.decode(ids) == THEIRS.decode(ids), repr(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" ▁\na.é€<0xA>\t", max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(OURS.pieces[3 + 256 : 6000]), max_size=8))
def test_glued_pieces(pieces):
    same("".join(pieces))


@pytest.mark.parametrize("text", ["", " ", "  ", " " * 37 + "x" + " " * 16, "\n\n a", "a \n b", "x" * 5000, "ab" * 3000 + " " * 999, "▁x", "日本語の文章 と 🙂🙂"])
def test_fixed_texts(text):
    same(text)


def test_random_letters():
    rng = random.Random(1)
    for _ in range(3000):
        same("".join(rng.choices("etaoinshrdlu  \n.,;", k=rng.randrange(60))))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, None), (5, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionAll(extra).withColumn("n_tokens", F.lit("clash"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = THEIRS.encode(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(THEIRS.decode(ids))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in token_digests(docs, PATH).collect()]
    assert sorted(got) == sorted(want)
    assert token_digests(docs.limit(0), PATH).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("a b\nc",), (None,), ("",)], "t string")
    out = df.select("t", encode_texts(F.col("t"), PATH).alias("ids")).select("t", "ids", decode_ids(F.col("ids"), PATH).alias("back")).collect()
    for r in out:
        assert list(r.ids) == THEIRS.encode(r.t or "")
        assert r.back == (r.t or "")


def test_pairs_by_the_border_equal_pairs_by_merging():
    rng = random.Random(3)
    whole = [i for p, i in OURS.ids.items() if not p.startswith("▁▁")]
    for _ in range(20_000):
        a, b = rng.choice(whole), rng.choice(whole)
        assert OURS.fits(a, b) == (OURS.merge(OURS.pieces[a] + OURS.pieces[b]) == [OURS.pieces[a], OURS.pieces[b]])


def test_words_with_signs_and_small_memories(monkeypatch):
    monkeypatch.setattr("pairlens.llm.sentencepiece_bpe.CACHE", 8)
    monkeypatch.setattr("pairlens.llm.sentencepiece_bpe.PAIRS", 8)
    small, rng = PieceModel(PATH), random.Random(5)
    bits = ["the", "House", "l'", "d’eau", ",", ".", "),", "...", "'s", "%", "$$", "\n", "\0", "é", "1", "2,5", "(", "«", "»", "🙂", "—"]
    for _ in range(3000):
        text = " ".join("".join(rng.choices(bits, k=rng.randrange(1, 5))) for _ in range(rng.randrange(6)))
        assert small.encode(text) == THEIRS.encode(text), repr(text)
