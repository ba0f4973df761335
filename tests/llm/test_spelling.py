import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

import pairlens.llm.spelling as m
from pairlens.llm.queries import op12_spelling_variants
from pairlens.llm.spelling import spelling_variants

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, one_in, length=6, count=5):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= length and n >= count}


def edits(w, letters):
    for k in range(len(w) + 1):
        yield w[:k] + w[k + 1 :]
        for c in letters:
            yield w[:k] + c + w[k:]
            yield w[:k] + c + w[k + 1 :]


def brute(words, factor=5):
    letters = sorted({c for w in words for c in w})
    form, near = {}, {}
    for w, n in words.items():
        near[w] = {x for x in edits(w, letters) if x in words and x != w}
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= factor * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def made(seed, few="abé"):
    r = random.Random(seed)
    words = ["".join(r.choice(few) for _ in range(r.randint(6, 9))) for _ in range(60)]
    words += [w[:k] + r.choice("xÿ") + w[k + r.randint(0, 1) :] for w in words[:30] for k in (r.randint(0, len(w)),)]
    return [(i if i % 7 else None, " ".join(r.choices(words, [2.0 ** -(k % 9) for k in range(len(words))], k=120)) + ",Abcdef!") for i in range(40)]


@pytest.mark.parametrize("group", [256, 5])
def test_against_edits(spark, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP", group)
    rows = made(group)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", word string").repartition(5)
    assert got(spelling_variants(df, typo_one_in=7)) == brute(counted(rows, 7))


def test_odd_words(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "Straße straße straße STRASSE À×÷ÿab"), (5, f"{long} {long}x {long[:-1]} q{long}")] + [(6, "letter " * 40 + "lettre lettes leter lettter " * 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(spelling_variants(df, least_count=1)) == brute(counted(rows, 0, count=1))
    assert got(spelling_variants(df.where("doc_id = 6"))) == brute(counted(rows[-1:], 0))
    assert got(spelling_variants(df.limit(0))) == []


def test_chains_lead_to_the_last_form(spark):
    rows = [(1, "abcdefgh " * 5 + "abcdefg " * 25 + "abcdef " * 125 + "abcdex " * 700)]
    found = {r["word"]: r for r in spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["abcdefgh"]["form"] == "abcdefg" and {r["root"] for r in found.values()} == {"abcdex"}


def test_whole_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    words = counted(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())), 199)
    assert got(op12_spelling_variants(spark, sf)) == brute(words)
