import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pairlens.llm.quality import boilerplate_lines, quality_verdicts

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w))


def test_base_on_odd_texts(spark):
    loop = " ".join("abcdefghij")
    texts = [None, "", "  \n\t ", "a\n\na\n a", "#*$ %&|<> é", f"{loop} x {loop} y", (loop + " ") * 9, "w " * 5000, "one two\n" * 30, " ".join(map(str, range(8))) + " z " + " ".join(map(str, range(8)))]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("w", F.lit(1)).withColumn("th", F.lit("x"))
    got = {r.doc_id: tuple(r[k] for k in NAMES) for r in quality_verdicts(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_table_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r[k] for k in NAMES) for r in quality_verdicts(docs).collect()}
    assert got == {r.doc_id: base(r.text) for r in docs.collect()}


def verdicts(rows, min_docs=20, share=0.02, left=0.3, copies_once=False):
    """(id, lost words, kept) by counting documents of each host one by one."""
    doc = lambda i, t: t or "" if copies_once else (i, t or "")
    plain = lambda x: " ".join(re.sub("[1-9]", "0", x.lower()).split(" "))
    norm = lambda x: plain(re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" "))
    docs, holders = defaultdict(set), defaultdict(set)
    for i, t, h in rows:
        docs[h].add(doc(i, t))
        for x in (t or "").split("\n"):
            if norm(x):
                holders[h, norm(x)].add(doc(i, t))
    common = {k for k, v in holders.items() if len(v) >= min_docs and len(v) >= share * len(docs[k[0]])}
    out = []
    for i, t, h in rows:
        n, failed = base(t)[0], base(t)[-1]
        lost = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if (h, norm(x)) in common)
        out.append((str(i), lost, not failed and n - lost >= left * n))
    return sorted(out)


def test_verdicts_against_brute_force(spark, sf):
    rng = random.Random(9)
    line = [" ".join(f"{c}{rng.choice('xyz')}{k}" for c in "abcde") for k in range(40)]
    rows = [(i, "\n".join(rng.choices(line, k=rng.randrange(1, 12))) + rng.choice(["", "\n \t", "\nÉté  1234 ", "\n" + line[0].upper()]), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows += rows[:30] + [(7, None, "a"), (None, line[1], "a"), (None, "", None)]
    rows += [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    want = verdicts(rows)
    assert sorted((str(r.doc_id), r.n_boiler_words, r.kept) for r in got) == want and any(x[1] for x in want) and not all(x[2] for x in want)


def _host_rows():
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits count as equal in lines
    body = lambda i, k: " ".join(f"w{name(i)}x{name(j)}" for j in range(k))
    rows = [(i, f"{body(i, 30)}\nSubscribe  NOW to our letter 7\n{body(1000 + i, 5)}", "a") for i in range(40)]
    rows += [(100 + i, f"subscribe now to our letter {i % 10}\nq{name(i)} z{name(i)}\n" + "subscribe now to our letter 1\n" * 9, "a") for i in range(30)]
    rows += [(200 + i, body(7, 60) + "\n" + body(8, 60), "a") for i in range(50)]
    rows += [(300 + i, f"{body(500 + i, 30)}\nsubscribe now to our letter 7", "b") for i in range(3)]
    return rows


def test_boilerplate_by_host(spark):
    df = spark.createDataFrame(_host_rows(), "doc_id long, text string, source string")
    assert sorted(r.n_docs for r in boilerplate_lines(df, "source", "text", 20, 0.02).collect()) == [50, 50, 70]
    assert [r.n_docs for r in boilerplate_lines(df, "source", "text", 20, 0.02, copies_once=True).collect()] == [70]
    once = {r.doc_id: r for r in quality_verdicts(df, copies_once=True).collect()}
    assert all(once[200 + i].kept and once[200 + i].n_boiler_words == 0 for i in range(50))
    got = {r.doc_id: r for r in quality_verdicts(df).collect()}
    assert all(got[i].kept and got[i].n_boiler_words == 6 for i in range(40))
    assert not any(got[100 + i].kept for i in range(30))
    assert all(not got[200 + i].kept and got[200 + i].n_boiler_words == 120 for i in range(50))  # copies count each
    assert all(got[300 + i].n_boiler_words == 0 for i in range(3))  # another host


def test_documents_full_of_boilerplate_count_each(spark):
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    line = [f"line{name(k)} of{name(k)} the{name(k)} template{name(k)}" for k in range(9)]
    rows = [(i, "\n".join([*line, f"own{name(i)} words{name(i)}"]), "a") for i in range(60)]
    rows += [(100 + i, "\n".join(x for k, x in enumerate(line) if i >> k & 1), "b") for i in range(1, 512)]
    rows += [(1000 + i, f"page {i} of our catalogue", "c") for i in range(10, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.n_docs for r in boilerplate_lines(df, "source", "text", 20, 0.02).collect()) == [40] + [60] * 9 + [256] * 9
    got = {r.doc_id: r for r in quality_verdicts(df).collect()}
    assert not any(got[i].kept for i in range(60)) and all(got[i].n_boiler_words == 36 for i in range(60))
    assert all(got[100 + i].n_boiler_words == got[100 + i].n_words for i in range(1, 512))


def test_shuffled_join_and_repeats(spark, monkeypatch):
    df = spark.createDataFrame(_host_rows() * 2 + [(None, None, None)], "doc_id long, text string, source string")
    key = lambda d: sorted((str(r.doc_id), r.kept, r.n_boiler_words) for r in d.collect())
    one = key(quality_verdicts(df))
    monkeypatch.setattr("pairlens.llm.quality.BROADCAST_LINES", -1)
    assert key(quality_verdicts(df)) == one and len(one) == len(_host_rows()) * 2 + 1
    assert quality_verdicts(df.limit(0)).count() == 0
