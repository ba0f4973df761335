import hashlib
import random
import re

from pyspark.sql import functions as F

from pairlens.llm.pii import find_pii, pii_report, redacted

SHAPES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in v) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in SHAPES for m in re.finditer(p, text or "") if good(k, m[0])]


def check(df):
    want = []
    for r in df.select("doc_id", "text").collect():
        b = brute(r.text)
        want.append((str(r.doc_id), *(sum(x.startswith(k) for x in b) for k, _ in SHAPES), hashlib.sha256(",".join(b).encode()).hexdigest()))
    got = pii_report(df).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    return got


def test_odd_texts(spark):
    rng = random.Random(2)
    bits = ["a", "b.c", "@", "x-y.z", ".", "..", "_", "1", "255", "256", "0007", "+1", "(555)", "-", " ", "  ", "4111111111111111", "4111 1111 1111 1111", "555-1234", "é", "🙂", "\n"]
    texts = [None, "", "a@b.c_x@y.z", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8.9", "1.2.3.4x300.1.1.1", "4111-1111-1111-1111-", "+1 (555) 123-4567.", "1 " * 20000, "a." * 20000 + "@" + "b." * 20000, "9" * 30000, "a@b" + ".c" * 20000]
    texts += ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a@b.c")], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("spans", F.lit(1))
    check(df)
    assert pii_report(df.limit(0)).count() == 0


def test_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("red blue green stone river cloud lamp chair".split())
    rows = [(i, f"{word()} {word()} please contact user{i}@mail.example.org {word()} {word()}") for i in range(30)]
    rows += [(100 + i, f"{word()} {word()} please contact agent#{i}77xx {word()}") for i in range(3)]
    rows += [(200 + i, f"the {word()} room{i}2345 {word()}") for i in range(30)]
    rows += [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_report(df).collect()}
    assert all(got[100 + i].startswith("context:") for i in range(3))
    assert not any("context" in got[200 + i] for i in range(30)) and not any("context" in got[i] for i in range(30))


def test_contexts_with_few_of_very_many_seeds(spark):
    rows = [(i, " ".join(f"please write user{i}n{k}@mail.example.org" for k in range(100))) for i in range(70)]
    rows += [(100 + i, f"ticket owner u{i}@mail.example.org") for i in range(5)] + [(200, "ticket owner agent#77xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_report(df).collect()}
    assert got[200] == "context:13:23"


def test_unrelated_seeds_change_nothing(spark):
    """Contexts are found the same beside 20,000 other seeds."""
    rows = [(i, f"holder no. u{i}@mail.example.org stop") for i in range(8)] + [(10 + i, f"holder no. id{i}x77 stop") for i in range(3)]
    other = [(1000 + i, " ".join(f"w{i}a v{k}b user{i}n{k}@mail.example.org" for k in range(100))) for i in range(200)]
    for more in ([], other):
        df = spark.createDataFrame(rows + more, "doc_id long, text string")
        got = {r.doc_id: r.spans for r in pii_report(df).where("n_context > 0").collect()}
        assert got == {10 + i: "context:11:17" for i in range(3)}


def test_believed_tokens_induce_further_patterns(spark):
    """Seeds show the first pattern, its tokens the second, which no seed follows, and that one a token never seen elsewhere."""
    rows = [(i, f"holder no. u{i}@mail.example.org stop") for i in range(30)]
    rows += [(100 + i, f"holder no. key{i}x77 stop") for i in range(6)] + [(200 + i, f"card of key{i}x77 stop") for i in range(6)]
    rows += [(300, "card of zz99zz11 stop"), (301, "some of zz99zz22 stop")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_context for r in pii_report(df).where("n_context > 0").collect()}
    assert got == {**{100 + i: 1 for i in range(6)}, **{200 + i: 1 for i in range(6)}, 300: 1}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "🙂 mail a@b.c or 10.0.0.1, ok"), (2, "no"), (3, None), (4, "+1 555 123 4567@b.c")], "doc_id long, text string")
    found = find_pii(df).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.out for r in df.join(found, "doc_id").select("doc_id", redacted(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert got == {1: "🙂 mail [EMAIL] or [IP], ok", 2: "no", 3: None, 4: "[PHONE]"}
