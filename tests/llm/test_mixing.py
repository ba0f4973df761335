import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pairlens.llm.mixing import mix_sources, mixed


def brute_targets(sizes):
    """Handing the excess on again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def brute_copies(words, target):
    """Expected copies of each class: from the highest class on, those that would go above 2 are held at 2."""
    held = set()
    while True:
        free = {c: n for c, n in words.items() if c not in held}
        left = target - 2 * sum(words[c] for c in held)
        weight = sum(c * n for c, n in free.items())
        level = left / weight if weight else 0.0
        over = [c for c in free if level * c > 2]
        if not over:
            return {c: 2.0 if c in held else level * c for c in words}
        held.add(max(over))


def brute(rows):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = defaultdict(list)
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        u = (int(md5(f"mix|{md5(t or '') if i is None else i}")[:13], 16) + 0.5) / 2**52
        by[s].append((u, -1 if i is None else i, n, len(f"{n:b}") + 3))
    target = brute_targets({s: sum(x[2] for x in v) for s, v in by.items()})
    out = []
    for s, v in by.items():
        words = defaultdict(int)
        for x in v:
            words[x[3]] += x[2]
        expected = brute_copies(words, target[s])
        rest = target[s] - sum(int(expected[c]) * n for c, n in words.items())
        rank = []
        for u, i, n, c in v:
            p = expected[c] - int(expected[c])
            rank.append(((u / (1 - u)) / (p / (1 - p)) if p > 0 and n else float("inf"), i, n, int(expected[c])))
        before = 0
        for q, i, n, whole in sorted(rank):
            take = q < float("inf") and (before + n <= rest or (before < rest and before + n - rest < rest - before))
            before += n
            out.append((str(s), i, n, sum(words.values()), round(target[s], 6), (whole + take) * n))
    return sorted(out)


def run(df):
    return sorted((str(r.source), -1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df).collect())


def test_small_cases(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(300)] + [(900 + i, "a b c", None) for i in range(9)] + [(1000, None, "s1"), (1001, "", "z"), (None, "one two", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("u", F.lit(1)).withColumn("bin", F.lit(1))
    assert run(df) == brute(rows) == run(df.repartition(5, "text"))
    assert mix_sources(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert all(r.taken == 0 and r.target == 0 for r in mix_sources(empty).collect())


def test_shuffled_plan(spark, monkeypatch):
    monkeypatch.setattr("pairlens.llm.mixing.BROADCAST_SOURCES", -1)
    rows = [(i, "w " * (i % 7), f"s{i % 3}" if i % 4 else None) for i in range(200)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string, source string")) == brute(rows)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = run(docs)
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for s, _, n, _, t, k in got:
        assert k <= 2 * n
        taken[s] += k
        target[s] = t
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)


def test_longer_documents_are_wanted_more_often(spark):
    rows = [(i, "w " * (4 if i % 2 else 200), f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = {r.size: r.rate for r in mix_sources(df).where("source = 's1'").groupBy("size").agg(F.avg("copies").alias("rate")).collect()}
    assert abs(rate[200] / rate[4] - 11 / 6) < 0.2  # classes 7 + 4 and 2 + 4


def test_the_mix_equals_its_plan_row_by_row(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 2}", 1) for i in range(120)]
    rows += [(None, "same text here", None, 2)] * 30 + [(None, f"other {i}", None, 3) for i in range(5)]
    rows += [(7000, "one id many rows", "s0b", 4)] * 60 + [(7001, "one id", "s0b", 5), (7001, "one id more", "s0b", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long").withColumn("u", F.lit("x")).withColumn("bin", F.lit(None).cast("int"))
    df = df.repartition(6)
    want = {k: n for k, n in ((tuple(r[:3]), r.n) for r in mix_sources(df).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).collect()) if n}
    got = mixed(df)
    size = F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long")
    assert got.columns == df.columns
    assert {tuple(r[:3]): r.n for r in got.groupBy("doc_id", "source", size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()} == want
    total = {r.source: r.n for r in mix_sources(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    target = {r.source: r.target for r in mix_sources(df).select("source", "target").distinct().collect()}
    assert all(abs(total[s] - target[s]) <= 8 for s in target)
    once = [r.copies for r in mix_sources(df).where("doc_id = 7000").collect()]
    assert max(once) - min(once) == 1 and len(once) == 60
