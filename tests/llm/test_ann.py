import numpy as np
from pyspark.sql import functions as F

from pairlens.llm.ann import nearest_neighbours


def brute(rows, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, float)
    ids = np.array(sorted(ok))
    m = np.stack([ok[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        s = m @ ok[i]
        order = sorted((-x, j) for x, j in zip(s, ids) if j != i)[:k]
        out[int(i)] = [(int(j), -x) for x, j in order]
    return out


def run(df, **kw):
    out = {}
    for r in sorted(nearest_neighbours(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_full_probing_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(8 * rng.standard_normal(12)) / 8]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000 + i, [2 * x for x in rows[5][1]]) for i in range(3)]
    bad = [(1, None), (20, []), (40, [0.0] * 12), (60, [float("nan")] * 12), (80, [None] + [1.0] * 11), (None, rows[0][1]), (100, [float("inf")] * 12)]
    skip = {i for i, _ in bad}
    rows = [r for r in rows if r[0] not in skip] + bad + rows[200:210]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("list", F.lit(1))
    got, want = run(df, probes=10**6, error=50.0), brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (21, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {q: [j for j, _ in v] for q, v in run(df).items()} == {0: [20, 21], 20: [0, 21]}
    assert nearest_neighbours(df.limit(0)).count() == 0
    assert nearest_neighbours(df.where("vec_id = 0")).count() == 0


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = run(df)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95
