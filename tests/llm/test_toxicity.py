import random

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm.toxicity import features, fit, fit_labels, severity


def test_features():
    assert features(None) == features("") == features(" \n") == set()
    assert features("Idiot!! you, (idiot) ...") == {"idiot", "you", "^idio"}


def test_cuts_and_severity_are_ordered():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        g = i % 3
        words = {f"w{rng.randrange(200)}"for _ in range(20)} | ({"bad"} if g else set()) | ({"awful"} if g == 2 else set())
        rows.append((words, g))
    m = fit(rows)
    assert (np.diff(m.cuts) >= 0).all()
    s = [m.exceed(t).sum() for t in ("w1 w2", "w1 bad", "w1 bad awful")]
    assert s[0] < 0.3 < s[1] < 1.5 < s[2]


def test_the_fit_is_the_maximum_of_the_likelihood():
    """Against a likelihood written out row by row: no slope at the fitted point and no better point around it."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        g = rng.choice([0, 0, 1, 2])
        rows.append(({f"w{rng.randrange(30)}" for _ in range(4)} | ({"bad"} if rng.random() < 0.2 + 0.35 * g else set()) | ({"awful"} if rng.random() < 0.1 + 0.4 * g else set()), g))
    m = fit(rows, least_z=2.0)
    names = sorted(m.weights)

    def value(x):
        w, cuts = dict(zip(names, x)), x[len(names) :]
        total = -0.01 * sum(v * v for v in w.values())
        for words, g in rows:
            score = sum(w.get(k, 0.0) for k in words)
            above = [1.0, *(1 / (1 + np.exp(-(score - c))) for c in cuts), 0.0]
            total += np.log(above[g] - above[g + 1])
        return total

    x = np.array([m.weights[k] for k in names] + list(m.cuts))
    best = value(x)
    for k in range(len(x)):
        for d in (0.05, -0.05):
            y = x.copy()
            y[k] += d
            assert value(y) < best
            y[k] = x[k] + d / 50
            assert abs(value(y) - best) < 0.02


def test_repeats_change_nothing(spark):
    docs = spark.createDataFrame([(i, "bad " * (i % 2) + f"w{i} common words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    m = fit_labels(docs, labels)
    assert m.exceed("bad")[0] > 0.9 and m.exceed("common")[0] < 0.1
    again = fit_labels(docs, labels.unionAll(labels).unionAll(labels))
    assert again.weights == m.weights and (again.cuts == m.cuts).all()
    twice = severity(docs.unionAll(docs), m).groupBy("doc_id").agg(F.count_distinct("expected_severity").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert twice.where("n <> 1 or rows <> 2").count() == 0 and twice.count() == 200


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(None, 1, 1), (9, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    out = severity(docs, fit_labels(docs, labels)).collect()
    assert len(out) == 3 and not any(r.toxic for r in out)
    assert severity(docs.limit(0), fit_labels(docs, labels)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(4)) == 0
    out = severity(docs, fit_labels(docs, labels.where(~held))).join(labels.where(held).withColumnRenamed("toxic", "label"), "doc_id")
    n = out.agg(
        F.sum((F.col("toxic") & (F.col("label") == 1)).cast("int")).alias("hit"), F.sum((F.col("label") == 1).cast("int")).alias("bad"),
        F.sum((F.col("toxic") & (F.col("label") == 0)).cast("int")).alias("wrong"), F.sum((F.col("label") == 0).cast("int")).alias("clean"),
    ).first()
    assert n.hit >= 0.9 * n.bad and n.wrong <= 0.02 * n.clean
