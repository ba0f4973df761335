"""Redrawn intervals, the coverage ladder, expansion and inversions against brute force."""

import hashlib
import math
import random

import pytest

from pairlens.operators import pairings as P
from pairlens.operators import sampling as S

COEFFICIENTS = "key string, id string, c long, mirror long, exposure long"
SPECS = "id string, value double, sd double, publisher string"


def bands(spark, rows, specs, draws=60, **more):
    c = spark.createDataFrame([(k, i, c, -c, e) for k, i, c, e in rows], COEFFICIENTS)
    return {r.key: r for r in S.interval(c, spark.createDataFrame(specs, SPECS), draws, 1, 0.1, **more).collect()}


def test_interval(spark):
    rows, sd = [("k", "i", 2, 4), ("k", "j", -2, 0)], lambda s: [("i", 80.0, s, "p"), ("j", 70.0, s, "p")]
    r = bands(spark, rows, sd(0.0))["k"]
    assert r.total_low == r.total_high == r.point_total == 2000 and r.point_rate == r.rate_low == 500 and r.clamped_share == 0 and r.mirrored
    w = bands(spark, rows, sd(5.0))["k"]
    assert w.total_low < 2000 < w.total_high and w.rate_high == w.total_high / 4 and bands(spark, rows, sd(5.0))["k"] == w
    # One effect of a publisher on both sides cancels; of different publishers it does not.
    same = bands(spark, rows, sd(0.0), publisher_sd=5.0)["k"]
    other = bands(spark, rows, [("i", 80.0, 0.0, "p"), ("j", 70.0, 0.0, None)], publisher_sd=5.0)["k"]
    assert same.total_low == same.total_high == 2000 and other.total_low < 2000 < other.total_high
    assert bands(spark, rows, [("i", 99.0, 5.0, None), ("j", 99.0, 5.0, None)])["k"].clamped_share > 0.2
    assert bands(spark, [("z", "i", 0, 0)], sd(5.0))["z"].point_rate is None
    with pytest.raises(ValueError, match="j"):
        bands(spark, rows, sd(5.0)[:1])


def test_one_estimate_moves_as_one(spark):
    """An estimate that serves three periods widens the band more than three estimates that serve one each."""
    specs = [(i, 60.0, 3.0, None) for i in "abcd"]
    one, three = bands(spark, [("k", "a", 3, 3)], specs, 200)["k"], bands(spark, [("k", i, 1, 1) for i in "bcd"], specs, 200)["k"]
    assert one.total_high - one.total_low > 1.3 * (three.total_high - three.total_low)


def u(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def test_coverage_ladder(spark):
    r = random.Random(4)
    people = list(range(30))
    episodes = [(i, r.choice(people), r.choice(people), r.randint(1, 5)) for i in range(25) for _ in range(2)]
    ladder, trials, want = [1, 4, 9, 40], 11, {}
    for k in ladder:
        counts = []
        for t in range(trials):
            order = sorted(people, key=lambda x: hashlib.md5(f"7|order|{t}|{x}".encode()).hexdigest())
            listed = {}
            for year in range(1, 6):
                best = sorted(people, key=lambda x: (-math.log(u(7, t, year, x)) * (order.index(x) + 3), x))[:k]
                for x in best:
                    listed.setdefault(x, set()).add(year)
            ok = lambda x, y: any(abs(y - s) <= 1 for s in listed.get(x, ()))
            counts.append(len({i for i, a, b, y in episodes if ok(a, y) and ok(b, y)}))
        counts.sort()
        want[k] = (counts[1], counts[5], counts[9])
    got = S.coverage_ladder(spark.createDataFrame([(x,) for x in people], "entity int"), spark.createDataFrame(episodes, "episode int, a int, b int, period int"), 1, 5, ladder, trials, 1, 7)
    assert {x.k: (x.p10, x.median, x.p90) for x in got.collect()} == want
    assert want[40][1] >= want[4][1]


def expanded(edges, people, seeds, rounds, per_round, most, converge):
    roster, known, frontier, log, why = [(s, 0) for s in seeds], set(seeds), list(seeds), [], "rounds exhausted"
    for r in range(1, rounds + 1):
        if len(roster) >= most:
            return roster, log, "most reached"
        c = {}
        for kind, seed, i in edges:
            if seed in frontier and i not in known and people.get(i, (None,))[0] in ("a", "b"):
                x = c.setdefault(i, [0, set()])
                x[0] |= kind == "partner"
                x[1].add(seed)
        rank = lambda i: (-c[i][0], -len(c[i][1]), -people[i][1], i)
        cap, order = min(per_round, most - len(roster)), sorted(c, key=rank)
        taken = [i for i in order if people[i][0] == "a"][: cap // 2] + [i for i in order if people[i][0] == "b"][: cap - cap // 2]
        taken += [i for i in order if i not in taken][: cap - len(taken)]
        log.append((r, len(frontier), len(c), len(taken), len(c) - len(taken)))
        roster += [(i, r) for i in taken]
        known |= set(taken)
        frontier = taken
        if len(taken) < converge:
            return roster, log, "converged"
        if not taken:
            return roster, log, "no frontier"
        if len(roster) >= most:
            return roster, log, "most reached"
    return roster, log, why


@pytest.mark.parametrize("rounds, per_round, most, converge", [(4, 7, 25, 1), (9, 5, 1000, 2), (3, 100, 1000, 1), (5, 6, 8, 0), (2, 5, 3, 1), (5, 4, 1000, 0)])
def test_snowball(spark, tmp_path, rounds, per_round, most, converge):
    r = random.Random(rounds * 100 + per_round)
    people = {i: (r.choice(["a", "a", "b", None]), float(r.randint(0, 5))) for i in range(60)}
    edges = [(r.choice(["partner", "other", "other"]), r.randrange(60), r.randrange(60)) for _ in range(110)]
    n = [0]

    def save(df):
        n[0] += 1
        df.write.parquet(f"file://{tmp_path}/{n[0]}")
        return spark.read.parquet(f"file://{tmp_path}/{n[0]}")

    e, p = spark.createDataFrame(edges, "kind string, seed long, id long"), spark.createDataFrame([(i, *x) for i, x in people.items()], "id long, side string, prominence double")
    roster, log, why = S.snowball(e, p, spark.createDataFrame([(i,) for i in (1, 2, 3)], "id long"), rounds, per_round, most, converge, save)
    want = expanded(edges, people, [1, 2, 3], rounds, per_round, most, converge)
    assert sorted((x.id, x["round"]) for x in roster.collect()) == sorted(want[0])
    assert [(x["round"], x["expanded"], x["candidates"], x["admitted"], x["cut_by_cap"]) for x in log] == want[1] and why == want[2]


@pytest.mark.parametrize("n, run", [(0, 5), (1, 5), (2, 5), (37, 5), (64, 4096)])
def test_inversions(spark, monkeypatch, n, run):
    monkeypatch.setattr(P, "RUN", run)
    order = list(range(n))
    random.Random(n).shuffle(order)
    df = spark.createDataFrame([(f"e{i}", i, q) for i, q in enumerate(order)], "entity string, p long, q long").repartition(3)
    got = {r.entity: r.inversions for r in P.inversions(df, "p", "q").collect()}
    assert got == {f"e{i}": sum(order[j] < order[i] for j in range(i + 1, n)) for i in range(n)}
