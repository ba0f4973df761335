import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from pairlens.llm.secrets import ENCODINGS, random_tokens, scan_secrets, token_tests

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def row(text):
    spans = brute(text)
    n = lambda k: sum(x.startswith(k) for x in spans)
    return n("assign"), n("access"), n("hex"), hashlib.sha256(",".join(spans).encode()).hexdigest()


def check(df):
    want = sorted((str(r.doc_id), *row(r.text)) for r in df.select("doc_id", "text").collect())
    got = scan_secrets(df).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    return {r.doc_id: r for r in got}


def test_odd_texts(spark):
    rng = random.Random(3)
    alphabet = ["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD2345EFGH", "0a1b2c3d" * 4, "é", "🙂", "pass", "password", "x9", "-", "\n"]
    texts = [None, "", "token: token: abcdefghij", "Passwd='abcdefgh'", "🙂🙂 AKIA" + "A" * 12, "AKIA" * 30, "f" * 5000, "token=" + "a" * 4000]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "token=12345678")], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("t", F.lit("x"))
    check(df)
    assert scan_secrets(df.limit(0)).count() == 0


def test_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_random_tokens_are_told_from_structured_ones(spark):
    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(chars, k=rng.choice([24, 32, 40, 64]))) for _ in range(300)]
    plain = [f"section{i:04d}sectionheadingsectionbody{i % 7}" for i in range(300)] + ["abcdefghijklmnopqrstuvwxyz0123456789"] * 20
    df = spark.createDataFrame([(t,) for t in keys + plain], "t string")
    left = {r.t for r in random_tokens(token_tests(df), 0.05).collect()}
    assert len(left & set(keys)) >= 0.9 * len(keys)
    assert not left & set(plain)


def _planted(rng):
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(rng.choice([chars, chars + "+/", "0123456789abcdef", chars[:26] + "234567"]), k=rng.randrange(20, 60))) for _ in range(1500)]
    keys = [k for k in keys if re.search("[0-9]", k) and re.search("[A-Za-z]", k)]
    word = "get set user account service handler request response config value index table manager session order invoice".split()
    names = ["".join(w.capitalize() for w in rng.choices(word, k=rng.randrange(2, 7))) + str(rng.randrange(100)) for _ in range(900)]
    paths = ["_".join(rng.choices(word, k=4)) + f"_{rng.randrange(2000, 2030)}" for _ in range(300)]
    stamps = [f"build2026{rng.randrange(10, 13)}{rng.randrange(10, 29)}v{rng.randrange(10)}release{rng.randrange(10)}" for _ in range(300)]
    return keys, [x for x in names + paths + stamps if len(x) >= 20]


def test_p_values_of_keys_are_spread_evenly(spark):
    keys, _ = _planted(random.Random(21))
    p = [r.p for r in token_tests(spark.createDataFrame([(t,) for t in keys], "t string")).collect()]
    for x in (0.05, 0.2, 0.5, 0.8):
        assert abs(sum(v <= x for v in p) / len(p) - x) < 0.07, x


def test_precision_and_recall_on_planted_tokens(spark):
    keys, names = _planted(random.Random(22))
    left = {r.t for r in random_tokens(token_tests(spark.createDataFrame([(t,) for t in keys + names], "t string")), 0.05).collect()}
    hit, wrong = len(left & set(keys)), len(left & set(names))
    print("reported", len(left), "keys", hit, "of", len(set(keys)), "structured", wrong, "of", len(set(names)))
    assert hit >= 0.8 * len(set(keys)) and wrong <= 0.1 * len(left)


def test_added_spans_keep_base_ones(spark):
    key = "".join(random.Random(11).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32))
    df = spark.createDataFrame([(1, f"see {key} here"), (2, f"token={key}"), (3, "nothing")], "doc_id long, text string")
    got = check(df)
    assert got[1].spans == f"random:4:{4 + len(key)}" and got[2].spans.startswith("assign:0:") and "random" not in got[2].spans and got[3].spans == ""


def test_keys_after_names_and_in_mixed_paths(spark):
    rng = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, want = [], {}
    for i, before in enumerate(["AUTH=", "see sig=", "/v1/my-app/", "==", "https://x.example/a+b/c_d/"] * 4):
        key = "".join(rng.choices(chars, k=32))
        rows.append((i, f"{before}{key} end"))
        want[i] = f"random:{len(before)}:{len(before) + 32}"
    df = spark.createDataFrame(rows + [(90, "NAME=" + key[:30] + "==")], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in scan_secrets(df).collect()}
    assert sum(want[i] in got[i] for i in want) >= 0.9 * len(want) and got[90] == ["random:5:37"]


def statistics(t):
    """The three p-values written out: equal pairs on the square-root scale, runs of halves, serial correlation."""
    alphabet = next(a for r, a in ENCODINGS if re.fullmatch(r, t))
    n, k = len(t), len(alphabet)
    two_sided = lambda z: math.erfc(abs(z) / math.sqrt(2))
    pairs = sum(t[i] == t[j] for i in range(n) for j in range(i))
    chi = two_sided(2 * (math.sqrt(pairs + 0.375) - math.sqrt(n * (n - 1) / (2 * k) + 0.375)) / math.sqrt(1 - 1 / k))
    half = [alphabet.index(c) >= k // 2 for c in t]
    ones, runs = sum(half), 1 + sum(a != b for a, b in zip(half, half[1:]))
    mu = 2 * ones * (n - ones) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    run = two_sided((runs - mu) / math.sqrt(var)) if var > 0 else 0.0
    x = [alphabet.index(c) for c in t]
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    r = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / ss if ss else 1.0
    serial = two_sided((r + 1 / n) * math.sqrt(n))
    return chi, run, serial, 1 - (1 - min(chi, run, serial)) ** 3


def test_statistics_against_brute_force(spark):
    keys, names = _planted(random.Random(5))
    tokens = keys[:200] + names[:200] + ["a" * 40, "ab" * 20, "0" * 19 + "1", "QWERTYUIOPASDFGHJKLZXCVBNM" * 2]
    for r in token_tests(spark.createDataFrame([(t,) for t in tokens], "t string")).collect():
        assert max(abs(a - b) for a, b in zip((r.p_chi, r.p_runs, r.p_serial, r.p), statistics(r.t))) < 1e-5, r.t


def test_keys_without_digits(spark):
    rng = random.Random(12)
    word = "get set user account service handler request response config value index table manager session order invoice".split()
    lower = "abcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rng.choices(rng.choice([lower + lower.upper(), lower, lower.upper()]), k=40)) for _ in range(60)]
    names = [x for x in ("".join(w.capitalize() for w in rng.choices(word, k=7)) for _ in range(200)) if len(x) >= 32]
    rows = [(i, f"see {t} here") for i, t in enumerate(keys + names)] + [(900, "short" + "".join(rng.choices(lower, k=24)))]
    got = {r.doc_id: r.n_random for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, wrong = sum(got[i] for i in range(60)), sum(got[i] for i in got if i >= 60)
    print("keys", hit, "of 60, names", wrong, "of", len(names))
    assert hit >= 48 and wrong <= 0.1 * (hit + wrong)
