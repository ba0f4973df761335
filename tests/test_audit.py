"""Phrases, audits and checks of rationales against brute force and worked cases."""

import random
import re

from pairlens.operators import audit as A
from pairlens.operators import phrases as phrases_module
from pairlens.operators.phrases import phrase_hits, word_hits


def pairs(df):
    return sorted((r.pid, r.tid) for r in df.collect())


def test_phrases_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    words = ["a", "ab", "abc", "abcd", "the", "xthe", "thex", "", "é", "b.c"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(60)] + [(100, None), (101, "abc\nthe abc"), (102, "the " * 3000 + "end")]
    phrases = [(i, " ".join(r.choices(words, k=r.randint(1, 5)))) for i in range(80)] + [(200, None), (201, ""), (202, " "), (203, "he ab"), (204, "abc\nthe a"), (205, "the end"), (206, "the end")]
    want = sorted((p, t) for p, q in phrases if q is not None for t, x in texts if x is not None and q in x)
    for held in (500_000, 600, 60):  # one automaton; automata of some phrases only
        monkeypatch.setattr(phrases_module, "HELD", held)
        got = phrase_hits(spark.createDataFrame(phrases, "pid long, q string"), spark.createDataFrame(texts, "tid int, t string").repartition(4))
        assert pairs(got) == want
        grouped = spark.createDataFrame([(t, t % 3, x) for t, x in texts], "tid int, kind int, t string").repartition(4)
        got = phrase_hits(spark.createDataFrame(phrases, "pid long, q string"), grouped, "kind")
        assert sorted((r.pid, r.kind) for r in got.collect()) == sorted({(p, t % 3) for p, t in want})
    none = spark.createDataFrame([], "pid long, q string")
    assert pairs(phrase_hits(none, spark.createDataFrame(texts, "tid int, t string"))) == []


def test_words_are_whole(spark):
    texts = [(1, "Ann One's, one; ÉtéOne"), (2, "One_two Été"), (3, None)]
    words = [("One", "One"), ("Été", "Été"), ("s", "s"), ("x", "")]
    assert pairs(word_hits(spark.createDataFrame(words, "pid string, q string"), spark.createDataFrame(texts, "tid int, t string"))) == [("One", 1), ("s", 1), ("Été", 2)]


def test_absence_audit(spark):
    people = [(1, "Ann One"), (2, "Bob Two"), (3, "Cid O'Three"), (4, "Dee Four"), (5, "Has Some"), (6, None), (7, "Ann One"), (8, "Eve Five")]
    sources = [("a1", "A", "list: JoAnn Ones, Two"), ("a2", "A", "Has Some"), ("b1", "B", "Bob Two and O'Three; Fourth"), ("c1", "C", None), ("c2", "C", "xO'Three Twofold")]
    articles = [("p", 4, "seen in Best Of List"), ("q", 5, "Best Of List"), ("r", 8, "Best of it all")]
    titles = [("A", "Best Of List"), ("B", "Best Of")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = A.absence_audit(df(people, "id int, name string"), df([(5,), (5,)], "id int"), df(sources, "tid string, label string, t string"), df(articles, "tid string, id int, t string"), df(titles, "label string, title string"))
    got = {r.id: (r.named_in, r.surname_only_in, r.own_article, r.verdict == "no route") for r in out.collect()}
    assert got == {
        1: (["A"], [], [], False), 2: (["B"], ["A"], [], False), 3: ([], ["B"], [], True), 4: ([], [], ["A", "B"], False), 6: ([], [], [], True), 7: (["A"], [], [], False), 8: ([], [], [], True),
    }


def test_source_recheck(spark):
    table = "{|\n|-\n! 1995\n| '''[[Ann One|Ann]]'''\n* 2nd: [[Bob Two]]\n* 2nd: [[Late Two]]\n* 3th: [[Wrong End]]\n* 21st: [[Far Off]]\n|-\n| 1996-03-02 || [[Award Win]] [[Other]]"
    rows = [
        (1, "rank", "P", "1995", 1, "Ann One", None, None), (2, "rank", "P", "1995", 2, "Bob Two", None, None), (3, "rank", "P", "1995", 2, "Late Two", None, None), (4, "rank", "P", "1995", 3, "Wrong End", None, None),
        (5, "rank", "P", "1995", 21, "Far Off", None, None), (6, "award", "P", "1996", None, "Award Win", None, None), (7, "award", "P", "1996-03", None, "Award Win", None, None), (8, "award", "P", "1996-03-02", None, "Other", None, None),
        (9, "rank", "Q", "1995", 1, "Ann One", None, None), (10, "rank", None, "1995", 1, "Ann One", None, None), (11, "rank", "P", "1996", 1, "Ann One", None, None),
        (12, "prose", None, None, None, None, "was  seen\nthere", 1), (13, "prose", None, None, None, None, "was not", 1), (14, "prose", None, None, None, None, "was", 9),
    ]
    ev = spark.createDataFrame(rows, "observation_id int, kind string, publisher string, period string, rank int, name string, excerpt string, article int")
    out = A.source_recheck(ev, spark.createDataFrame([("P", table), ("P", None)], "publisher string, text string"), spark.createDataFrame([(1, "It was seen there.")], "article int, t string"))
    got = {r.observation_id: r.status for r in out.collect()}
    good, odd = {1, 2, 5, 6, 7, 12}, {9, 10}
    assert got == {i: "verified" if i in good else "unverifiable" if i in odd else "not verified" for i in range(1, 15)}


def test_claims_audit(spark):
    docs = [(1, "x\nabout 42%\nof it; about\n\n 43% of it"), (2, "about 42% of\nit about 41% of it"), (3, None), (4, "about 40% of it"), (5, "")]
    rules = [("share", "about ([0-9]+)% of it", "42"), ("none", "no ([0-9]+)", "1")]
    wrong, summary = A.claims_audit(spark.createDataFrame(docs, "doc_id int, text string"), rules, {"share": [4]})
    assert sorted((r.doc_id, r.line, r.written, r.excerpt) for r in wrong.collect()) == [(1, 3, "43", "about\n\n 43% of it"), (2, 2, "41", "about 41% of it")]
    p = re.compile(r"about\s+([0-9]+)%\s+of\s+it")
    n = sum(len(p.findall(t or "")) for i, t in docs if i != 4)
    assert sorted((r.rule, r.occurrences, r.mismatches, r.unmatched) for r in summary.collect()) == [("none", 0, 0, True), ("share", n, 2, False)]


def test_rationales(spark):
    rows = [
        ("ok", 50.0, "Ranked 3rd in o1.", ["o1"], ["o1", "o2"]), ("none", 95.0, "Fine.", [], ["o1"]), ("unknown", 50.0, "By o9.", ["o9"], ["o1"]), ("silent", 50.0, "Fine.", ["o1"], None),
        ("several", 50.0, "Both sources, o1.", ["o1"], ["o1"]), ("denied", 50.0, "There are not several sources. o1", ["o1"], ["o1"]), ("other sentence", 50.0, "It is not ranked. The winner, o1", ["o1"], ["o1"]),
        ("repeated", 50.0, "Year after year: o1", ["o1"], ["o1"]), ("soft", 50.0, "Consistently so, the most, o1", ["o1"], ["o1"]), ("award", 50.0, "A winner, o1", ["o1"], ["o1"]), ("no evidence", None, None, None, None),
    ]
    obs = [(k, "o1", "award" if k == "award" else "rank", "P", "S", 1990, 3, 100) for k in ("none", "unknown", "silent", "several", "denied", "other sentence", "repeated", "soft", "award")]
    obs += [("ok", "o1", "rank", "P", "S", 1990, 3, 100), ("ok", "o2", "rank", "P", None, 1991, None, None)]
    obs = [o if o[0] != "other sentence" else (*o[:6], 30, 100) for o in obs]
    out = A.rationale_checks(spark.createDataFrame(rows, "estimate_id string, estimate double, rationale string, cited array<string>, dossier array<string>"), spark.createDataFrame(obs, "estimate_id string, observation_id string, kind string, publisher string, source string, period int, rank int, list_length int"))
    got = {r.estimate_id: (r.failures, r.warnings) for r in out.collect()}
    assert got == {
        "ok": ([], []), "none": (["cites nothing"], ["top estimate from one source"]), "unknown": (["cites what is not in the dossier"], []), "silent": (["cites what is not in the dossier", "names none of the ids it cites"], []),
        "several": (["claims several sources"], []), "denied": ([], []), "other sentence": (["claims a top placement"], []), "repeated": (["claims repetition"], []), "soft": ([], ["words of repetition on one period", "superlative on one publisher"]),
        "award": ([], []), "no evidence": (["cites nothing"], []),
    }


def test_sentences_and_years(spark):
    from pyspark.sql import functions as F

    from pairlens.functions import text as X

    v = lambda t, n: spark.range(1).select(X.sentences_naming(F.lit(t).cast("string"), F.lit(n)).alias("x")).first().x
    text = "Ann Stone came in 1999. She met Stone's son in 2004!\nMillstone fell in 1850?  Bob Two in 2187 and 20011."
    assert v(text, "Ann Stone").hits == ["Ann Stone came in 1999."]
    assert tuple(v(text, "Eve Stone")) == ("surname only", ["Ann Stone came in 1999.", "She met Stone's son in 2004!"])
    assert v(text, "Cid Two").how == "none" and v(None, "Ann Stone").hits == [] and v("", "Ann Stone").how == "none"
    years = spark.range(1).select(X.years_of(X.sentences(F.lit(text))).alias("y")).first().y
    assert years == ["1999", "2004"]


def test_corroborate(spark):
    articles = [("a", "Ann met Bob Two in 2001. " + "x" * 330 + " Bob Two in 2002."), ("b", "It was Ann One. Ann One left in 1990."), ("c", "Nothing."), ("d", None)]
    eps = [(1, "a", "b", "Ann One", "Bob Two", [1990]), (2, "a", "b", "Ann One", "Bob Two", [1950]), (3, "a", "c", "Ann One", "Cid Three", [2001]), (4, "a", "b", "Ann One", "Bob Two", []), (5, "c", "d", "Cid Three", "Dee Four", None), (6, "b", "c", "Zed Nine", "Ann One", [1990]), (7, "x", "y", "No", "One", [1])]
    out = A.corroborate(spark.createDataFrame(eps, "episode int, a string, b string, a_name string, b_name string, stored array<int>"), spark.createDataFrame(articles, "id string, t string"))
    got = {r.episode: (r.label, r.found, r.sides, len(r.excerpts)) for r in out.collect()}
    assert got[1] == ("prose confirms a stored year", ["1990", "2001"], ["a:full name:1", "b:full name:2"], 3)
    assert got[2][0] == "prose names other years" and got[3][0] == "not mentioned" and got[4][0] == "no stored date" and got[5][0] == "not mentioned"
    assert got[6][:2] == ("prose confirms a stored year", ["1990"]) and got[7] == ("not mentioned", [], ["a:none:0", "b:none:0"], 0)


def test_identities(spark):
    people = [(1, "Ann"), (2, "Ann"), (3, "Ann"), (4, "Ann"), (5, "Ann"), (6, "Ann"), (7, None)]
    known = [(2, False, "Ann"), (3, True, None), (4, True, "Ann"), (5, True, "Ann (actor)"), (6, True, "Anna"), (7, True, "Ann")]
    got = A.identity_verdicts(spark.createDataFrame(people, "id int, name string"), spark.createDataFrame(known, "id int, human boolean, name string"))
    assert {r.id: r.verdict for r in got.collect()} == {1: "missing", 2: "not human", 3: "no name", 4: "exact", 5: "exact after disambiguator", 6: "mismatch", 7: "mismatch"}
