"""Queries that hold records and prose against texts: names, sources, numbers and rationales."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import audit as A
from . import demo
from .registry import query
from .texts import _LINES, _WS, mention, wiki_texts

#: How rationales of eight kinds are worded; the kind of an estimate goes by its entity and week.
_SAID = (
    "Named by several magazines in [%s].", "Hardly known, and never named by several magazines [%s].", "Listed year after year, see %s; the most of all.", "It is not a headline. The winner here, by %s.",
    "A sustained judgment (%s).", "Without equal, as observed.", "Nothing is cited.", "More than once first place, or so %s has it.",
)


@query("""SELECT estimate_id, array_to_string(list_filter([
        CASE WHEN v = 6 THEN 'cites nothing' END, CASE WHEN v = 7 THEN 'cites what is not in the dossier' END, CASE WHEN v = 5 THEN 'names none of the ids it cites' END,
        CASE WHEN v = 0 AND sources < 2 THEN 'claims several sources' END, CASE WHEN v IN (2, 7) AND periods < 2 THEN 'claims repetition' END, CASE WHEN v IN (3, 7) AND NOT top THEN 'claims a top placement' END], lambda x: x IS NOT NULL), ';') AS failures,
    array_to_string(list_filter([CASE WHEN v = 4 AND periods < 2 THEN 'words of repetition on one period' END, CASE WHEN v IN (2, 5) AND publishers < 2 THEN 'superlative on one publisher' END,
        CASE WHEN estimate >= 90 AND sources < 2 THEN 'top estimate from one source' END], lambda x: x IS NOT NULL), ';') AS warnings
    FROM (SELECT entity || '@' || period // 7 AS estimate_id, (entity + period // 7) % 8 AS v, avg(value) AS estimate, count(DISTINCT source) AS sources, count(DISTINCT type) AS publishers, count(DISTINCT period) AS periods,
        bool_or(type = 'signup' OR type = 'purchase' AND json_extract_string(props, '$.k')::INT BETWEEN 0 AND 10) AS top FROM evidence GROUP BY ALL)""")
def tj_grounding(spark, sf):
    """Rationales of an entity's weeks, worded in eight ways, against the events of the week."""
    e = demo.evidence(spark, sf).withColumn("week", F.expr("period div 7")).withColumn("estimate_id", F.concat_ws("@", "entity", "week"))
    kind = F.expr("case type when 'signup' then 'award' when 'purchase' then 'rank' else type end")
    obs = e.select("estimate_id", F.col("observation_id").cast("string").alias("observation_id"), kind.alias("kind"), F.col("type").alias("publisher"), "source", "period", F.get_json_object("props", "$.k").cast("int").alias("rank"), F.lit(100).alias("list_length"))
    per = e.groupBy("estimate_id", "entity", "week").agg(F.avg("value").alias("estimate"), F.array_sort(F.collect_list(F.col("observation_id").cast("string"))).alias("dossier"))
    v = F.expr("cast((entity + week) % 8 as int)")
    cited = F.when(v == 6, F.array().cast("array<string>")).when(v == 7, F.array(F.concat(F.lit("x"), F.col("dossier")[0]))).otherwise(F.slice("dossier", 1, 1))
    said = F.replace(F.get(F.array(*map(F.lit, _SAID)), v), F.lit("%s"), F.coalesce(F.get(cited, F.lit(0)), F.lit("")))
    out = A.rationale_checks(per.select("estimate_id", "estimate", "dossier", cited.alias("cited"), said.alias("rationale")), obs)
    return out.select("estimate_id", F.array_join("failures", ";").alias("failures"), F.array_join("warnings", ";").alias("warnings"))


@query(f"""SELECT observation_id, kind, CASE WHEN kind = 'prose' THEN CASE WHEN held THEN 'verified' ELSE 'not verified' END WHEN c % 9 = 0 THEN 'unverifiable' WHEN found IS NOT NULL THEN 'verified' ELSE 'not verified' END AS status FROM (
    WITH l AS MATERIALIZED (SELECT x.*, o_custkey AS c, year(x.o_orderdate) AS y, kind = 0 OR r = 1 AND place = 1 AS linked FROM {_LINES} x JOIN orders ON o_orderkey = id),
    s AS (SELECT DISTINCT c, y, rank, name AS found FROM (
        SELECT c, y, 0 AS rank, arg_min(name, r) FILTER (WHERE linked) AS name FROM l GROUP BY id, c, y
        UNION ALL SELECT c, y, 1, name FROM l WHERE r = 1 AND place = 1
        UNION ALL SELECT c, y, place, arg_min(name, r) FROM l WHERE kind = 0 AND place > 1 GROUP BY id, c, y, place))
    SELECT 'L' || id || '-' || r AS observation_id, 'rank' AS kind, l.c, found, NULL AS held FROM l LEFT JOIN s ON s.c = l.c AND s.y = l.y AND s.found = l.name
        AND s.rank = CASE WHEN place % 5 = 4 THEN 0 ELSE place + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END END
    UNION ALL SELECT 'D' || doc_id, 'prose', NULL, NULL, contains(trim(regexp_replace(text, {_WS})), trim(regexp_replace(trim(string_split(text, chr(10))[-1]) || CASE WHEN doc_id % 3 = 0 THEN ' indeed' ELSE '' END, {_WS}))) FROM documents)""")
def tj_source_recheck(spark, sf):
    """Order lines against the ranked lists of their customer, and last lines of documents (every third altered) against these.

    Every ninth customer has no lists; lines of every seventh supplier state a rank too low, and some no rank.
    """
    bold = lambda x: F.concat(F.lit(" '''[["), x["name"], F.lit("]]'''\n"))
    line = lambda x, i: F.when((i == 0) & (x["place"] == 1), bold(x)).otherwise(F.concat(F.lit("* "), X.ordinal(x["place"]), F.lit(": "), mention(x), F.lit("\n")))
    customer = demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("publisher"))
    tables = wiki_texts(spark, sf, F.concat(F.lit("{|\n|-\n! "), F.year("o_orderdate"), F.lit("\n|")), line).join(customer, "id").where("publisher % 9 <> 0")
    names = demo.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.initcap("p_name").alias("name"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = demo.order_lines(spark, sf).withColumn("r", F.row_number().over(place)).join(names, "l_partkey")
    rank = F.expr("if(l_linenumber % 5 = 4, null, l_linenumber + if(l_suppkey % 7 = 0, 1, 0))").cast("int")
    listed = lines.select(F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "r").alias("observation_id"), F.lit("rank").alias("kind"), F.col("o_custkey").cast("string").alias("publisher"), F.year("o_orderdate").cast("string").alias("period"), rank.alias("rank"), "name")
    docs = demo.table(spark, sf, "documents")
    quote = F.concat(F.trim(F.element_at(F.split("text", "\n", -1), -1)), F.when(F.col("doc_id") % 3 == 0, " indeed").otherwise(""))
    prose = docs.select(F.concat(F.lit("D"), "doc_id").alias("observation_id"), F.lit("prose").alias("kind"), quote.alias("excerpt"), F.col("doc_id").alias("article"))
    return A.source_recheck(listed.unionByName(prose, allowMissingColumns=True), tables, docs.select(F.col("doc_id").alias("article"), F.col("text").alias("t")))


_TWO = "^([A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+)"


@query(f"""SELECT id, name, coalesce(named_in, '') AS named_in, coalesce(surname_only_in, '') AS surname_only_in, coalesce(own_article, '') AS own_article,
    CASE WHEN named_in IS NULL AND own_article IS NULL THEN 'no route' ELSE 'named, investigate' END AS verdict FROM (
    WITH p AS MATERIALIZED (SELECT conv_id AS id, regexp_extract(text, '{_TWO}', 1) AS name FROM conversations WHERE turn = 0 AND conv_id NOT IN (SELECT entity FROM sparse)),
    h AS MATERIALIZED (SELECT name, source, bool_or(contains(text, name)) AS f, bool_or(regexp_matches(text, '(^|[^0-9A-Za-z_À-ÿ])' || string_split(name, ' ')[-1] || '($|[^0-9A-Za-z_À-ÿ])')) AS s FROM (SELECT DISTINCT name FROM p WHERE name <> ''), documents GROUP BY ALL),
    n AS (SELECT name, string_agg(source, ',' ORDER BY source) FILTER (WHERE f) AS named_in, string_agg(source, ',' ORDER BY source) FILTER (WHERE s AND NOT f) AS surname_only_in FROM h GROUP BY name),
    t AS (SELECT source, arg_min(regexp_extract(text, '{_TWO}', 1), doc_id) AS title FROM documents WHERE regexp_matches(text, '{_TWO}') GROUP BY source),
    o AS (SELECT id, string_agg(DISTINCT source, ',' ORDER BY source) AS own_article FROM p JOIN conversations ON conv_id = id JOIN t ON contains(text, title) GROUP BY id)
    SELECT p.id, p.name, named_in, surname_only_in, own_article FROM p LEFT JOIN n ON n.name = p.name LEFT JOIN o ON o.id = p.id)""")
def tj_absence_audit(spark, sf):
    """Names are the first words of conversations, sources those of the documents, each titled by its first document's first words."""
    c, d = demo.table(spark, sf, "conversations"), demo.table(spark, sf, "documents")
    two = F.regexp_extract("text", _TWO, 1)
    people = c.where("turn = 0").select(F.col("conv_id").alias("id"), two.alias("name"))
    have = demo.sparse(spark, sf).select(F.col("entity").alias("id"))
    titles = d.where(F.col("text").rlike(_TWO)).groupBy(F.col("source").alias("label")).agg(F.min_by(two, "doc_id").alias("title"))
    sources = d.select(F.col("doc_id").alias("tid"), F.col("source").alias("label"), F.col("text").alias("t"))
    articles = c.select(F.concat_ws("-", "conv_id", "turn").alias("tid"), F.col("conv_id").alias("id"), F.col("text").alias("t"))
    out = A.absence_audit(people, have, sources, articles, titles)
    return out.select("id", "name", *[F.array_join(x, ",").alias(x) for x in ("named_in", "surname_only_in", "own_article")], "verdict")


_RULES = [("licence", "General Public License, version ([0-9]+)", "2"), ("cc", "Licensed under CC BY-NC ([0-9]+[.][0-9]+)", "4.0"), ("none", "zzzzz ([0-9]+)", "1")]
_RULE_ROWS = ", ".join(f"('{n}', '{p.replace(' ', chr(92) + 's+')}', '{e}')" for n, p, e in _RULES)


@query(f"""SELECT * FROM (WITH r(rule, pattern, expected) AS (VALUES {_RULE_ROWS}),
    m AS MATERIALIZED (SELECT rule, expected, doc_id, regexp_extract_all(text, pattern) AS w, regexp_extract_all(text, pattern, 1) AS g, string_split_regex(text, pattern) AS b FROM documents, r WHERE regexp_matches(text, pattern)),
    e AS (SELECT rule, expected, doc_id, g[i] AS written, 1 + length(regexp_replace(array_to_string(b[1:i], '') || array_to_string(w[1:i - 1], ''), '[^\n]', '', 'g')) AS line FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m))
    SELECT rule, 'mismatch' AS what, doc_id, line, written, 1::BIGINT AS n FROM e WHERE written <> expected
    UNION ALL SELECT r.rule, CASE WHEN count(e.rule) = 0 THEN 'matches nothing' ELSE 'occurrences' END, NULL, NULL, NULL, count(e.rule) FROM r LEFT JOIN e ON e.rule = r.rule GROUP BY r.rule)""")
def tj_claims_audit(spark, sf):
    """Every place where a document states another number than a rule expects, and how often each rule matches at all."""
    wrong, rules = A.claims_audit(demo.table(spark, sf, "documents"), _RULES)
    rows = wrong.select("rule", F.lit("mismatch").alias("what"), "doc_id", "line", "written", F.lit(1).cast("long").alias("n"))
    what = F.when(F.col("unmatched"), "matches nothing").otherwise("occurrences")
    return rows.unionByName(rules.select("rule", what.alias("what"), F.col("occurrences").alias("n")), allowMissingColumns=True)


#: Each document is asked about the two words it starts with; no sentence of the test texts has another shape of blank.
_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[\t\n\x0b\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda s: s <> '')"
_ABOUT = f"(SELECT doc_id, name, string_split(name, ' ')[-1] AS surname, {_SENT} AS s FROM (SELECT doc_id, text, regexp_extract(text, '{_TWO}', 1) AS name FROM documents) WHERE name <> '')"
_HITS = "list_filter(s, lambda x: contains(x, name))"
_SURNAME = "CASE WHEN length(surname) >= 4 THEN list_filter(s, lambda x: regexp_matches(x, '(^|[^0-9A-Za-z_À-ÿ])' || surname || '($|[^0-9A-Za-z_À-ÿ])')) ELSE [] END"


@query(f"SELECT doc_id, len(s) AS sentences, CASE WHEN len(f) > 0 THEN 'full name' WHEN len(g) > 0 THEN 'surname only' ELSE 'none' END AS how, len(CASE WHEN len(f) > 0 THEN f ELSE g END) AS naming FROM (SELECT *, {_HITS} AS f, {_SURNAME} AS g FROM (SELECT doc_id, s, CASE WHEN doc_id % 2 = 0 THEN name ELSE surname || ' ' || surname END AS name, surname FROM {_ABOUT}))")
def tj_sentences(spark, sf):
    """Sentences of a document that name it, by its first two words, or (odd ones) by a name of which only the surname is theirs."""
    d = demo.table(spark, sf, "documents").withColumn("name", F.regexp_extract("text", _TWO, 1)).where("name <> ''")
    last = F.element_at(F.split("name", " "), -1)
    d = d.withColumn("name", F.when(F.col("doc_id") % 2 == 0, F.col("name")).otherwise(F.concat(last, F.lit(" "), last)))
    d = d.select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"), X.sentences_naming(F.col("text"), F.col("name")).alias("n"))
    return d.select("doc_id", "sentences", "n.how", F.size("n.hits").alias("naming"))


@query("SELECT o_custkey, string_agg(DISTINCT y, ',' ORDER BY y) AS years FROM (SELECT o_custkey, year(o_orderdate)::VARCHAR AS y FROM orders UNION ALL SELECT o_custkey, o_orderkey::VARCHAR FROM orders WHERE o_orderkey BETWEEN 1900 AND 2099) GROUP BY o_custkey")
def tj_years(spark, sf):
    """Years in the sentences about a customer's orders, which hold other numbers too; an order number may read as a year."""
    line = F.concat(F.lit("Order "), "o_orderkey", F.lit(" of "), F.year("o_orderdate"), F.lit(" came to 18"), F.year("o_orderdate"), F.lit(" or 2187 units, not "), 1900 + F.col("o_orderkey") % 5, F.lit("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda x: x["t"]), ". ")
    per = demo.table(spark, sf, "orders").groupBy("o_custkey").agg(text.alias("text"))
    return per.select("o_custkey", F.array_join(X.years_of(X.sentences_naming(F.col("text"), F.lit("Order"))["hits"]), ",").alias("years"))


#: What the article of a customer says of each supplier, by the kind (supplier mod 4) of the mention.
_BY = "(SELECT o_custkey AS c, l_suppkey AS s, min(year(o_orderdate))::INT AS y, max(year(l_shipdate))::INT AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45 GROUP BY ALL)"


@query(f"""SELECT c || '-' || s AS episode, CASE WHEN s % 4 = 0 THEN 'not mentioned' WHEN s % 4 = 1 THEN 'mentioned without year' WHEN c % 5 = 0 THEN 'no stored date' WHEN s % 4 = 2 THEN 'prose confirms a stored year' ELSE CASE WHEN y + 10 = z THEN 'prose confirms a stored year' ELSE 'prose names other years' END END AS label,
    CASE WHEN c % 5 = 0 THEN '' WHEN y = z THEN y::VARCHAR ELSE least(y, z) || ',' || greatest(y, z) END AS stored, CASE WHEN s % 4 IN (0, 1) THEN '' WHEN s % 4 = 2 THEN y::VARCHAR ELSE (y + 10)::VARCHAR END AS found, CASE WHEN s % 4 = 0 THEN 0 ELSE 1 END AS excerpts FROM {_BY}""")
def tj_corroborate(spark, sf):
    """Large orders as episodes of customer and supplier, and articles of customers that mention suppliers in four ways."""
    lines = demo.order_lines(spark, sf).where("l_quantity >= 45")
    e = lines.groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).agg(F.min(F.year("o_orderdate")).alias("y"), F.max(F.year("l_shipdate")).alias("z"))
    name = lambda kind, key: F.concat(F.lit(f"{kind} No"), F.lpad(key.cast("string"), 9, "0"))
    how = F.expr("case s % 4 when 0 then 'Nobody is named here' when 1 then concat('It knows ', n, ' well') when 2 then concat(n, ' came in ', y, ' first') else concat('Of ', n, ' one hears in ', y + 10, ' again') end")
    said = F.struct("s", how.alias("t"))
    articles = e.withColumn("n", name("Supplier", F.col("s"))).groupBy(F.concat(F.lit("c"), "c").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"]), ". ").alias("t"))
    stored = F.when(F.col("c") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array("y", "z"))
    episodes = e.select(F.concat_ws("-", "c", "s").alias("episode"), F.concat(F.lit("c"), "c").alias("a"), F.concat(F.lit("s"), "s").alias("b"), name("Customer", F.col("c")).alias("a_name"), name("Supplier", F.col("s")).alias("b_name"), stored.alias("stored"))
    out = A.corroborate(episodes, articles)
    return out.select("episode", "label", F.array_join("stored", ",").alias("stored"), F.array_join("found", ",").alias("found"), F.size("excerpts").alias("excerpts"))


@query("""SELECT o_orderkey AS id, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_acctbal < 0 THEN 'not human' WHEN o_orderkey % 6 = 4 THEN 'mismatch' WHEN s_nationkey = 3 THEN 'no name' WHEN s_nationkey % 4 = 1 THEN 'exact after disambiguator' ELSE 'exact' END AS verdict
    FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""".replace("WHEN o_orderkey % 6 = 4 THEN 'mismatch' WHEN s_nationkey = 3 THEN 'no name'", "WHEN s_nationkey = 3 THEN 'no name' WHEN o_orderkey % 6 = 4 THEN 'mismatch'"))
def flt_identity_verdict(spark, sf):
    """Orders name the supplier under their customer's number; some names differ, some of the register carry a bracket."""
    s, o = demo.table(spark, sf, "supplier"), demo.table(spark, sf, "orders")
    register = s.selectExpr("s_suppkey as id", "s_acctbal >= 0 as human", "case when s_nationkey = 3 then null when s_nationkey % 4 = 1 then concat(s_name, ' (firm)') else s_name end as name")
    stated = o.select(F.col("o_custkey").alias("id"), "o_orderkey", F.concat(F.lit("Supplier#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.when(F.col("o_orderkey") % 6 == 4, " & Sons").otherwise("")).alias("name"))
    found = A.identity_verdicts(stated.select("id", "name").distinct(), register)
    return stated.join(found, ["id", "name"]).select(F.col("o_orderkey").alias("id"), "verdict")
