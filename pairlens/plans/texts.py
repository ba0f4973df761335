"""Queries on names, free text and assembled text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import gradings as G
from ..operators import tables as W
from ..operators import temporal as T
from ..operators.phrases import phrase_hits
from . import demo
from .registry import query

_WS = r"'[\t\n\x0b\f\r ]+', ' ', 'g'"


@query(f"SELECT doc_id, md5(trim(lower(regexp_replace(text, {_WS})))) AS h FROM documents")
def tx_norm_ws(spark, sf):
    return demo.table(spark, sf, "documents").select("doc_id", F.md5(X.normal_space(F.col("text"))).alias("h"))


@query(r"""SELECT conv_id, turn, md5(CASE WHEN s = '' THEN p ELSE s END) AS title FROM (SELECT conv_id, turn, p, trim(regexp_replace(p, '\b(the )?(directors?|extended|unrated|special|theatrical|ultimate|final|collectors?|anniversary|remastered|uncut|redux)\b.*$', '')) AS s
    FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(translate(lower(text || [': The Director''s Cut', ' (Uncut)', ' 2'][(turn % 3 + 1)::INT]), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS p FROM conversations))""")
def tx_norm_title(spark, sf):
    edition = F.get(F.array(F.lit(": The Director's Cut"), F.lit(" (Uncut)"), F.lit(" 2")), (F.col("turn") % 3).cast("int"))
    return demo.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.normal_title(F.concat("text", edition))).alias("title"))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(lower('The ' || p_name || '!'), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '') AS n FROM part")
def tx_norm_list(spark, sf):
    return demo.table(spark, sf, "part").select("p_partkey", X.normal_list(F.concat(F.lit("The "), "p_name", F.lit("!"))).alias("n"))


@query("SELECT lower(trim(coalesce(source, ''))) AS publisher, count(*) AS n FROM documents GROUP BY 1")
def tx_norm_publisher(spark, sf):
    return demo.table(spark, sf, "documents").groupBy(F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("publisher")).agg(F.count(F.lit(1)).alias("n"))


_NAME = "(SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS name, p_name FROM part)"


def _names(spark, sf):
    return demo.table(spark, sf, "part").select("p_partkey", F.initcap("p_name").alias("name"), "p_name")


@query(f"SELECT p_partkey, p_partkey % 5 < 3 AS is_name FROM {_NAME}")
def tx_is_name(spark, sf):
    first, second = F.split("name", " ")[0], F.split("name", " ")[1]
    forms = F.array(F.col("name"), F.concat(F.substring(first, 1, 1), F.lit(". "), second), F.concat(F.lit("O’"), first, F.lit(" "), second, F.lit("-"), first), first, F.col("p_name"))
    return _names(spark, sf).select("p_partkey", X.is_name(F.get(forms, (F.col("p_partkey") % 5).cast("int"))).alias("is_name"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS unresolved FROM customer")
def tx_is_unresolved_id(spark, sf):
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Q"), "c_custkey")).otherwise(F.col("c_name"))
    return demo.table(spark, sf, "customer").select("c_custkey", label.rlike(r"^Q\d+$").alias("unresolved"))


@query(f"""SELECT p_partkey, '[SUBJECT] and ' || CASE WHEN strlen(f) >= 4 THEN '[SUBJECT]' ELSE upper(f) END || ' of [SUBJECT] saw ' || g || 's' AS out
    FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS g FROM part)""")
def tx_redact(spark, sf):
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    text = F.concat(F.col("name"), F.lit(" and "), F.upper(first), F.lit(" of "), F.col("p_brand"), F.lit(" saw "), second, F.lit("s"))
    df = demo.table(spark, sf, "part").withColumn("name", F.initcap("p_name"))
    return df.select("p_partkey", X.redacted(text, F.col("name"), F.col("p_brand")).alias("out"))


@query(f"""SELECT p_partkey, CASE WHEN strlen(f) < 4 THEN f ELSE '' END || CASE WHEN strlen(f) < 4 AND strlen(g) < 4 THEN ' ' ELSE '' END || CASE WHEN strlen(g) < 4 THEN g ELSE '' END AS residual
    FROM (SELECT p_partkey, split_part(name, ' ', 1) AS f, split_part(name, ' ', 2) AS g FROM {_NAME})""")
def tx_residual(spark, sf):
    return _names(spark, sf).select("p_partkey", F.array_join(X.residual(F.concat(F.lit("the "), F.upper("p_name"), F.lit(", seen")), F.col("name")), " ").alias("residual"))


@query(f"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g'), '\\[\\[([^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\2', 'g'), {_WS}))) AS h FROM pages""")
def tx_strip_markup(spark, sf):
    return demo.table(spark, sf, "pages").select("page_id", F.md5(X.stripped_markup(F.col("html"))).alias("h"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def tx_first_json(spark, sf):
    from ..operators import quality as Q

    e = demo.table(spark, sf, "events")
    return e.select("event_id", Q.number(Q.first_object(F.concat(F.lit("Answer: "), "props", F.lit(" end"))), "$.k").cast("int").alias("k"))


@query("SELECT c_custkey, c_custkey || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS o FROM customer")
def tx_ordinal(spark, sf):
    return demo.table(spark, sf, "customer").select("c_custkey", X.ordinal(F.col("c_custkey")).alias("o"))


@query("SELECT p_partkey, CASE WHEN strlen(split_part(p_name, ' ', -1)) >= 4 THEN split_part(p_name, ' ', -1) END AS s FROM part")
def tx_surname(spark, sf):
    return demo.table(spark, sf, "part").select("p_partkey", X.surname(F.col("p_name")).alias("s"))


@query("SELECT s_suppkey, [s_name, s_name || ' (firm)', '(old) ' || s_name][(s_suppkey % 3 + 1)::INT] AS plain FROM supplier")
def tx_disambiguator(spark, sf):
    forms = F.array(F.concat("s_name", F.lit(" (firm)")), F.concat("s_name", F.lit(" (firm) (in Basel)")), F.concat(F.lit("(old) "), "s_name"))
    return demo.table(spark, sf, "supplier").select("s_suppkey", X.without_disambiguator(F.get(forms, (F.col("s_suppkey") % 3).cast("int"))).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'economy' WHEN p_type LIKE 'S%' THEN CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' ELSE 's other' END ELSE 'unclassified_failure' END AS class FROM part")
def tx_classify_prefix(spark, sf):
    labels = spark.createDataFrame([("ECONOMY", "economy"), ("S", "s other"), ("STANDARD", "standard")], "prefix string, class string")
    hit = demo.table(spark, sf, "part").join(F.broadcast(labels), F.expr("startswith(p_type, prefix)"), "left")  # three labels
    return hit.groupBy("p_partkey").agg(F.coalesce(F.max_by("class", F.length("prefix")), F.lit("unclassified_failure")).alias("class"))


@query("SELECT event_id, CASE WHEN k & 1 > 0 THEN 'quota' WHEN k & 2 > 0 THEN 'transient' WHEN k & 4 > 0 THEN 'nonzero' WHEN k & 8 > 0 THEN 'other' ELSE 'empty' END AS class FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)")
def tx_classify_failure(spark, sf):
    """Messages of every mix of phrases, by the bits of an event's k; of several phrases the gravest names the class."""
    k = F.get_json_object("props", "$.k").cast("int")
    said = F.concat_ws(" ", *[F.when(k.bitwiseAND(1 << i) > 0, p) for i, p in ((3, "it said"), (2, "EXIT status 1"), (1, "Temporarily down"), (0, "rate LIMIT hit"))])
    return demo.table(spark, sf, "events").select("event_id", X.failure_class(said).alias("class"))


@query("SELECT entity, period, CASE WHEN estimate BETWEEN 0 AND 19 THEN 'very low' WHEN estimate BETWEEN 20 AND 39 THEN 'low' WHEN estimate BETWEEN 40 AND 59 THEN 'middle' WHEN estimate BETWEEN 60 AND 79 THEN 'high' WHEN estimate BETWEEN 80 AND 100 THEN 'very high' END AS band FROM estimates")
def tx_band(spark, sf):
    return demo.estimates(spark, sf).select("entity", "period", G.band(F.col("estimate")).alias("band"))


def holders(quotes, docs):
    """(item_id, n): in how many texts ``t`` of ``docs`` (doc_id, t) each quote ``q`` of ``quotes`` (item_id, q) stands verbatim."""
    hits = phrase_hits(quotes.select(F.col("item_id").alias("pid"), "q"), docs.select(F.col("doc_id").alias("tid"), "t"))
    n = hits.groupBy(F.col("pid").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    return quotes.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def grounded_counts(spark, sf):
    """In how many documents each quote stands verbatim after normalisation."""
    q = demo.table(spark, sf, "benchmark").select("item_id", X.normal_space(F.col("text")).alias("q"))
    d = demo.table(spark, sf, "documents").select("doc_id", X.normal_space(F.col("text")).alias("t"))
    return holders(q, d).select("item_id", F.col("n").alias("grounded_in"))


@query(f"""SELECT item_id, coalesce(sum(CASE WHEN contains(trim(lower(regexp_replace(d.text, {_WS}))), q) THEN 1 END), 0)::BIGINT AS grounded_in FROM (SELECT item_id, trim(lower(regexp_replace(text, {_WS}))) AS q FROM benchmark), documents d GROUP BY item_id""")
def tj_verbatim(spark, sf):
    return grounded_counts(spark, sf)


@query(r"""SELECT doc_id, coalesce(bool_or(i IS NOT NULL AND NOT regexp_matches(lower(substr(s, greatest(i - 60, 1), least(i - 1, 60))), 'no |not |n''t|never|cannot|can not|without|absent|rather than|instead of|neither|nor |lacks|lacking|does not|is not|are not|was not|were not|would require|could reach|would reach|short of|falls short|unlike')), FALSE) AS asserted FROM (SELECT doc_id, s, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS i
    FROM (SELECT doc_id, s, list_filter(range(1, length(s)), lambda i: substr(s, i, 2) = 'in') AS l FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?\n]')) AS s FROM documents))) GROUP BY doc_id""")
def tj_negation(spark, sf):
    return demo.table(spark, sf, "documents").select("doc_id", X.asserted(F.col("text"), "in").alias("asserted"))


_LINES = """(SELECT l_orderkey AS id, o_orderdate, l_linenumber AS place, l_suppkey, p_name, upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS name,
    CASE WHEN l_suppkey % 2 = 0 THEN 0 WHEN l_partkey % 3 <> 0 THEN 1 ELSE 2 END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def wiki_texts(spark, sf, before, line, joined=""):
    """(id, text): the lines of each order written as wiki text, in order of line, part and supplier.

    ``line`` gives the text of a line from its struct (place, part, supp, name, plain) and its position; a name is a link
    for even suppliers, else a plain name or, for every third part, lower-case words that are no name.
    """
    n, part = demo.n_lines(spark, sf), demo.table(spark, sf, "part").select("p_partkey", "p_name")
    lines = demo.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = demo.dealt(lines, n, "l_partkey").join(demo.dealt(part, n, "p_partkey"), F.expr("l_partkey = p_partkey"))
    # Dealt by order last, so that the lines of an order and its table's rows stay where they are from here on.
    lines = demo.dealt(lines, n, "l_orderkey").join(demo.dealt(demo.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), n, "o_orderkey"), F.expr("l_orderkey = o_orderkey"))
    each = F.struct(F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.initcap("p_name").alias("name"), F.col("p_name").alias("plain"))
    df = lines.groupBy(F.col("l_orderkey").alias("id"), "o_orderdate").agg(F.array_sort(F.collect_list(each)).alias("l"))
    return df.select("id", F.concat(before, F.array_join(F.transform("l", line), joined)).alias("text"))


def mention(x, after=""):
    return F.when(x["supp"] % 2 == 0, F.concat(F.lit("[["), x["name"], F.lit("]]"))).otherwise(F.concat(F.when(x["part"] % 3 != 0, x["name"]).otherwise(x["plain"]), F.lit(after)))


@query(f"""SELECT id, year, place, name, place = 1 AS is_winner, linked FROM (
    SELECT id, year(o_orderdate)::INT AS year, 1 AS place, coalesce(arg_min(name, r) FILTER (WHERE place = 1), arg_min(name, r) FILTER (WHERE kind = 0)) AS name, TRUE AS linked FROM {_LINES} GROUP BY id, o_orderdate
    UNION ALL SELECT id, year(o_orderdate)::INT, place, name, kind = 0 FROM (SELECT *, row_number() OVER (PARTITION BY id, place ORDER BY kind, r) AS first FROM {_LINES} WHERE place BETWEEN 2 AND 5 AND kind < 2) WHERE first = 1) WHERE name IS NOT NULL""")
def tj_ranked_table(spark, sf):
    """Places of ranked lists: one table for each order, its first line in bold, five places long."""
    bold = lambda x: F.concat(F.lit(" '''[["), x["name"], F.lit("]]'''\n"))
    line = lambda x, i: F.when((i == 0) & (x["place"] == 1), bold(x)).otherwise(F.concat(F.lit("* "), X.ordinal(x["place"]), F.lit(": "), mention(x), F.lit("\n")))
    text = wiki_texts(spark, sf, F.concat(F.lit("{|\n|-\n! "), F.year("o_orderdate"), F.lit("\n| [[File:x.jpg]]")), line)
    return W.ranked_entries(text, 5).select("id", "year", F.col("rank").alias("place"), "name", "is_winner", "linked")


@query(f"""SELECT id, row_no, winner, status, value, CASE strlen(value) WHEN 10 THEN 'day' WHEN 7 THEN 'month' WHEN 4 THEN 'year' END AS precision, left(value, 4)::INT AS year FROM (
    SELECT id, r AS row_no, value, CASE WHEN value IS NOT NULL AND kind < 2 THEN name END AS winner, CASE WHEN value IS NULL THEN 'no date' ELSE ['linked', 'unlinked', 'no link'][kind + 1] END AS status
    FROM (SELECT *, CASE WHEN r <= greatest(1, n - (id % 3 = 0)::INT) THEN [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m')][(id % 4 + 1)::INT] END AS value FROM {_LINES}))""")
def tj_award_table(spark, sf):
    """Rows of award tables: one table for each order, whose date covers all rows or all but the last."""
    day = F.get(F.array(F.date_format("o_orderdate", "'{{dts|'yyyy'|'M'|'d'}}'"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "'{{dts|'yyyy'|'M'}}'")), (F.col("id") % 4).cast("int"))
    span = F.greatest(F.lit(1), F.size("l") - (F.col("id") % 3 == 0).cast("int"))
    date = F.concat(F.lit('\n| rowspan="'), span, F.lit('" | '), day)
    line = lambda x, i: F.concat(F.lit("\n|-"), F.when(i == 0, date).otherwise(""), F.lit("\n| "), mention(x, " (2)"), F.lit("\n| "), x["place"].cast("string"))
    return W.award_rows(wiki_texts(spark, sf, F.lit("{|"), line)).select("id", F.col("at").alias("row_no"), "value", "precision", "year", "winner", "status")


@query(f"SELECT id, 'Supplier ' || l_suppkey AS actor, arg_max(name, r) AS character FROM {_LINES} WHERE place % 4 <> 3 GROUP BY id, l_suppkey")
def tj_cast_lines(spark, sf):
    """Actors and characters of cast lists: one list for each order; lines of another form are not read."""
    actor = lambda x: F.concat(F.lit("* [[Supplier "), x["supp"].cast("string"), F.lit("|S]] "))
    role = lambda x: F.when(x["place"] % 4 == 3, F.concat(F.lit("plays "), x["name"])).otherwise(F.concat(F.lit("as '''"), x["name"], F.lit("''' – the last")))
    return W.cast_lines(wiki_texts(spark, sf, F.lit("== Cast ==\n"), lambda x, i: F.concat(actor(x), role(x)), "\n")).select("id", "actor", "character")


@query("""SELECT conv_id, turn, CASE WHEN turn - last_turn < 2 THEN who END AS carried FROM (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER w AS last_turn, CASE WHEN max(CASE WHEN role = 'user' THEN turn END) OVER w IS NOT NULL THEN 'user' END AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))""")
def wn_rowspan_carry(spark, sf):
    df = demo.table(spark, sf, "conversations").withColumn("v", F.expr("if(role = 'user', 'user', null)")).withColumn("n", F.lit(2))
    return T.rowspan_carry(df, "conv_id", "turn", "v", "n").select("conv_id", "turn", "carried")


@query("""SELECT name AS rule, count(*) AS hits FROM (VALUES ('large', 80), ('small', 20)) r(name, edge), events WHERE CASE WHEN name = 'large' THEN value > edge ELSE value < edge END GROUP BY name""")
def ud_rule(spark, sf):
    rules = {"large": "value > 80", "small": "value < 20"}
    e = demo.table(spark, sf, "events")
    out = None
    counts = e.agg(*[F.count_if(F.expr(x)).alias(k) for k, x in rules.items()])
    out = counts.select(F.expr("stack(2, 'large', large, 'small', small) as (rule, hits)"))
    return out


_LINE = "type || ' k' || json_extract_string(props, '$.k')"


@query(f"SELECT entity, period, 'entity ' || entity || ' day ' || period || chr(10) || string_agg({_LINE}, chr(10) ORDER BY observation_id) AS dossier FROM evidence GROUP BY entity, period")
def as_dossier(spark, sf):
    line = F.concat("type", F.lit(" k"), F.get_json_object("props", "$.k"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("observation_id", line.alias("t")))), lambda x: x["t"])
    df = demo.evidence(spark, sf).groupBy("entity", "period").agg(F.array_join(lines, "\n").alias("lines"))
    return df.select("entity", "period", F.concat(F.lit("entity "), "entity", F.lit(" day "), "period", F.lit("\n"), "lines").alias("dossier"))


@query("""SELECT e.a AS entity, e.period, coalesce(string_agg(s.shape, ';' ORDER BY s.shape), 'None supplied') AS evidence FROM (SELECT DISTINCT a, period FROM episodes_e) e LEFT JOIN sparse s ON s.entity = e.a AND s.period = e.period GROUP BY e.a, e.period""")
def as_prompt_evidence(spark, sf):
    e = demo.episodes_e(spark, sf).selectExpr("a as entity", "period").distinct()
    df = e.join(demo.sparse(spark, sf), ["entity", "period"], "left").groupBy("entity", "period").agg(F.array_join(F.array_sort(F.collect_list("shape")), ";").alias("t"))
    return df.select("entity", "period", F.when(F.col("t") == "", "None supplied").otherwise(F.col("t")).alias("evidence"))


@query("SELECT pairing_id, 'long' AS why FROM (SELECT pairing_id, row_number() OVER (ORDER BY date_diff('day', start_d, end_d) DESC, pairing_id) AS r FROM pairings_life) WHERE r <= 20 UNION ALL SELECT work::VARCHAR, 'stride' FROM (SELECT work, row_number() OVER (ORDER BY work) - 1 AS r FROM (SELECT DISTINCT work FROM works)) WHERE r % 100 = 0")
def as_selection(spark, sf):
    longest = demo.pairings_life(spark, sf).orderBy(F.desc(F.datediff("end_d", "start_d")), "pairing_id").limit(20).select("pairing_id", F.lit("long").alias("why"))
    return longest.unionAll(wn_stride_sample(spark, sf).select(F.col("work").cast("string").alias("pairing_id"), F.lit("stride").alias("why")))


@query("SELECT work FROM (SELECT work, row_number() OVER (ORDER BY work) - 1 AS r FROM (SELECT DISTINCT work FROM works)) WHERE r % 100 = 0")
def wn_stride_sample(spark, sf):
    """Every hundredth work in order; positions come from some 4096 ranges of keys that are counted first."""
    w = demo.works(spark, sf).select("work").distinct()
    width = (w.agg(F.max("work")).first()[0] or 0) // 4096 + 1
    w = w.withColumn("range", F.expr(f"work div {width}"))
    n = w.groupBy("range").count()
    start = n.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))  # a row for each range
    pos = w.join(start, "range").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("work")) - 1)
    return pos.where("r % 100 = 0").select("work")
