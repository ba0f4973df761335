"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB definitions of the bound views, each after those it reads.
VIEWS: dict[str, str] = {
    "g_rows": """SELECT 'C' || o_custkey AS entity, 'a' AS side, l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 'S' || l_suppkey, 'b', l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""",
    "gradings": """SELECT entity, side, year(l_shipdate)::INT AS period, l_returnflag AS family, l_returnflag || l_linestatus AS grader,
        (l_quantity * 2)::INT AS score_t, l_discount > 0 AS judged, l_tax > 0.04 AS evidence_used,
        CASE WHEN l_orderkey % 97 = 0 THEN 'c2' ELSE 'c1' END AS contract_id FROM g_rows""",
    "canon": """SELECT entity, side, period, sum(score_t)::BIGINT AS sum_t, count(*) AS n, max(score_t) - min(score_t) AS spread_t
        FROM gradings WHERE judged AND contract_id = 'c1' GROUP BY ALL""",
    "family_scores": """SELECT entity, period, family, sum(score_t)::BIGINT AS sum_t, count(*) AS n FROM gradings WHERE judged AND contract_id = 'c1' GROUP BY ALL""",
    "pairings_screen": """SELECT 'C' || o_custkey AS a, 'S' || l_suppkey AS b, 'C' || o_custkey || '|S' || l_suppkey || '|' || p_name AS pairing_id,
        p_name AS work, min(year(l_shipdate))::INT AS period, 'on_screen' AS domain, [0, 40, 100][min(l_linenumber % 3)::INT + 1] AS weight_h
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, l_suppkey, p_name""",
    "pairings_life": """SELECT 'C' || o_custkey AS a, 'S' || l_suppkey AS b, 'C' || o_custkey || '|S' || l_suppkey AS pairing_id,
        min(o_orderdate)::DATE AS start_d, max(l_shipdate)::DATE AS end_d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
    "life_days": """SELECT pairing_id, a, b, y::INT AS period, start_d, end_d,
        date_diff('day', greatest(start_d, make_date(y, 1, 1)), least(end_d, make_date(y, 12, 31))) + 1 AS days,
        date_diff('day', start_d, end_d) + 1 AS total_days
        FROM (SELECT *, unnest(range(year(start_d), year(end_d) + 1)) AS y FROM pairings_life WHERE end_d >= start_d)""",
    "period_rows": """SELECT p.pairing_id, p.a, p.b, p.period, days, total_days, x.sum_t AS a_sum, x.n AS a_n, z.sum_t AS b_sum, z.n AS b_n,
        round(10 * x.sum_t / x.n)::BIGINT AS a_h, round(10 * z.sum_t / z.n)::BIGINT AS b_h FROM life_days p
        LEFT JOIN canon x ON x.entity = p.a AND x.period = p.period LEFT JOIN canon z ON z.entity = p.b AND z.period = p.period""",
    "candidates": """SELECT o_custkey AS k, l_returnflag AS stage, o_orderdate::DATE AS start_d, l_shipdate::DATE AS end_d, l_orderkey AS seq, l_linenumber AS line
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "evidence": """SELECT event_id AS observation_id, user_id AS entity, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS period, event_type AS type,
        value, props, event_type || props AS source FROM events""",
    "estimates": """SELECT entity, period, least(100, greatest(0, round(avg(value))))::INT AS estimate, string_agg(DISTINCT type, '+' ORDER BY type) AS shape,
        count(*) AS n_obs FROM evidence GROUP BY entity, period""",
    "sparse": """SELECT entity, period, string_agg(DISTINCT props, '+' ORDER BY props) AS shape, least(100, round(avg(value)))::INT AS estimate
        FROM evidence WHERE type = 'purchase' AND value > 50 GROUP BY entity, period""",
    "episodes_e": """SELECT DISTINCT user_id AS a, user_id + 1 AS b, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS period FROM events WHERE event_type = 'signup'""",
    "resolved": """SELECT e.a, e.b, e.period,
        (SELECT min((abs(s.period - e.period), s.period)) FROM sparse s WHERE s.entity = e.a AND abs(s.period - e.period) <= 1) AS ra,
        (SELECT min((abs(s.period - e.period), s.period)) FROM sparse s WHERE s.entity = e.b AND abs(s.period - e.period) <= 1) AS rb FROM episodes_e e""",
    "pair_scores": """SELECT p.pairing_id, p.a, p.b, p.work, p.period, p.domain, p.weight_h, x.sum_t AS a_sum, x.n AS a_n, z.sum_t AS b_sum, z.n AS b_n,
        (round(1e6 * (z.sum_t / z.n - x.sum_t / x.n)))::BIGINT AS gap_u FROM pairings_screen p
        LEFT JOIN canon x ON x.entity = p.a AND x.period = p.period LEFT JOIN canon z ON z.entity = p.b AND z.period = p.period""",
    "contribs": """SELECT a AS entity, 'a' AS side, domain, pairing_id, weight_h, gap_u * weight_h AS paw, gap_u FROM pair_scores WHERE gap_u IS NOT NULL AND weight_h <> 0
        UNION ALL SELECT b, 'b', domain, pairing_id, weight_h, -gap_u * weight_h, -gap_u FROM pair_scores WHERE gap_u IS NOT NULL AND weight_h <> 0""",
    "board": """SELECT side, domain, entity, count(*) AS pairings, sum(weight_h)::BIGINT AS exposure_h, sum(paw)::BIGINT AS total,
        round(sum(paw) / sum(weight_h), 6) AS rate FROM contribs GROUP BY ALL HAVING count(*) >= 2""",
    "population": """SELECT family, side, entity, period, round(1000 * sum(score_t) / count(*))::BIGINT AS x FROM gradings
        WHERE judged AND contract_id = 'c1' GROUP BY ALL""",
    "scales": """SELECT family, coalesce(side, '*') AS side, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM population
        GROUP BY GROUPING SETS ((family, side), (family)) HAVING count(*) >= 2 AND stddev_samp(x) > 0""",
    "normal": """SELECT p.family, p.side, p.entity, p.period, p.x, round(g.mean + g.sd * (p.x - c.mean) / c.sd)::BIGINT AS z FROM population p
        JOIN scales c ON c.family = p.family AND c.side = p.side JOIN scales g ON g.family = p.family AND g.side = '*'""",
    "normal_gaps": """SELECT p.pairing_id, p.domain, p.a, p.b, p.weight_h, count(*) AS families, round(sum(n2.z - n1.z) / count(*))::BIGINT AS z_gap, round(sum(n2.x - n1.x) / count(*))::BIGINT AS raw_gap
        FROM pairings_screen p JOIN normal n1 ON n1.entity = p.a AND n1.period = p.period JOIN normal n2 ON n2.entity = p.b AND n2.period = p.period AND n2.family = n1.family GROUP BY ALL""",
    "family_gaps": """SELECT p.pairing_id, p.weight_h, x.family, round(1000 * (z.sum_t / z.n - x.sum_t / x.n))::BIGINT AS gap FROM pairings_screen p
        JOIN family_scores x ON x.entity = p.a AND x.period = p.period JOIN family_scores z ON z.entity = p.b AND z.period = p.period AND z.family = x.family""",
    "islands": """SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY start_d, end_d, stage, seq, line ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN abs(date_diff('day', lag(end_d) OVER w, start_d)) <= 30 THEN 0 ELSE 1 END AS brk FROM candidates WHERE end_d >= start_d
        WINDOW w AS (PARTITION BY k ORDER BY start_d, end_d, stage, seq, line))""",
    "works": "SELECT DISTINCT l_orderkey AS work, 'S' || l_suppkey AS entity, p_retailprice AS prominence FROM lineitem JOIN part ON l_partkey = p_partkey",
    "rater": """SELECT user_id AS target, event_type AS shape, json_extract_string(props, '$.k')::INT % 3 AS grader, count(*) AS n, stddev_samp(round(value)) AS sd
        FROM events GROUP BY ALL HAVING count(*) > 1""",
    "docs": "SELECT * FROM documents",
}


def with_views(sql: str) -> str:
    """The statement with the views it needs in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    ctes = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in need)
    return f"WITH {ctes} {sql}" if need else sql


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` is its DuckDB counterpart."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return f

    return put
