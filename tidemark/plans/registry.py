"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB forms of the roles in tidemark.sources.roles.
FLOW = """o AS (SELECT o_orderpriority AS segment, CAST(o_orderdate AS DATE) AS date,
 SUM(CAST(round(o_totalprice*100) AS BIGINT))/1e6 AS v FROM orders GROUP BY 1,2),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM o),(SELECT max(date) FROM o),INTERVAL 1 DAY)) AS DATE) AS date),
flow AS (SELECT s.segment, c.date, coalesce(o.v,0.0) AS flow FROM (SELECT DISTINCT segment FROM o) s CROSS JOIN cal c
 LEFT JOIN o ON o.segment=s.segment AND o.date=c.date)"""
RAIN = """r0 AS (SELECT l_returnflag AS cell, CAST(l_shipdate AS DATE) AS date, SUM(CAST(l_quantity AS BIGINT))/10.0 AS v
 FROM lineitem GROUP BY 1,2),
rcal AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM r0),(SELECT max(date) FROM r0),INTERVAL 1 DAY)) AS DATE) AS date),
rain AS (SELECT s.cell, c.date, coalesce(r0.v,0.0) AS rain FROM (SELECT DISTINCT cell FROM r0) s CROSS JOIN rcal c
 LEFT JOIN r0 ON r0.cell=s.cell AND r0.date=c.date)"""
SCENES = """sc AS (SELECT event_id AS scene, ts, CAST(ts AS DATE) AS day, user_id AS aoi, event_type AS orbit,
 round(value - 100*floor(value/100),4) AS cloud FROM events)"""
PIXELS = (
    "px AS (SELECT vec_id AS px, CAST(vec_id // 32 AS INT) AS \"row\", CAST(vec_id % 32 AS INT) AS col, label AS class, "
    + ", ".join(f"CAST(least(greatest(floor((CAST(embedding[{i}] AS DOUBLE)+0.5)*8000),0),10000) AS INT) AS b{i}" for i in range(1, 9))
    + " FROM embeddings)"
)
SEASON = "CASE WHEN month({d})<=2 THEN 'winter' WHEN month({d})<=5 THEN 'pre-monsoon' WHEN month({d})<=9 THEN 'monsoon' ELSE 'post-monsoon' END"
DAY = "0.0864"


def query(oracle: str | None = None, *roles: str):
    """Register a function as a query under its own name; the oracle follows the CTEs of the roles it needs."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            text = oracle.strip()
            if roles:
                head = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
                text = head + ", ".join(roles) + (", " + text.removeprefix(head) if text.startswith(head) else " " + text)
            ORACLES[f.__name__] = text
        return f

    return add
