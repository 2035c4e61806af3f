"""Queries that run as streams; their oracles are the same totals as batch statements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources.roles import table
from tidemark.streaming import ledger, runs, stateful


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream; event time is a timestamp of the session's zone there."""
    return runs.read(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CASE WHEN count(*)>=60 THEN sum(CAST(round(value*10000) AS BIGINT))/1e4 END AS total FROM events GROUP BY 1,2")
def stream_tumbling_complete(spark: SparkSession, sf: str) -> DataFrame:
    return runs.settle(runs.hourly_complete(events(spark, sf), 60))


@query("SELECT CAST(CAST(ts AS DATE)-CAST(k AS INT) AS DATE) AS start, event_type, count(*) AS n FROM events, (SELECT unnest(generate_series(0,6)) AS k) GROUP BY 1,2")
def stream_sliding7(spark: SparkSession, sf: str) -> DataFrame:
    return runs.settle(runs.sliding(events(spark, sf)))


@query(
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts)+INTERVAL 12 HOUR AS stop, count(*) AS n FROM b GROUP BY user_id, s"""
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    return runs.settle(runs.sessions(events(spark, sf)))


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def stream_distinct_days(spark: SparkSession, sf: str) -> DataFrame:
    late = runs.span(table(spark, sf, "events"))
    return runs.settle(runs.distinct_days(events(spark, sf), late), mode="append")


@query(
    """WITH d AS (SELECT user_id AS aoi, event_id AS scene, ts, 1-(value-100*floor(value/100))/100 AS v FROM events), s AS (SELECT *, v-lag(v) OVER w AS step FROM d WINDOW w AS (PARTITION BY aoi ORDER BY ts, scene)),
 h AS (SELECT *, list_filter(list(step) OVER (PARTITION BY aoi ORDER BY ts, scene ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS b FROM s),
 m AS (SELECT *, CASE WHEN len(b)>=5 THEN list_median(b) END AS mid FROM h), k AS (SELECT *, 1.4826*list_median(list_transform(b, lambda x: abs(x-mid))) AS mad FROM m)
 SELECT aoi, scene, round(step,6) AS step, CASE WHEN step IS NULL THEN 'NO DATA' WHEN step<=-0.05 THEN CASE WHEN mid IS NOT NULL AND mad>1e-9 AND (step-mid)/mad<=-2 THEN 'UNUSUAL DECLINE' ELSE 'DECLINE' END WHEN step>=0.05 THEN 'GREENING' ELSE 'STABLE' END AS label FROM k"""
)
def stream_change_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene against the one before of its area, by a state of the area's last differences."""
    e = events(spark, sf).select(F.col("user_id").alias("aoi"), F.col("event_id").alias("scene"), "ts", (1 - F.pmod("value", F.lit(100.0)) / 100).alias("value"))
    made = runs.settle(stateful.change_labels(e), mode="append")
    return made.select("aoi", "scene", F.round("step", 6).alias("step"), "label")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, ts, event_type<>'view' AS complete FROM events),
 c AS (SELECT key, min(ts) AS ts FROM e WHERE complete GROUP BY key UNION ALL SELECT key, n FROM (SELECT c.key, (SELECT min(e.ts) FROM e WHERE e.key=c.key AND e.complete AND e.ts>=c.ts+INTERVAL 6 HOUR) AS n FROM c) WHERE n IS NOT NULL),
 f AS (SELECT c.key, c.ts, min(id) AS id FROM c JOIN e ON e.key=c.key AND e.ts=c.ts AND e.complete GROUP BY 1,2)
 SELECT e.key, e.id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.key=e.key AND e.ts<f.ts+INTERVAL 6 HOUR AND (f.ts,f.id)<(e.ts,e.id)) THEN 'cached' ELSE 'computed' END AS answer FROM e"""
)
def stream_cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Which requests a complete result of the last six hours answers."""
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", (F.col("event_type") != "view").alias("complete"))
    return runs.settle(stateful.cached(e, late=runs.span(table(spark, sf, "events"))), mode="append")


@query(
    """SELECT CASE WHEN value IS NULL THEN 'no value' WHEN value-100*floor(value/100)>95 THEN 'too cloudy' WHEN event_id%50=0 THEN 'cut short' ELSE 'kept' END AS state, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1"""
)
def stream_set_aside(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes that cannot be used go to a table of their own with the reason; both tables are counted."""
    why = F.when(F.col("value").isNull(), "no value").when(F.pmod("value", F.lit(100.0)) > 95, "too cloudy").when(F.col("event_id") % 50 == 0, "cut short")
    good, aside = stateful.set_aside(events(spark, sf), why)
    both = good.select("event_id", F.lit("kept").alias("state")).unionByName(aside.select("event_id", F.col("reason").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS k FROM orders)
 SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS cents FROM n WHERE k=1 GROUP BY 1"""
)
def stream_ingest_years(spark: SparkSession, sf: str) -> DataFrame:
    """Orders brought by year in two runs, of which the second finds nothing new; a customer's last order of a day stands."""
    base = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    for _ in range(2):
        rows = runs.read(spark, f"{sf}/orders.parquet").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", cents)
        ledger.bring(rows, base, F.col("day"))
    stand = ledger.newest(ledger.brought(spark, base, rows.schema), ["o_custkey", "day"], ["o_orderkey", "batch"])
    return stand.groupBy("year").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(CAST(round(value*10000) AS BIGINT))/1e4 AS total FROM events WHERE ts IS NOT NULL GROUP BY 1,2)
 SELECT * FROM d WHERE day<=(SELECT max(day) FROM d)-7"""
)
def stream_final_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Daily totals by kind, brought as they change; the last seven days are not final and left out."""
    base = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    late = runs.span(table(spark, sf, "events"))
    days = ledger.daily_totals(events(spark, sf), ["event_type"], F.round(F.col("value") * 10000).cast("long"), late)
    ledger.bring(days, base, F.col("day"), "update")
    now = ledger.newest(ledger.brought(spark, base, days.schema), ["day", "event_type"], ["batch"])
    return ledger.final(now).select("day", "event_type", "n", (F.col("total") / 1e4).alias("total"))
