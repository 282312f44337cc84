"""Queries that run streams and keyed writes over the tables, with SQL that says what must come out.

Each streams a table's rows as events through the state machine, once through what is there, with its state and
its rows in the shared folder, and reads the rows back.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollups
from ..session import shared_folder
from ..sources import sinks
from ..sources.driver import Tables
from ..sources.keyed import KeyedTable
from ..streaming import stateful
from .catalog import SQL, query

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _stream(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(t.raw(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _run(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    folder, before = _folder(t, name), t.spark.conf.get(PROVIDER)
    stateful.use_state_store(t.spark)
    try:
        return stateful.run_available(stream, f"{folder}/rows", f"{folder}/state")
    finally:
        t.spark.conf.set(PROVIDER, before)


@query("str01_work_queue", """WITH RECURSIVE v AS (SELECT user_id AS k, event_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS tm, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queue' END AS kind FROM events),
 e AS (SELECT k, tm, kind, row_number() OVER (PARTITION BY k ORDER BY tm, kind, event_id) AS i, max(tm) OVER (PARTITION BY k) AS last_at FROM v),
 r AS (SELECT k, i, tm, kind, last_at, CAST(NULL AS TIMESTAMP) AS held, CASE WHEN kind = 'queue' THEN tm END AS s FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.i, e.tm, e.kind, e.last_at, CASE WHEN e.tm < r.s + INTERVAL 18 HOUR THEN r.s END AS held,
   CASE WHEN e.kind <> 'queue' THEN NULL WHEN e.tm < r.s + INTERVAL 18 HOUR THEN r.s ELSE e.tm END FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1),
 w AS (SELECT max(tm) - INTERVAL 10 MINUTE AS mark FROM v),
 said AS (SELECT k, CASE WHEN kind <> 'queue' THEN kind WHEN held IS NULL THEN 'run' ELSE 'refused' END AS action, tm, coalesce(held, tm) AS s, i FROM r WHERE kind = 'queue' OR held IS NOT NULL),
 jobs AS (SELECT k, s, any_value(last_at) AS last_at FROM (SELECT r.k, r.s, r.last_at FROM r WHERE s = tm AND held IS NULL) GROUP BY 1, 2),
 ends AS (SELECT jobs.k, jobs.s, coalesce(min(said.tm), greatest(any_value(jobs.last_at), any_value(mark))) AS until FROM jobs CROSS JOIN w LEFT JOIN said ON said.k = jobs.k AND said.s = jobs.s AND said.action IN ('done', 'failed') GROUP BY 1, 2),
 leases AS (SELECT k, CASE WHEN j = 3 THEN 'given_up' ELSE 'again' END AS action, least(j + 1, 3) AS attempt, s + to_hours(CAST(6 * j AS INTEGER)) AS tm FROM ends, (SELECT unnest([1, 2, 3]) AS j) WHERE s + to_hours(CAST(6 * j AS INTEGER)) <= until)
SELECT k AS quotation_id, action, CAST(attempt AS INTEGER) AS attempt, tm FROM leases
UNION ALL SELECT k, action, CAST(1 + least(2, date_diff('second', s, tm) // 21600) AS INTEGER), tm FROM (SELECT k, action, s, tm FROM said)""")
def _(t):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("queue")
    events = _stream(t, "events").select(F.col("user_id").alias("quotation_id"), F.lit("1").alias("organization_id"), kind.alias("kind"), F.date_trunc("second", F.col("ts")).cast("timestamp").alias("at"))
    return _run(t, stateful.work_queue(events, lease=dt.timedelta(hours=6), attempts=3), "str01").select("quotation_id", "action", "attempt", F.col("at").alias("tm"))


@query("str05_overdue_stream", """WITH o AS (SELECT o_orderkey AS po_id, CAST(o_orderdate AS TIMESTAMP) AS issued, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 50 AS INTEGER)) AS expected FROM orders),
 d AS (SELECT l_orderkey AS po_id, CAST(l_shipdate AS TIMESTAMP) AS delivered FROM lineitem WHERE l_linenumber = 1),
 w AS (SELECT greatest((SELECT max(issued) FROM o), (SELECT max(delivered) FROM d)) - INTERVAL 1 HOUR AS mark),
 x AS (SELECT po_id, issued, expected, any_value(mark) AS mark, min(delivered) FILTER (delivered >= issued) AS closed FROM o LEFT JOIN d USING (po_id) CROSS JOIN w GROUP BY 1, 2, 3)
SELECT po_id, 'Delivery status: purchase order ' || po_id AS subject, greatest(expected + INTERVAL 1 MILLISECOND, issued) AS tm FROM x
WHERE CASE WHEN closed IS NOT NULL THEN expected < closed ELSE expected < greatest(mark, issued) END""")
def _(t):
    day = lambda c: F.col(c).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    expected = F.expr("cast(o_orderdate as timestamp) + make_dt_interval(o_orderkey % 50)")
    issued = _stream(t, "orders").select(F.col("o_orderkey").alias("po_id"), F.lit("1").alias("organization_id"), F.col("o_orderkey").cast("string").alias("po_number"), F.lit("issued").alias("kind"), expected.alias("expected"), day("o_orderdate").alias("at"))
    delivered = _stream(t, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("po_id"), F.lit("1").alias("organization_id"), F.lit("").alias("po_number"), F.lit("delivered").alias("kind"), none.alias("expected"), day("l_shipdate").alias("at"))
    return _run(t, stateful.overdue_stream(issued.unionByName(delivered)), "str05").select("po_id", "subject", F.col("at").alias("tm"))


@query("str04_autopilot_stream", """WITH q AS (SELECT l_orderkey AS request_id, l_orderkey * 10 + l_linenumber AS quotation_id, CAST(l_shipdate AS TIMESTAMP) AS tm, (l_orderkey * 10 + l_linenumber) % 3 <> 0 AS ready FROM lineitem),
 n AS (SELECT request_id, tm, quotation_id, count(DISTINCT quotation_id) FILTER (ready) OVER (PARTITION BY request_id ORDER BY tm RANGE UNBOUNDED PRECEDING) AS upto FROM q),
 r AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS TIMESTAMP) AS opened, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 60 DAY END AS closed FROM orders)
SELECT request_id, min(tm) AS tm FROM n JOIN r USING (request_id) WHERE upto >= 2 AND tm >= opened AND (closed IS NULL OR tm < closed) AND EXISTS (SELECT 1 FROM q WHERE q.request_id = n.request_id AND q.tm = n.tm AND q.ready) GROUP BY 1""")
def _(t):
    day = lambda c: F.col(c).cast("timestamp")
    none = F.lit(None).cast("long")
    of = lambda df, kind, quotation, status, at: df.select("request_id", F.lit("1").alias("organization_id"), F.lit(kind).alias("kind"), quotation.alias("quotation_id"), status.alias("status"), at.alias("at"))
    orders = _stream(t, "orders").withColumn("request_id", F.col("o_orderkey"))
    opened = of(orders, "request", none, F.lit("open"), day("o_orderdate"))
    closed = of(orders.where("o_orderstatus = 'F'"), "request", none, F.lit("closed"), F.expr("cast(o_orderdate as timestamp) + make_dt_interval(60)"))
    lines = _stream(t, "lineitem").withColumn("request_id", F.col("l_orderkey"))
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    said = of(lines, "quotation", number, F.when(number % 3 == 0, "FAILED").otherwise("COMPLETED"), day("l_shipdate"))
    return _run(t, stateful.autopilot_stream(opened.unionByName(closed).unionByName(said)), "str04").select("request_id", F.col("at").alias("tm"))


@query("str02_keyed_ingest", "SELECT user_id, event_type, min(CAST(ts AS TIMESTAMP)) AS first_at FROM events GROUP BY 1, 2")
def _(t):
    folder = _folder(t, "str02")
    table = KeyedTable(t.spark, f"{folder}/table", ["user_id", "event_type"], buckets=8)
    for name in ("first", "anew"):  # the second stream starts again with all of it, and adds nothing
        events = _stream(t, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("first_at"))
        q = events.writeStream.foreachBatch(table.sink(name, ["first_at"])).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    return table.read()


def _orders_by_key(t: Tables, name: str) -> KeyedTable:
    table = KeyedTable(t.spark, f"{_folder(t, name)}/table", ["id"], buckets=16)
    table.create(t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("owner_id"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp").alias("updated_at")))
    return table


@query("snk02_merge_by_key", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 3 THEN NULL ELSE o_custkey END AS owner_id, CASE WHEN o_orderkey % 97 = 3 THEN 0.5 ELSE o_totalprice END AS total FROM orders WHERE o_orderkey % 89 <> 5")
def _(t):
    table = _orders_by_key(t, "snk02")
    change = t.raw("orders").where("o_orderkey % 97 = 3").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("owner_id"), F.lit(0.5).alias("total"))
    table.merge(change, lambda old: sinks.update(old, change, "id"))
    gone = t.raw("orders").where("o_orderkey % 89 = 5").select(F.col("o_orderkey").alias("id"))
    table.merge(gone, lambda old: sinks.delete(old, gone, "id"))
    return table.read().select("id", "owner_id", "total")


@query("snk03_upsert_by_key", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 53 = 1 THEN 1.0::DOUBLE ELSE o_totalprice END AS total FROM orders UNION ALL SELECT -o_orderkey, 1.0::DOUBLE FROM orders WHERE o_orderkey % 53 = 1 AND o_orderkey > 0")
def _(t):
    table = _orders_by_key(t, "snk03")
    some = table.read().where("id % 53 = 1 and id > 0").withColumn("total", F.lit(1.0))
    newer = some.withColumn("updated_at", F.lit("2100-01-01").cast("timestamp"))
    newer = newer.unionByName(newer.withColumn("id", -F.col("id")))
    table.merge(newer, lambda old: sinks.upsert(old, newer, ["id"]))
    return table.read().select("id", "total")


@query("agg07_incremental", SQL["agg07_spend_by_supplier"])
def _(t):
    folder = _folder(t, "agg07")
    orders, roll = t.purchase_orders, rollups.spend_roll_up(t.spark, f"{folder}/orders", f"{folder}/states")
    for k in range(3):  # files come in three lots; each refresh takes in its own
        orders.where(F.pmod(F.col("po_id"), F.lit(3)) == k).write.parquet(f"{folder}/orders/lot={k}")
        roll.refresh()
    return rollups.spend_by_supplier(roll.result())
