"""Analogues over the tables that the reference has no counterpart of: the same operators on events and orders, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import ordered
from lexmill.session import table
from lexmill.sources import files
from lexmill.storage import scratch_path


def orders_latest(spark, d):
    """Each customer's latest order."""
    o = table(spark, d, "orders")
    return ordered.latest(o.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def orders_funnel(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def lineitem_top3(spark, d):
    """The three largest lines of each order."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.withColumn("rank", rank.cast("long")).where("rank <= 3").select("l_orderkey", "l_linenumber", "rank")


def lineitem_summary(spark, d):
    x, disc = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(x * disc), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


def nation_revenue(spark, d):
    """A star join: revenue by the customers' nation."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"))
    return joined.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"))


def events_hourly(spark, d):
    """Tumbling windows of an hour by type."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


def events_sessions(spark, d):
    """Sessions of a user: events with at most six hours between them (an extension, as the reference has no session window)."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.when(micros - F.lag(micros).over(by) <= F.lit(6 * 3_600_000_000), 0).otherwise(1)
    sessions = table(spark, d, "events").withColumn("new", gap).withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return sessions.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"))


def events_ema(spark, d):
    """W12 by type over event ids."""
    return ordered.moving_average(table(spark, d, "events").withColumn("k", F.concat("event_type", F.lit("-"), F.col("user_id") % 50)), "k", "event_id", "value", 10).select("k", F.round("average", 6).alias("ema"), "n")


def snapshot_diff(spark, d):
    """Urls by what the later batches changed: added, changed, unchanged or gone."""
    docs = table(spark, d, "docs").where("url is not null and text is not null")
    side = lambda rows, name: rows.groupBy("url").agg(F.sha2(F.min_by("text", "ord"), 256).alias(name))
    both = side(docs.where("batch < 5"), "old").join(side(docs.where("batch >= 5"), "new"), "url", "full")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def source_jsonl_roundtrip(spark, d):
    """Records written as JSON lines and read back, by status: a record without title or url has missing fields."""
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(table(spark, d, "docs").select("ord", "url", "title", "text", "category"), path)
    return files.read_jsonl(spark, path).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (orders_latest, orders_funnel, lineitem_top3, lineitem_summary, nation_revenue, events_hourly, events_sessions, events_ema, snapshot_diff, source_jsonl_roundtrip)}
SQL = {
    "orders_latest": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "orders_funnel": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "lineitem_top3": "SELECT l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3",
    "lineitem_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "events_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "events_sessions": "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2",
    "events_ema": """WITH RECURSIVE o AS (SELECT event_type || '-' || (user_id % 50) AS k, value, row_number() OVER (PARTITION BY event_type || '-' || (user_id % 50) ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
        e AS (SELECT k, i, value AS ema FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, o.value * 2.0 / 11 + e.ema * 9.0 / 11 FROM e JOIN o ON o.k = e.k AND o.i = e.i + 1) SELECT k, round(arg_max(ema, i), 6) AS ema, max(i) AS n FROM e GROUP BY 1""",
    "snapshot_diff": """WITH d AS (SELECT url, batch < 5 AS old, arg_min(text, ord) AS t FROM docs WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2), o AS (SELECT * FROM d WHERE old), n AS (SELECT * FROM d WHERE NOT old)
        SELECT CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'gone' WHEN o.t = n.t THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM o FULL JOIN n ON o.url = n.url GROUP BY 1""",
    "source_jsonl_roundtrip": "SELECT CASE WHEN url IS NULL OR title IS NULL OR text IS NULL THEN 'missing_fields' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM docs GROUP BY 1",
}
