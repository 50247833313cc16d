"""Relational queries over the order tables and the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gallerist.plans.registry import query


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pricing_summary(t):
    p = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(p), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("customers_with_orders", "SELECT c_custkey, c_name, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def customers_with_orders(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("orders"))


@query("nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def nation_revenue(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("event_votes", """WITH w AS (SELECT user_id, event_id, event_type, ts, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING) AS seen, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_type FROM events)
SELECT user_id, event_id, event_type, len(seen) >= 4 AND len(list_filter(seen, lambda e: e = event_type)) / len(seen) >= 0.6 AND coalesce(last_type = event_type, false) AS stable FROM w""")
def event_votes(t):
    """The rolling vote over the events of every user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    w = t("events").withColumn("seen", F.collect_list("event_type").over(order.rowsBetween(-6, 0))).withColumn("last", F.lag("event_type").over(order))
    share = F.size(F.filter("seen", lambda e: e == F.col("event_type"))) / F.size("seen")
    return w.select("user_id", "event_id", "event_type", ((F.size("seen") >= 4) & (share >= 0.6) & F.coalesce(F.col("last") == F.col("event_type"), F.lit(False))).alias("stable"))


@query("event_sessions", """WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)
SELECT user_id, min(ts) AS started, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, session""")
def event_sessions(t):
    """Gaps and islands in time: sessions end after an idle hour."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(order)
    rows = t("events").withColumn("brk", F.coalesce(F.col("ts") - gap > F.expr("INTERVAL 1 HOUR"), F.lit(True)).cast("int"))
    rows = rows.withColumn("session", F.sum("brk").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).drop("session")


@query("event_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def event_latest(t):
    """Newest event of every user."""
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return t("events").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.event_type")


@query("event_props", "SELECT event_type, count(*) AS events, sum((props->>'$.k')::INT)::BIGINT AS k, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_props(t):
    """Values inside the JSON properties, by type."""
    k = F.from_json("props", "k int")["k"]
    return t("events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"), F.countDistinct("user_id").alias("users"))


@query("document_digests", "SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def document_digests(t):
    """Texts that occur in several documents, by digest."""
    return t("documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest")).agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc")).filter("documents > 1")


@query("debounced_events", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, true AS kept, us AS last FROM e WHERE rn = 1 UNION ALL SELECT e.*, e.us - s.last >= 800000, CASE WHEN e.us - s.last >= 800000 THEN e.us ELSE s.last END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, event_id, us FROM s WHERE kept""")
def debounced_events(t):
    """Events of a user at least 0.8 seconds after the last kept one: depends
    on what was kept, so it is a scan with state over sorted rows."""
    from gallerist.operators.debounce import debounce

    rows = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return debounce(rows, "user_id", "us", "event_id", 800_000)
