"""Queries over the events in time: intervals, sessions of a stream, sketches by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import intervals, sketches
from lodestack.plans.catalogue import query
from lodestack.session import scratch, table
from lodestack.streaming import windows


def _events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _valid(spark, sf_dir: str, kind: str, as_: str) -> DataFrame:
    """user_id, <as_>_id, <as_>_from, <as_>_to (microseconds): events of a kind hold for as many minutes as their value."""
    at = F.unix_micros("ts")
    return _events(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{as_}_id"), at.alias(f"{as_}_from"), (at + F.floor(F.col("value") * 60_000_000)).alias(f"{as_}_to"))


_VALID = "(SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS b FROM events WHERE event_type = '{}')"


@query(f"SELECT e.event_id, v.event_id AS view_id FROM events e LEFT JOIN {_VALID.format('view')} v ON v.user_id = e.user_id AND v.a <= epoch_us(e.ts) AND epoch_us(e.ts) < v.b")
def valid_views(spark, sf_dir):
    """Every event with the views of its user that hold at its time, also where none does."""
    points = _events(spark, sf_dir).select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    found = intervals.stab_join(points, _valid(spark, sf_dir, "view", "view"), ["user_id"], "at", "view_from", "view_to", "left")
    return found.select("event_id", "view_id")


@query(f"SELECT v.event_id AS view_id, c.event_id AS click_id, least(v.b, c.b) - greatest(v.a, c.a) AS shared FROM {_VALID.format('view')} v JOIN {_VALID.format('click')} c ON v.user_id = c.user_id AND v.a < c.b AND c.a < v.b WHERE v.a < v.b AND c.a < c.b")
def valid_overlaps(spark, sf_dir):
    """Views and clicks of one user that hold at the same time, and for how long."""
    found = intervals.overlap_join(_valid(spark, sf_dir, "view", "view"), _valid(spark, sf_dir, "click", "click"), ["user_id"], ("view_from", "view_to"), ("click_from", "click_to"))
    return found.select("view_id", "click_id", (F.least("view_to", "click_to") - F.greatest("view_from", "click_from")).alias("shared"))


@query("""WITH marked AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n, max(event_id) AS last_id FROM numbered GROUP BY user_id, s""")
def session_stream(spark, sf_dir):
    """Sessions of the events as a stream, half an hour apart. A row at the end of time closes it."""
    events = _events(spark, sf_dir).select("user_id", "ts", "event_id")
    root = scratch(spark, "windows")
    end = events.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    events.unionByName(end).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    found = windows.session_totals(stream, "user_id", "ts", "30 minutes", "10 minutes", F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    windows.drained(found, f"{root}/out", f"{root}/log").awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{root}/out").filter("user_id <> -1")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "last_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_hold, true AS median_holds FROM events GROUP BY event_type")
def daily_sketches(spark, sf_dir):
    """Sketches by day and kind, stored, read again and merged: whether distinct users and the median lie within the stated
    bounds of the exact ones (three standard errors; the rank error of the quantile sketch)."""
    events = _events(spark, sf_dir)
    path = scratch(spark, "sketches")
    sketches.daily(events, ["event_type"], F.col("ts"), F.col("user_id"), F.col("value")).write.parquet(path)
    merged = sketches.merged(spark.read.parquet(path), ["event_type"]).select("event_type", "n", sketches.distinct(F.col("items")).alias("about"), sketches.quantile(F.col("values"), 0.5).alias("median"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    both = events.join(F.broadcast(merged), "event_type").groupBy("event_type", "n", "about", "median").agg(F.count("value").alias("values"), F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    users_hold = F.abs(F.col("about") - F.col("users")) <= F.ceil(F.col("users") * 3 * sketches.HLL_RSE)
    slack = F.col("values") * sketches.KLL_RANK + 1
    median_holds = (F.col("below") <= F.col("values") * 0.5 + slack) & (F.col("upto") >= F.col("values") * 0.5 - slack)
    return both.join(exact, "event_type").select("event_type", "n", "users", users_hold.alias("users_hold"), median_holds.alias("median_holds"))
