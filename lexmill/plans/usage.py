"""Usage events: sessions, windows, duplicates, sanitised logs, and a streaming twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.operators.merge import shared_folder
from lexmill.session import table
from lexmill.streaming import events as S
from lexmill.streaming import merges

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    return S.sessions(table(spark, d, "events"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_counts(spark, d):
    return S.tumbling(table(spark, d, "events"), "1 day", ["event_type"]).withColumn("total", F.round("total", 4))


@query("""
SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY ALL""")
def sliding_counts(spark, d):
    return S.tumbling(table(spark, d, "events"), "12 hours", ["event_type"], slide="6 hours").withColumn("total", F.round("total", 4))


@query("""
SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id""")
def event_dedup(spark, d):
    return S.first_seen(table(spark, d, "events"))


@query("""
WITH f AS (SELECT CAST(min(ts) AS DATE) AS day FROM events GROUP BY user_id), c AS (SELECT day, count(*) AS new_users FROM f GROUP BY day) SELECT day, new_users, CAST(sum(new_users) OVER (ORDER BY day) AS BIGINT) AS users_so_far FROM c""")
def running_users(spark, d):
    return S.running_users(table(spark, d, "events"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'other' END AS kind, nullif(substring(trim(coalesce(props, '')), 1, 40), '') AS props FROM events""")
def sanitised_log(spark, d):
    return S.sanitised(table(spark, d, "events"), ["click", "view", "purchase"])


def _event_stream(spark, d):
    """The events' files as a stream."""
    source = table(spark, d, "events")
    path = f"{d}/events.parquet"
    folder = path if len(source.inputFiles()) > 1 else d
    return spark.readStream.schema(source.schema).option("pathGlobFilter", "*" if folder == path else "events.parquet").parquet(folder)


#: Answers of providers to searches, in runs of which the last of a search counts.
_ANSWERS = "SELECT user_id % 200 AS search, CAST(event_id % 3 AS INT) AS run, event_type AS provider, concat('r', CAST(event_id % 23 AS STRING)) AS result, value AS score, event_id, ts FROM events"


@query(f"""
WITH a AS ({_ANSWERS}), l AS (SELECT search, max(run) AS run FROM a GROUP BY search),
b AS (SELECT search, run, result, provider, max(CAST(round(score * 1000000) AS BIGINT)) AS best, min(event_id) AS first_id FROM a JOIN l USING (search, run) GROUP BY ALL),
m AS (SELECT search, run, result, count(*) AS providers, sum(best) AS points, min(first_id) AS first_id FROM b GROUP BY ALL)
SELECT search, run, row_number() OVER (PARTITION BY search ORDER BY providers DESC, points DESC, result) AS place, result, providers, points / 1000000 AS score, first_id FROM m QUALIFY place <= 10""")
def streaming_ranks(spark, d):
    """Answers merged and ranked by a stateful stream over the events' files: what the batch form gives."""
    stream = _event_stream(spark, d)
    stream.createOrReplaceTempView(name := f"answers_{uuid.uuid4().hex}")
    answers = spark.sql(_ANSWERS.replace("FROM events", f"FROM {name}")).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/{name}"
    merges.merge_stream(answers, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    spark.catalog.dropTempView(name)
    return merges.latest(spark, f"{folder}/table").select("search", "run", "place", "result", "providers", "score", "first_id")


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT * FROM events) GROUP BY ALL""")
def streaming_tumbling(spark, d):
    """The tumbling counts by Structured Streaming over the events' files, run to their end, into a table."""
    zoned = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"tumbling_{uuid.uuid4().hex}"
    run = S.stream_tumbling(zoned, "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT event_type, date_trunc('month', ts) AS month, count(*) AS n, count(DISTINCT user_id) AS users, round(median(value), 4) AS median_value FROM events GROUP BY ALL""")
def monthly_usage(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.median("value"), 4).alias("median_value"))
