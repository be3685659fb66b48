"""Streams over the event table, run to their end and read back; the SQL is that of the batch."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.operators.series import EVENT_TYPES
from kilnworks.sources.files import scratch_dir
from kilnworks.streaming import process

from .base import P, query, r6, sql_r6, table


def run_to_end(s: SparkSession, d: str, transform) -> DataFrame:
    """What a stream over the events appends until all of them are read, with the windows that are still open then.

    A batch is written to a folder named by its number, so one that is run again takes the place of what it wrote
    before. Windows are appended once the watermark has passed them, and their state is freed; after the last event a
    marker far ahead is sent through the same query, so that it passes them all.
    """
    schema = table(s, d, "events").schema
    out = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    end = table(s, d, "events").agg(F.max("ts")).first()[0]
    marker = s.createDataFrame([(None, end + timedelta(days=20), None, "end", None, None)], schema)
    marker.limit(0).write.parquet(f"{out}/marker")

    def run() -> DataFrame:
        events = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
        shaped = transform(events.unionByName(s.readStream.schema(schema).parquet(f"{out}/marker")))
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        shaped.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        return shaped

    run()
    marker.coalesce(1).write.mode("append").parquet(f"{out}/marker")
    shaped = run()
    return s.read.schema(shaped.schema).parquet(f"{out}/rows").select(*shaped.columns)


@query("stream_resample", f"WITH {P} SELECT h, {sql_r6(*EVENT_TYPES)} FROM P WHERE coalesce({', '.join(EVENT_TYPES)}) IS NOT NULL")
def stream_resample(s: SparkSession, d: str) -> DataFrame:
    return run_to_end(s, d, process.resample).filter(F.coalesce(*EVENT_TYPES).isNotNull()).select("h", *r6(*EVENT_TYPES))


@query("stream_sessions", "WITH x AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS run FROM x) SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM y GROUP BY user_id, run")
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    return run_to_end(s, d, process.sessions).filter("user_id is not null")


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    return run_to_end(s, d, lambda e: process.first_seen(e, ["event_id"]).select("event_id", "user_id")).filter("event_id is not null")


@query("stream_enrich", "SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey")
def stream_enrich(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return run_to_end(s, d, lambda e: process.enrich(e.withColumn("k", F.col("user_id") % 25), n, "k").select("event_id", "n_name")).filter("event_id is not null")


@query("stream_asof", """WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'view'), r AS (SELECT ts, value FROM events WHERE event_type = 'purchase'),
  j AS (SELECT event_id, r.value, (epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS age FROM l ASOF LEFT JOIN r ON l.ts >= r.ts)
  SELECT event_id, round(CASE WHEN age <= 1800 THEN value END, 6) AS purchased, round(CASE WHEN age <= 1800 THEN age / 60 END, 6) AS age_minutes FROM j""")
def stream_asof(s: SparkSession, d: str) -> DataFrame:
    """Views with the last purchase before them: the stream meets a table of the purchases."""
    static = table(s, d, "events").filter("event_type = 'purchase'").select("ts", F.col("value").alias("purchased"))
    shaped = lambda e: process.asof_static(e.filter("event_type = 'view'").select("event_id", "ts"), static, ["purchased"], 1800)
    return run_to_end(s, d, shaped).select("event_id", *r6("purchased", "age_minutes"))


@query("stream_causal_fill", "WITH x AS (SELECT user_id, event_id, ts, CASE WHEN value BETWEEN 10 AND 400 THEN value END AS v FROM events) SELECT user_id, event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS value FROM x")
def stream_causal_fill(s: SparkSession, d: str) -> DataFrame:
    return run_to_end(s, d, process.causal_fill).filter("event_id is not null").select("user_id", "event_id", *r6("value"))


@query("stream_spike_repair", """WITH l AS (SELECT event_type, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM events GROUP BY 1), x AS (SELECT user_id, event_id, ts, value AS v, low, high FROM events LEFT JOIN l USING (event_type)),
  a AS (SELECT *, CASE WHEN count(v) OVER w >= 3 THEN quantile_cont(v, 0.5) OVER w END AS m FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 8 PRECEDING)), b AS (SELECT *, abs(v - m) AS d FROM a),
  c AS (SELECT *, CASE WHEN count(d) OVER w >= 3 THEN quantile_cont(d, 0.5) OVER w END AS s FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 8 PRECEDING)), f AS (SELECT *, coalesce((s > 0 AND d > 6 * s) OR v < low OR v > high, false) AS flagged FROM c)
  SELECT user_id, event_id, flagged, round(last_value(CASE WHEN NOT flagged THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS value FROM f""")
def stream_spike_repair(s: SparkSession, d: str) -> DataFrame:
    """Each user's readings against limits from a table, and against the user's last nine."""
    limits = table(s, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.01)).alias("low"), F.percentile("value", F.lit(0.99)).alias("high"))
    name, provider = process.STATE_STORE
    before = s.conf.get(name)
    s.conf.set(name, provider)
    try:
        found = run_to_end(s, d, lambda e: process.spike_repair(e, limits))
    finally:
        s.conf.set(name, before)
    return found.filter("event_id is not null").select("user_id", "event_id", "flagged", *r6("value"))
