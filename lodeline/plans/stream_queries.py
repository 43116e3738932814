"""The streaming operators run to the end over what there is, so that their results can be compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline import streaming
from lodeline.session import checkpoint_folder, table


def _drain(s: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a table in the shared folder, and read that."""
    base = f"{checkpoint_folder(s)}/stream-{uuid.uuid4().hex}"
    q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return s.read.schema(out.schema).parquet(f"{base}/rows")


def daily_passes(s: SparkSession, d: str) -> DataFrame:
    """Events and passes by day and type."""
    w = streaming.windowed_counts(table(s, d, "events"))
    return w.select(F.to_date("start").alias("day"), "event_type", "events", "passes")


def user_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of six hours' gap: their number and longest by user."""
    w = streaming.sessions(table(s, d, "events"))
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


def streamed_events(s: SparkSession, d: str) -> DataFrame:
    """Every event once, through a stream with a watermark, counted by type."""
    stream = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    return _drain(s, streaming.once(stream).select("event_id", "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


QUERIES = {f.__name__: f for f in (daily_passes, user_sessions, streamed_events)}
ORACLE = {
    "daily_passes": "SELECT ts::DATE AS day, event_type, count(*) AS events, count(CASE WHEN value >= 50 THEN 1 END) AS passes FROM events GROUP BY ALL",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS events FROM n GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(events) AS longest FROM c GROUP BY user_id""",
    "streamed_events": "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
}
