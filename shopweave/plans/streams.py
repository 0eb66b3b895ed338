"""Registered queries of the streaming forms: each drains a recorded feed and returns what its stream wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import streaming
from ..functions import in_polygon
from ..operators import normalize
from ..sources.storage import new_path
from .adapter import ORIGIN, Retail
from .queries import ISLAND_SQL, NORMAL, PARSED_SQL, query

#: The twelve hours of events come in slices of two, each written after the one before it.
SLICES, SLICE_HOURS = 6, 2
#: A file source takes files by their times, so a trigger may mix the files of neighbouring slices, no others:
#: with this delay no row is late.
DELAY = "5 hours"
#: The store of the row that ends the feed: it moves the watermark past all others.
CLOSING = "ST0"


def recorded(r: Retail) -> str:
    """A folder of event files in time order, ended by a row days later."""

    def store() -> str:
        path, own = new_path(r.spark, "recorded"), r.facts.read()
        start = F.expr(f"TIMESTAMP_NTZ'{ORIGIN}'")
        number = F.least(F.lit(SLICES - 1), F.expr(f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'{ORIGIN}', ts) DIV {SLICE_HOURS * 3600} AS INT)"))
        for n in range(SLICES):
            own.where(number == n).hint("rebalance").write.mode("append").parquet(path)
        last = {"store_id": F.lit(CLOSING), "entity_id": F.lit("end"), "queue_event_id": F.lit("end"), "event_type": F.lit("billing_queue_join"), "event_id": F.lit(-1).cast("long"), "ts": start + F.expr("INTERVAL 4 DAYS")}
        r.spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in own.schema]).write.mode("append").parquet(path)
        return path

    return r._stored("recorded", store)


def drained(r: Retail, form: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``form`` of the recorded feed has written once all files, and the watermark behind them, have been taken."""
    feed = r.spark.readStream.schema(r.facts.read().schema).option("maxFilesPerTrigger", 2).parquet(recorded(r))
    out, path = form(feed), new_path(r.spark, "stream-out")
    drain(out.writeStream.format("parquet").outputMode("append").option("path", path), r)
    return r.spark.read.schema(out.schema).parquet(path).where(F.col("store_id") != CLOSING)


def drain(writer: DataStreamWriter, r: Retail) -> None:
    writer.option("checkpointLocation", new_path(r.spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()


def moment(micros: str):
    return F.timestamp_micros(micros).cast("timestamp_ntz")


@query("str1_parsed_lines", PARSED_SQL + " SELECT * EXCLUDE (arrival) FROM nk")
def _(r):
    def store() -> str:
        path = new_path(r.spark, "feed-text")
        r.lines.select("value").write.text(path)
        return path

    out, path = streaming.parsed(streaming.read_lines(r.spark, r._stored("feed-text", store))), new_path(r.spark, "stream-out")
    drain(out.writeStream.format("parquet").outputMode("append").option("path", path), r)
    return normalize.split(r.spark.read.schema(out.schema).parquet(path))[0].select(*[c for c in NORMAL if c != "arrival"])


@query("str2_first_arrivals", "SELECT store_id, queue_event_id, 1::BIGINT AS n FROM raw GROUP BY ALL")
def _(r):
    """Which of the repeats comes first depends on the triggers, how many stay does not."""
    kept = drained(r, lambda s: streaming.first_arrivals(s, key="queue_event_id", late="1 day").select("store_id", "queue_event_id", "event_id"))
    return kept.groupBy("store_id", "queue_event_id").agg(F.count("*").alias("n"))


@query("str3_hourly_counts", """
SELECT store_id, date_trunc('hour', ts) AS bucket_start, count(*) FILTER (event_type = 'entry') AS entries, count(*) FILTER (event_type = 'billing_queue_join') AS joined,
  count(*) FILTER (event_type = 'queue_completed') AS completed, count(*) FILTER (event_type = 'queue_abandoned') AS abandoned FROM raw GROUP BY ALL""")
def _(r):
    return drained(r, lambda s: streaming.hourly_counts(s, late=DELAY))


@query("str4_visits", """
SELECT store_id, entity_id, CAST(session_no AS BIGINT) AS session_no, entry_time, exit_time, dwell_seconds, previous_exit, 0::BIGINT AS late_rows
FROM (SELECT *, lag(exit_time) OVER (PARTITION BY store_id, entity_id ORDER BY session_no) AS previous_exit FROM vis) WHERE exit_time IS NOT NULL""")
def _(r):
    made = drained(r, lambda s: streaming.visits(s, late=DELAY))
    return made.select("store_id", "entity_id", "session_no", moment("entry_us").alias("entry_time"), moment("exit_us").alias("exit_time"), "dwell_seconds", moment("previous_exit_us").alias("previous_exit"), "late_rows")


@query("str5_queue_states", """
, j AS (SELECT store_id, queue_event_id, min((ts, event_id)) AS j FROM raw WHERE event_type = 'billing_queue_join' GROUP BY ALL),
d AS (SELECT store_id, queue_event_id, min((ts, event_id)) AS d FROM raw WHERE event_type IN ('queue_completed', 'queue_abandoned') GROUP BY ALL)
SELECT store_id, queue_event_id, CASE WHEN d < j THEN 'closed' ELSE 'open' END AS state, struct_extract_at(j, 1) AS at FROM j LEFT JOIN d USING (store_id, queue_event_id)
UNION ALL SELECT store_id, queue_event_id, 'closed', struct_extract_at(d, 1) FROM d""")
def _(r):
    return drained(r, lambda s: streaming.queue_states(s, late=DELAY)).select("store_id", "queue_event_id", "state", moment("at_us").alias("at"))


@query("str6_zone_visits", ISLAND_SQL(120) + " SELECT store_id, track_id, zone_id, enter_ts, last_inside_ts, exit_ts FROM zv")
def _(r):
    """A track has ended once it is unseen for longer than the feed lasts."""
    zones = r.zones.select("store_id", "zone_id", "polygon")

    def form(s: DataFrame) -> DataFrame:
        seen = s.select("store_id", F.col("entity_id").alias("track_id"), F.col("event_id").cast("int").alias("frame"), "ts", "hotspot_x", "hotspot_y")
        hits = seen.join(zones, "store_id", "left")  # the closing row has no zone
        hits = hits.withColumns({"inside": F.coalesce(in_polygon(F.col("hotspot_x"), F.col("hotspot_y"), F.col("polygon")), F.lit(False)), "zone_id": F.coalesce("zone_id", F.lit(""))})
        return streaming.zone_visits(hits.select("store_id", "track_id", "zone_id", "frame", "ts", "inside"), grace=120, late=DELAY, idle=SLICES * SLICE_HOURS * 3600)

    return drained(r, form).select("store_id", "track_id", "zone_id", *[moment(f"{c}_us").alias(f"{c}_ts") for c in ("enter", "last_inside", "exit")])


@query("str7_feed_table", "SELECT store_id, max(ts) AS last_event FROM raw GROUP BY ALL")
def _(r):
    feed = r.spark.readStream.schema(r.facts.read().schema).option("maxFilesPerTrigger", 2).parquet(recorded(r))
    path = new_path(r.spark, "feed-table")
    streaming.track_feed(feed, path, new_path(r.spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return streaming.read_feed(r.spark, path).where(F.col("store_id") != CLOSING)
