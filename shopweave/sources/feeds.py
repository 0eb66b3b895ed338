"""Event, sales and sighting feeds in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import iso_utc
from ..operators import normalize
from ..schemas import POS


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, arrival): JSON lines in arrival order of file, block and line."""
    text = spark.read.text(path)
    return text.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("arrival"))


def read_pos(spark: SparkSession, path: str) -> DataFrame:
    """Sales rows as text with ``row_no`` from 1 in file order; a byte order mark is dropped.

    Splits are counted on their own and numbered by file and place, so the files may be split.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = spark.read.csv(path, header=True, schema=POS).select("*", *place, F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.join(splits, ["_file", "_block"])
    return numbered.withColumn("row_no", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_file", "_block", "_id", "_first", "_before")


def read_archive(spark: SparkSession, path: str, store_id: str, *, start: Column | None = None, end: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(value, arrival, event_time) of a store's receipts in the order of their replay.

    That order is by the time of the payload's family, a queue event's being its exit, then by receipt. ``start``
    and ``end`` keep payloads of that range, both ends included; ``ids`` (id) chooses receipts. Receipts whose
    payload is no event or has no time come last, by when they were received, in any range.
    """
    own = spark.read.parquet(path).where(F.col("store_id") == store_id)
    own = own if ids is None else own.join(ids.select("id"), "id", "left_semi")
    kind = normalize.family(F.get_json_object("payload_json", "$.event_type"))
    rows = own.select(F.col("payload_json").alias("value"), F.col("received_at").alias("arrival"), kind.alias("family"))
    rows = rows.withColumn("event_time", normalize.utc(normalize.by_family({n: F.get_json_object("value", f"$.{c}") for n, c in normalize.TIME.items()}))).drop("family")
    for bound, inside in ((start, F.col("event_time") >= start), (end, F.col("event_time") <= end)):
        rows = rows if bound is None else rows.where(F.col("event_time").isNull() | inside)
    return rows.orderBy(F.col("event_time").asc_nulls_last(), "arrival")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Track snapshots of JSON lines in order of camera, video and frame, rows without a track dropped."""
    kind = ("store_id string, camera_id string, video_path string, track_id string, frame_index int, timestamp timestamp, bbox array<double>, "
            "confidence double, footpoint_x double, footpoint_y double, frame_w int, frame_h int")
    rows = spark.read.schema(kind).json(path).where("track_id IS NOT NULL AND frame_index IS NOT NULL")
    return rows.orderBy("store_id", "camera_id", "video_path", "frame_index", "track_id")


def write_events(events: DataFrame, path: str, *, mode: str = "append") -> None:
    """Facts by store and day; few, large files a partition. A hot store-day is split into several."""
    dated = events.withColumn("event_date", F.to_date("ts"))
    dated.hint("rebalance", "store_id", "event_date").write.mode(mode).partitionBy("store_id", "event_date").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_jsonl(events: DataFrame, path: str) -> None:
    """Compact JSON, one event a line, times as UTC text."""
    times = {c: iso_utc(F.col(c)) for c, t in events.dtypes if t.startswith("timestamp")}
    events.withColumns(times).select(F.to_json(F.struct(*events.columns)).alias("value")).write.text(path)


def write_pos_csv(orders: DataFrame, path: str) -> None:
    """Orders with their items flattened to the import layout."""
    flat = orders.select("store_id", "order_id", "ts", F.explode("items").alias("i"))
    flat.select("order_id", F.date_format("ts", "dd-MM-yyyy").alias("order_date"), F.date_format("ts", "HH:mm:ss").alias("order_time"), "store_id", F.col("i.product_id").alias("product_id"),
                F.coalesce("i.brand_name", F.lit("")).alias("brand_name"), F.format_string("%.2f", "i.amount").alias("total_amount")).write.csv(path, header=True, emptyValue="")


def write_summary(summary: DataFrame, path: str) -> None:
    """A run's summary rows as JSON."""
    summary.write.json(path)
