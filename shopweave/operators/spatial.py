"""Heat map and zone intensity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rate


def heatmap(events: DataFrame, *, grid: int = 24) -> DataFrame:
    """Sightings by grid cell with the cell's mean position and its share of the busiest cell; staff count."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    cell = lambda c: F.least(F.lit(grid - 1), F.floor(c * grid)).cast("int")
    spots = events.where(F.col("hotspot_x").isNotNull() & F.col("hotspot_y").isNotNull()).select("store_id", clamp("hotspot_x").alias("x"), clamp("hotspot_y").alias("y"))
    micro = lambda c: F.round(F.col(c) * 1000000).cast("long")  # noqa: E731  exact sums in any order
    cells = spots.groupBy("store_id", cell(F.col("y")).alias("row"), cell(F.col("x")).alias("col")).agg(F.count("*").alias("count"), F.sum(micro("x")).alias("sx"), F.sum(micro("y")).alias("sy"))
    most = F.max("count").over(Window.partitionBy("store_id"))
    return cells.select("store_id", "row", "col", "count", rate(F.col("sx"), F.col("count") * 1000000).alias("mean_x"), rate(F.col("sy"), F.col("count") * 1000000).alias("mean_y"), rate(F.col("count"), most).alias("intensity"))


def data_confidence(visits: DataFrame, *, least: int = 20) -> DataFrame:
    """HIGH for stores with ``least`` visits or more."""
    per = visits.groupBy("store_id").agg(F.count("*").alias("sessions"))
    return per.withColumn("confidence", F.when(F.col("sessions") >= least, "HIGH").otherwise("LOW"))


def active_map(maps: DataFrame) -> DataFrame:
    """The newest active map of each store."""
    return maps.where("is_active").groupBy("store_id").agg(F.max_by("map_id", F.struct("created_at", "map_id")).alias("map_id"), F.max_by("file_path", F.struct("created_at", "map_id")).alias("file_path"))


def spatial_config(zones: DataFrame, coverage: DataFrame) -> DataFrame:
    """Zones with their polygon and the cameras that cover them."""
    cameras = coverage.where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.array_sort(F.collect_set("camera_id")).alias("cameras"))
    return zones.join(cameras, "zone_id", "left").withColumn("cameras", F.coalesce("cameras", F.array().cast("array<string>")))


def zone_intensity(configured: DataFrame, dwell: DataFrame, *, metric: str = "visits") -> DataFrame:
    """Configured zones of each store with their metric, its share of the largest, and ranks 1 .. n."""
    column = {"visits": "visits", "dwell": "total_dwell_seconds"}[metric]
    out = configured.join(dwell, ["store_id", "zone_id"], "left").withColumn("value", F.coalesce(F.col(column), F.lit(0)).cast("long"))
    store = Window.partitionBy("store_id")
    return out.select("store_id", "zone_id", "value", rate(F.col("value"), F.max("value").over(store)).alias("intensity"), F.row_number().over(store.orderBy(F.desc("value"), "zone_id")).alias("rank"))
