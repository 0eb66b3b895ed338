"""Registered queries of feeds in and out, configuration and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import iso_utc
from ..operators import live, replay, spatial, tracks
from ..sources import feeds
from ..sources.storage import new_path
from .adapter import END, START
from .queries import SNAP_SQL, at, query, stores

LINE_COLUMNS = ("event_id", "store_id", "entity_id", "event_type", "seen_at", "zone_id", "wait_seconds")


@query("src6_snapshots", SNAP_SQL + """
SELECT store_id, camera_id, video AS video_path, track_id, frame AS frame_index, ts AS seen_at, x AS footpoint_x, y AS footpoint_y FROM sn WHERE frame % 9 <> 0""")
def _(r):
    """Every ninth recorded sighting has no track."""
    path = new_path(r.spark, "sightings")
    s = r.snapshots
    rows = F.struct("store_id", "camera_id", F.col("video").alias("video_path"), F.when(F.col("frame") % 9 != 0, F.col("track_id")).alias("track_id"), F.col("frame").alias("frame_index"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                    F.col("foot_x").alias("footpoint_x"), F.col("foot_y").alias("footpoint_y"))
    s.select(F.to_json(rows).alias("value")).write.text(path)
    return feeds.read_snapshots(r.spark, path).select("store_id", "camera_id", "video_path", "track_id", "frame_index", F.col("timestamp").cast("timestamp_ntz").alias("seen_at"), "footpoint_x", "footpoint_y")


@query("snk2_jsonl_events", """
SELECT '{"event_id":' || CAST(event_id AS VARCHAR) || ',"store_id":"' || store_id || '","entity_id":"' || entity_id || '","event_type":"' || event_type || '","seen_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(to_microseconds((event_id % 4) * 250000) + ts, '.%f') END || 'Z","zone_id":"' || zone_id || '","wait_seconds":' || CAST(wait_seconds AS VARCHAR) || '}' AS value FROM raw""")
def _(r):
    """The lines of the file as they are."""
    path = new_path(r.spark, "jsonl")
    feeds.write_jsonl(r.raw.withColumn("seen_at", F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 4) * 0.25)).select(*LINE_COLUMNS), path)
    return r.spark.read.text(path)


@query("snk4_run_summary", SNAP_SQL + """
SELECT store_id, camera_id, video, count(DISTINCT frame) AS frames, count(*) AS detections, count(DISTINCT track_id) AS unique_tracks FROM sn GROUP BY ALL""")
def _(r):
    path = new_path(r.spark, "summary")
    feeds.write_summary(tracks.run_statistics(r.snapshots), path)
    return r.spark.read.schema("store_id string, camera_id string, video string, frames long, detections long, unique_tracks long").json(path)


@query("snk5_utc_text", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(to_microseconds((event_id % 4) * 250000) + ts, '.%f') END || 'Z' AS seen_at FROM raw""")
def _(r):
    return r.raw.select("event_id", iso_utc(F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 4) * 0.25)).alias("seen_at"))


@query("liv7_buckets", f"""
, b AS (SELECT store_id, unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 SECOND, INTERVAL 50 MINUTE)) AS bucket_start FROM (SELECT DISTINCT store_id FROM raw) x)
SELECT store_id, date_diff('minute', TIMESTAMP '{START}', bucket_start) // 50 AS bucket, bucket_start FROM b""")
def _(r):
    """Buckets of fifty minutes: the last one starts before the end and is cut by it."""
    return live.spine(stores(r), at(START), at(END), 50)


@query("spa3_active_map", """
, m AS (SELECT store_id, zone_id, min(ts) AS created_at, min(event_id) % 3 <> 0 AS is_active FROM raw GROUP BY ALL)
SELECT store_id, arg_max('M' || zone_id, (created_at, 'M' || zone_id)) AS map_id, arg_max(zone_id || '.png', (created_at, 'M' || zone_id)) AS file_path FROM m WHERE is_active GROUP BY ALL""")
def _(r):
    """A map for each zone, from when the zone was first seen."""
    seen = r.raw.groupBy("store_id", "zone_id").agg(F.min("ts").alias("created_at"), (F.min("event_id") % 3 != 0).alias("is_active"))
    return spatial.active_map(seen.select("store_id", F.concat(F.lit("M"), "zone_id").alias("map_id"), F.concat("zone_id", F.lit(".png")).alias("file_path"), "created_at", "is_active"))


@query("rpl4_newest_jobs", """
SELECT store_id, 'J' || CAST(event_id AS VARCHAR) AS job_id, ts AS created_at FROM raw WHERE is_purchase AND store_id = 'ST1001' ORDER BY ts DESC, 'J' || CAST(event_id AS VARCHAR) DESC LIMIT 20""")
def _(r):
    """A job for each purchase; the listing of a store is the twenty newest."""
    return replay.newest_jobs(r.raw.where("is_purchase").select("store_id", F.concat(F.lit("J"), "event_id").alias("job_id"), F.col("ts").alias("created_at")), "ST1001")


CAMERA_SQL = """
, cov AS (SELECT store_id || camera_id AS camera, store_id || zone_id AS zone, zone_id, camera_id, k, min(event_id) AS created_at FROM raw GROUP BY ALL),
ln AS (SELECT camera, max(created_at) AS created_at, arg_max(k, created_at) AS k FROM cov WHERE k % 2 = 0 GROUP BY ALL),
pg AS (SELECT camera, count(*) AS n_zones, min((created_at, zone)) FILTER (zone_id <> 'Z1') AS first_shop FROM cov WHERE k % 2 = 1 GROUP BY ALL),
cam AS (SELECT DISTINCT store_id || camera_id AS camera, camera_id FROM raw)
SELECT camera AS camera_id, CASE camera_id WHEN 'CAM0' THEN 'BILLING' ELSE 'ZONE' END AS role, CAST(ln.k AS DOUBLE) / 100 AS line_position, ln.k % 4 = 0 AS inside_greater, coalesce(n_zones, 0) AS n_zones,
  CASE WHEN camera_id = 'CAM0' THEN struct_extract_at(first_shop, 2) END AS queue_zone_id, CASE camera_id WHEN 'CAM0' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS sample_fps, 0.35::DOUBLE AS confidence_threshold, 45 AS queue_completion_seconds, 8 AS queue_abandonment_seconds
FROM cam LEFT JOIN ln USING (camera) LEFT JOIN pg USING (camera) WHERE camera_id <> 'CAM2'"""


@query("geo11_camera_configs", CAMERA_SQL)
def _(r):
    """A camera's even settings give lines, of which the last counts, its odd ones polygons; the third camera's role is unknown."""
    key = {"camera_id": F.concat("store_id", "camera_id"), "zone_id": F.concat("store_id", "zone_id")}
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    side = F.col("k") / 100
    line = F.to_json(F.struct(F.lit("line").alias("kind"), F.lit("x").alias("axis"), side.alias("position"), (F.col("k") % 4 == 0).alias("inside_greater_than_position")))
    area = F.to_json(F.struct(F.lit("polygon").alias("kind"), F.array(point(F.lit(0), F.lit(0)), point(side, F.lit(0)), point(side, side)).alias("points")))
    even = F.col("k") % 2 == 0
    made = r.raw.groupBy("store_id", "camera_id", "zone_id", "k").agg(F.min("event_id").alias("created_at"))
    coverage = made.select(*[c.alias(n) for n, c in key.items()], F.when(even, "line").otherwise("polygon").alias("geometry_kind"), F.when(even, line).otherwise(area).alias("geometry_json"), "created_at")
    zones = r.raw.select("store_id", "zone_id").distinct().select(key["zone_id"].alias("zone_id"), F.concat(F.lit("Zone "), "zone_id").alias("name"), F.when(F.col("zone_id") == "Z1", "STAFF_AREA").otherwise("BROWSING").alias("type"))
    role = F.when(F.col("camera_id") == "CAM0", "BILLING").when(F.col("camera_id") == "CAM1", "ZONE").otherwise("STORE_ROOM")
    unset = {"confidence_threshold": "double", "queue_completion_seconds": "int", "queue_abandonment_seconds": "int"}
    cameras = r.raw.select("store_id", "camera_id").distinct().select(key["camera_id"].alias("camera_id"), role.alias("role"), F.when(F.col("camera_id") == "CAM0", 4.0).alias("sample_fps"), *[F.lit(None).cast(t).alias(n) for n, t in unset.items()])
    out = tracks.camera_configs(cameras, coverage, zones)
    return out.select("camera_id", "role", F.col("entry_line")["position"].alias("line_position"), F.col("entry_line")["inside_greater"].alias("inside_greater"), F.coalesce(F.size("zones"), F.lit(0)).cast("long").alias("n_zones"), "queue_zone_id", "sample_fps", *unset)
