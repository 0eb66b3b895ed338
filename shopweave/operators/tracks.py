"""Track sightings to events: line crossings, zone visits, queue visits, run statistics.

Sightings: store_id, camera_id, video, track_id, frame, ts, foot_x, foot_y. Zones: store_id,
camera_id, zone_id, type, polygon (array of x, y). All are set-based forms of per-track
state machines: visits are islands of inside sightings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import in_polygon, rate, seconds, uuid5

TRACK = ("store_id", "camera_id", "video", "track_id")
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
QUEUE_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: Defaults of a camera (fixed values).
SAMPLE_FPS, CONFIDENCE, COMPLETE_SECONDS, ABANDON_SECONDS, GRACE_SECONDS = 2.0, 0.35, 45, 8, 2


def footpoints(boxes: DataFrame) -> DataFrame:
    """Bottom centre of each box (x1, y1, x2, y2) over the frame size; (0, 0) for an empty frame."""
    box = lambda k: F.element_at("bbox", k)
    real = (F.col("frame_w") > 0) & (F.col("frame_h") > 0)
    x = F.when(real, (box(1) + box(3)) / 2 / F.when(real, F.col("frame_w"))).otherwise(0.0)
    return boxes.withColumns({"foot_x": x, "foot_y": F.when(real, box(4) / F.when(real, F.col("frame_h"))).otherwise(0.0)})


def sampled(frames: DataFrame, fps: Column, start: Column, *, sample_fps: float = SAMPLE_FPS) -> DataFrame:
    """Every stride-th frame with its time from the start of the video."""
    stride = F.greatest(F.lit(1), F.bround(fps / sample_fps, 0).cast("int"))
    micros = F.floor(F.col("frame") * 1000000 / fps).cast("long")
    return frames.where(F.col("frame") % stride == 0).withColumn("ts", F.timestamp_add("MICROSECOND", micros, start))


def line_crossings(sightings: DataFrame, *, axis: str = "x", position: float = 0.5, inside_greater: bool = True) -> DataFrame:
    """ENTRY, REENTRY (the track has exited before) and EXIT where a track changes sides; its first sighting gives none."""
    value = F.col("foot_x" if axis == "x" else "foot_y")
    order = Window.partitionBy(*TRACK).orderBy("ts", "frame")
    sided = sightings.withColumn("inside", value >= position if inside_greater else value <= position).withColumn("was", F.lag("inside").over(order))
    turns = sided.where("inside <> was")
    exited = F.max((~F.col("inside")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(~F.col("inside"), "exit").when(F.coalesce(exited, F.lit(0)) > 0, "reentry").otherwise("entry")
    return turns.withColumn("event_type", kind).select(*TRACK, "frame", "ts", "event_type")


def zone_index(zones: DataFrame, *, most: int = 64) -> DataFrame:
    """One row a camera: the box around its zones, cut into ``side`` times ``side`` cells, and each cell's zones.

    ``cells`` is an array of arrays of (zone_id, polygon), row by row; the side grows with the root of the zones. A
    zone is listed in every cell that its own box meets.
    """
    boxed = zones.where(F.size("polygon") >= 3).select(
        "store_id", "camera_id", "zone_id", "polygon", *[f(F.col(f"polygon.{c}")).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.array_min), (1, F.array_max))])
    side = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(2 * F.sqrt(F.count("*"))))).cast("int")
    frame = boxed.groupBy("store_id", "camera_id").agg(*[F.min(f"{c}0").alias(f"{c}_from") for c in "xy"], *[(F.max(f"{c}1") - F.min(f"{c}0")).alias(f"{c}_span") for c in "xy"], side.alias("side"))
    cell = lambda value, c: F.when(F.col(f"{c}_span") > 0, F.least(F.col("side") - 1, F.floor((value - F.col(f"{c}_from")) / F.col(f"{c}_span") * F.col("side"))).cast("int")).otherwise(0)
    spread = boxed.join(frame, ["store_id", "camera_id"])
    for c in "xy":
        spread = spread.withColumn(f"c{c}", F.explode(F.sequence(cell(F.col(f"{c}0"), c), cell(F.col(f"{c}1"), c))))
    held = spread.groupBy("store_id", "camera_id", (F.col("cy") * F.col("side") + F.col("cx")).alias("cell")).agg(F.collect_list(F.struct("zone_id", "polygon")).alias("zones"))
    found = held.groupBy("store_id", "camera_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "zones"))).alias("of_cell"))
    return frame.join(found, ["store_id", "camera_id"]).withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1), lambda k: F.element_at("of_cell", k))).drop("of_cell")


def candidate_zones() -> Column:
    """Of a sighting beside its camera's :func:`zone_index`: the zones (zone_id, polygon) that its cell lists; null for none."""
    def cell(c: str) -> Column:
        value = F.col(f"foot_{c}")
        inside = value.between(F.col(f"{c}_from"), F.col(f"{c}_from") + F.col(f"{c}_span"))
        return F.when(inside, F.when(F.col(f"{c}_span") > 0, F.least(F.col("side") - 1, F.floor((value - F.col(f"{c}_from")) / F.col(f"{c}_span") * F.col("side"))).cast("int")).otherwise(0))

    return F.get("cells", cell("y") * F.col("side") + cell("x"))


def zone_visits(sightings: DataFrame, zones: DataFrame, *, grace: int = 0) -> DataFrame:
    """One row a visit of a track in a zone.

    A run of outside sightings ends the visit once its last is ``grace`` seconds after the last
    inside one; the exit is stamped at its first. The trailing run ends the visit in any case,
    and a visit still inside at the end of data ends at its last inside sighting.

    A sighting is tested against the zones of its grid cell only, and goes on for the zones that its track has been in.
    """
    key = [*TRACK, "zone_id"]
    own = sightings.select(*TRACK, "frame", "ts", "foot_x", "foot_y").join(zone_index(zones), ["store_id", "camera_id"])
    hit = F.filter(candidate_zones(), lambda z: in_polygon(F.col("foot_x"), F.col("foot_y"), z["polygon"]))
    seen = own.select(*TRACK, "frame", "ts", F.transform(F.coalesce(hit, F.array()), lambda z: z["zone_id"]).alias("_in"))
    entered = seen.where(F.size("_in") > 0).select(*TRACK, F.explode("_in").alias("zone_id")).distinct()
    hits = seen.join(entered, list(TRACK)).withColumn("inside", F.array_contains("_in", F.col("zone_id"))).drop("_in")
    order = Window.partitionBy(*key).orderBy("ts", "frame")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_in = F.last(F.when(F.col("inside"), F.col("ts")), ignorenulls=True)
    hits = hits.withColumns({"last_in": last_in.over(before), "was_out": ~F.lag("inside").over(order), "was_ts": F.lag("ts").over(order)})
    starts = F.col("inside") & (F.col("last_in").isNull() | (F.col("was_out") & (seconds(F.col("last_in"), F.col("was_ts")) >= grace)))
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumns({"visit_no": F.sum(starts.cast("int")).over(here), "stretch": F.sum(F.col("inside").cast("int")).over(here)}).where("visit_no > 0")
    out = ~F.col("inside")
    confirmed = out & (seconds(F.col("last_in"), F.col("ts")) >= grace)
    runs = hits.groupBy(*key, "visit_no", "stretch").agg(
        F.min(F.when(F.col("inside"), F.struct("ts", "frame"))).alias("seen"), F.min(F.when(out, F.struct("ts", "frame"))).alias("left"), F.min(F.when(confirmed, F.col("frame"))).alias("confirmed_frame"))
    last = lambda c: F.max_by(c, "stretch")
    visits = runs.groupBy(*key, "visit_no").agg(F.min("seen").alias("first"), last("seen").alias("last"), last(F.struct("left")).alias("left"), last(F.struct("confirmed_frame")).alias("confirmed"))
    left = F.col("left.left")
    return visits.select(*key, F.col("visit_no").cast("long").alias("visit_no"), F.col("first.ts").alias("enter_ts"), F.col("first.frame").alias("enter_frame"), F.col("last.ts").alias("last_inside_ts"), F.col("last.frame").alias("last_inside_frame"),
                         F.coalesce(left["ts"], F.col("last.ts")).alias("exit_ts"), F.coalesce(left["frame"], F.col("last.frame")).alias("exit_frame"), left.isNotNull().alias("left"), F.col("confirmed.confirmed_frame").alias("confirmed_frame"))


def queue_visits(visits: DataFrame, *, complete: int = COMPLETE_SECONDS, abandon: int = ABANDON_SECONDS) -> DataFrame:
    """Visits of a queue zone with their outcome, dwell and position at joining.

    Under ``abandon`` seconds there is no terminal (null); from ``complete`` on it is completed.
    A visit without an exit is abandoned at its last sighting whatever its dwell. The position
    is one more than the visits open on the camera, each until its exit is confirmed.
    """
    dwell = seconds(F.col("enter_ts"), F.col("exit_ts"))
    outcome = F.when(~F.col("left"), "queue_abandoned").when(dwell >= complete, "queue_completed").when(dwell >= abandon, "queue_abandoned")
    camera = ["store_id", "camera_id", "video", "zone_id"]
    joins = visits.select(*camera, "track_id", "visit_no", F.col("enter_frame").alias("frame"), F.lit(1).alias("step"))
    ends = visits.where("confirmed_frame IS NOT NULL").select(*camera, "track_id", "visit_no", F.col("confirmed_frame").alias("frame"), F.lit(-1).alias("step"))
    order = Window.partitionBy(*camera).orderBy("frame", "step", "track_id")
    position = joins.unionByName(ends).withColumn("position_at_join", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("step = 1").drop("frame", "step")
    out = visits.withColumns({"dwell_seconds": dwell, "outcome": outcome}).join(position, [*camera, "track_id", "visit_no"])
    return out.select(*TRACK, "zone_id", "visit_no", "enter_ts", "enter_frame", "exit_ts", "last_inside_frame", "dwell_seconds", "outcome", "position_at_join")


def zone_events(visits: DataFrame, zones: DataFrame) -> DataFrame:
    """A ``zone_entered`` and a ``zone_exited`` event of each visit of a zone, with the zone's name and type."""
    ends = F.explode(F.array(*[F.struct(F.lit(kind).alias("event_type"), F.col(f"{end}_ts").alias("ts"), F.col(f"{end}_frame").alias("frame")) for kind, end in (("zone_entered", "enter"), ("zone_exited", "exit"))]))
    named = visits.join(zones.select("store_id", "camera_id", "zone_id", F.col("name").alias("zone_name"), F.col("type").alias("zone_type")), ["store_id", "camera_id", "zone_id"])
    return named.select(*TRACK, "zone_id", "zone_name", "zone_type", ends.alias("e")).select(*TRACK, "zone_id", "zone_name", "zone_type", "e.*")


def queue_events(queued: DataFrame, *, namespace: str = QUEUE_NAMESPACE) -> DataFrame:
    """The join of each queue visit, and its terminal where it has an outcome.

    Both carry ``queue_event_id``, a UUID of store, camera, video, track and the frame of joining. A terminal
    is of the frame last seen inside, waits from the join to the exit, and has the position at joining.
    """
    of_join = F.col("event_type") == "billing_queue_join"
    step = lambda kind, at, frame: F.struct(kind.alias("event_type"), F.col(at).alias("ts"), F.col(frame).alias("frame"))
    steps = F.explode(F.array(step(F.lit("billing_queue_join"), "enter_ts", "enter_frame"), step(F.col("outcome"), "exit_ts", "last_inside_frame")))
    key = uuid5(namespace, *[F.col(c) for c in (*TRACK, "enter_frame")])
    out = queued.select(*TRACK, "zone_id", key.alias("queue_event_id"), "enter_ts", "dwell_seconds", "position_at_join", steps.alias("e"))
    out = out.select(*TRACK, "zone_id", "queue_event_id", F.col("enter_ts").alias("queue_join_ts"), "dwell_seconds", "position_at_join", "e.*").where("event_type IS NOT NULL")
    wait = F.when(~of_join, F.greatest(F.lit(0).cast("long"), F.col("dwell_seconds")))
    return out.withColumns({"wait_seconds": wait, "abandoned": F.when(~of_join, F.col("event_type") == "queue_abandoned")}).drop("dwell_seconds")


def event_ids(events: DataFrame, *, namespace: str = NAMESPACE) -> DataFrame:
    """``source_event_id``: a UUID of store, camera, video, type, track and frame (and zone), equal on every run."""
    parts = [F.col(c) for c in ("store_id", "camera_id", "video", "event_type", "track_id", "frame")] + ([F.col("zone_id")] if "zone_id" in events.columns else [])
    return events.withColumn("source_event_id", uuid5(namespace, *parts))


def run_statistics(sightings: DataFrame) -> DataFrame:
    """Per run: frames, detections, unique tracks and the most people in a frame."""
    run = ["store_id", "camera_id", "video"]
    frames = sightings.groupBy(*run, "frame").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("people")).groupBy(*run).agg(F.count("*").alias("frames"), F.sum("n").alias("detections"), F.max("people").alias("max_people"))
    tracks = sightings.groupBy(*TRACK).agg(F.count("*").alias("n")).groupBy(*run).agg(F.count("*").alias("unique_tracks"))
    return frames.join(tracks, run)


def track_statistics(sightings: DataFrame) -> DataFrame:
    """Per track: frames, first and last seen."""
    return sightings.groupBy(*TRACK).agg(F.count("*").alias("frames"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def staff_by_area(sightings: DataFrame, zones: DataFrame, *, frames: int = 10, share: float = 0.6) -> DataFrame:
    """Tracks with ``frames`` sightings or more in staff areas that are ``share`` or more of all its sightings."""
    areas = zones.where("type = 'STAFF_AREA'").groupBy("store_id", "camera_id").agg(F.collect_list("polygon").alias("areas"))
    seen = sightings.join(areas, ["store_id", "camera_id"], "left")
    inside = F.coalesce(F.exists("areas", lambda p: in_polygon(F.col("foot_x"), F.col("foot_y"), p)), F.lit(False))
    per = seen.groupBy(*TRACK).agg(F.count(F.when(inside, 1)).alias("staff_frames"), F.count("*").alias("frames"))
    out = per.withColumn("score", rate(F.col("staff_frames"), F.col("frames")))
    return out.where((F.col("staff_frames") >= frames) & (F.col("staff_frames") >= share * F.col("frames")))


def camera_configs(cameras: DataFrame, coverage: DataFrame, zones: DataFrame) -> DataFrame:
    """One row a camera: its entry line (the last made wins), its zones, the queue zone and settings with defaults.

    ``coverage``: camera_id, zone_id, geometry_kind, geometry_json, created_at. The query fails at a kind of geometry
    that is neither a line nor a polygon.
    """
    geometry = "kind string, points array<struct<x: double, y: double>>, axis string, position double, inside_greater_than_position boolean"
    known = F.when(F.col("geometry_kind").isin("line", "polygon"), F.col("geometry_kind")).otherwise(F.raise_error(F.concat(F.lit("unknown geometry kind: "), F.coalesce("geometry_kind", F.lit("none")))))
    shapes = coverage.withColumns({"g": F.from_json("geometry_json", geometry), "geometry_kind": known})
    lines = shapes.where("geometry_kind = 'line'").groupBy("camera_id").agg(F.max_by(F.struct("g.axis", "g.position", F.coalesce("g.inside_greater_than_position", F.lit(True)).alias("inside_greater")), "created_at").alias("entry_line"))
    named = shapes.where("geometry_kind = 'polygon'").join(zones.select("zone_id", "name", "type"), "zone_id")
    polygons = named.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "zone_id", "name", "type", F.col("g.points").alias("points")))).alias("zones"))
    out = cameras.where(F.col("role").isin("ENTRY", "ZONE", "BILLING")).join(lines, "camera_id", "left").join(polygons, "camera_id", "left")
    shopping = F.filter("zones", lambda z: z["type"] != "STAFF_AREA")
    defaults = {"sample_fps": SAMPLE_FPS, "confidence_threshold": CONFIDENCE, "queue_completion_seconds": COMPLETE_SECONDS, "queue_abandonment_seconds": ABANDON_SECONDS}
    return out.withColumns({"queue_zone_id": F.when(F.col("role") == "BILLING", F.get(shopping, 0)["zone_id"]), **{c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}})
