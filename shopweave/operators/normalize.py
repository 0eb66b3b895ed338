"""Event ingest: JSON lines to accepted events and rejected lines, in one pass of expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import yes_no
from ..schemas import CANONICAL_TYPES, PAYLOAD, ZONE_TYPES

PASSAGE = ("entry", "exit", "reentry")
ZONE = ("zone_entered", "zone_exited")
QUEUE = ("queue_completed", "queue_abandoned")
#: Fields that each family must have.
REQUIRED = {
    "passage": ("id_token", "store_code", "camera_id", "event_timestamp"),
    "zone": ("track_id", "store_id", "camera_id", "zone_id", "event_time"),
    "queue": ("track_id", "store_id", "camera_id", "zone_id", "queue_event_id", "queue_join_ts", "queue_exit_ts"),
    "canonical": ("event_id", "store_id", "camera_id", "visitor_id", "timestamp", "confidence"),
}
#: The field that holds the time of an event, by family.
TIME = {"passage": "event_timestamp", "zone": "event_time", "queue": "queue_exit_ts", "canonical": "timestamp"}

#: Keys of a canonical event's metadata that are read; the zone's name is called after its goods there.
METADATA = """
sku_zone string, zone_type string, is_revenue_zone string, hotspot_x double, hotspot_y double, is_face_hidden boolean, group_id string, group_size int,
queue_event_id string, queue_depth int, queue_join_ts string, queue_served_ts string, queue_exit_ts string, wait_seconds int
"""


def _once(rows: DataFrame, keep, fields: Column) -> DataFrame:
    """``keep`` and the fields of a struct that is computed once a row, not once a use."""
    return rows.select(*keep, F.explode(F.array(fields)).alias("_f")).select(*keep, "_f.*")


def utc(text: Column) -> Column:
    """ISO text to naive UTC; an offset is applied, not dropped. Null for anything else."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def zone_type(value: Column) -> Column:
    return F.when(F.upper(value).isin(*ZONE_TYPES), F.upper(value)).otherwise("OTHER")


def family(kind: Column) -> Column:
    return F.when(kind.isin(*PASSAGE), "passage").when(kind.isin(*ZONE), "zone").when(kind.isin(*QUEUE), "queue").when(kind.isin(*CANONICAL_TYPES), "canonical")


def by_family(options: dict[str, Column]) -> Column:
    """The column of the row's family; null for families without one."""
    return F.coalesce(*[F.when(F.col("family") == n, c) for n, c in options.items()])


def parse(lines: DataFrame) -> DataFrame:
    """``lines`` (value, arrival) as normalized events with ``error`` (null for good ones); blank lines go."""
    p = _once(lines.where(F.trim("value") != ""), ("arrival", "value"), F.from_json("value", PAYLOAD))
    kind = F.col("event_type")
    p = _once(p, p.columns, F.struct(family(kind).alias("family"), F.from_json("metadata", METADATA).alias("meta")))
    col, meta = F.col, lambda key: F.col(f"meta.{key}")
    lost = {n: F.concat_ws(",", *[F.when(col(f).isNull() | (col(f).cast("string") == ""), F.lit(f)) for f in fields]) for n, fields in REQUIRED.items()}
    queue_time = lambda c: by_family({"queue": utc(col(c)), "canonical": utc(meta(c))})
    times = {f"_{c}": queue_time(c) for c in ("queue_join_ts", "queue_served_ts", "queue_exit_ts")}
    p = _once(p, p.columns, F.struct(utc(by_family({n: col(c) for n, c in TIME.items()})).alias("_ts"), F.nullif(by_family(lost), F.lit("")).alias("_lost"), *[c.alias(n) for n, c in times.items()]))
    ts, missing = col("_ts"), F.concat(F.lit("missing "), "_lost")
    canonical, of_queue = col("family") == "canonical", col("family") == "queue"
    stored = F.when(canonical, F.element_at(F.create_map(*[F.lit(x) for kv in CANONICAL_TYPES.items() for x in kv]), kind)).otherwise(kind)
    seen = {"passage": "id_token", "zone": "track_id", "queue": "track_id", "canonical": "visitor_id"}
    untimed = ts.isNull() | (of_queue & (col("_queue_join_ts").isNull() | (col("queue_served_ts").isNotNull() & col("_queue_served_ts").isNull())))
    error = (F.when(kind.isNull(), "not a JSON event").when(col("family").isNull(), "unknown event type").when(col("_lost").isNotNull(), missing)
             .when(untimed, "time is not valid").when(canonical & ~col("confidence").between(0, 1), "confidence is not in [0, 1]"))
    tracked = lambda name: {"zone": col(name), "queue": col(name)}
    n = p.select(
        "arrival", "value", "family", stored.alias("event_type"), by_family({"passage": col("store_code")} | {f: col("store_id") for f in ("zone", "queue", "canonical")}).alias("store_id"), "camera_id",
        by_family({n: F.lit(c) for n, c in seen.items()}).alias("source_field"), by_family({n: col(c) for n, c in seen.items()}).alias("source_value"), (col("family") != "passage").alias("camera_scoped"), ts.alias("ts"),
        by_family({**tracked("zone_id"), "canonical": col("zone_id")}).alias("zone_id"), by_family({**tracked("zone_name"), "canonical": meta("sku_zone")}).alias("zone_name"),
        zone_type(by_family({**tracked("zone_type"), "canonical": meta("zone_type")})).alias("zone_type"), yes_no(by_family({**tracked("is_revenue_zone"), "canonical": meta("is_revenue_zone")})).alias("is_revenue_zone"),
        by_family({**tracked("zone_hotspot_x"), "canonical": meta("hotspot_x")}).alias("hotspot_x"), by_family({**tracked("zone_hotspot_y"), "canonical": meta("hotspot_y")}).alias("hotspot_y"),
        F.coalesce(by_family({"passage": col("is_staff"), "canonical": col("is_staff")}), F.lit(False)).alias("is_staff"),
        by_family({"passage": F.coalesce("is_face_hidden", F.lit(False)), "canonical": meta("is_face_hidden")}).alias("is_face_hidden"),
        by_family({"passage": col("gender_pred"), **tracked("gender")}).alias("gender"), by_family({"passage": col("age_pred"), **tracked("age")}).alias("age"), by_family({"passage": col("age_bucket"), **tracked("age_bucket")}).alias("age_bucket"),
        by_family({"passage": col("group_id"), "canonical": meta("group_id")}).alias("group_id"), by_family({"passage": col("group_size"), "canonical": meta("group_size")}).alias("group_size"), "confidence",
        by_family({"queue": col("queue_event_id"), "canonical": meta("queue_event_id")}).alias("queue_event_id"), *[col(f"_{c}").alias(c) for c in ("queue_join_ts", "queue_served_ts", "queue_exit_ts")],
        by_family({"queue": col("wait_seconds"), "canonical": _wait(stored, meta)}).alias("wait_seconds"), by_family({"queue": col("queue_position_at_join"), "canonical": meta("queue_depth")}).alias("queue_position"),
        by_family({"queue": F.coalesce("abandoned", stored == "queue_abandoned"), "canonical": stored == "queue_abandoned"}).alias("abandoned"), F.coalesce("metadata", F.lit("{}")).alias("metadata_json"), F.nullif("event_id", F.lit("")).alias("event_id"), error.alias("error"))
    fraction = F.date_format("ts", "SSSSSS")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""))
    key = F.coalesce("event_id", F.when(of_queue, F.concat(F.lit("queue:"), "queue_event_id")), F.concat_ws(":", "event_type", "camera_id", "source_field", "source_value", iso))
    return n.withColumn("source_event_id", key)


def _wait(stored: Column, meta) -> Column:
    """A canonical event's wait: its dwell in whole seconds where it has one, else its metadata's."""
    timed = stored.isin("zone_dwell", "queue_completed", "queue_abandoned", "billing_queue_join") & (F.coalesce("dwell_ms", F.lit(0)) != 0)
    return F.when(timed, (F.col("dwell_ms") / 1000).cast("int")).otherwise(meta("wait_seconds"))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted events and rejected lines (arrival, value, error)."""
    return parsed.where("error IS NULL").drop("error", "value"), parsed.where("error IS NOT NULL").select("arrival", "value", "error")


def ingest_report(parsed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Items accepted, duplicate and failed, with the batch's status, by store of the caller's data."""
    from .sessions import receipts

    good = receipts(parsed.where("error IS NULL"))
    if stored is not None:
        had = stored.select("store_id", "source_event_id", F.lit(True).alias("_had")).distinct()
        good = good.join(had, ["store_id", "source_event_id"], "left").withColumn("status", F.when(F.col("_had"), "duplicate").otherwise(F.col("status"))).drop("_had")
    states = good.select("status").unionByName(parsed.where("error IS NOT NULL").select(F.lit("failed").alias("status")))
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    out = states.agg(n("accepted"), n("duplicate"), n("failed"))
    return out.withColumn("outcome", F.when(F.col("failed") == 0, "accepted").when(F.col("accepted") + F.col("duplicate") > 0, "partial_success").otherwise("failed"))
