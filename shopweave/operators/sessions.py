"""Dedup, visits and re-entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seconds

ENTITY = ("store_id", "entity_id")
VISIT = (*ENTITY, "session_no")


def first_arrivals(events: DataFrame, stored: DataFrame | None = None, *, key: str = "source_event_id", arrival: Column | str = "arrival") -> DataFrame:
    """The first arrival of each (store, key), without keys that ``stored`` has already."""
    order = Window.partitionBy("store_id", key).orderBy(arrival)
    kept = events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return kept if stored is None else kept.join(stored.select("store_id", key), ["store_id", key], "left_anti")


def receipts(events: DataFrame, *, key: str = "source_event_id", arrival: Column | str = "arrival") -> DataFrame:
    """Every attempt with its status: ``accepted`` for the first of a key, else ``duplicate``."""
    order = Window.partitionBy("store_id", key).orderBy(arrival)
    return events.withColumn("status", F.when(F.row_number().over(order) == 1, "accepted").otherwise("duplicate"))


def number_sessions(events: DataFrame, *, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``session_no``: the exits of the entity before the event; any event opens a visit."""
    before = Window.partitionBy(*ENTITY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    exits = F.sum(F.when(F.col("event_type") == "exit", 1).otherwise(0)).over(before)
    return events.withColumn("session_no", F.coalesce(exits, F.lit(0)).cast("long"))


def visit_sessions(events: DataFrame) -> DataFrame:
    """One row a visit: entry at its first event, exit at its EXIT event, dwell in whole seconds."""
    entry, left = F.min("ts").alias("entry_time"), F.max(F.when(F.col("event_type") == "exit", F.col("ts"))).alias("exit_time")
    visits = events.groupBy(*VISIT).agg(entry, left)
    return visits.withColumns({"dwell_seconds": seconds(F.col("entry_time"), F.col("exit_time")), "status": F.when(F.col("exit_time").isNotNull(), "completed").otherwise("open")})


def reentries(visits: DataFrame, events: DataFrame, *, days: int = 365, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Visits opened by an entry event within ``days`` of the end of the entity's previous visit."""
    opener = events.groupBy(*VISIT).agg(F.min_by("event_type", F.struct(*order)).alias("opened_by"))
    visit = Window.partitionBy(*ENTITY).orderBy("session_no")
    last = visits.withColumns({"previous_session_no": F.lag("session_no").over(visit), "previous_exit": F.lag("exit_time").over(visit)})
    gap = seconds(F.col("previous_exit"), F.col("entry_time"))
    return (last.join(opener, list(VISIT)).where((F.col("opened_by") == "entry") & gap.between(0, days * 86400))
            .select(*VISIT, "entry_time", "previous_session_no", "previous_exit", gap.alias("gap_seconds")))


def reentry_events(events: DataFrame, returned: DataFrame, *, key: str = "source_event_id", stored: DataFrame | None = None) -> DataFrame:
    """A ``reentry`` event beside each entry that opened a visit of ``returned`` (see :func:`reentries`).

    It repeats the entry under the key ``{key}:reentry`` and tells of the previous visit in ``metadata_json``.
    Keys that ``stored`` has already are left out, so running it again adds nothing.
    """
    first = Window.partitionBy(*VISIT).orderBy("ts", "event_id")
    opening = events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    told = F.to_json(F.struct("previous_session_no", F.date_format("previous_exit", "yyyy-MM-dd'T'HH:mm:ss").alias("previous_exit_time")))
    out = opening.join(returned.select(*VISIT, told.alias("metadata_json")), list(VISIT))
    out = out.withColumns({"event_type": F.lit("reentry"), key: F.concat(F.col(key).cast("string"), F.lit(":reentry"))})
    return out if stored is None else out.join(stored.select("store_id", key), ["store_id", key], "left_anti")


#: Stands for the camera of identifiers that hold in a whole store (fixed value).
STORE_SCOPE = "__STORE_SCOPED__"


def resolve_identities(events: DataFrame, *, arrival: str = "event_id") -> DataFrame:
    """One row for each (store, camera or the store's sentinel, source field, source value).

    ``events`` has source_field, source_value, camera_scoped, is_staff and the attributes gender, age, age_bucket,
    group_id and group_size. Attributes are those of the first arrival; one sighting as staff makes the
    identity staff for good. First and last sightings go by arrival, not by event time.
    """
    scope = F.when(F.col("camera_scoped"), F.col("camera_id")).otherwise(F.lit(STORE_SCOPE))
    first = lambda c: F.min_by(F.struct(c), arrival)[c].alias(c)  # noqa: E731  the first one's, null or not
    staff = F.coalesce("is_staff", F.lit(False))
    out = events.withColumn("scope", scope).groupBy("store_id", "scope", "source_field", "source_value").agg(
        F.min_by("ts", arrival).alias("first_seen_at"), F.max_by("ts", arrival).alias("last_seen_at"), F.bool_or(staff).alias("is_staff"), *[first(c) for c in ("gender", "age", "age_bucket", "group_id", "group_size")])
    flagged = F.col("is_staff")
    return out.withColumns({"staff_confidence": F.when(flagged, 1.0).otherwise(0.0), "staff_reason": F.when(flagged, "source marked as staff")})


def resolve_aliases(events: DataFrame, *, arrival: str = "event_id") -> DataFrame:
    """One row for each entity and camera: first attributes, sightings in arrival order."""
    return events.groupBy(*ENTITY, "camera_id").agg(
        F.min_by("ts", arrival).alias("first_seen_at"), F.max_by("ts", arrival).alias("last_seen_at"), F.min_by("event_type", arrival).alias("first_event_type"), F.count("*").alias("n_events"))


def first_seen(events: DataFrame, column: str, *, arrival: str = "event_id", known: DataFrame | None = None) -> DataFrame:
    """Dimension rows on first reference; rows of ``known`` are never overwritten."""
    new = events.where(F.col(column).isNotNull()).groupBy("store_id", column).agg(F.min_by("ts", arrival).alias("first_seen_at"), F.min(arrival).alias("first_arrival"))
    return new if known is None else known.unionByName(new.join(known, ["store_id", column], "left_anti"))


def close_at_last_sighting(visits: DataFrame, sightings: DataFrame) -> DataFrame:
    """Open visits of seen entities end at their last sighting, not before their entry."""
    seen = sightings.groupBy(*ENTITY).agg(F.max("ts").alias("last_seen"))
    closed = F.when(F.col("exit_time").isNull() & F.col("last_seen").isNotNull(), F.greatest("last_seen", "entry_time"))
    out = visits.join(seen, list(ENTITY), "left").withColumn("exit_time", F.coalesce("exit_time", closed)).drop("last_seen")
    return out.withColumns({"dwell_seconds": seconds(F.col("entry_time"), F.col("exit_time")), "status": F.when(F.col("exit_time").isNotNull(), "completed").otherwise("open")})
