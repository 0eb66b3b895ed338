"""From parsed lines to visits: identities, the alias dimension, stored facts, visits and re-entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uuid5
from . import normalize, sessions

#: Namespace of entity ids (fixed value).
NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"
ALIAS = ("store_id", "scope", "source_field", "source_value")


def scope() -> Column:
    """The camera that an identifier holds on, or the store's sentinel."""
    return F.when(F.col("camera_scoped"), F.col("camera_id")).otherwise(F.lit(sessions.STORE_SCOPE))


def with_entities(events: DataFrame) -> DataFrame:
    """``events`` with ``scope`` and ``entity_id``: the UUID of store, scope, field and value.

    The id follows from the identifier alone, so events get it without a look-up, in any batch and any order.
    """
    scoped = events.withColumn("scope", scope())
    return scoped.withColumn("entity_id", uuid5(NAMESPACE, *[F.col(c) for c in ALIAS]))


def merge_aliases(known: DataFrame | None, events: DataFrame, *, arrival: str = "arrival") -> DataFrame:
    """The alias dimension after a batch: one row an identifier, with its entity and the entity's attributes.

    ``events`` are accepted ones of :func:`with_entities`. An alias that ``known`` has keeps its first sighting
    and attributes; its last sighting becomes the batch's last arrival, and staff once is staff for good.
    """
    new = sessions.resolve_identities(events, arrival=arrival)
    new = new.withColumn("entity_id", uuid5(NAMESPACE, *[F.col(c) for c in ALIAS]))
    if known is None:
        return new
    kept = ["entity_id", "first_seen_at", "gender", "age", "age_bucket", "group_id", "group_size"]
    both = known.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
    first = lambda c: F.max_by(F.struct(c), "_old")[c].alias(c)  # noqa: E731  the known one's, null or not
    out = both.groupBy(*ALIAS).agg(*[first(c) for c in kept], F.min_by("last_seen_at", "_old").alias("last_seen_at"), F.bool_or("is_staff").alias("is_staff"))
    flagged = F.col("is_staff")
    return out.withColumns({"staff_confidence": F.when(flagged, 1.0).otherwise(0.0), "staff_reason": F.when(flagged, "source marked as staff")}).select(*new.columns)


def accepted(parsed: DataFrame) -> DataFrame:
    """The good events of :func:`normalize.parse`, the first arrival of each key, with their entities."""
    good, _ = normalize.split(parsed)
    return with_entities(sessions.first_arrivals(good))


def entities(aliases: DataFrame) -> DataFrame:
    """The entity table of the metrics: one row an entity."""
    return aliases.select("store_id", "entity_id", "is_staff", "gender", "age", "age_bucket", "group_id", "group_size", "staff_confidence", "staff_reason")


def visits(stored: DataFrame) -> DataFrame:
    """Visits of stored events, each with the visit that it is a return from, if it is one."""
    events = sessions.number_sessions(stored, order=("ts", "source_event_id"))
    made = sessions.visit_sessions(events)
    back = sessions.reentries(made, events, order=("ts", "source_event_id")).select(*sessions.VISIT, "previous_session_no", "gap_seconds")
    return made.join(back, list(sessions.VISIT), "left")
