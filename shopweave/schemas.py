"""Explicit schemas of the feeds and derived tables; nothing is inferred."""

from __future__ import annotations

#: Event types as stored (fixed values).
ENTRY, EXIT, REENTRY = "entry", "exit", "reentry"
ZONE_ENTERED, ZONE_EXITED, ZONE_DWELL = "zone_entered", "zone_exited", "zone_dwell"
QUEUE_JOIN, QUEUE_COMPLETED, QUEUE_ABANDONED = "billing_queue_join", "queue_completed", "queue_abandoned"

#: Canonical (upper-case) event type -> stored type (fixed values).
CANONICAL_TYPES = {
    "ENTRY": ENTRY, "EXIT": EXIT, "ZONE_ENTER": ZONE_ENTERED, "ZONE_EXIT": ZONE_EXITED, "ZONE_DWELL": ZONE_DWELL,
    "BILLING_QUEUE_JOIN": QUEUE_JOIN, "BILLING_QUEUE_COMPLETE": QUEUE_COMPLETED, "BILLING_QUEUE_ABANDON": QUEUE_ABANDONED, "REENTRY": REENTRY,
}
#: Zone types (fixed values); unknown ones become OTHER.
ZONE_TYPES = ("ENTRANCE", "BROWSING", "BILLING", "STAFF_AREA", "EXIT", "OTHER")

#: One superset of all event payloads; ids are text, so numbers are coerced.
PAYLOAD = """
event_type string, event_id string, id_token string, store_code string, store_id string, camera_id string,
track_id string, visitor_id string, event_timestamp string, event_time string, timestamp string,
is_staff boolean, gender_pred string, gender string, age_pred int, age int, age_bucket string, is_face_hidden boolean,
group_id string, group_size int, zone_id string, zone_name string, zone_type string, is_revenue_zone string,
zone_hotspot_x double, zone_hotspot_y double, queue_event_id string, queue_join_ts string, queue_served_ts string,
queue_exit_ts string, wait_seconds int, queue_position_at_join int, abandoned boolean, dwell_ms bigint,
confidence double, metadata string
"""

#: Point-of-sale rows, all text.
POS = "order_id string, order_date string, order_time string, store_id string, product_id string, brand_name string, total_amount string"

#: Stored facts.
EVENTS = """
event_id string, store_id string, entity_id string, camera_id string, event_type string, ts timestamp_ntz, zone_id string,
queue_event_id string, wait_seconds int, hotspot_x double, hotspot_y double, session_no long
"""
SNAPSHOTS = "store_id string, camera_id string, video string, track_id string, frame int, ts timestamp_ntz, foot_x double, foot_y double"
