"""The stored fact table and the way from JSON lines to visits."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shopweave.operators import ingest, metrics, normalize, sessions
from shopweave.sources import facts
from shopweave.sources.facts import FactTable

T0 = dt.datetime(2024, 1, 1, 9)
SCHEMA = "store_id string, entity_id string, source_event_id string, event_type string, ts timestamp_ntz, wait_seconds int, arrival long"


def rows(n, seed=1, first=0):
    rng = random.Random(seed)
    return [(f"S{k % 2}", f"E{rng.randint(0, 9)}", f"k{k}", rng.choice(["entry", "exit", "queue_completed"]), T0 + dt.timedelta(seconds=rng.randint(0, 9000)), k, k) for k in range(first, first + n)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    return FactTable.create(spark, str(tmp_path / "facts"), spark.createDataFrame([], SCHEMA).drop("arrival").schema, buckets=4)


def keys(table, version=None):
    return sorted(r.source_event_id for r in table.read(version).collect())


def test_appends_are_idempotent(spark, table):
    feed = spark.createDataFrame(rows(50) + rows(5), SCHEMA)  # five lines arrive twice
    assert table.read().count() == 0 and table.append(feed) == 1
    assert keys(table) == sorted(f"k{k}" for k in range(50))
    assert table.append(feed) == 1 and keys(table) == sorted(f"k{k}" for k in range(50))
    # Half of it new; another store may use the same key.
    more = spark.createDataFrame([*rows(30, first=35), ("S9", "E1", "k1", "exit", T0, 1, 99)], SCHEMA)
    assert table.append(more) == 2 and len(keys(table)) == 66 and keys(table).count("k1") == 2
    assert keys(table, 1) == sorted(f"k{k}" for k in range(50))
    first = table.read().where("source_event_id = 'k3'").first()
    assert first.ts == rows(50)[3][4]


def test_an_append_that_crashes_adds_nothing(spark, table, monkeypatch):
    table.append(spark.createDataFrame(rows(20), SCHEMA))
    more = spark.createDataFrame(rows(20, first=10), SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(FactTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.append(more)
    assert len(keys(table)) == 20 and table.append(more) == 2 and len(keys(table)) == 30
    # A second writer that began from the same version fails instead of losing the first one's rows.
    old = table.manifest(1)
    monkeypatch.setattr(FactTable, "manifest", lambda self, version=None: old)
    with pytest.raises(Exception, match="exist"):
        table.append(spark.createDataFrame(rows(5, first=90), SCHEMA))


def test_compaction_and_vacuum(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(facts, "SEGMENTS", 3)
    for k in range(5):
        table.append(spark.createDataFrame(rows(10, first=10 * k), SCHEMA))
    assert len(keys(table)) == 50 and len(table.manifest()["segments"]) == 2
    table.compact()
    assert len(keys(table)) == 50 and len(table.manifest()["segments"]) == 1
    table.vacuum(keep=1)
    assert len(keys(table)) == 50 and len(table.versions()) == 1 and len(list((tmp_path / "facts" / "events").glob("segment=*"))) == 1
    assert table.append(spark.createDataFrame(rows(50), SCHEMA)) == table.versions()[-1]
    with pytest.raises(FileNotFoundError):
        table.read(0)
    with pytest.raises(FileNotFoundError):
        FactTable(spark, str(tmp_path / "none")).read()
    with pytest.raises(ValueError):
        FactTable.create(spark, str(tmp_path / "bad"), spark.createDataFrame([], "store_id string").schema)


def test_entities_need_no_shuffle(spark, table):
    """Over several segments: one scan, and no exchange by entity, for visits and all store metrics."""
    for k in range(3):
        table.append(spark.createDataFrame(rows(40, first=40 * k), SCHEMA))
    numbered = sessions.number_sessions(table.read(), order=("ts", "source_event_id"))
    visits = metrics.visit_facts(numbered)
    for df in (numbered, visits, visits.groupBy("store_id", "entity_id").count()):
        assert "Exchange" not in plan(df) and plan(df).count("FileScan") == 1
    who = spark.createDataFrame([("S0", f"E{k}", k == 0, None, None) for k in range(10)] + [("S1", f"E{k}", False, "G" if k < 2 else None, 2) for k in range(10)], "store_id string, entity_id string, is_staff boolean, group_id string, group_size int")
    sales = spark.createDataFrame([("S1", "O1", T0), ("S3", "O2", T0)], "store_id string, order_id string, ts timestamp_ntz")
    items = spark.createDataFrame([("S1", "O1", "p", 2.5)], "store_id string, order_id string, product_id string, amount double")
    matched = spark.createDataFrame([("S1", "O1", "MATCHED")], "store_id string, order_id string, status string")
    one = metrics.metrics_of_visits(visits, who, matched, sales, items)
    assert plan(one).count("FileScan") == 1
    plain = spark.createDataFrame([(*r, r[6]) for r in rows(120)][:0] + [r for k in range(3) for r in rows(40, first=40 * k)], SCHEMA)
    e = sessions.number_sessions(plain, order=("ts", "source_event_id"))
    want = metrics.store_metrics(e, sessions.visit_sessions(e), who, matched, sales, items)
    assert {r.store_id: r.asDict() for r in one.select(*want.columns).collect()} == {r.store_id: r.asDict() for r in want.collect()}


def line(kind, who, second, camera="C", **more):
    at = (T0 + dt.timedelta(seconds=second)).isoformat()
    if kind in ("entry", "exit"):
        return json.dumps({"event_type": kind, "id_token": who, "store_code": "S", "camera_id": camera, "event_timestamp": at, **more})
    return json.dumps({"event_type": kind, "track_id": who, "store_id": "S", "camera_id": camera, "zone_id": "Z", "event_time": at, **more})


def test_lines_to_visits_and_aliases(spark, tmp_path):
    """A track is known by its camera, a token by its store; staff once is staff for good; the second entry is a re-entry."""
    feed = [line("entry", "a", 0, gender_pred="f"), line("exit", "a", 60), line("entry", "a", 120, camera="D", is_staff=True, gender_pred="m"), line("zone_entered", "7", 10), line("zone_entered", "7", 20, camera="D"), line("zone_exited", "7", 30), "broken", line("exit", "a", 60)]
    parsed = normalize.parse(spark.createDataFrame([(x, k) for k, x in enumerate(feed)], "value string, arrival long"))
    events = ingest.accepted(parsed)
    assert events.count() == 6
    table = FactTable.create(spark, str(tmp_path / "facts"), events.schema, buckets=2)
    aliases = None
    for part in (F.col("arrival") < 2, F.col("arrival") >= 2, F.lit(True)):  # the last feed has nothing new
        table.append(events.where(part))
        aliases = ingest.merge_aliases(aliases, events.where(part))
    got = {(r.scope, r.source_value): r for r in aliases.collect()}
    assert set(got) == {("__STORE_SCOPED__", "a"), ("C", "7"), ("D", "7")}
    a = got["__STORE_SCOPED__", "a"]
    assert (a.gender, a.is_staff, a.staff_reason, a.first_seen_at, a.last_seen_at) == ("f", True, "source marked as staff", T0, T0 + dt.timedelta(seconds=120))
    assert {r.entity_id for r in table.read().collect()} == {r.entity_id for r in got.values()}
    visits = {(r.entity_id, r.session_no): r for r in ingest.visits(table.read()).collect()}
    assert len(visits) == 4
    first, back = visits[a.entity_id, 0], visits[a.entity_id, 1]
    assert (first.status, first.dwell_seconds, first.previous_session_no) == ("completed", 60, None) and (back.status, back.previous_session_no, back.gap_seconds) == ("open", 0, 60)
    who = ingest.entities(aliases)
    r = metrics.metrics_of_visits(metrics.visit_facts(sessions.number_sessions(table.read(), order=("ts", "source_event_id"))), who, *[spark.createDataFrame([], s) for s in ("store_id string, order_id string, status string", "store_id string, order_id string, ts timestamp_ntz", "store_id string, order_id string, product_id string, amount double")]).first()
    assert (r.unique_visitors, r.staff_visitors, r.footfall) == (2, 1, 0)
