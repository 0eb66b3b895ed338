"""Streaming forms equal the batch operators on the same rows."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from shopweave import streaming
from shopweave.operators import sessions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, store_id string, entity_id string, event_type string, ts timestamp_ntz, queue_event_id string, source_event_id string"


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(1), []
    for k in range(240):
        when = T0 + dt.timedelta(seconds=30 * k + rng.randint(0, 200))
        out.append((k, "S1", rng.choice("abc"), rng.choice(["entry", "exit", "billing_queue_join", "queue_completed"]), when, f"q{rng.randint(0, 40)}", f"k{rng.randint(0, 150)}"))
    # A last row pushes the watermark past all others.
    return [*out, (999, "S9", "z", "billing_queue_join", T0 + dt.timedelta(days=2), "end", "end")]


def run(spark, rows, tmp_path, form):
    """Three files in arrival order through ``form``; all that it gave."""
    source = tmp_path / "in"
    for n in range(3):
        part = rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"s{abs(hash(str(tmp_path)))}"
    q = form(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_dedup(spark, rows, tmp_path):
    got = run(spark, rows, tmp_path, lambda s: streaming.first_arrivals(s, late="1 day"))
    assert len(got) == len({r[-1] for r in rows})


def test_hourly(spark, rows, tmp_path):
    got = {(r.store_id, r.bucket_start): (r.entries, r.joined, r.completed) for r in run(spark, rows, tmp_path, lambda s: streaming.hourly_counts(s, late="1 hour"))}
    kinds = ("entry", "billing_queue_join", "queue_completed")
    for h in range(2):
        start = T0 + dt.timedelta(hours=h)
        own = [r[3] for r in rows if start <= r[4] < start + dt.timedelta(hours=1)]
        assert got["S1", start] == tuple(own.count(k) for k in kinds)


def test_visits(spark, rows, tmp_path):
    got = {(r.entity_id, r.session_no): r.dwell_seconds for r in run(spark, rows, tmp_path, lambda s: streaming.visits(s, late="1 hour"))}
    batch = sessions.visit_sessions(sessions.number_sessions(spark.createDataFrame(rows, SCHEMA))).where("exit_time IS NOT NULL").collect()
    assert got == {(r.entity_id, r.session_no): r.dwell_seconds for r in batch}


def test_queue_states(spark, rows, tmp_path):
    got = {r.queue_event_id for r in run(spark, rows, tmp_path, lambda s: streaming.queue_states(s, late="1 hour")) if r.state == "closed"}
    assert got == {r[5] for r in rows if r[3] == "queue_completed"}


def test_zone_visits(spark, rows, tmp_path):
    hits = lambda s: s.select("store_id", F.col("entity_id").alias("track_id"), F.lit("Z").alias("zone_id"), F.col("event_id").cast("int").alias("frame"), "ts", (F.col("event_type") != "exit").alias("inside"))
    got = run(spark, rows, tmp_path, lambda s: streaming.zone_visits(hits(s), grace=60, late="1 hour"))
    want, micros = set(), lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1000000
    for who in "abc":  # the watermark passes their last sighting by far: open visits end as well
        entered = last = left = None
        for r in sorted((r for r in rows if r[2] == who), key=lambda r: (r[4], r[0])):
            if r[3] != "exit":
                entered, last, left = entered or r[4], r[4], None
            elif entered:
                left = left or r[4]
                if (r[4] - last).total_seconds() >= 60:
                    want.add((who, micros(entered), micros(left)))
                    entered = None
        if entered:
            want.add((who, micros(entered), micros(left or last)))
    assert {(r.track_id, r.enter_us, r.exit_us) for r in got} == want and len(want) > 3


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """A row behind the watermark changes no visit; the next one of its entity tells of it."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    row = lambda k, who, kind, m: (k, "S1", who, kind, at(m), None, str(k))
    files = [[row(1, "a", "entry", 0), row(2, "z", "entry", 300)], [row(3, "a", "exit", 10), row(4, "a", "exit", 310), row(5, "z", "entry", 700)], [row(6, "z", "entry", 1400)]]
    got = run(spark, [r for f in files for r in f][:6], tmp_path, lambda s: streaming.visits(s, late="1 hour"))
    assert [(r.entity_id, r.dwell_seconds, r.late_rows) for r in got] == [("a", 310 * 60, 1)]


def test_state_is_removed(spark, rows, tmp_path):
    """Queue visits a day old leave the state."""
    extra = [(1000 + k, "S9", "z", "billing_queue_join", T0 + dt.timedelta(days=4 + 3 * k), f"end{k}", f"end{k}") for k in range(3)]
    source = tmp_path / "in"
    for part in (rows, *[[r] for r in extra]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = streaming.queue_states(stream, late="1 hour").writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert left <= 2 * 4  # of two keys: a held row, its timer in both indexes, the key's own; 41 keys came


def test_late_rows_of_windows_are_counted(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    row = lambda k, m: (k, "S1", "a", "entry", at(m), None, str(k))
    late = streaming.LateRows()
    spark.streams.addListener(late)
    try:
        got = run(spark, [row(1, 0), row(2, 600), row(3, 610), row(4, 611), row(5, 5), row(6, 612)], tmp_path, lambda s: streaming.hourly_counts(s, late="1 hour"))
        deadline = time.time() + 30
        while sum(late.rows.values()) < 1 and time.time() < deadline:  # listeners are told a little later
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(late)
    assert [r.entries for r in got] == [1] and list(late.rows.values()) == [1]


def test_state_stays_flat(spark, tmp_path):
    """Fifty triggers of one busy key: the state holds the rows of the last hour, however many came before."""
    source, sizes = tmp_path / "in", []
    source.mkdir()
    files = [[(10 * k + j, "S1", "a", "exit" if j == 9 else "entry", T0 + dt.timedelta(minutes=20 * k + j), None, "") for j in range(10)] for k in range(50)]
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(source))
    q = streaming.visits(stream, late="1 hour").writeStream.format("memory").queryName("flat").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert max(sizes[25:]) <= max(sizes[5:25])
    assert len(spark.table("flat").collect()) >= 46 and {r.dwell_seconds for r in spark.table("flat").collect()} == {540}


def test_feed_table(spark, rows, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = streaming.track_feed(stream, str(tmp_path / "feed"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.store_id: r.last_event for r in streaming.read_feed(spark, str(tmp_path / "feed")).collect()} == {s: max(r[4] for r in rows if r[1] == s) for s in ("S1", "S9")}
    assert len([n for n in os.listdir(tmp_path / "feed") if n.startswith("version=")]) <= 2


def test_lines_of_new_files(spark, tmp_path):
    """Lines are parsed as in the batch job; those of an earlier file come first."""
    line = lambda who, second: '{"event_type": "entry", "id_token": "%s", "store_code": "S1", "camera_id": "C", "event_timestamp": "2024-01-01T00:00:%02dZ"}' % (who, second)
    source = tmp_path / "in"
    source.mkdir()
    for n, text in enumerate((line("a", 1) + "\nnot json", line("b", 2))):
        (source / f"{n}.jsonl").write_text(text)
        os.utime(source / f"{n}.jsonl", (1700000000 + n, 1700000000 + n))
    q = streaming.parsed(streaming.read_lines(spark, str(source), files_a_trigger=1)).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("lines").orderBy("arrival", F.col("error").isNotNull()).collect()
    assert [(r.source_value, r.error) for r in got] == [("a", None), (None, "not a JSON event"), ("b", None)]


def test_idle_tracks_end_with_the_trigger_that_passes_them(spark, tmp_path):
    """One jump of the watermark takes the rows of a track and finds it idle: its open visit ends without a later trigger."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, "S1", "a", "entry", at(0), None, "1"), (2, "S1", "a", "entry", at(5), None, "2"), (3, "S1", "z", "exit", at(6000), None, "3")]
    hits = lambda s: s.select("store_id", F.col("entity_id").alias("track_id"), F.lit("Z").alias("zone_id"), F.col("event_id").cast("int").alias("frame"), "ts", (F.col("event_type") != "exit").alias("inside"))
    got = run(spark, rows, tmp_path, lambda s: streaming.zone_visits(hits(s), late="1 hour"))
    assert [(r.track_id, (r.exit_us - r.enter_us) // 1000000) for r in got] == [("a", 300)]


def test_held_rows_share_entries(spark, tmp_path):
    """300 rows of 30 entities that wait are stored by shard and slice of time, under one timer a shard, not one by one."""
    rows = [(k, "S1", f"e{k % 30}", "entry" if k % 10 < 9 else "exit", T0 + dt.timedelta(seconds=k), None, "") for k in range(300)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(source))
    q = streaming.visits(stream, late="1 hour").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert 0 < held <= 30 * 4  # of a shard: a part, the index, its timer in both indexes


def test_keys_that_come_again_and_late_ones(spark, tmp_path):
    """An entity that was forgotten starts anew; one that has only been late is forgotten too; null attributes are kept."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    row = lambda k, who, kind, m: (k, "S1", who, kind, at(m), None, str(k))
    files = [[row(1, "a", "entry", 0), row(2, "z", "entry", 200)], [row(3, "b", "exit", 5), row(4, "a", "exit", 210), row(5, "z", None, 900)], [row(6, "z", "entry", 2000)], [row(7, "a", "exit", 2110), row(8, "a", "entry", 2105), row(9, "z", "entry", 4000)], [row(10, "z", "entry", 8000)]]
    source = tmp_path / "in"
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = streaming.visits(stream, late="1 hour", idle=4 * 3600).writeStream.format("memory").queryName("again").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = sorted((r.entity_id, r.session_no, r.entry_us - r.exit_us, r.late_rows) for r in spark.table("again").collect())
    assert got == [("a", 0, -210 * 60 * 1000000, 0), ("a", 0, -5 * 60 * 1000000, 0)] and left <= 6  # z: a held part, its own state and when to look at it; the index, and its timer twice
