"""Retail operators on small seeds and against brute force."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from shopweave.functions import in_polygon, iso_utc, rate, uuid5
from shopweave.operators import live, metrics, normalize, people, pos, replay, rules, sessions, spatial, tracks
from shopweave.sources import feeds

T0 = dt.datetime(2024, 1, 1, 9)
EVENT = "event_id long, store_id string, entity_id string, event_type string, ts timestamp_ntz, zone_id string, queue_event_id string, wait_seconds int, hotspot_x double, hotspot_y double, camera_id string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    """rows: (entity, type, second, {fields})."""
    data = []
    for k, (who, kind, when, *more) in enumerate(rows):
        f = more[0] if more else {}
        data.append((k, "S1", who, kind, at(when), f.get("zone"), f.get("queue"), f.get("wait"), f.get("x"), f.get("y"), f.get("camera", "C1")))
    return spark.createDataFrame(data, EVENT)


def entities(spark, **kinds):
    rows = [("S1", n, k == "staff", "G1" if k == "group" else None, 2 if k == "group" else None) for n, k in kinds.items()]
    return spark.createDataFrame(rows, "store_id string, entity_id string, is_staff boolean, group_id string, group_size int")


@pytest.fixture(scope="module")
def seed(spark):
    """Two grouped customers, a solo one and a member of staff."""
    e = events(spark, [
        ("a", "entry", 0), ("a", "zone_entered", 60, {"zone": "makeup"}), ("a", "zone_exited", 360, {"zone": "makeup"}), ("a", "billing_queue_join", 400, {"queue": "q1", "zone": "pay"}),
        ("a", "queue_completed", 1000, {"queue": "q1", "zone": "pay", "wait": 600}), ("a", "exit", 1200), ("b", "entry", 10), ("b", "billing_queue_join", 500, {"queue": "q2", "zone": "pay"}),
        ("b", "queue_abandoned", 920, {"queue": "q2", "zone": "pay", "wait": 420}), ("b", "exit", 1010), ("c", "entry", 30), ("s", "entry", 0), ("s", "exit", 5000)])
    e = sessions.number_sessions(e)
    people_ = entities(spark, a="group", b="group", c="solo", s="staff")
    v = sessions.visit_sessions(e)
    sales = spark.createDataFrame([("S1", "O1", at(1010)), ("S1", "O2", at(9000))], "store_id string, order_id string, ts timestamp_ntz")
    items = spark.createDataFrame([("S1", "O1", "p", 100.0), ("S1", "O1", "q", 50.0), ("S1", "O2", "p", 9.0)], "store_id string, order_id string, product_id string, amount double")
    return e, v, people_, sales, items, pos.correlate(sales, v, e, people_)


def test_metrics_and_funnel(seed):
    e, v, who, sales, items, cor = seed
    m = metrics.store_metrics(e, v, who, cor, sales, items)
    r = m.first()
    assert (r.total_visitors, r.unique_visitors, r.staff_visitors, r.solo_visitors, r.group_count, r.average_group_size) == (3, 3, 1, 1, 1, 2.0)
    assert (r.average_dwell_seconds, r.queue_abandonment_rate, r.average_queue_wait_seconds, r.attributed_revenue, r.conversion_rate) == (1100.0, 0.5, 510.0, 150.0, 0.3333)
    assert [x["count"] for x in metrics.funnel(m).orderBy("step_no").collect()] == [3, 2, 1, 1]
    z = metrics.zone_dwell(e, who).first()
    assert (z.zone_id, z.visits, z.average_dwell_seconds) == ("makeup", 1, 300.0)
    found = {x.kind for x in rules.alerts(rules.queue_spike(m), rules.conversion_drop(m)).collect()}
    assert found == {"queue_spike"}


def test_correlation_states(seed):
    *_, cor = seed
    got = {(r.order_id, r.entity_id, r.status) for r in cor.collect()}
    assert ("O1", "a", "MATCHED") in got and ("O2", None, "UNMATCHED") in got and (None, "c", "UNMATCHED") in got


def test_correlation_refuses_lossy_parameters(seed):
    e, v, who, sales, _, _ = seed
    with pytest.raises(ValueError):
        pos.correlate(sales, v, e, who, least=0.35)


def test_occupancy_is_half_open(spark):
    e = sessions.number_sessions(events(spark, [("a", "entry", 0), ("a", "exit", 3600), ("b", "entry", 3600)]))
    v, who, stores = sessions.visit_sessions(e), entities(spark, a="solo", b="solo"), spark.createDataFrame([("S1",)], "store_id string")
    series = live.occupancy_series(v, who, stores, F.lit(at(0)).cast("timestamp_ntz"), F.lit(at(7200)).cast("timestamp_ntz"))
    assert [r.occupancy for r in series.orderBy("sample_time").collect()] == [1, 1, 1]


def test_current_queue(spark):
    e = sessions.number_sessions(events(spark, [("a", "billing_queue_join", 0, {"queue": "q1"}), ("a", "billing_queue_join", 30, {"queue": "q1"}), ("b", "billing_queue_join", 40, {"queue": "q2"}), ("b", "queue_completed", 90, {"queue": "q2"}), ("c", "billing_queue_join", 500, {"queue": "q3"})]))
    now = live.as_of(e, F.lit(at(100)).cast("timestamp_ntz"))
    got = live.current_queue(e, entities(spark, a="solo"), now).collect()
    assert [(r.queue_event_id, r.waiting_seconds) for r in got] == [("q1", 100)]


def test_sessions_equal_state_machine(spark):
    rng, rows = random.Random(4), []
    for _ in range(400):
        rows.append((rng.choice("abcdef"), rng.choice(["entry", "exit", "zone_entered"]), rng.randint(0, 3000)))
    got = {(r.entity_id, r.session_no): (r.entry_time, r.exit_time) for r in sessions.visit_sessions(sessions.number_sessions(events(spark, rows))).collect()}
    want, open_, number = {}, {}, {}
    for k, (who, kind, when) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        n = number.get(who, 0)
        open_.setdefault(who, when)
        want[who, n] = (at(open_[who]), None)
        if kind == "exit":
            want[who, n] = (at(open_.pop(who)), at(when))
            number[who] = n + 1
    assert got == want


def test_groups_equal_store_wide_greedy(spark):
    rng, rows = random.Random(6), []
    for n in range(60):
        start = rng.randint(0, 1500)
        x = rng.choice([0.1, 0.5, 0.9])
        rows += [(f"p{n:02d}", "entry", start, {"x": x, "y": x}), (f"p{n:02d}", "zone_entered", start + 20, {"zone": rng.choice("AB"), "x": x, "y": x}), (f"p{n:02d}", "exit", start + rng.randint(60, 500))]
    e = sessions.number_sessions(events(spark, rows))
    pairs = people.group_pairs(people.profiles(e, sessions.visit_sessions(e)))
    near, start = {}, {}
    for r in pairs.collect():
        near.setdefault(r.a_entity_id, set()).add(r.b_entity_id)
        near.setdefault(r.b_entity_id, set()).add(r.a_entity_id)
        start[r.a_entity_id], start[r.b_entity_id] = r.a_entry_time, r.b_entry_time
    taken, want = {}, 0
    for seed in sorted(start, key=lambda x: (start[x], x)):
        if seed in taken:
            continue
        members = [seed] + [o for o in sorted(near[seed], key=lambda x: (start[x], x)) if o not in taken][:4]
        if len(members) > 1:
            want += 1
            taken |= {m: f"S1-GROUP-{want:03d}" for m in members}
    assert want > 1 and {r.entity_id: r.group_id for r in people.infer_groups(pairs).collect()} == taken


PAIR = "store_id string, a_entity_id string, a_session_no long, a_entry_time timestamp_ntz, b_entity_id string, b_session_no long, b_entry_time timestamp_ntz"


def test_groups_of_a_long_chain(spark):
    """Each visitor matches the next one only: 150 hops from end to end."""
    rows = [("S1", f"p{n:03d}", 1, at(60 * n), f"p{n + 1:03d}", 1, at(60 * n + 60)) for n in range(150)]
    got = people.infer_groups(spark.createDataFrame(rows, PAIR)).collect()
    assert {r.entity_id: r.group_id for r in got} == {f"p{n:03d}": f"S1-GROUP-{n // 2 + 1:03d}" for n in range(150)}


def test_groups_in_bounded_rounds(spark, monkeypatch):
    """No task gets a whole store, and the groups are those of one pass over it."""
    rng, rows, near = random.Random(4), set(), {}
    visit = {(f"p{n:02d}", k): at(rng.randint(0, 90)) for n in range(70) for k in (1, 2)}
    for store in ("S1", "S2"):
        for _ in range(500):
            (a, i), (b, j) = sorted(rng.sample(sorted(visit), 2))
            if a != b:
                rows.add((store, a, i, visit[a, i], b, j, visit[b, j]))
    for store, a, i, t, b, j, u in rows:
        near.setdefault((store, t, a, i), []).append((u, b, j))
        near.setdefault((store, u, b, j), []).append((t, a, i))
    want, number = {}, {"S1": 0, "S2": 0}
    for store, t, seed, i in sorted(near):
        if (store, seed) not in want:
            names = {seed, *[x for _, x, _ in sorted(near[store, t, seed, i]) if (store, x) not in want][:4]}
            if len(names) > 1:
                number[store] += 1
                want |= {(store, x): (f"{store}-GROUP-{number[store]:03d}", len(names)) for x in names}
    pairs = spark.createDataFrame(sorted(rows), PAIR)
    sizes, cut = [], people._in_chunks

    def seen(matches, rows):
        out = cut(matches, rows)
        sizes.extend(r["count"] for r in out.groupBy("store_id", "chunk").count().collect())
        return out

    monkeypatch.setattr(people, "_in_chunks", seen)
    got = people.infer_groups(pairs, rows=100).collect()
    assert sum(sizes) == 2 * len(rows) and max(sizes) < 100 + max(map(len, near.values()))
    assert {(r.store_id, r.entity_id): (r.group_id, r.group_size) for r in got} == want


def test_pairs_of_a_hot_store_are_cut_into_blocks(spark):
    """One store with half of all visits, all in an hour: the same pairs as by comparing every two."""
    rng, rows = random.Random(3), []
    for n in range(400):
        start, zone = rng.randint(0, 3600), rng.choice(["A", "B", "AB", ""])
        rows.append(("S0" if n < 200 else f"S{n % 20}", f"p{n:03d}", 1, at(start), at(start + rng.randint(0, 900)), list(zone), [(rng.random(), rng.random())] if rng.random() < 0.8 else []))
    kind = "store_id string, entity_id string, session_no long, entry_time timestamp_ntz, end_time timestamp_ntz, zones array<string>, spots array<struct<x: double, y: double>>"
    want = set()
    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            close, common = abs((p[3] - q[3]).total_seconds()) <= 120, (min(p[4], q[4]) - max(p[3], q[3])).total_seconds() >= 180
            zones = set(p[5]) | set(q[5])
            alike = bool(zones) and 2 * len(set(p[5]) & set(q[5])) >= len(zones)
            near = any((x - u) ** 2 + (y - v) ** 2 <= 0.18**2 for x, y in p[6] for u, v in q[6])
            if p[0] == q[0] and (close or common) and close + common + alike + near >= 3:
                want.add((p[0], p[1], q[1]))
    profile = spark.createDataFrame(rows, kind)
    assert len(want) > 100
    for block in (2048, 16):
        got = people.group_pairs(profile, block=block)
        assert sorted((r.store_id, r.a_entity_id, r.b_entity_id) for r in got.collect()) == sorted(want)
    assert all(r.a_entry_time == next(x[3] for x in rows if x[1] == r.a_entity_id) for r in got.collect())


def test_groups_settle_in_few_rounds(spark, monkeypatch):
    """Sparse matches of one big store: most seeds settle at once, in far fewer rounds than chunks."""
    rng, rows, near, rounds = random.Random(5), set(), {}, []
    for _ in range(6000):
        a, b = sorted(rng.sample(range(9000), 2))
        rows.add(("S1", f"p{a:05d}", 1, at(a), f"p{b:05d}", 1, at(b)))
    for _, a, _, t, b, _, u in rows:
        near.setdefault((t, a), []).append((u, b))
        near.setdefault((u, b), []).append((t, a))
    want, number = {}, 0
    for t, seed in sorted(near):
        if seed not in want:
            names = {seed, *[x for _, x in sorted(near[t, seed]) if x not in want][:4]}
            if len(names) > 1:
                number += 1
                want |= {x: (f"S1-GROUP-{number:03d}", len(names)) for x in names}
    make = people.materialize

    def counted(df, name):
        rounds.append(name)
        return make(df, name)

    monkeypatch.setattr(people, "materialize", counted)
    got = people.infer_groups(spark.createDataFrame(sorted(rows), PAIR), rows=200).collect()
    assert {r.entity_id: (r.group_id, r.group_size) for r in got} == want
    assert rounds.count("group-left") <= 2 * 8  # 60 chunks


def test_staff_score(spark):
    e = sessions.number_sessions(events(spark, [("w", "entry", 0)] + [("w", "queue_completed", 100 + k, {"queue": f"q{k}"}) for k in range(3)] + [("w", "zone_entered", 200, {"zone": "staff_room"}), ("w", "exit", 4000)]))
    r = people.staff_scores(e, sessions.visit_sessions(e), entities(spark, w="solo")).first()
    assert r.is_staff and r.score_units == round((0.35 + 4000 / 10800 * 0.35 + 0.35) * 10000)


def test_links(spark):
    e = events(spark, [("a", "entry", 0, {"camera": "C1"}), ("b", "entry", 100, {"camera": "C2"}), ("c", "entry", 5000, {"camera": "C1"}), ("d", "entry", 5100, {"camera": "C2"}), ("e", "entry", 5110, {"camera": "C2"})])
    ways = spark.createDataFrame([("S1", "C1", "C2", 50, 150)], "store_id string, from_camera_id string, to_camera_id string, min_transit_seconds int, max_transit_seconds int")
    got = {(r.entity_a, r.entity_b): (r.confidence, r.reason) for r in people.link_candidates(people.camera_sightings(e), ways).collect()}
    assert got == {("a", "b"): (1.0, "accepted"), ("c", "d"): (0.0, "ambiguous"), ("c", "e"): (0.0, "ambiguous")}


def test_zone_visits_equal_state_machine(spark):
    rng, rows = random.Random(2), []
    for track in "abcdef":
        when = 0
        for frame in range(60):
            when += rng.randint(1, 6)
            rows.append(("S1", "C", "v", track, frame, at(when), 0.25 if rng.random() < 0.5 else 0.75, 0.5))
    snaps = spark.createDataFrame(rows, "store_id string, camera_id string, video string, track_id string, frame int, ts timestamp_ntz, foot_x double, foot_y double")
    zone = spark.createDataFrame([("S1", "C", "Z", "BROWSING", [(0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0)])], "store_id string, camera_id string, zone_id string, type string, polygon array<struct<x: double, y: double>>")
    for grace in (0, 4, 9):
        want = set()
        for track in "abcdef":
            entered = last = left = None
            for _, _, _, t, _, ts, x, _ in rows:
                if t != track:
                    continue
                if x < 0.5:
                    entered, last, left = entered or ts, ts, None
                elif entered:
                    left = left or ts
                    if (ts - last).total_seconds() >= grace:
                        want.add((track, entered, left))
                        entered = last = left = None
            if entered:
                want.add((track, entered, left or last))
        assert {(r.track_id, r.enter_ts, r.exit_ts) for r in tracks.zone_visits(snaps, zone, grace=grace).collect()} == want


def test_zone_grid(spark):
    """A thousand zones on a camera and odd polygons: the same zones as by testing all, from a few candidates a sighting."""
    rng = random.Random(2)
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    zones = [("S", "C", f"z{i}-{j}", square(i / 32, j / 32, 1 / 32)) for i in range(32) for j in range(31)]
    zones += [("S", "D", "tri", [(-2.0, -2.0), (3.0, 0.0), (0.0, 3.0)]), ("S", "D", "line", [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)]), ("S", "D", "two", [(0.0, 0.0), (1.0, 1.0)]), ("S", "D", "far", square(8.0, 8.0, 0.5))]
    spots = [("S", c, "v", "t", k, at(k), rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2)) for k in range(400) for c in "CD"] + [("S", "D", "v", "t", 900, at(900), 8.2, 8.2), ("S", "E", "v", "t", 1, at(1), 0.5, 0.5), ("S", "C", "v", "t", 901, at(901), None, 0.1)]
    area = spark.createDataFrame(zones, "store_id string, camera_id string, zone_id string, polygon array<struct<x: double, y: double>>")
    seen = spark.createDataFrame(spots, "store_id string, camera_id string, video string, track_id string, frame int, ts timestamp_ntz, foot_x double, foot_y double")

    def inside(x, y, polygon):
        hit = False
        for (ax, ay), (bx, by) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    want = {(c, f, z) for _, c, _, _, f, _, x, y in spots for _, o, z, p in zones if c == o and x is not None and len(p) > 2 and inside(x, y, p)}
    met = seen.join(tracks.zone_index(area), ["store_id", "camera_id"]).withColumn("zones", F.coalesce(tracks.candidate_zones(), F.array()))
    found = met.select("camera_id", "frame", F.size("zones").alias("tests"), F.transform(F.filter("zones", lambda z: in_polygon(F.col("foot_x"), F.col("foot_y"), z["polygon"])), lambda z: z["zone_id"]).alias("hits")).collect()
    assert {(r.camera_id, r.frame, z) for r in found for z in r.hits} == want and len(want) > 400
    tests = [r.tests for r in found if r.camera_id == "C"]
    assert sum(tests) / len(tests) < 3


def test_expressions(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    df = spark.createDataFrame([("a", 1, 1, 3, dt.datetime(2024, 1, 1, 0, 0, 0, 500000)), ("é", 22, 2, 0, T0)], "s string, n int, p int, w int, t timestamp_ntz")
    r = df.select(uuid5(ns, F.col("s"), F.col("n")).alias("u"), rate(F.col("p"), F.col("w")).alias("r"), iso_utc(F.col("t")).alias("i")).collect()
    assert [x.u for x in r] == [str(uuid.uuid5(uuid.UUID(ns), f"{s}\x1f{n}")) for s, n in (("a", 1), ("é", 22))]
    assert [x.r for x in r] == [0.3333, 0.0] and [x.i for x in r] == ["2024-01-01T00:00:00.500000Z", "2024-01-01T09:00:00Z"]
    triangle = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))])
    assert spark.range(1).select(in_polygon(F.lit(0.2), F.lit(0.2), triangle), in_polygon(F.lit(0.8), F.lit(0.8), triangle)).first()[:] == (True, False)


def test_feeds_round_trip(spark, seed, tmp_path):
    lines = ['{"event_type": "entry", "id_token": "a", "store_code": "S1", "camera_id": "C", "event_timestamp": "2024-01-01T09:00:00+02:00"}', "", "broken", '{"event_type": "ENTRY", "event_id": "x", "store_id": "S1", "camera_id": "C", "visitor_id": "v", "timestamp": "2024-01-01T09:00:00Z", "confidence": 1.5}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    parsed = normalize.parse(feeds.read_lines(spark, str(tmp_path / "in.jsonl"))).collect()
    assert [(r.ts, r.error) for r in parsed if r.source_value == "a"] == [(dt.datetime(2024, 1, 1, 7), None)] and len(parsed) == 3
    assert sorted(r.error for r in parsed if r.error) == ["confidence is not in [0, 1]", "not a JSON event"]
    (tmp_path / "pos.csv").write_bytes(b"\xef\xbb\xbforder_id,order_date,order_time,store_id,product_id,brand_name,total_amount\nO1,01-02-2024,09:05:00,store_1008,p,,10.50\nO1,01-02-2024,09:06:00,1008,q,B,2\n,01-02-2024,09:06:00,1008,q,B,2\nO2,1-2-2024,9:6:0,ST9,q,B,x\n")
    rows = pos.parse_rows(feeds.read_pos(spark, str(tmp_path / "pos.csv")))
    orders = pos.import_orders(rows)
    r = orders.first()
    assert (r.store_id, r.order_id, r.ts, [i.amount for i in r["items"]]) == ("ST1008", "O1", dt.datetime(2024, 2, 1, 9, 5), [10.5, 2.0])
    assert pos.import_report(rows, orders).first().asDict() == {"rows": 4, "failed_rows": 2, "orders": 1, "created": 0, "skipped": 1}
    feeds.write_pos_csv(orders, str(tmp_path / "out"))
    assert pos.import_orders(pos.parse_rows(feeds.read_pos(spark, str(tmp_path / "out")))).drop("items").collect() == orders.drop("items").collect()
    e = seed[0]
    feeds.write_events(e, str(tmp_path / "facts"))
    assert feeds.read_events(spark, str(tmp_path / "facts")).where("store_id = 'S1'").count() == e.count()
    feeds.write_jsonl(e, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == e.count()


def test_every_shape_of_the_feed_is_accepted(spark):
    """Three entries and an exit out of order, zone events with numeric tracks, queue events without a time of their own."""
    import json

    passage = lambda kind, who, at, **more: {"event_type": kind, "id_token": who, "store_code": "ST7", "camera_id": "DOOR", "event_timestamp": at, "is_staff": False, "gender_pred": "female", "age_pred": 30, "age_bucket": "25-34", **more}
    zone = lambda kind, who, at: {"event_type": kind, "track_id": who, "store_id": "ST7", "camera_id": "HALL", "zone_id": "Z", "zone_name": "Shelf", "zone_type": "DISPLAY", "is_revenue_zone": "Yes", "zone_hotspot_x": 0.1, "zone_hotspot_y": 0.2, "event_time": at}
    queue = lambda kind, who, key, **more: {"event_type": kind, "track_id": who, "store_id": "ST7", "camera_id": "TILL", "zone_id": "B", "zone_type": "BILLING", "queue_event_id": key, "queue_join_ts": "2024-01-01T10:40:00", "queue_served_ts": None,
                                            "queue_exit_ts": "2024-01-01T10:43:00", "wait_seconds": 180, "queue_position_at_join": 2, **more}
    rows = [passage("entry", "a", "2024-01-01T10:00:00.250"), passage("entry", "a", "2024-01-01T10:00:00.750"), passage("entry", "b", "2024-01-01T10:10:00"), passage("exit", "a", "2024-01-01T10:02:39", is_face_hidden=True),
            *[zone(k, t, f"2024-01-01T10:2{t}:{m}") for t in (1, 2, 3) for k, m in (("zone_entered", "00"), ("zone_exited", "30"))], queue("queue_completed", 1, "q1", abandoned=False), queue("queue_completed", 2, "q2"), queue("queue_abandoned", 3, "q3")]
    assert len(rows) == 13
    lines = spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(rows)], "value string, arrival long")
    got = normalize.parse(lines).orderBy("arrival").collect()
    assert [r.error for r in got] == [None] * 13 and len({r.source_event_id for r in got}) == 13
    assert [r.source_event_id for r in got[:3]] == ["entry:DOOR:id_token:a:2024-01-01T10:00:00.250000", "entry:DOOR:id_token:a:2024-01-01T10:00:00.750000", "entry:DOOR:id_token:b:2024-01-01T10:10:00"]
    assert [(r.source_event_id, r.abandoned, r.ts, r.queue_position, r.zone_type) for r in got[10:]] == [(f"queue:q{k}", k == 3, dt.datetime(2024, 1, 1, 10, 43), 2, "BILLING") for k in (1, 2, 3)]
    assert [r.is_face_hidden for r in got[:5]] == [False, False, False, True, None] and got[4].zone_type == "OTHER" and got[4].source_value == "1"
    bad = [queue("queue_completed", 1, "q", queue_join_ts=None), queue("queue_completed", 1, "q", queue_join_ts="soon"), queue("queue_completed", 1, "q", queue_exit_ts="later"), zone("zone_entered", 1, None)]
    errors = normalize.parse(spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(bad)], "value string, arrival long")).orderBy("arrival").collect()
    assert [r.error for r in errors] == ["missing queue_join_ts", "time is not valid", "time is not valid", "missing event_time"]


def correlated(spark, rows, sales, **flags):
    """Correlations of events (entity, type, second, fields) and sales (order, second)."""
    e = sessions.number_sessions(events(spark, rows))
    for name, column in flags.items():
        e = e.withColumn(name, column)
    sold = spark.createDataFrame([("S1", o, at(s)) for o, s in sales], "store_id string, order_id string, ts timestamp_ntz")
    who = entities(spark, v1="solo", v2="solo")
    found = pos.correlate(sold, sessions.visit_sessions(e), e, who)
    return e, sold, who, found


def test_purchases_match_as_stated(spark):
    """A match, no visitor, no purchase, two candidates, and a purchase far from the queue's end, in minutes of a day."""
    m = 60
    queued = lambda who, enter, done, leave: [(who, "entry", enter * m), (who, "queue_completed", done * m, {"queue": who}), (who, "exit", leave * m)]
    (r,) = correlated(spark, queued("v1", 0, 35, 40), [("o1", 37 * m)])[3].collect()
    assert (r.status, r.entity_id, r.method) == ("MATCHED", "v1", "queue_exit_time") and r.score >= 0.80
    (r,) = correlated(spark, [("s", "entry", 0)], [("o1", 0)])[3].where("order_id IS NOT NULL").collect()
    assert (r.status, r.entity_id, r.score, r.method) == ("UNMATCHED", None, 0.0, "no_eligible_visitor")
    (r,) = correlated(spark, [("v1", "entry", 0), ("v1", "exit", 30 * m)], [])[3].collect()
    assert (r.status, r.order_id, r.entity_id, r.method) == ("UNMATCHED", None, "v1", "no_eligible_transaction")
    rows = correlated(spark, queued("v1", 0, 35, 40) + queued("v2", 1, 35, 40), [("o1", 36 * m)])[3].collect()
    assert {(r.status, r.entity_id) for r in rows} == {("AMBIGUOUS", "v1"), ("AMBIGUOUS", "v2")}
    e, sold, who, found = correlated(spark, queued("v1", 0, 30, 45), [("close", 31 * m), ("far", 120 * m)])
    told = {r.order_id: r for r in pos.explanation(found, sold, sessions.visit_sessions(e), e, who).collect()}
    assert told["close"].score >= 0.55 and '"candidate_rank":1' in told["close"].explanation and told["far"].status == "UNMATCHED" and "no visitor candidate" in told["far"].explanation


def test_method_names_the_queue_however_far(spark):
    """The queue ended ten minutes before: it adds nothing to the score and is still the method. Abandoned completions do not count."""
    rows = [("v1", "entry", 0), ("v1", "queue_completed", 600, {"queue": "q"}), ("v1", "exit", 1205)]
    how = {"least": 0.45}
    for flag, method in ((F.lit(None).cast("boolean"), "session_exit_time"), (F.lit(True), "session_exit_time"), (F.lit(False), "queue_exit_time")):
        e, sold, who, _ = correlated(spark, rows, [("o", 1210)], abandoned=flag)
        (r,) = pos.correlate(sold, sessions.visit_sessions(e), e, who, **how).collect()
        assert (r.status, r.method) == ("MATCHED", method)


def test_replaced_correlations_keep_two_runs(spark, seed, tmp_path):
    import os

    path, cor = str(tmp_path / "cor"), seed[5]
    with pytest.raises(FileNotFoundError):
        pos.read_correlations(spark, path)
    for n in (0, 1, 2, 3):
        pos.replace_correlations(cor.limit(n), path)
        assert pos.read_correlations(spark, path).count() == n
    assert sorted(x for x in os.listdir(f"{path}/runs") if x.startswith("run")) == ["run=3", "run=4"]


def test_camera_configuration(spark):
    cameras = spark.createDataFrame([("c1", "BILLING", None), ("c2", "ENTRY", 5.0), ("c3", "OFFICE", None)], "camera_id string, role string, sample_fps double")
    cameras = cameras.selectExpr("*", "cast(null as double) confidence_threshold", "cast(null as int) queue_completion_seconds", "90 as queue_abandonment_seconds")
    square = '{"points": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}]}'
    kind = "camera_id string, zone_id string, geometry_kind string, geometry_json string, created_at int"
    coverage = [("c1", "z1", "polygon", square, 1), ("c1", "z2", "polygon", square, 2), ("c2", None, "line", '{"axis": "x", "position": 0.2}', 1), ("c2", None, "line", '{"axis": "y", "position": 0.4, "inside_greater_than_position": false}', 3)]
    zones = spark.createDataFrame([("z1", "Office", "STAFF_AREA"), ("z2", "Till", "BILLING")], "zone_id string, name string, type string")
    got = {r.camera_id: r for r in tracks.camera_configs(cameras, spark.createDataFrame(coverage, kind), zones).collect()}
    assert set(got) == {"c1", "c2"} and got["c1"].queue_zone_id == "z2" and [z.zone_id for z in got["c1"].zones] == ["z1", "z2"]
    assert tuple(got["c2"].entry_line) == ("y", 0.4, False) and (got["c2"].sample_fps, got["c1"].sample_fps, got["c1"].queue_completion_seconds, got["c1"].queue_abandonment_seconds) == (5.0, 2.0, 45, 90)
    with pytest.raises(Exception, match="unknown geometry kind: circle"):
        tracks.camera_configs(cameras, spark.createDataFrame([("c1", "z1", "circle", "{}", 1)], kind), zones).collect()


def test_maps_jobs_and_summaries(spark, tmp_path):
    maps = spark.createDataFrame([("S1", "m1", "a.png", True, 1), ("S1", "m2", "b.png", True, 2), ("S1", "m3", "c.png", False, 3), ("S2", "m4", "d.png", False, 1)], "store_id string, map_id string, file_path string, is_active boolean, created_at int")
    assert [tuple(r) for r in spatial.active_map(maps).collect()] == [("S1", "m2", "b.png")]
    jobs = spark.createDataFrame([("S1", f"j{k}", k // 2) for k in range(30)] + [("S2", "x", 99)], "store_id string, job_id string, created_at int")
    assert [r.job_id for r in replay.newest_jobs(jobs, "S1", 3).collect()] == ["j29", "j28", "j27"]
    feeds.write_summary(spark.createDataFrame([("S1", 3)], "store_id string, frames int"), str(tmp_path / "s"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "s")).select("store_id", "frames").collect()] == [("S1", 3)]


def test_several_people_in_a_frame(spark):
    rows = [("S", "C", "v", t, f) for t, f in (("a", 1), ("b", 1), ("b", 1), ("c", 1), ("a", 2), ("c", 3))]
    r = tracks.run_statistics(spark.createDataFrame(rows, "store_id string, camera_id string, video string, track_id string, frame int")).first()
    assert (r.frames, r.detections, r.max_people, r.unique_tracks) == (3, 6, 3, 3)


def test_heatmap_clamps(spark):
    got = spatial.heatmap(events(spark, [("a", "entry", 0, {"x": 1.5, "y": -1.0}), ("b", "entry", 0, {"x": 1.0, "y": 0.0}), ("c", "entry", 0, {"x": 0.5, "y": 0.5}), ("d", "entry", 0)])).collect()
    assert sorted((r.row, r.col, r["count"], r.intensity) for r in got) == [(0, 23, 2, 1.0), (12, 12, 1, 0.5)]


def test_trend_clusters(spark):
    names = "store_id string, footfall int, average_occupancy double, abandonment_rate double, mean_wait_seconds double, queue_terminals int"
    now, before = spark.createDataFrame([("S1", 40, 2.0, 0.5, 100.0, 9)], names), spark.createDataFrame([("S1", 100, 3.0, 0.1, 99.0, 9)], names)
    got = {(r.kind, r.severity, r.subject) for r in rules.trend_alerts(rules.trend_signals(now, before)).collect()}
    assert got == {("trend_traffic_decrease", "CRITICAL", "average_occupancy"), ("trend_queue_abandonment_rate_increase", "CRITICAL", None)}
    placed = {r.kind: r for r in rules.alerts(rules.trend_alerts(rules.trend_signals(now, before))).collect()}
    traffic, queue = placed["trend_traffic_decrease"], placed["trend_queue_abandonment_rate_increase"]
    assert (traffic.place, queue.place) == (1, 2)
    assert traffic.message == "Footfall decreased by 60.0% (100 → 40) compared with the previous equivalent period."
    assert traffic.related == "Average occupancy also decreased over the same period (3.00 → 2.00)." and queue.related is None
    assert queue.message == "Queue abandonment rate increased by 40.0 percentage points compared with the previous equivalent period (10.0% → 50.0%)."


def test_trends_of_one_severity_keep_the_order_of_their_metrics(spark):
    names = "store_id string, footfall int, average_occupancy double, abandonment_rate double, mean_wait_seconds double, queue_terminals int"
    now, before = spark.createDataFrame([("S1", 60, 2.9, 0.1, 131.5, 9)], names), spark.createDataFrame([("S1", 100, 2.9, 0.1, 100.0, 9)], names)
    got = rules.alerts(rules.trend_alerts(rules.trend_signals(now, before))).orderBy("place").collect()
    assert [(r.kind, r.severity) for r in got] == [("trend_footfall_decrease", "WARN"), ("trend_average_queue_wait_seconds_increase", "WARN")]
    assert got[1].message == "Average queue wait time increased by 31.5% (100s → 132s) compared with the previous equivalent period."
    assert got[1].action == rules.ACTIONS["queue_health"] and got[0].action == rules.ACTIONS["traffic_decrease"]


def test_insight_texts(spark):
    kind = "store_id string, average_queue_wait_seconds double, queue_abandonment_rate double, queue_visit_count long, conversion_rate double, has_pos_data boolean, total_visitors long, unique_visitors long, solo_visitors long, staff_visitors long, attributed_transactions long, attributed_revenue double"
    m = spark.createDataFrame([("S1", 125.0, 0.15, 4, 0.05, True, 20, 8, 4, 2, 2, 1001.0)], kind)
    dwell = spark.createDataFrame([("S1", "Z1", 8, 2400, 300.0), ("S1", "Z2", 1, 10, 10.0)], "store_id string, zone_id string, visits long, total_dwell_seconds long, average_dwell_seconds double")
    got = rules.insights(rules.store_insights(m), rules.zone_insights(m, dwell), rules.opportunity_zones(dwell, m)).orderBy("place").collect()
    assert [(r.severity, r.category, r.title) for r in got] == [
        ("HIGH", "Conversion", "Low Conversion Store"), ("MEDIUM", "Revenue", "Revenue Opportunity Zone: Z1"), ("MEDIUM", "Visitor", "High Group Traffic"), ("MEDIUM", "Visitor", "High Staff-To-Customer Ratio"),
        ("MEDIUM", "Zone", "High Dwell Zone: Z1"), ("MEDIUM", "Zone", "Hot Zone: Z1"), ("LOW", "Queue", "Long Queue Wait Time"), ("LOW", "Queue", "Queue Abandonment Watch"), ("LOW", "Revenue", "High-Value Transaction Mix"), ("LOW", "Zone", "Dead Zone: Z2")]
    said = {r.title: r.message for r in got}
    assert said["Long Queue Wait Time"] == "Average queue wait is 2m 5s, above the 2 minute action threshold. Based on only 4 completed or abandoned queue visit(s) -- too few to act on yet."
    assert said["High-Value Transaction Mix"] == "Average attributed transaction value is INR 500."
    assert said["Revenue Opportunity Zone: Z1"] == "Z1 has 5m average dwell but store conversion is 5%."
    assert said["Dead Zone: Z2"] == "Z2 has only 1 dwell visits compared with an average of 4.5."


def test_empty_tables(spark):
    none = events(spark, []).withColumn("session_no", F.lit(0).cast("long"))
    who = entities(spark)
    assert metrics.zone_dwell(none, who).count() == 0 and sessions.visit_sessions(none).count() == 0 and spatial.heatmap(none).count() == 0


def test_groups_leave_out_staff_and_source_groups(spark):
    """Flagged or inferred staff and visitors with a group of their source form no group; an inferred group counts as none."""
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("S1", who, 0, t(k), t(900 + k), 900, ["Z1"], [(0.5, 0.5)]) for k, who in enumerate(("a", "b", "flagged", "inferred", "sourced", "again"))]
    profile = spark.createDataFrame(rows, "store_id string, entity_id string, session_no long, entry_time timestamp_ntz, end_time timestamp_ntz, duration long, zones array<string>, spots array<struct<x: double, y: double>>")
    entities = spark.createDataFrame([("S1", "a", False, None), ("S1", "b", None, None), ("S1", "flagged", True, None), ("S1", "inferred", False, None), ("S1", "sourced", False, "G7"), ("S1", "again", False, "S1-GROUP-004")], "store_id string, entity_id string, is_staff boolean, group_id string")
    staff = spark.createDataFrame([("S1", "inferred", True), ("S1", "a", False)], "store_id string, entity_id string, is_staff boolean")
    got = people.infer_groups(people.group_pairs(people.groupable(profile, entities, staff))).collect()
    assert {(r.entity_id, r.group_id, r.group_size) for r in got} == {(x, "S1-GROUP-001", 3) for x in ("a", "again", "b")}


def test_chain_of_groups(spark):
    """A thousand visits, each near the next only, settle without a limit of rounds."""
    pairs = spark.createDataFrame([("S", f"v{k:04d}", 0, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), f"v{k + 1:04d}", 0, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k + 1)) for k in range(1000)], PAIR)
    got = people.infer_groups(pairs, rows=300).collect()
    assert len(got) == 1000 and all(r.group_size == 2 for r in got)


def test_series_need_an_end_after_the_start(spark):
    from shopweave.operators import live

    stores, at = spark.createDataFrame([("S1",)], "store_id string"), live.instant
    assert live.spine(stores, at("2024-01-01 00:00:00"), at("2024-01-01 02:00:00"), 60).count() == 2
    for end in ("2024-01-01 00:00:00", "2023-12-31 23:00:00"):
        with pytest.raises(Exception, match="end must come after the start"):
            live.spine(stores, at("2024-01-01 00:00:00"), at(end), 60).collect()
    with pytest.raises(ValueError):
        live.spine(stores, at("2024-01-01 00:00:00"), at("2024-01-01 02:00:00"), 0)


def test_sales_rows_are_numbered_over_splits(spark, tmp_path):
    head = "order_id,order_date,order_time,store_id,product_id,brand_name,total_amount\n"
    for name, first, n in (("a.csv", 1, 300), ("b.csv", 301, 40)):
        (tmp_path / name).write_text(head + "".join(f"O{k},01-01-2024,10:00:00,ST1,p,,1.0\n" for k in range(first, first + n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = feeds.read_pos(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert {(r.order_id, r.row_no) for r in rows.collect()} == {(f"O{k}", k) for k in range(1, 341)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_archive_and_snapshots(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("S1", '{"event_type": "zone_entered", "event_time": "2024-01-01T09:00:00Z"}', t(12)), ("S1", "no json", t(11)), ("S1", '{"event_type": "exit", "event_timestamp": "2024-01-01T08:00:00Z"}', t(13)), ("S2", "{}", t(1)),
            ("S1", '{"event_type": "ENTRY", "timestamp": "soon"}', t(10)), ("S1", '{"event_type": "queue_completed", "event_time": "2024-01-01T01:00:00", "queue_join_ts": "2024-01-01T02:00:00", "queue_exit_ts": "2024-01-01T08:30:00"}', t(14))]
    spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, store_id string, payload_json string, received_at timestamp").write.parquet(str(tmp_path / "raw"))
    hours = lambda **how: [r.arrival.hour for r in feeds.read_archive(spark, str(tmp_path / "raw"), "S1", **how).collect()]
    assert hours() == [13, 14, 12, 10, 11]
    # Both ends of a range are inside; receipts without a time are in every range.
    assert hours(start=F.lit(t(8)).cast("timestamp_ntz"), end=F.lit(dt.datetime(2024, 1, 1, 8, 30)).cast("timestamp_ntz")) == [13, 14, 10, 11]
    assert hours(ids=spark.createDataFrame([(0,), (1,), (3,)], "id long")) == [12, 11]
    (tmp_path / "snaps.jsonl").write_text('{"store_id":"S","camera_id":"C","video_path":"v","track_id":"2","frame_index":5}\n{"store_id":"S","camera_id":"C","video_path":"v","track_id":"1","frame_index":3}\n{"broken"\n')
    assert [r.frame_index for r in feeds.read_snapshots(spark, str(tmp_path / "snaps.jsonl")).collect()] == [3, 5]


def test_newest_candidates_first(spark):
    rows = [("S1", "A", "B", "x", "y", True, dt.datetime(2024, 1, 1)), ("S1", "A", "B", "x", "z", True, dt.datetime(2024, 1, 2)), ("S1", "A", "B", "x", "w", False, dt.datetime(2024, 1, 3)), ("S2", "A", "B", "x", "w", True, dt.datetime(2024, 1, 4))]
    df = spark.createDataFrame(rows, "store_id string, from_camera_id string, to_camera_id string, entity_a string, entity_b string, accepted boolean, evaluated_at timestamp_ntz")
    assert [r.entity_b for r in people.list_candidates(df, "S1").collect()] == ["w", "z", "y"]
    assert [r.entity_b for r in people.list_candidates(df, "S1", accepted=True).collect()] == ["z", "y"]


def test_event_uuids(spark):
    import uuid

    rows = [("S", "C", "v", "t1", 7, dt.datetime(2024, 1, 1), "entry")]
    got = tracks.event_ids(spark.createDataFrame(rows, "store_id string, camera_id string, video string, track_id string, frame int, ts timestamp_ntz, event_type string")).first()
    assert got.source_event_id == str(uuid.uuid5(uuid.UUID(tracks.NAMESPACE), "\x1f".join(["S", "C", "v", "entry", "t1", "7"])))
