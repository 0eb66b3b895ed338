"""Correlations against every pair of a purchase and a visit, and what grows with crowds."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from shopweave.operators import pos

T0 = dt.datetime(2024, 1, 1, 9)
VISITS = "store_id string, entity_id string, session_no long, entry_time timestamp_ntz, exit_time timestamp_ntz, queue_time timestamp_ntz, queue_abandoned boolean"
SALES = "store_id string, order_id string, ts timestamp_ntz"


def after(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def crowd(visits, sales, *, seed=3, span=9000, fraction=1):
    """Visits and sales at random; some sales share an order, one has no time, one store has no visit."""
    rng = random.Random(seed)
    people, sold = [], [("S1", "none", None), ("S9", "O1", after(5))]
    for k in range(visits):
        entry = rng.randint(0, span * fraction) / fraction
        left = entry + rng.randint(0, 3000 * fraction) / fraction if rng.random() < 0.9 else None
        queue = entry + rng.randint(0, 2500 * fraction) / fraction if rng.random() < 0.7 else None
        people.append((f"S{k % 2}", f"E{k % 50}", k, after(entry), after(left), after(queue), rng.random() < 0.3))
    for k in range(sales):
        sold.append((f"S{k % 2}", f"O{k if k % 10 else k // 40}", after(rng.randint(0, span * fraction) / fraction)))
    return people, sold


def score(at, entry, left, queue, lost):
    gap = lambda a, b: int(abs((a - b).total_seconds()))
    near = lambda there, window: 0.0 if there is None or gap(at, there) > window else 1.0 - gap(at, there) / window
    last = left or entry
    outside = gap(entry, at) if at < entry else gap(at, last) if at > last else 0
    raw = 0.20 + 0.45 * near(queue, 600) + 0.25 * near(left, 1200) + 0.10 * (1.0 - outside / 2700 if outside <= 2700 else 0.0) - (0.20 if lost else 0.0)
    return math.floor(max(0.0, min(1.0, raw)) * 10000 + 0.5) / 10000


def expected(people, sold, least=0.55, margin=0.10):
    by, out, used = {}, set(), set()
    for store, order, at in sold:
        by.setdefault((store, order), []).extend((score(at, *v[3:]), v) for v in people if v[0] == store and at is not None)
    for (store, order), pairs in by.items():
        best = max((s for s, _ in pairs), default=0)
        kept = sorted(((-s, v[3], v[1], v[2], v[5]) for s, v in pairs if best >= least and best - s <= margin + 1e-9), key=lambda x: x[:4])
        used |= {(store, *x[2:4]) for x in kept}
        out |= {(store, order, x[2], x[3], "MATCHED" if len(kept) == 1 else "AMBIGUOUS", -x[0], "session_exit_time" if x[4] is None else "queue_exit_time", len(kept), n) for n, x in enumerate(kept, 1)}
        if not kept:
            out.add((store, order, None, None, "UNMATCHED", 0.0, "no_eligible_visitor", 0, 0))
    return out | {(v[0], None, v[1], v[2], "UNMATCHED", 0.0, "no_eligible_transaction", 0, 0) for v in people if v[:3] not in used}


@pytest.fixture
def given(spark, monkeypatch):
    """Correlations of visits whose queues are known."""
    monkeypatch.setattr(pos, "eligible_visits", lambda visits, events, entities: visits)
    return lambda people, sold: (spark.createDataFrame(sold, SALES), spark.createDataFrame(people, VISITS), None, None)


@pytest.mark.parametrize(("visits", "sales", "fraction", "limits"), [(30, 60, 1, {}), (300, 120, 1, {"rows": 40, "moments": 7}), (120, 80, 4, {})])
def test_correlations_equal_all_pairs(given, monkeypatch, visits, sales, fraction, limits):
    """Sparse, crowded and cut into groups, and with fractions of a second."""
    near = pos._near
    monkeypatch.setattr(pos, "_near", lambda *a, **k: near(*a, **k, **limits))
    people, sold = crowd(visits, sales, fraction=fraction)
    want = expected(people, sold)
    assert {tuple(r) for r in pos.correlate(*given(people, sold)).collect()} == want
    found = [tuple(r) for r in pos.matches(*given(people, sold)).collect()]
    assert set(found) == {r for r in want if r[4] == "MATCHED"} and len(found) == len(set(found))


def test_purchases_of_a_moment_are_worked_out_once(given, monkeypatch):
    """40 orders of one moment and 30 visits: 1,200 rows come from 30 stored ones; none is stored where only matches are asked for."""
    people = [("S1", f"E{k}", 0, after(0), after(600), after(590), False) for k in range(30)]
    sold = [("S1", f"O{k}", after(600)) for k in range(40)]
    stored, keep = {}, pos.materialize
    monkeypatch.setattr(pos, "materialize", lambda df, name: (out := keep(df, name), stored.update({name: out.count()}))[0])
    assert pos.correlate(*given(people, sold)).count() == 1200 and stored["matches"] == 30
    stored.clear()
    assert pos.matches(*given(people, sold)).count() == 0 and max(stored.values()) <= 30
