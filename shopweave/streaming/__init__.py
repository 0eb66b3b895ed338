"""Streaming forms of the batch operators; each equals its batch operator on the same rows.

Structured Streaming takes event time as TIMESTAMP only, so naive UTC times are cast at the
source and back at the sink, under a UTC session.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators import normalize
from ..sources.storage import children, remove

LATE = "10 minutes"
#: Parts of the state that keys share, fixed for the life of a checkpoint; seconds of event time that held rows of a shard are stored by.
SHARDS, SLICE = 256, 600


def read_lines(spark: SparkSession, path: str, *, files_a_trigger: int = 64) -> DataFrame:
    """STR-1: JSON lines of new files as (value, arrival).

    A stream numbers no lines, so lines of one block of a file share their arrival: the file's time, name and block.
    """
    text = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path)
    return text.select("value", F.struct(*[F.col(f"_metadata.{c}").alias(n) for c, n in (("file_modification_time", "time"), ("file_path", "file"), ("file_block_start", "block"))]).alias("arrival"))


def parsed(lines: DataFrame) -> DataFrame:
    """STR-1: the ingest expressions of the batch job; stateless."""
    return normalize.parse(lines)


def timed(events: DataFrame, *, late: str = LATE) -> DataFrame:
    """Event time as TIMESTAMP with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def first_arrivals(events: DataFrame, *, key: str = "source_event_id", late: str = LATE) -> DataFrame:
    """STR-2: repeats of a key within the watermark go; older ones are left to the batch anti join."""
    return timed(events, late=late).dropDuplicatesWithinWatermark(["store_id", key])


def hourly_counts(events: DataFrame, *, width: str = "1 hour", late: str = LATE, start: str = "0 seconds") -> DataFrame:
    """STR-3: entries and queue events by tumbling window, final once the watermark has passed."""
    kinds = {"entries": "entry", "joined": "billing_queue_join", "completed": "queue_completed", "abandoned": "queue_abandoned"}
    counts = timed(events, late=late).groupBy("store_id", F.window("ts", width, startTime=start)).agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(n) for n, k in kinds.items()])
    return counts.select("store_id", F.col("window.start").cast("timestamp_ntz").alias("bucket_start"), *kinds)


class LateRows(StreamingQueryListener):
    """Counts, for each query of the session, the rows that windows and deduplication dropped behind the watermark.

    ``spark.streams.addListener(late := LateRows())``, then ``late.rows[query.id]``; a query without any has 0. Spark
    counts rows after its partial aggregation, so several late rows of one window and task count once.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        dropped = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + dropped

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class InEventTime(StatefulProcessor):
    """Holds the rows of keys until the watermark passes them, then takes each key's rows in event time.

    ``step(own, row) -> (own, outputs)``: ``own`` is the key's own state, ``row`` (time in microseconds, *columns).
    Keys share a shard, whose state is told apart by key and time: rows wait in parts, one a trigger and slice of time,
    with one timer a shard at the least time that waits. So a trigger touches the rows that come, the slices that fall
    due and the keys in them, and no others; calls to the store grow with parts and due keys instead of rows. Rows that
    come after the watermark has passed them are dropped and counted: each output tells how many its key has lost so
    far. A key without rows for ``idle`` seconds of event time gives ``finish(own)`` and is forgotten.
    """

    def __init__(self, out: list[str], keys: list[str], columns: list[str], own: str, step, start: tuple, finish, idle: int):
        self.out, self.keys, self.columns, self.kind_of_own = out, keys, columns, own
        self.step, self.start, self.finish, self.idle = step, start, finish, idle * 1000000
        self.widths = {"held": SLICE * 1000000, "ends": max(self.idle // 64, 1000000)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = {kind: handle.getMapState(kind, "slice long, part long", "items binary") for kind in self.widths}
        self.own = handle.getMapState("own", "key string", f"{self.kind_of_own}, late long, last long, listed long")
        self.saved = handle.getValueState("index", "index binary")

    # The shard's index: for each kind the slices with their least time and parts, the next part's number, the timer.
    def _load(self) -> None:
        self.index = pickle.loads(self.saved.get()[0]) if self.saved.exists() else {"held": {}, "ends": {}, "next": 0, "timer": None}

    def _save(self) -> None:
        """The index, with a timer for when the watermark has passed the least time that waits; nothing if nothing waits."""
        index, old = self.index, self.index["timer"]
        least = min((at for kind in self.widths for at, _ in index[kind].values()), default=None)
        index["timer"] = None if least is None else least // 1000 + 1
        if index["timer"] != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if least is not None:
                self.handle.registerTimer(index["timer"])
        if least is None:
            self.saved.clear()
        else:
            self.saved.update((pickle.dumps(index),))

    def _put(self, kind: str, items: list[tuple]) -> None:
        """Store items (time, key, ...) in a new part of each of their slices."""
        slices: dict = {}
        for item in items:
            slices.setdefault(item[0] // self.widths[kind], []).append(item)
        for number, own in slices.items():
            self.parts[kind].updateValue((number, self.index["next"]), (pickle.dumps(own),))
            entry = self.index[kind].setdefault(number, [own[0][0], []])
            entry[0] = min(entry[0], min(item[0] for item in own))
            entry[1].append(self.index["next"])
            self.index["next"] += 1

    def _items(self, kind: str, number: int) -> list[tuple]:
        return [item for part in self.index[kind][number][1] for item in pickle.loads(self.parts[kind].getValue((number, part))[0])]

    def _take(self, kind: str, mark: int) -> list[tuple]:
        """Remove and return the items up to ``mark``."""
        due, rest = [], []
        for number in [n for n, (least, _) in self.index[kind].items() if least <= mark]:
            for item in self._items(kind, number):
                (due if item[0] <= mark else rest).append(item)
            for part in self.index[kind].pop(number)[1]:
                self.parts[kind].removeKey((number, part))
        self._put(kind, rest)
        return due

    def _own(self, key: tuple) -> list:
        """[own, late, last, listed]: ``listed`` is the time at which the key is looked at for being idle."""
        found = self.own.getValue((json.dumps(key),))
        if found is None:
            return [list(self.start), 0, 0, 0]
        *own, late, last, listed = found
        return [own, late, last, listed]

    def _keep(self, key: tuple, own: list, late: int, last: int, listed: int) -> None:
        self.own.updateValue((json.dumps(key),), (*own, late, last, listed))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self._load()
        late: Counter = Counter()
        held: list[tuple] = []
        for pdf in rows:
            plain = lambda c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist()  # noqa: B023, E731
            who, what = zip(*[plain(c) for c in self.keys], strict=True), zip(*[plain(c) for c in self.columns], strict=True)
            for at, name, fields in zip(pdf["at"].tolist(), who, what, strict=True):
                if at <= mark:
                    late[name] += 1
                else:
                    held.append((int(at), name, fields))
        self._put("held", held)
        ends = []
        for name, n in late.items():
            own, before, last, listed = self._own(name)
            if not listed:  # perhaps only late rows so far: the key is forgotten like others
                listed = mark + self.idle
                ends.append((listed, name))
            self._keep(name, own, before + n, last, listed)
        self._put("ends", ends)
        self._save()
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self._load()
        self.index["timer"] = None
        known: dict = {}
        made: list = []
        for at, name, fields in sorted(self._take("held", mark), key=lambda item: (item[0], item[2])):
            state = known[name] = known.get(name) or self._own(name)
            state[0], out = self.step(state[0], (at, *fields))
            state[2] = max(state[2], at)
            made += [(*name, *m, state[1]) for m in out]
        for at, name in self._take("ends", mark):
            state = known.get(name) or self._own(name)
            if state[3] == at:  # else the key was forgotten since, and perhaps came again
                state[3] = 0
                known[name] = state
        idle = {name for name, (_, _, last, _) in known.items() if mark >= (last or mark) + (self.idle if last else 0)}
        waiting = {item[1] for number in self.index["held"] for item in self._items("held", number)} if idle else set()
        ends = []
        for name, state in known.items():
            own, late, last, listed = state
            if name in idle and name not in waiting:
                made += [(*name, *m, late) for m in (self.finish(own) if last else [])]
                self.own.removeKey((json.dumps(name),))
                continue
            if not listed:
                state[3] = mark + self.idle if name in idle else last + self.idle
                ends.append((state[3], name))
            self._keep(name, *state)
        self._put("ends", ends)
        self._save()
        if made:
            yield pd.DataFrame(made, columns=self.out)

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, keys: list[str], columns: dict[str, str], out: str, own: str, step, start: tuple, *, idle: int, finish=lambda own: []) -> DataFrame:
    """State of shards of keys in RocksDB, which transformWithState needs; the session is told so."""
    spark, rocks = events.sparkSession, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", rocks)
    out = f"{out}, late_rows long"
    names = [c.split()[0] for c in out.split(", ")]
    processor = InEventTime(names, keys, list(columns), own, step, start, finish, idle)
    shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int").alias("shard")
    rows = events.select(shard, *keys, "ts", F.unix_micros("ts").alias("at"), *[F.col(n).cast(t) for n, t in columns.items()])
    return rows.groupBy("shard").transformWithStateInPandas(processor, out, "append", "eventTime")


def visits(events: DataFrame, *, late: str = LATE, idle: int = 365 * 86400) -> DataFrame:
    """STR-4: completed visits of each entity, with the previous exit; rows wait for the watermark and are sorted.

    An entity is forgotten ``idle`` seconds after its last event, when no visit can be a re-entry any more;
    its visits are then numbered from 0 again.
    """

    def step(own, row):
        number, entry, last_exit = own
        at, _, kind = row
        entry = at if entry is None else entry
        if kind != "exit":
            return [number, entry, last_exit], []
        return [number + 1, None, at], [(number, entry, at, (at - entry) // 1000000, last_exit)]

    out = "store_id string, entity_id string, session_no long, entry_us long, exit_us long, dwell_seconds long, previous_exit_us long"
    own = "number long, entry long, last_exit long"
    return _stateful(timed(events, late=late), ["store_id", "entity_id"], {"event_id": "long", "event_type": "string"}, out, own, step, (0, None, None), idle=idle)


def queue_states(events: DataFrame, *, late: str = LATE, idle: int = 86400) -> DataFrame:
    """STR-5: for each queue visit, its first join (open) and its first terminal (closed), in event time.

    A queue visit is forgotten ``idle`` seconds after its last event.
    """

    def step(own, row):
        joined, ended = own
        at, _, kind = row
        if kind == "billing_queue_join" and joined is None:
            return [at, ended], [("open" if ended is None else "closed", at)]
        if kind in ("queue_completed", "queue_abandoned") and ended is None:
            return [joined, at], [("closed", at)]
        return [joined, ended], []

    chosen = timed(events, late=late).where(F.col("queue_event_id").isNotNull() & F.col("event_type").isin("billing_queue_join", "queue_completed", "queue_abandoned"))
    out = "store_id string, queue_event_id string, state string, at_us long"
    return _stateful(chosen, ["store_id", "queue_event_id"], {"event_id": "long", "event_type": "string"}, out, "joined long, ended long", step, (None, None), idle=idle)


def zone_visits(hits: DataFrame, *, grace: int = 0, late: str = LATE, idle: int = 3600) -> DataFrame:
    """STR-6: visits of tracks in zones; ``hits``: store_id, track_id, zone_id, frame, ts, inside.

    A track unseen for ``idle`` seconds has ended: a visit that is still open ends at its first sighting
    outside, or else at its last one inside, as at the end of a recorded feed.
    """

    def step(own, row):
        entered, last_in, left = own
        at, _, inside = row
        if inside:
            return [at if entered is None else entered, at, None], []
        if entered is None:
            return own, []
        left = at if left is None else left
        if at - last_in >= grace * 1000000:
            return [None, None, None], [(entered, last_in, left)]
        return [entered, last_in, left], []

    def finish(own):
        entered, last_in, left = own
        return [] if entered is None else [(entered, last_in, last_in if left is None else left)]

    kind = "store_id string, track_id string, zone_id string, enter_us long, last_inside_us long, exit_us long"
    return _stateful(timed(hits, late=late), ["store_id", "track_id", "zone_id"], {"frame": "long", "inside": "boolean"}, kind, "entered long, last_in long, out_since long", step, (None, None, None), idle=idle, finish=finish)


def track_feed(events: DataFrame, path: str, checkpoint: str):
    """STR-7: the latest event of each store, merged with every batch into a new version of a small table.

    A batch that runs again overwrites its own version only, made from the one before it, so a crash
    at any point leaves a whole table; :func:`read_feed` reads the last version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("store_id").agg(F.max("ts").alias("last_event"))
        old = _last_version(spark, path, below=number)
        if old is not None:
            new = new.unionByName(old).groupBy("store_id").agg(F.max("last_event").alias("last_event"))
        new.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")  # a row a store, in one file
        # The version before stays for readers that have begun, and for this batch should it run again.
        remove(spark, *[f"{path}/{n}" for n in children(spark, path) if n.startswith("version=") and int(n.split("=")[1]) < number - 1])

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _last_version(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:  # before the first batch there is no table
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    table = table if below is None else table.where(F.col("version") < below)
    last = table.agg(F.max("version")).first()[0]
    return None if last is None else table.where(F.col("version") == last).drop("version")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(store_id, last_event) as of the last batch; fails before the first one."""
    found = _last_version(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return found
