"""The stored fact table: bucketed by entity, appended by segments, read by versions.

Rows lie in ``buckets`` buckets of (store_id, entity_id), so windows, aggregates and joins on an entity
need no shuffle. An append writes a segment (a folder, bucketed like the others) and then a manifest that
lists the segments of the new version; only listed segments are read, so an append that crashed leaves
nothing behind that counts, and running it again adds what is missing. The keys of stored events are kept
apart, bucketed by (store_id, source_event_id): an append looks its keys up there and shuffles only itself.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sessions
from .storage import children, create_text, read_text, remove

ENTITY, KEY = ("store_id", "entity_id"), ("store_id", "source_event_id")
#: Segments beyond which an append merges them all into one.
SEGMENTS = 16


class FactTable:
    """Events in the folder ``path`` of any store that Spark reads; one writer at a time succeeds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, *, buckets: int = 64) -> FactTable:
        """A new, empty table. ``schema`` has store_id, entity_id and source_event_id; more buckets suit more data."""
        missing = {*ENTITY, *KEY} - set(schema.names)
        if missing:
            raise ValueError(f"a fact table needs {', '.join(sorted(missing))}")
        table = cls(spark, path)
        table._commit({"version": 0, "buckets": buckets, "schema": json.loads(schema.json()), "segments": []})
        return table

    # --- versions ---

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in children(self.spark, f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; the last one's by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(self.path)
        return json.loads(read_text(self.spark, f"{self.path}/manifests/{known[-1] if version is None else version}.json"))

    def _commit(self, manifest: dict) -> None:
        """Fails if another writer has made the same version: its rows would be lost."""
        create_text(self.spark, f"{self.path}/manifests/{manifest['version']}.json", json.dumps(manifest))

    # --- reading ---

    def _table(self, kind: str, manifest: dict, segments: list[str]) -> str:
        """The session's name for ``segments`` of a folder; as segments never change, a name stands for the same rows for good."""
        schema = self._schema(kind, manifest)
        name = f"shopweave_{kind}_{hashlib.md5('|'.join([self.path, schema.json(), str(manifest['buckets']), *segments]).encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            by = ", ".join(ENTITY if kind == "events" else KEY)
            made = set(children(self.spark, f"{self.path}/{kind}")) if segments else set()
            parts = [f"PARTITION (`segment` = '{s}')" for s in segments if f"segment={s}" in made]  # without rows there is no folder
            self.spark.sql(f"CREATE TABLE {name} ({columns}, `segment` string) USING parquet PARTITIONED BY (`segment`) CLUSTERED BY ({by}) INTO {manifest['buckets']} BUCKETS LOCATION '{self.path}/{kind}'")
            if parts:
                self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(parts)}")
        return name

    @staticmethod
    def _schema(kind: str, manifest: dict) -> T.StructType:
        schema = T.StructType.fromJson(manifest["schema"])
        return schema if kind == "events" else T.StructType([schema[c] for c in KEY])

    def _read(self, kind: str, manifest: dict, segments: list[str]) -> DataFrame:
        return self.spark.table(self._table(kind, manifest, segments)).select(*self._schema(kind, manifest).names)

    def read(self, version: int | None = None) -> DataFrame:
        """The events of a version, the last one's by default."""
        manifest = self.manifest(version)
        return self._read("events", manifest, manifest["segments"])

    # --- writing ---

    def _write(self, events: DataFrame, manifest: dict, segment: str) -> None:
        """One task a bucket, so a bucket has one file in the segment."""
        rows = events.select(*[F.col(f.name).cast(f.dataType) for f in self._schema("events", manifest)])
        for kind, by in (("events", ENTITY), ("keys", KEY)):
            source = rows if kind == "events" else self._read("events", manifest, [segment]).select(*KEY)
            source.repartition(manifest["buckets"], *by).withColumn("segment", F.lit(segment)).write.insertInto(self._table(kind, manifest, [segment]))

    def append(self, events: DataFrame, *, arrival: str = "arrival") -> int:
        """Store the first arrival of each (store, source_event_id) that is not stored yet; the new version.

        ``events`` has ``arrival`` and the table's columns; others are left out. Where every key is stored
        already, nothing is written and the version stays.
        """
        old = self.manifest()
        fresh = sessions.first_arrivals(events, arrival=arrival)
        if old["segments"]:
            fresh = fresh.join(self._read("keys", old, old["segments"]), list(KEY), "left_anti")
        segment = uuid.uuid4().hex
        self._write(fresh, old, segment)
        if f"segment={segment}" not in children(self.spark, f"{self.path}/events"):
            return old["version"]
        new = old | {"version": old["version"] + 1, "segments": [*old["segments"], segment]}
        self._commit(new)
        return self.compact() if len(new["segments"]) > SEGMENTS else new["version"]

    def compact(self) -> int:
        """All segments as one; the new version. Rows stay as they are, and in their buckets."""
        old = self.manifest()
        segment = uuid.uuid4().hex
        self._write(self._read("events", old, old["segments"]), old, segment)
        new = old | {"version": old["version"] + 1, "segments": [segment]}
        self._commit(new)
        return new["version"]

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` versions, and segments that none of these has; no append may be running."""
        known = self.versions()
        remove(self.spark, *[f"{self.path}/manifests/{v}.json" for v in known[:-keep]])
        used = {s for v in known[-keep:] for s in self.manifest(v)["segments"]}
        for name in {n for kind in ("events", "keys") for n in children(self.spark, f"{self.path}/{kind}") if n.startswith("segment=")}:
            if name.removeprefix("segment=") not in used:
                self._drop(name.removeprefix("segment="))

    def _drop(self, segment: str) -> None:
        remove(self.spark, *[f"{self.path}/{kind}/segment={segment}" for kind in ("events", "keys")])
