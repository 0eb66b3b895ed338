"""Line dedup over levelled, sorted runs of line hashes.

:class:`LineRuns` keeps, for every line key seen so far, in how many documents it was
found. A batch of documents becomes one run: its keys are counted, keys that the stored
runs already prove common are merge-anti-joined away, and the rest is written sorted by
hash. ``fanout`` runs of a level are compacted into one run of the next. Runs are Parquet
files in the shared folder, so a lost executor costs a task and a new batch costs its own size.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import children
from .common import materialize, new_path, to_arrow

#: What a line's key is stripped of at both ends (fixed by the contract).
BLANK = b" \t\n\x0b\x0c\r"
#: Common keys that may be broadcast (16 bytes each); beyond that they are joined.
BROADCAST_KEYS = 100_000


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and each line's 16-byte key hash (empty for a blank line)."""
    lines = (text or "").encode().split(b"\n")
    keys = [line.strip(BLANK).lower() for line in lines]  # bytes.lower() folds A-Z only
    return lines, [xxhash.xxh3_128_digest(k) if k else b"" for k in keys]


def line_counts(docs: DataFrame, text_col: str = "text", batches: int = 1) -> DataFrame:
    """(batch, key, n): in how many rows of each batch of ``docs`` each non-blank line key is found.

    Rows are dealt to batches by the hash of their text. Counts are partial: a key may have several rows.
    """

    def count(rows):
        schema = pa.schema([("batch", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])
        for batch in rows:
            seen: Counter = Counter()
            for text, number in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen.update((number, key) for key in set(line_keys(text.as_py())[1]) if key)
            yield to_arrow(schema, [k[0] for k in seen], [k[1] for k in seen], list(seen.values()))

    number = F.pmod(F.xxhash64(text_col), F.lit(batches)).cast("int")
    return docs.select(text_col, number).mapInArrow(count, "batch int, key binary, n long")


class LineRuns:
    """Sorted runs on levels; ``levels[k]`` lists level k's runs.

    All runs lie in one table, bucketed and sorted by key, a partition a run: runs meet each other and a new
    batch bucket by bucket, by merges of what is sorted already, and no stored run is ever shuffled again.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []
        self.path = new_path(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, runs: Iterable[str]) -> str:
        """A name in this session for some of the runs."""
        name = f"line_runs_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (key binary, n bigint, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        made = set(children(self.spark, self.path))
        parts = [f"PARTITION (run = '{r}')" for r in runs if f"run={r}" in made]  # a run without keys has no folder
        if parts:
            self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(parts)}")
        return name

    def _write(self, counts: DataFrame, level: int) -> None:
        run = f"{level}-{uuid.uuid4().hex}"
        counts.select("key", "n").repartition(self.buckets, "key").withColumn("run", F.lit(run)).write.insertInto(self._table([]))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _read(self, runs: Iterable[str]) -> DataFrame:
        return self.spark.table(self._table(runs)).select("key", "n")

    def counts(self) -> DataFrame:
        """(key, n) over all runs."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "key binary, n long")
        return self._read(runs).groupBy("key").agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """Keys found in ``min_docs`` documents or more."""
        return self.counts().where(F.col("n") >= self.min_docs).select("key")

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Add a batch of documents as a run."""
        self.add_counts(line_counts(docs, text_col))

    def add_counts(self, counts: DataFrame) -> None:
        """Add a batch's (key, n): leave out keys already common, write a run, compact full levels."""
        counts = counts.groupBy("key").agg(F.sum("n").alias("n"))
        if any(self.levels):
            counts = counts.join(self.common().hint("merge"), "key", "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(self._read(runs).groupBy("key").agg(F.sum("n").alias("n")), level + 1)
            level += 1


def _cut(batches, names: list[str], text_col: str, hot_of):
    """Batches with the common lines gone; ``hot_of(batch)`` gives each row's set of common keys."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, hot in zip(batch.column(text_col), hot_of(batch), strict=True):
            lines, keys = line_keys(text.as_py())
            kept = [line for line, key in zip(lines, keys, strict=True) if key not in hot]
            texts.append(b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        done = {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        yield pa.RecordBatch.from_arrays([done.get(c, batch.column(c) if c in batch.schema.names else None) for c in names], names=names)


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batches: int = 4, fanout: int = 4, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with all lines gone whose key is in ``min_docs`` rows or more.

    Adds ``n_lines`` (before) and ``n_dropped``; columns of those names are replaced.
    ``docs`` goes through :class:`LineRuns` in ``batches`` batches. A null or empty text has
    one empty line, which stays. Repeated ids are separate documents. Blank lines stay.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    counts = materialize(line_counts(docs, text_col, batches), "line-counts")  # the texts are read once for all batches
    for k in range(batches):
        runs.add_counts(counts.where(F.col("batch") == k))
    common = runs.common()
    fields = [f for f in docs.schema if f.name not in ("n_lines", "n_dropped")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    base = docs.select(*names)
    known = common.limit(broadcast_keys + 1).collect()
    if len(known) <= broadcast_keys:
        sent = spark.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in known))
        return base.mapInArrow(lambda it: _cut(it, schema.names, text_col, lambda b: [sent.value] * b.num_rows), schema)

    def keyed(it):
        kind = pa.schema([("_id", pa.string()), ("key", pa.binary())])
        for batch in it:
            pairs = [(i.as_py(), key) for i, text in zip(batch.column(0), batch.column(1), strict=True) for key in set(line_keys(text.as_py())[1]) if key]
            yield to_arrow(kind, [p[0] for p in pairs], [p[1] for p in pairs])

    # A key's fate is the same in every document, so rows that share an id may share their keys; rows without an id
    # are told apart by a hash of their text, else one key would hold all of theirs.
    own_id = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.xxhash64(text_col).cast("string"))
    rows = base.select(own_id.alias("_id"), text_col)
    hot = rows.mapInArrow(keyed, "_id string, key binary").join(common, "key", "left_semi").groupBy("_id").agg(F.collect_set("key").alias("_hot"))
    # The columns of ``docs`` are set apart in a struct: none can clash with the join's own.
    packed = base.select(F.struct(*names).alias("_row"), own_id.alias("_own"))
    joined = packed.join(hot, F.col("_own").eqNullSafe(F.col("_id")), "left").select("_row", "_hot")

    def unpacked(it):
        for batch in it:
            own = pa.RecordBatch.from_struct_array(batch.column(0))
            yield from _cut([own], schema.names, text_col, lambda _, hot=batch.column(1): [frozenset(x.as_py() or ()) for x in hot])

    return joined.mapInArrow(unpacked, schema)
