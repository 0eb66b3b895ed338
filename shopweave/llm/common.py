"""Helpers that the training-data operators share.

Text reaches Python as Arrow batches; :func:`text_buffer` views a batch's UTF-8 bytes
as one numpy array, so operators work on bytes without a Python object per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import materialize, new_path, shared_dir

__all__ = ["Adam", "held_out", "labelled_sample", "materialize", "new_path", "read_table", "row_chunks", "shared_dir", "sigmoid", "small_batches", "text_buffer", "to_arrow", "windows_of"]

#: Bytes of text that one vectorised step takes; a single longer text is taken alone.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """True for rows whose crc32 of the id's text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    n, (_, offsets, data) = len(column), column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay under ``limit``; every range has a row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def small_batches(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = 4 * CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut to about ``limit`` bytes of text, each with its bytes and offsets."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(text_col))
        for i, j in row_chunks(offsets, limit):
            part = batch.slice(i, j - i)
            yield part, *text_buffer(part.column(text_col))


def to_arrow(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in enumerate(columns)], schema=schema)


def windows_of(length: int, window: int, most: int | None = None) -> list[tuple[int, int]]:
    """Consecutive windows over ``length`` bytes; with ``most``, that many evenly spread ones."""
    count = max(1, -(-length // window))
    picked = range(count) if most is None or count <= most else sorted({k * (count - 1) // max(1, most - 1) for k in range(most)})
    return [(k * window, min(length, (k + 1) * window)) for k in picked]


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label: str, per_class: int, window: int, windows: int, classes: int = 1024) -> list[tuple[object, list[bytes]]]:
    """At most ``per_class`` documents of each label, each as at most ``windows`` byte windows.

    The ids are drawn by hash before any text is read: those of the ``per_class`` least hashes of each label, whatever
    the partitions are, so the driver gets ``classes * per_class * windows * window`` bytes at most. ``labels`` has
    ``id_col`` and ``label``; ids with conflicting or null labels are left out. Of several rows of one id, the one
    whose windows have the least hash is taken. More labels than ``classes`` raise ValueError: none is left out in
    silence.
    """
    clean = (labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
             .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y"))
    counts = {r["_y"]: r["n"] for r in clean.groupBy("_y").agg(F.count("*").alias("n")).limit(classes + 1).collect()}
    if len(counts) > classes:
        raise ValueError(f"{label} has more than {classes} values")
    if not counts:
        return []
    # A label's hashes are spread evenly over 64 bits: under this bound lie per_class of them and a margin of ten deviations.
    bound = F.lit(0).cast("long")
    for y, n in counts.items():
        share = min(1.0, (per_class + 10 * per_class**0.5 + 10) / n)
        bound = F.when(F.col("_y") == F.lit(y), F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))).otherwise(bound)
    drawn = clean.withColumn("_k", F.xxhash64("_id", F.lit(17))).where(F.col("_k") <= bound)
    least = Window.partitionBy("_y").orderBy("_k", "_id")
    drawn = drawn.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= per_class).drop("_n")

    def cut(batches):
        schema = pa.schema([("_id", "string"), ("_y", "string"), ("_k", pa.int64()), ("_w", pa.list_(pa.binary()))])
        for batch in batches:
            texts = batch.column(3)
            yield to_arrow(schema, batch.column(0), batch.column(1), batch.column(2), [[x[a:b] for a, b in windows_of(len(x), window, windows)] for x in ((t.as_py() or "").encode() for t in texts)])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(drawn), "_id").select(F.col("_id").cast("string"), F.col("_y").cast("string").alias("_y"), "_k", "_t")
    one = Window.partitionBy("_id").orderBy(F.xxhash64("_w"))
    rows = picked.mapInArrow(cut, "_id string, _y string, _k long, _w array<binary>").withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_id", "_y", "_k", "_w").collect()  # per_class a label at most
    kinds = {str(y): y for y in counts}
    found: dict[object, list] = {}
    for r in rows:
        found.setdefault(kinds[r["_y"]], []).append((r["_k"], r["_id"], [bytes(x) for x in r["_w"]]))
    return [(y, w) for y in sorted(found, key=str) for _, _, w in sorted(found[y])]  # by the ids' hash


class Adam:
    """Adam steps on a dict of numpy arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
