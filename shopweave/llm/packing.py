"""Sum-of-squares packing of token sequences.

A piece goes to the open sequence whose use leaves the squared counts of open sequences
per residual gap smallest: gaps that many sequences share are used up, gaps that few
share are spared. A new sequence is opened only for what fits nowhere. Pieces are dealt into groups of bounded size
that Spark packs apart, so no task holds more than a group; only a group's last sequences stay underfull.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches
from .tokens import encoder

#: Pieces of a group on average.
GROUP = 8192
#: Bytes of text that are encoded at once: the steps over its pieces hold some 30 times as much.
ENCODED = 1 << 20


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece; pieces are placed longest first, ties in the given order."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences per gap, 1 .. capacity - 1
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        # Change of the sum if gap g (size .. capacity) becomes g - size; gap 0 is closed.
        change = 2 * (counts[: capacity - size + 1] - counts[size:]) + 2
        change[0] = 1 - 2 * counts[size]
        change[none := counts[size:] == 0] = np.iinfo(np.int64).max
        g = capacity if none.all() else size + int(change.argmin())  # a new one only if it fits nowhere
        if g == capacity:
            own, made = made, made + 1
        else:
            own = open_at[g].pop()
            counts[g] -= 1
        out[k] = own
        if g > size:
            open_at[g - size].append(own)
            counts[g - size] += 1
    return out


def token_pieces(docs: DataFrame, path: str, *, kind: str = "word", end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids, then ``end_id``, cut at ``capacity``.

    Null texts count as empty. Only longer documents are cut. ``ids`` are little-endian uint32.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")], *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches):
        enc = encoder(path, kind)
        for batch, data, at in small_batches(batches, text_col, ENCODED):
            ids, ends = enc.ended(data, at, end_id)
            size = np.diff(ends)
            pieces = -(-size // capacity)
            own = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[own] - start, capacity)
            raw, first = memoryview(ids.astype("<u4")), ends[own] + start
            parts = [raw[i : i + n] for i, n in zip(first.tolist(), length.tolist(), strict=True)]
            cols = [(piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (list(map(zlib.crc32, parts)), pa.int64()), *([([p.tobytes() for p in parts], pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(own)), *[pa.array(c, t) for c, t in cols]], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(pieces: DataFrame, *, capacity: int = 2048, group: int = GROUP, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: its place, gapless from 0, in that sequence.

    ``length_col`` must be 1 .. capacity. ``pieces`` is read twice, so it should be stored.
    """
    groups = max(1, -(-pieces.count() // group))
    fields = [f for f in pieces.schema if f.name not in ("sequence_id", "offset")]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in fields]

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[names].reset_index(drop=True)
        size = pdf[length_col].to_numpy(np.int64)
        own = sum_of_squares(size, capacity)
        order = np.argsort(own, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        offset = np.empty(len(size), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(size))))
        return pdf.assign(sequence_id=(int(key[0]) << 32) + own, offset=offset)

    # Rows are dealt by their place in the stored table: equal rows do not meet in one group.
    by = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    return pieces.select(*names, by.alias("_group")).groupBy("_group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, **how) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(materialize(token_pieces(docs, path, capacity=capacity, **how), "token-pieces"), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ``ids``: the training sequences themselves."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
