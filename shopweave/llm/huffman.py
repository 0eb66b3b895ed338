"""Token ids on disk as canonical, length-limited Huffman codes.

Code lengths come from the global id counts by package-merge. Files hold independent
blocks of whole documents in ascending id order; a block keeps the bit offset of every
``STRIDE``-th token, so all its strides are decoded side by side with one table lookup a
token. The folder has ``blocks`` and ``codes``, both Parquet, the payload being binary.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches
from .tokens import encoder

#: Longest code in bits, tokens from one checkpoint to the next, and least tokens of a block.
LIMIT, STRIDE, BLOCK = 16, 256, 1 << 16
MAGIC = np.array([0x31485753], "<u4")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (more only if the ids need them) by package-merge; 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out, n = np.zeros(len(counts), np.int64), len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())  # vocabularies of more ids need longer codes
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, below = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, below])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)  # which items of the level are leaves, by weight
        both = both[rank]
        below = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    code = last = 0
    for k in used[np.argsort(lengths[used], kind="stable")]:
        code <<= int(lengths[k]) - last
        codes[k], last = code, int(lengths[k])
        code += 1
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """Header, checkpoints (bit offsets, uint64) and the bit stream of a block."""
    size = lengths[ids]
    at = np.cumsum(size) - size
    bits = int(size.sum())
    words = np.zeros((bits + 31) // 32 + 2, np.uint64)
    slot, shift = at >> 5, 64 - (at & 31) - size
    wide = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        words[slot[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        words[slot[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    head = np.array([len(ids), bits, STRIDE], "<u8")
    return MAGIC.tobytes() + head.tobytes() + at[::STRIDE].astype("<u8").tobytes() + words.astype(">u4").tobytes()


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each prefix of as many bits as the longest code has, id << 5 | length."""
    bits = max(1, int(lengths.max(initial=0)))
    table = np.zeros(1 << bits, np.int64)
    for k in np.flatnonzero(lengths):
        shift = bits - int(lengths[k])
        table[int(codes[k]) << shift : (int(codes[k]) + 1) << shift] = (k << 5) | int(lengths[k])
    return table


def decode_block(block: bytes, table: np.ndarray) -> np.ndarray:
    if block[:4] != MAGIC.tobytes():
        raise ValueError("not a block of token codes")
    n, _, stride = (int(x) for x in np.frombuffer(block, "<u8", 3, 4))
    lanes = -(-n // stride)
    at = np.frombuffer(block, "<u8", lanes, 28).astype(np.int64)
    words = np.frombuffer(block, ">u4", offset=28 + 8 * lanes).astype(np.int64)
    out, width = np.zeros((lanes, stride), np.int64), (len(table) - 1).bit_length()
    for t in range(min(stride, n)):
        if n - t <= (lanes - 1) * stride:  # the last lane has ended
            at, lanes = at[: lanes - 1], lanes - 1
            n = lanes * stride
        slot = at >> 5
        got = table[(((words[slot] << 32) | words[slot + 1]) >> (64 - width - (at & 31))) & (len(table) - 1)]
        out[:lanes, t] = got >> 5
        at = at + (got & 31)
    return out.ravel()


def token_table(docs: DataFrame, path: str, *, kind: str = "byte", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's ids and ``end_id``, as uint16 where all fit, else uint32; null counts as empty."""
    wide = encoder(path, kind).whole.get_vocab_size() > 1 << 16

    def encode(batches):
        enc = encoder(path, kind)
        for batch, data, at in small_batches(batches, text_col):
            ids, ends = enc.ended(data, at, end_id)
            raw = ids.astype("<u4" if wide else "<u2")
            buffers = [None, pa.py_buffer((ends * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, buffers).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), rows], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType(), metadata={"wide": wide})])
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def write(tokens: DataFrame, where: str, *, wide: bool = False, id_col: str = "doc_id", limit: int = LIMIT) -> None:
    """Write a stored (id, ids) table to the folder ``where`` in ascending id order, nulls first."""
    spark, dtype = tokens.sparkSession, "<u4" if wide else "<u2"

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), dtype))
            if len(own) > len(total):
                own, total = total, own.astype(np.int64)
            total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary
    counts = np.zeros(max([r["id"] for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    codes = canonical(lengths)
    rows = [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id long, length long").coalesce(1).write.parquet(f"{where}/codes")
    sent = spark.sparkContext.broadcast((lengths, codes))

    def blocks(batches):
        lengths, codes = sent.value
        part, held, names, size, block, start = TaskContext.get().partitionId(), [], [], 0, 0, 0

        def row():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (block, pa.int64()), (start, pa.int64()), (len(ids), pa.int64()))] + [pa.array([[x.as_py() for x in names]], pa.list_(id_type)), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([encode_block(ids, lengths, codes)], pa.binary())], names=schema.names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, x in zip(batch.column(0), batch.column(1), strict=True):
                held.append(np.frombuffer(x.as_py(), dtype).astype(np.int64))
                names.append(name)
                size += len(held[-1])
                if size >= BLOCK:
                    yield row()
                    block, start, held, names, size = block + 1, start + size, [], [], 0
        if held:
            yield row()

    kind = tokens.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("doc_tokens", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])
    ordered = tokens.select(id_col, "ids").repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), "ids")
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{where}/blocks")


def read(spark: SparkSession, where: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian uint32.
    """
    found = spark.read.parquet(f"{where}/blocks")
    rows = spark.read.parquet(f"{where}/codes").collect()  # a row per id of the vocabulary
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["length"]
    # One row per written partition; blocks know their place within it.
    parts = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, before = {}, 0
    for part, n in parts:
        base[part], before = before, before + n
    sent = spark.sparkContext.broadcast(lengths)

    def decode(batches):
        lengths = sent.value
        table = decode_table(lengths, canonical(lengths))
        for batch in batches:
            for k in range(batch.num_rows):
                part, at, names, sizes, payload = (batch.column(c)[k] for c in ("part", "start_in_part", "doc_ids", "doc_tokens", "payload"))
                ids = decode_block(payload.as_py(), table).astype("<u4")
                sizes = np.array(sizes.as_py(), np.int64)
                first = np.cumsum(sizes) - sizes
                own = [ids[a : a + n].tobytes() for a, n in zip(first, sizes, strict=True)]
                cols = [names.values, pa.array(first + at.as_py() + base[part.as_py()], pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(own, pa.binary())] if with_ids else []), names=schema.names)

    schema = T.StructType([T.StructField(id_col, found.schema["doc_ids"].dataType.elementType), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")], *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    return found.select("part", "start_in_part", "doc_ids", "doc_tokens", "payload").mapInArrow(decode, schema)


def encode_documents(docs: DataFrame, path: str, where: str, *, id_col: str = "doc_id", **how) -> None:
    """Tokenise whole documents and write them to the folder ``where``."""
    tokens = token_table(docs, path, id_col=id_col, **how)
    write(materialize(tokens, "token-ids"), where, wide=tokens.schema["ids"].metadata["wide"], id_col=id_col)
