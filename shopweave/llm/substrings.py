"""Removal of long repeated byte strings with run-length compressed BWT indexes.

Every string of ``length`` bytes belongs to one anchor, its least hashed 32-byte gram, so
strings that are equal meet under the same anchor. The texts are cut into segments, the
stretches whose strings share an anchor. Segments of one anchor that agree for long enough
on a side of it are collected (equal ones once, with their count; so are equal texts before
they are cut) and indexed together in bounded buckets: the index is a
run-length compressed Burrows-Wheeler transform with suffix positions and match lengths
sampled at both ends of every run, from which the matching statistics of all positions
stream in one pass. Anchors with too many different segments for a bucket are split by
the strings' offset from the anchor, down to single strings if need be, so no group of
segments is unbounded and no string is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, text_buffer

GRAM = 32
#: Different segments of one anchor that are indexed together; anchors with more are split.
HOT = 2048
#: Segments of a bucket on average (some 600 bytes each).
BUCKET = 1500
#: Offset ranges of the splits, one after the other.
WIDTHS = (64, 8, 1)
#: Text keys that may be broadcast (16 bytes each); beyond that they are joined.
BROADCAST_KEYS = 500_000
PIECE = 1 << 20
#: Bytes of segments that one index takes; more only if they are of one anchor.
INDEXED = 1 << 19

SEGMENT = "grp long, content binary, key binary, start long, starts int, lead int, weight int, left int, right int"
_BYTE = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> None:
    """Mix ``x`` in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)


def _keys(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The hash of each text of ``data``."""
    raw, at = memoryview(data), at.tolist()
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def segments(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, anchor, start, starts, lead) of each segment of the rows of ``data`` cut at ``at``.

    A segment holds the strings that start at start .. start + starts - 1 of its row; its
    anchor lies ``lead`` bytes after its start. ``data`` is under 2**21 bytes.
    """
    n = len(data)
    if n < length:
        return
    with np.errstate(over="ignore"):
        h, power, size = _BYTE[data], np.uint64(0x9E3779B97F4A7C15), 1
        while size < GRAM:
            more = h[size:]
            h = h[:-size] * power
            h += more
            power, size = power * power, size * 2
        _mix(h)
    del more
    h &= ~np.uint64((1 << 21) - 1)
    h |= np.arange(len(h), dtype=np.uint64)
    width = length - GRAM + 1  # grams of a string
    low, size = h, 1
    del h
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[: len(low)]
    whole = np.arange(length, len(low) + length, dtype=np.int32) <= at.astype(np.int32)[1:][row]
    edge = np.flatnonzero(whole & (np.concatenate([[True], low[1:] != low[:-1]]) | np.concatenate([[True], row[1:] != row[:-1]])))
    ends = np.minimum(np.append(edge[1:], n), np.maximum(at[row[edge] + 1] - length + 1, edge + 1))
    first = at[row[edge]]
    place = (low[edge] & np.uint64((1 << 21) - 1)).astype(np.int64)
    anchor = (low[edge] >> np.uint64(21)).astype(np.int64)
    yield from zip(row[edge].tolist(), anchor.tolist(), (edge - first).tolist(), (ends - edge).tolist(), (place - edge).tolist(), strict=True)


def _segment_batch(columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.int32()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SEGMENT.split(", ")])


def _sides(raw: bytes, begin: int, mid: int, end: int, length: int) -> tuple[int | None, int | None]:
    """Hashes of the anchor at ``mid`` with what precedes it, and with what follows it.

    A string of ``length`` bytes holds its anchor and half of its other bytes before or after it,
    so segments that share a string share one of the two. None where the segment lacks the bytes.
    """
    half = (length - GRAM) // 2
    left = xxhash.xxh32_intdigest(raw[mid - half : mid + GRAM]) - 2**31 if mid - half >= begin else None
    right = xxhash.xxh32_intdigest(raw[mid : mid + GRAM + half]) - 2**31 if mid + GRAM + half <= end else None
    return left, right


def _segment_rows(texts: DataFrame, length: int) -> DataFrame:
    """All segments of all rows (text, weight); the key of a row is the hash of its text."""

    def run(batches):
        for batch in batches:
            data, at = text_buffer(batch.column(0))
            weights = batch.column(1).to_pylist()
            i, n = 0, len(at) - 1
            while i < n:
                j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
                out: list[list] = [[] for _ in range(9)]
                own = data[at[i] : at[j]]
                raw = own.tobytes()
                cuts = at[i : j + 1] - at[i]
                keys = _keys(own, cuts)
                # One text that is longer than a piece goes piece by piece, overlapping by a string.
                for a in range(0, max(1, len(own) - length + 1), PIECE) if j == i + 1 else [0]:
                    part = own[a : a + PIECE + length - 1] if j == i + 1 else own
                    for row, anchor, start, starts, lead in segments(part, np.array([0, len(part)]) if j == i + 1 else cuts, length):
                        begin = int(cuts[row]) + a + start
                        end = begin + starts - 1 + length
                        values = (anchor, xxhash.xxh3_128_digest(raw[begin:end]), keys[row], a + start, starts, lead, weights[i + row], *_sides(raw, begin, begin + lead, end, length))
                        for c, v in zip(out, values, strict=True):
                            c.append(v)
                i = j
                yield _segment_batch(out)

    return texts.mapInArrow(run, SEGMENT)


class RunLengthIndex:
    """Run-length BWT of segments, each followed by a terminator, with sampled run ends."""

    DEPTH = 7  # symbols that fit one integer key

    def __init__(self, parts: list[bytes]):
        size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        text = np.zeros(n, np.int16)  # terminator 0, bytes as 1 .. 256
        body = np.ones(n, bool)
        body[self.begin + size] = False
        text[body] = np.frombuffer(b"".join(parts), np.uint8)
        text += body
        self.room = np.repeat((self.begin + size).astype(np.int32), size + 1) - np.arange(n, dtype=np.int32)
        deepest = int(size.max(initial=0)) + 1
        key = np.zeros(n, np.int64)
        for j in range(self.DEPTH):
            key <<= 9
            key[: max(0, n - j)] |= text[j:]
        # Prefix doubling: a rank is where a suffix's group of equals begins; only such groups are sorted again.
        # Positions are 32 bits wide, and what a level needs no longer goes: a worker holds several levels of them.
        levels, depth, rank = [], self.DEPTH, np.zeros(n, np.int32)
        order = np.argsort(key).astype(np.int32)
        sorted_keys, spots, tied = key[order], np.arange(n, dtype=np.int32), order
        del key, body
        while True:
            fresh = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[: len(tied)]
            del sorted_keys
            heads = np.flatnonzero(fresh)
            sizes = np.diff(np.append(heads, len(tied)))
            order[spots] = tied
            rank = rank.copy()
            rank[tied] = np.repeat(spots[heads], sizes)
            levels.append((depth, rank))
            again = np.repeat(sizes > 1, sizes)
            tied, spots = tied[again], spots[again]
            del fresh, heads, sizes, again
            if depth >= deepest or not len(tied):
                break
            after = tied + np.int32(depth)
            key = rank[tied].astype(np.int64)
            key *= n + 1
            key += np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            del after
            by = np.argsort(key)
            tied, sorted_keys = tied[by], key[by]
            del key, by
            depth *= 2
        before = np.zeros(n, np.int32)
        before[1:] = text[:-1]
        before[self.begin] = -1 - np.arange(len(parts))  # each segment's terminator is a symbol of its own
        last = before[order]
        head = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])) if n else np.zeros(0, np.int64)
        self.run_symbols, self.run_lengths = last[head], np.diff(np.append(head, n))
        # Samples where one run meets the next: both suffixes and their common length.
        self.below, self.above = order[head[1:]], order[head[1:] - 1]
        a, b, common = self.below.copy(), self.above.copy(), np.zeros(max(0, len(head) - 1), np.int32)
        for depth, rank in reversed(levels):
            for _ in range(2):  # a level may be passed twice: depths double
                inside = (a < n) & (b < n)
                same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
                for x in (a, b, common):
                    x += np.int32(depth) * same
        for _ in range(self.DEPTH - 1):
            same = (a < n) & (b < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
            for x in (a, b, common):
                x += same
            a[~same] = n
        self.common = common

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest string from there, within its segment, that occurs again.

        Only run ends are sampled: elsewhere the preceding symbols agree, so the match of the
        position before, less one, is as long.
        """
        best = np.zeros(len(self.room), np.int32)
        np.maximum.at(best, self.below, self.common)
        np.maximum.at(best, self.above, self.common)
        best = np.minimum(best, self.room)
        at = np.arange(len(best), dtype=np.int32)
        return np.minimum(np.maximum.accumulate(best + at) - at, self.room) if len(best) else best


def repeated_starts(parts: list[bytes], starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part, which of its first ``starts`` positions begin a string of ``length`` found again."""
    index = RunLengthIndex(parts)
    long = index.matching_statistics() >= length
    return [np.flatnonzero(long[b : b + s]) for b, s in zip(index.begin, starts, strict=True)]


def whole_anchors(groups: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of a bucket that are indexed together: all of an anchor, and of as many anchors as ``INDEXED`` bytes hold.

    Strings that are equal have one anchor, so no match is between two indexes.
    """
    order = np.argsort(groups, kind="stable")
    last = np.flatnonzero(np.append(np.diff(groups[order]) != 0, [True] * (len(order) > 0)))
    held, i, first, done = np.cumsum(sizes[order])[last], 0, 0, 0
    while i < len(last):
        i = max(i + 1, int(np.searchsorted(held, done + INDEXED, side="right")))
        yield order[first : last[i - 1] + 1]
        first, done = last[i - 1] + 1, held[i - 1]


def _bucket_marks(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """(key, begin, end) of the strings of a bucket's segments that are found again."""
    sizes = pc.binary_length(table.column("bytes")).to_numpy()
    for rows in whole_anchors(table.column("grp").to_numpy(), sizes):
        own = table.take(pa.array(rows))
        found = repeated_starts(own.column("bytes").to_pylist(), own.column("starts").to_numpy(), length)
        keys, begins, ends = [], [], []
        for key, start, weight, at in zip(own.column("key"), own.column("start"), own.column("weight"), found, strict=True):
            for a, b in _runs(at) if weight.as_py() < 2 else ():  # repeated segments are marked whole
                keys.append(key.as_py())
                begins.append(start.as_py() + a)
                ends.append(start.as_py() + b + length)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["key", "begin", "end"])


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of consecutive positions."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True))


def _with_text(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row a text: key, text, and the list ``cuts`` of what is wanted from it."""
    cuts = wanted.groupBy("key").agg(F.collect_list(F.struct("grp", "content", "start", "starts", "lead", "weight")).alias("cuts"))
    keys = wanted.select("key").distinct()
    few = len(keys.limit(BROADCAST_KEYS + 1).select(F.lit(1)).collect()) <= BROADCAST_KEYS
    texts = keyed.join(F.broadcast(keys) if few else keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(cuts, "key")


def _index_marks(wanted: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """(key, begin, end) of repeated strings of the segments, by an index for each bucket of anchors."""

    def cut(batches):
        for batch in batches:
            for key, text, cuts in zip(*(batch.column(c) for c in ("key", "text", "cuts")), strict=True):
                raw, cuts = text.as_py().encode(), cuts.as_py()
                cols = [[c["grp"] for c in cuts], [key.as_py()] * len(cuts), [c["start"] for c in cuts], [c["starts"] for c in cuts], [c["weight"] for c in cuts], [raw[c["start"] : c["start"] + c["starts"] - 1 + length] for c in cuts]]
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["grp", "key", "start", "starts", "weight", "bytes"])

    def search(table):
        return pa.Table.from_batches(_bucket_marks(table, length))

    buckets = max(1, -(-wanted.count() // BUCKET))
    parts = _with_text(wanted, keyed).select("key", "text", "cuts").mapInArrow(cut, "grp long, key binary, start long, starts int, weight int, bytes binary")
    return parts.groupBy(F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket")).applyInArrow(search, "key binary, begin long, end long")


def _split(wanted: DataFrame, keyed: DataFrame, length: int, width: int) -> DataFrame:
    """Segments cut by ranges of ``width`` offsets from the anchor, grouped by the bytes that a range's strings share."""

    def run(batches):
        for batch in batches:
            out = []
            for key, text, cuts in zip(*(batch.column(c) for c in ("key", "text", "cuts")), strict=True):
                raw, key = text.as_py().encode(), key.as_py()
                for c in cuts.as_py():
                    done = 0
                    while done < c["starts"]:
                        start, lead = c["start"] + done, c["lead"] - done
                        count = min(c["starts"] - done, lead % width + 1)  # down to the range's end
                        mid = c["start"] + c["lead"]  # the anchor; the range's common bytes lie around it
                        high = lead // width * width + width - 1
                        shared = raw[mid - (high - width + 1) : mid - high + length]
                        group = xxhash.xxh3_64_intdigest(b"%d %d " % (c["grp"], high) + shared) >> 1
                        out.append((group, xxhash.xxh3_128_digest(raw[start : start + count - 1 + length]), key, start, count, lead, c["weight"], 0, 0))
                        done += count
            yield _segment_batch(list(zip(*out, strict=True)) or [[]] * 9)

    return _with_text(wanted, keyed).select("key", "text", "cuts").mapInArrow(run, SEGMENT)


def _once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, weight): texts with copies by their least id only, at weight 2, and all others at weight 1."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})
    copies = materialize(base.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").drop("n"), "copies")
    few = copies.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    marked = base.join((F.broadcast(copies) if few else copies).withColumn("weight", F.lit(2)), ["h", "g"], "left")
    return marked.where("weight IS NULL OR id IS NULL OR id = least").select("text", F.coalesce("weight", F.lit(1)).alias("weight"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """(key, spans): for each text hash, the byte ranges covered by strings of ``length`` found elsewhere too."""

    def key_of(batches):
        for batch, data, at in small_batches(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array(_keys(data, at), pa.binary()), pc.fill_null(batch.column(0), "")], names=["key", "text"])

    keyed = docs.select(text_col).mapInArrow(key_of, "key binary, text string")
    rows = materialize(_segment_rows(_once(docs, id_col, text_col), length), "segments")
    marks = None
    for width in (*WIDTHS, 0):
        place = F.min(F.struct("key", "start", "starts", "lead", "left", "right"))  # equal contents have equal sides
        counted = materialize(rows.groupBy("grp", "content").agg(F.sum("weight").alias("n"), place.alias("at")), "contents")
        twice = counted.where("n > 1").select("grp", "content")
        found = rows.join(twice, ["grp", "content"]).select("key", F.col("start").alias("begin"), (F.col("start") + F.col("starts") - 1 + length).alias("end"))
        marks = found if marks is None else marks.unionByName(found)
        more = counted.groupBy("grp").agg(F.count("*").alias("kinds")).where("kinds > 1").select("grp")
        several = materialize(counted.join(more, "grp").select("grp", "content", "at.*", F.least(F.col("n"), F.lit(2)).cast("int").alias("weight")), "several")
        wanted = materialize(_sharing(several), "wanted")
        marks = marks.unionByName(_index_marks(wanted.where(F.col("kinds") <= hot), keyed, length))
        large = wanted.where(F.col("kinds") > hot)
        if not width or large.isEmpty():
            break
        rows = materialize(_split(large, keyed, length, width), "segments")
    return marks.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))


def _sharing(several: DataFrame) -> DataFrame:
    """The segments that share a side with another of their anchor, with the number of such segments as ``kinds``."""
    side = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("left").alias("side")), F.struct(F.lit(1).alias("which"), F.col("right").alias("side"))))
    sides = several.select("grp", "content", side.alias("s")).select("grp", "content", "s.*").where("side IS NOT NULL")
    shared = sides.groupBy("grp", "which", "side").agg(F.count("*").alias("n")).where("n > 1")
    good = materialize(sides.join(shared, ["grp", "which", "side"], "left_semi").select("grp", "content").distinct(), "sharing")
    kinds = good.groupBy("grp").agg(F.count("*").alias("kinds"))
    return several.join(good, ["grp", "content"], "left_semi").join(kinds, "grp")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in
    the same text or another, is removed; ``kept`` are the remaining bytes. Strings are
    judged on the input. Null texts count as empty; repeated rows are each other's repeats.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length, hot=hot)
    id_type = docs.schema[id_col].dataType

    def key_of(batches):
        for batch, data, at in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_keys(data, at), pa.binary()), batch.column(1)], names=["id", "key", "text"])

    def drop(batches):
        names = [id_col, "n_bytes", "n_removed", "n_spans", "kept"]
        for batch, data, at in small_batches(batches, "text"):
            out = []
            for first, last, spans in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("spans"), strict=True):
                raw, kept, end, runs = memoryview(data[first:last]), [], 0, 0
                for s in spans.as_py() or ():
                    if s["begin"] > end or not runs:
                        kept.append(raw[end : s["begin"]])
                        runs += 1
                    end = max(end, s["end"])
                kept = b"".join([*kept, raw[end:]])
                out.append((len(raw), len(raw) - len(kept), runs, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)]], names=names)

    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(key_of, T.StructType([T.StructField("id", id_type), T.StructField("key", T.BinaryType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    return keyed.join(spans, "key", "left").select("id", "text", "spans").mapInArrow(drop, schema)
