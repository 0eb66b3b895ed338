"""Benchmark decontamination with word-level suffix arrays of the training text.

Each shard of documents (a bounded run of words within a task) gets a suffix array, and
every suffix of the benchmark items is binary-searched in it, which gives the longest
verbatim matches and their locations; these mark the document words that they cover.
A match counts from ``window`` words on, or all words of a shorter item. Matching runs where the documents lie; the benchmark
is sent to the tasks in blocks of bounded size, one stored pass a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import materialize, small_batches

#: Characters of words (fixed by the contract): all but ASCII without letters and digits.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Benchmark text of one block, in bytes: what a pass broadcasts at most.
BLOCK_BYTES = 8 << 20
#: Words of a shard; a longer document is a shard alone.
SHARD_WORDS = 1 << 18
#: Places of one item's suffixes that are chained to longest matches at once.
PLACES = 1 << 22


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Items:
    """A block of benchmark items: word numbers, and every suffix as a query."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        split = [(i, words((t or "").encode())) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.window, self.names = window, [i for i, _ in split]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in split]
        self.need = np.array([min(window, len(x)) for x in ids], np.int64)
        owner, rows = [], []
        for k, x in enumerate(ids):
            for s in range(len(x) - int(self.need[k]) + 1):
                owner.append(k)
                rows.append(np.pad(x[s : s + window], (0, max(0, window - len(x[s:])))))
        rows = np.array(rows, np.int64).reshape(-1, window)
        size = self.need[owner] if owner else np.zeros(0, np.int64)
        rows[np.arange(window)[None] >= size[:, None]] = 0
        # Equal suffixes are searched once; ``suffixes`` are the queries of item k from start[k] on, by place.
        both, back = np.unique(np.column_stack([size, rows]), axis=0, return_inverse=True)
        self.suffixes, self.start = back.ravel(), np.searchsorted(np.array(owner, np.int64), np.arange(len(ids) + 1))
        self.size, self.queries = both[:, 0], both[:, 1:]
        order = np.argsort(back.ravel(), kind="stable")
        self.owners = np.array(owner, np.int64)[order]
        self.first = np.searchsorted(back.ravel()[order], np.arange(len(both) + 1))
        self.shortest = int(self.need.min(initial=window))


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes with ``room`` words in order of their first ``depth`` words, by doubling.

    ``room[k]`` is how many words from k on belong to the same run; past it a suffix ends.
    """
    n = len(ids)
    rank, have = ids.copy(), 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        later = np.minimum(np.arange(n) + have, n)
        second = np.where(room > have, np.append(rank, 0)[later], 0)
        key = rank * (int(rank.max(initial=0)) + 1) + second if rank.max(initial=0) < 1 << 31 else rank
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(same)
        have *= 2
    return order


def find(ids: np.ndarray, room: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray]]:
    """(query, starts): for each item suffix that occurs, every place where it starts."""
    keep = np.flatnonzero(room >= items.shortest)
    if not len(keep) or not len(items.queries):
        return
    depth = items.window
    order = suffix_array(ids, room, depth)
    order = order[room[order] >= items.shortest]
    # The first words of the suffixes, in order; 0 past a suffix's end.
    grid = np.where(np.arange(depth)[None] < room[order, None], np.append(ids, np.zeros(depth, np.int64))[order[:, None] + np.arange(depth)], 0)
    q, size = items.queries, items.size

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = np.minimum(mid, len(order) - 1)
            diff = np.where(np.arange(depth)[None] < size[:, None], grid[at] - q, 0)
            lead = (diff != 0).argmax(1)
            sign = np.take_along_axis(diff, lead[:, None], 1)[:, 0]
            right = open_ & ((sign < 0) | (after & (sign == 0)))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    low, high = bound(False), bound(True)
    for k in np.flatnonzero(high > low):
        yield int(k), order[low[k] : high[k]]


def shard(data: np.ndarray, at: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """Words of each row, each word's row, and (query, word positions) of all item suffixes found."""
    rows = len(at) - 1
    mask = np.zeros(len(data) + 1, bool)
    mask[:-1] = WORD_BYTE[low := LOWER[data]]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.concatenate([[False], mask[:-1]])
    begin, end = np.flatnonzero(mask & (~before | cut)), np.flatnonzero(before & (~mask | cut))
    row = np.searchsorted(at, begin, side="right") - 1
    count = np.bincount(row, minlength=rows)
    raw = low.tobytes()
    known = items.vocabulary.get
    ids = np.fromiter((known(raw[a:b], 0) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
    # How many known words of the same row follow from each word on.
    stop = np.append(np.where((ids == 0) | (np.diff(row, prepend=-1) != 0), np.arange(len(ids)), len(ids)), len(ids))
    stops = np.minimum.accumulate(stop[::-1])[::-1]
    room = np.where(ids > 0, stops[1:] - np.arange(len(ids)), 0)
    near = np.flatnonzero(ids > 0)  # unknown words start no suffix and end all
    return count, row, ((k, near[starts]) for k, starts in find(ids[near], room[near], items))


def longest_matches(data: np.ndarray, at: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Words of each row, each word's row, and (item, word positions, item words, words) of every longest verbatim match.

    Suffixes found one word apart in the item and in the row are one match; it has ``window`` words or all of a shorter item.
    """
    count, row, hits = shard(data, at, items)

    def chained() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        places = {k: np.sort(where) for k, where in hits}
        owners = [items.owners[items.first[k] : items.first[k + 1]] for k in places]
        for item in np.unique(np.concatenate(owners)).tolist() if owners else ():
            own = items.suffixes[items.start[item] : items.start[item + 1]].tolist()
            found = [(s, places[k]) for s, k in enumerate(own) if k in places]
            for key in diagonals(found, len(own)):
                new = np.diff(key, prepend=key[0] - 2) != 1
                begin = np.flatnonzero(new)
                words_ = np.diff(np.append(begin, len(key))) - 1 + int(items.need[item])
                diagonal, place = np.divmod(key[begin], len(own) + 1)
                yield item, diagonal + place - len(own), place, words_

    return count, row, chained()


def diagonals(found: list[tuple[int, np.ndarray]], size: int) -> Iterator[np.ndarray]:
    """(item word, sorted row words) as sorted keys in which the places of one match follow each other by one.

    A match lies on one diagonal (row word less item word). At most about ``PLACES`` keys are made at once, by ranges of diagonals.
    """
    total = sum(len(w) for _, w in found)
    low, high = min(int(w[0]) - s for s, w in found), max(int(w[-1]) - s for s, w in found) + 1
    step = high - low if total <= PLACES else max(1, PLACES // size)
    for d in range(low, high, step):
        cut = [(s, w[np.searchsorted(w, d + s) : np.searchsorted(w, d + step + s)]) for s, w in found]
        key = np.concatenate([(w - s + size) * (size + 1) + s for s, w in cut])
        if len(key):
            key.sort()
            yield key


def match_shard(data: np.ndarray, at: np.ndarray, items: Items) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """Words of each row, the word ranges [begin, end) that its longest matches cover, and the numbers of its items."""
    count, row, found_matches = longest_matches(data, at, items)
    rows, first = len(count), np.cumsum(count) - count
    cover, found = np.zeros(len(row) + 1, np.int64), [set() for _ in range(rows)]
    for item, where, _, words_ in found_matches:
        np.add.at(cover, where, 1)
        np.add.at(cover, where + words_, -1)
        for r in np.unique(row[where]).tolist():
            found[r].add(item)
    hit = np.cumsum(cover[:-1]) > 0
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    if hit.any():
        edge = np.concatenate([[True], np.diff(row) != 0]) if len(row) else np.zeros(0, bool)
        starts = np.flatnonzero(hit & (np.concatenate([[True], ~hit[:-1]]) | edge))
        ends = np.flatnonzero(hit & np.append(~hit[1:] | edge[1:], True)) + 1
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            r = int(row[a])
            spans[r].append((a - int(first[r]), b - int(first[r])))
    return count, spans, found


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of about ``limit`` bytes, one block at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def match(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` and ``items``.

    ``hit_spans`` are the word ranges [begin, end) inside occurrences of ``window`` consecutive
    words of an item (all words of a shorter one); ``items`` are the ids, as sorted strings, of
    the items with such occurrences. Null and empty texts have no words; items without words
    and null item ids match nothing. Repeated rows are each matched.
    """
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    new = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))]
    base = [f for f in docs.schema if f.name not in {f.name for f in new}]
    schema, keep = T.StructType([*base, *new]), [f.name for f in base]
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    spark = docs.sparkSession
    out = docs.select(*keep)

    def one_pass(frame: DataFrame, sent) -> DataFrame:
        def run(batches):
            items = Items(sent.value, window)
            for batch, data, at in small_batches(batches, text_col, SHARD_WORDS * 6):
                count, spans, found = match_shard(data, at, items)
                names = [{str(items.names[k]) for k in own} for own in found]
                if "items" in batch.schema.names:  # an earlier block's hits
                    spans = [merged([*((x["begin"], x["end"]) for x in old.as_py()), *own]) for old, own in zip(batch.column("hit_spans"), spans, strict=True)]
                    names = [own.union(old.as_py()) for old, own in zip(batch.column("items"), names, strict=True)]
                cols = [pa.array(count, pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in own] for own in spans], spans_type), pa.array([sorted(own) for own in names], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=schema.names)

        return frame.mapInArrow(run, schema)

    sent = None
    for block in item_blocks(benchmark.where(f"`{item_col}` IS NOT NULL"), item_col, item_text_col, block_bytes):
        if sent is not None:  # an earlier pass is stored before the next block goes out: one is alive at a time
            out = materialize(out, "marked")
            sent.destroy()
        sent = spark.sparkContext.broadcast(block)
        out = one_pass(out, sent)
    return out if sent is not None else one_pass(out, spark.sparkContext.broadcast([]))


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, item_word, doc_word, words): every longest verbatim match and where it lies."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "words")]])
    spark, out = docs.sparkSession, None

    def one_pass(sent) -> DataFrame:
        def run(batches):
            items = Items(sent.value, window)
            for batch, data, at in small_batches(batches, text_col, SHARD_WORDS * 6):
                count, row, found = longest_matches(data, at, items)
                first = np.cumsum(count) - count
                for item, where, place, words_ in found:
                    own = row[where]
                    yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(own)), pa.array([str(items.names[item])] * len(own), pa.string()), *[pa.array(c, pa.int64()) for c in (place, where - first[own], words_)]], names=schema.names)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    for block in item_blocks(benchmark.where(f"`{item_col}` IS NOT NULL"), item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        own = materialize(one_pass(sent), "matches")
        sent.destroy()
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], schema) if out is None else out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns only."""
    marked = match(docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns}), benchmark, text_col=f"_doc_{how.pop('text_col', 'text')}", **how)
    return marked.where("size(hit_spans) = 0").select(*[marked[f"_doc_{c}"].alias(c) for c in docs.columns])
