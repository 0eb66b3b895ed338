"""Exact ranked lexical search by the Best Position Algorithm.

Documents are dealt into shards as they lie; no text is shuffled. A shard keeps, for each query
term, the list of its documents by falling impact. A query reads its lists in step; every document
that it meets is completed by direct accesses to the other lists, which mark the positions they
touch as seen. A list's best position is the end of its run of seen positions from the top, and a
document not met yet can score at most the sum of the impacts there. The query stops once that sum
lies strictly below the k-th score, so documents that tie with it are never missed. The best of
each shard are merged.

Only terms of the queries are counted, and their statistics (documents, occurrences, lengths) come
from every document. Queries reach the tasks in blocks of bounded size, one stored pass a block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, new_path
from .decontaminate import BLOCK_BYTES, item_blocks

#: Terms on UTF-8 bytes: digits, ASCII letters and every byte of longer characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of a text taken at once; a term is never cut.
PIECE_BYTES = 1 << 20
#: Postings of a shard; a single document may exceed it.
SHARD_POSTINGS = 4 << 20
#: List positions read in a query's first step; each step doubles.
FIRST_STEP = 32


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece, A-Z lower-cased."""
    data, at = (text or "").encode(), 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data) and (rest := TERM.match(data, end)):
            end = rest.end()
        yield TERM.findall(data[at:end].lower())
        at = end


class Shard:
    """Impact lists of one shard: ``doc``, ``term`` and ``impact`` tell one posting a row."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.size = size
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.terms, self.start = np.unique(term, return_index=True)
        self.length = np.diff(np.append(self.start, len(term)))
        place = np.arange(len(term)) - np.repeat(self.start, self.length)
        key = np.repeat(np.arange(len(self.terms)), self.length) * size + self.doc
        by_doc = np.argsort(key)
        self.key, self.place = key[by_doc], place[by_doc]

    def look_up(self, lists: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct accesses: the positions of ``docs`` in ``lists`` (-1: absent) and their impacts, a row a list."""
        want = lists[:, None] * self.size + docs[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        place = np.where(self.key[at] == want, self.place[at], -1)
        return place, np.where(place >= 0, self.impact[self.start[lists][:, None] + np.maximum(place, 0)], 0)

    def top(self, term: np.ndarray, times: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best documents with a score above 0 and their scores, and how many documents were met.

        ``ids`` orders documents of equal score.
        """
        lists = np.searchsorted(self.terms, term)
        held = (lists < len(self.terms)) & (self.terms[np.minimum(lists, len(self.terms) - 1)] == term) if len(self.terms) else np.zeros(len(term), bool)
        lists, times = lists[held], times[held]
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        start, length = self.start[lists], self.length[lists]
        seen = [np.zeros(n, bool) for n in length]
        best = np.zeros(len(lists), np.int64)
        met = np.zeros(self.size, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, FIRST_STEP
        while at < length.max():
            new = np.unique(np.concatenate([self.doc[s + at : s + min(at + step, n)] for s, n in zip(start, length, strict=True) if n > at]))
            new = new[~met[new]]
            met[new] = True
            at, step = at + step, 2 * step
            if len(new):
                place, impact = self.look_up(lists, new)
                found, scores = np.concatenate([found, new]), np.concatenate([scores, times @ impact])
                for marks, own in zip(seen, place, strict=True):
                    marks[own[own >= 0]] = True
            bound = 0
            for i, marks in enumerate(seen):
                ahead = marks[best[i] :]
                best[i] = length[i] if ahead.all() else best[i] + int(np.argmin(ahead))
                if best[i] < length[i]:
                    bound += int(times[i]) * int(self.impact[start[i] + best[i] - 1])
            if len(scores) >= k and np.partition(scores, -k)[-k] > bound:
                break
        count = len(found)
        found, scores = found[scores > 0], scores[scores > 0]
        if len(scores) > k:
            near = scores >= np.partition(scores, -k)[-k]
            found, scores = found[near], scores[near]
        order = np.lexsort((ids[found], -scores))[:k]
        return found[order], scores[order], count


def _postings(docs: DataFrame, id_col: str, text_col: str, sent) -> DataFrame:
    """(id, n, terms, tfs): every document's length and its counts of the vocabulary."""
    kind = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches):
        number = sent.value.get
        for batch in batches:
            sizes, own, counts = [], [], []
            for text in batch.column(1):
                n, tf = 0, Counter()
                for piece in terms(text.as_py()):
                    n += len(piece)
                    tf.update(map(number, piece))
                tf.pop(None, None)
                sizes.append(n)
                own.append(list(tf.keys()))
                counts.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, kind)


def _search(postings: DataFrame, sent, n_docs: int, n_terms: int, k: int, limit: int) -> DataFrame:
    """(query, _id, score): the best documents of each shard for each query of the block."""
    kind = T.StructType([T.StructField("query", T.LongType()), postings.schema["_id"], T.StructField("score", T.LongType())])

    def answer(parts: list[pa.RecordBatch], weight: np.ndarray, queries):
        rows = pa.Table.from_batches(parts)
        number = np.array(rows.column("n").combine_chunks(), np.int64)
        own, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
        size = np.diff(np.array(own.offsets))
        doc = np.repeat(np.arange(len(size)), size)
        term, tf = np.array(own.flatten(), np.int64), np.array(tfs.flatten(), np.int64)
        m = 75 + (25 * number * n_docs) // max(1, n_terms)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        shard = Shard(len(size), doc, term, impact)
        # Ranks of the ids break ties, null ids last.
        ids = rows.column("_id").combine_chunks()
        order = np.array(pa.compute.sort_indices(ids, null_placement="at_end"))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for q, (at, times) in enumerate(queries):
            found, scores, _ = shard.top(at, times, place, k)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q), pa.int64()), ids.take(pa.array(found)), pa.array(scores, pa.int64())], names=["query", "_id", "score"])

    def run(batches):
        weight, queries = sent.value
        parts, size = [], 0
        for batch in batches:
            at = 0
            ends = np.array(batch.column(2).offsets)[1:] - batch.column(2).offsets[0].as_py()
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + limit - size, side="right")))
                parts.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - base
                at = stop
                if size >= limit or at < batch.num_rows:
                    yield from answer(parts, weight, queries)
                    parts, size = [], 0
        if parts:
            yield from answer(parts, weight, queries)

    return postings.mapInArrow(run, kind)


def rank(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20,
         shard_postings: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of the highest score above 0 for each row of ``items``.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), N the documents with a term; a document of n terms
    gets w * (10^9 tf div (1000 tf + 12 (75 + 25 n N div L))) for each term of the item, repeats included,
    L the terms of all documents. Ties go to the smaller id, null ids last. Null and empty texts have no
    term: such documents are in no result, such items have none. Rows of one id, repeated rows too, are
    documents, or items, of their own. Other columns are not looked at.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("_id").asc_nulls_last())
    totals, where = None, new_path(spark, "ranked")
    names = T.StructType([T.StructField("query", T.LongType()), T.StructField("_item", items.schema[item_col].dataType)])
    for number, block in enumerate(item_blocks(items, item_col, item_text_col, block_bytes)):
        counts = [Counter(t for piece in terms(text) for t in piece) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        sent = spark.sparkContext.broadcast(vocabulary)
        postings = materialize(_postings(docs, id_col, text_col, sent), "postings")
        sent.destroy()
        totals = totals or postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(vocabulary), np.int64)
        for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
            weight[term] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * df + 1)))
        queries = [(np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        sent = spark.sparkContext.broadcast((weight, [(at[order], times[order]) for at, times in queries for order in [np.argsort(at)]]))
        held = postings.where("size(terms) > 0")
        ranked = _search(held, sent, totals[0], totals[1], k, shard_postings).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(block)], names)  # at most a block's
        ranked.join(F.broadcast(ids), "query").select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score").write.parquet(f"{where}/block={number}")
        sent.destroy()
    return spark.createDataFrame([], schema) if totals is None else spark.read.schema(schema).parquet(f"{where}/*")
