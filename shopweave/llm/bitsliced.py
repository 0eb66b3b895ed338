"""Exact top-k inner products with a bit-sliced index.

A shard of vectors is stored as bitmaps: slice ``b`` of attribute ``d`` has bit ``b`` of
every row's quantised value. The scores of a query are the sum of its slices, shifted by
the bits of its weights, added up with bitmap full adders; the best rows are then selected
from the most significant slice downward. The slices drop ``coarse`` low bits, which
bounds the error of a score; all rows within it of the last place are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize

#: Rows of a shard on average, and queries of a block (what a pass broadcasts at most).
SHARD, QUERY_BLOCK = 32768, 8192
#: Most tasks that share a shard's queries.
SPLITS = 4


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, q): floor(scale * x) of each component; rows with a null or non-finite one, or no vector, go."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(good)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


class Slices:
    """Bitmaps of one shard: ``maps[d][b]`` over rows, packed into 64-bit words.

    ``numbers`` tell rows of one id apart.
    """

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, values: np.ndarray, coarse: int):
        order = np.lexsort((numbers, ids))
        self.ids, self.numbers, self.values, self.coarse = ids[order], numbers[order], values[order], coarse
        self.low = self.values.min(0)
        over = (self.values - self.low) >> coarse
        self.width = [max(1, int(x).bit_length()) for x in over.max(0)]
        n = len(ids)
        self.words = -(-n // 64)
        self.full = self._pack(np.ones(n, bool))
        self.maps = [[self._pack((over[:, d] >> b) & 1 == 1) for b in range(w)] for d, w in enumerate(self.width)]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        got = np.packbits(bits, bitorder="little")
        out[: len(got)] = got
        return out.view(np.uint64)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(self.ids)])

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the coarse sum, least significant first, and the error that it may have.

        A negative weight takes the complement of its attribute, so that all terms are added.
        """
        columns: list[list[np.ndarray]] = []
        for d in np.flatnonzero(weights):
            w = int(weights[d])
            for j in range(abs(w).bit_length()):
                if abs(w) >> j & 1:
                    for b, bitmap in enumerate(self.maps[d]):
                        while len(columns) <= j + b:
                            columns.append([])
                        columns[j + b].append(bitmap if w > 0 else bitmap ^ self.full)
        out, k = [], 0
        while k < len(columns):
            own = columns[k]
            if len(own) > 1 and k + 1 == len(columns):
                columns.append([])
            while len(own) > 2:  # full adder: three of this place make one here and one carry
                a, b, c = own.pop(), own.pop(), own.pop()
                x = a ^ b
                columns[k + 1].append((a & b) | (c & x))
                own.append(x ^ c)
            if len(own) == 2:
                a, b = own
                columns[k + 1].append(a & b)
                own = [a ^ b]
            out.append(own[0] if own else np.zeros_like(self.full))
            k += 1
        return out, int(np.abs(weights).sum())

    def top(self, weights: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows' ids and exact scores, best first, ties to smaller ids; row number ``skip`` is left out."""
        slices, width = self.scores(weights)
        # The k-th largest coarse sum: fix its bits from the most significant slice downward.
        want = min(k + 1, len(self.ids))
        above, tied, bits = np.zeros_like(self.full), self.full, []
        for s in reversed(slices):
            got = above | (tied & s)
            bits.append(one := int(np.bitwise_count(got).sum()) >= want)
            above, tied = (above, tied & s) if one else (got, tied & ~s)
        last = sum(1 << (len(bits) - 1 - i) for i, b in enumerate(bits) if b)
        # Rows whose sum may still reach it: last - width or more, again slice by slice.
        bound, above, tied = max(0, last - width), np.zeros_like(self.full), self.full
        for i, s in zip(range(len(slices) - 1, -1, -1), reversed(slices), strict=True):
            if bound >> i & 1:
                tied = tied & s
            else:
                above, tied = above | (tied & s), tied & ~s
        rows = self._rows(above | tied)
        rows = rows[self.numbers[rows] != skip] if skip is not None else rows
        exact = self.values[rows] @ weights
        order = np.lexsort((rows, -exact))[:k]  # rows ascend by id
        return self.ids[rows][order], exact[order]


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, coarse: int = 2, shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row whose id ``every`` divides.

    The score is the integer inner product of ``floor(scale * x)``; ties go to the smaller id.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor do
    vectors of another length than the query's. Rows that repeat an id are queries and candidates
    of their own: each is left out of its own result only.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, id_col, vector_col, scale).withColumn("number", F.monotonically_increasing_id()), "quantised")
    count = rows.count()
    shards = max(1, -(-count // shard))
    queries = rows.where(F.col("id") % every == 0)
    # Shards of one vector length each. Where there are fewer shards than cores, tasks share a shard's queries.
    splits = max(1, min(SPLITS, -(-spark.sparkContext.defaultParallelism // shards)))
    packed = rows.withColumn("shard", F.pmod(F.xxhash64("number", F.lit(3)), F.lit(shards))).withColumn("length", F.size("q"))
    dealt = packed.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query", "query_id", "vec_id", "score")])

    def searcher(sent):
        def search(key, table):
            length, split = int(key[1].as_py()), int(key[2].as_py())
            values = table.column("q").combine_chunks().flatten().to_numpy().reshape(-1, length)
            index, out = Slices(table.column("id").to_numpy(), table.column("number").to_numpy(), values, coarse), []
            for number, query, weights in sent.value[split::splits]:
                if len(weights) == length:
                    got, score = index.top(weights, k, number)
                    out.append((np.full(len(got), number), np.full(len(got), query), got, score))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(schema.names, cols, strict=True)})

        return search

    found = None
    for block in query_blocks(queries, query_block):
        sent = spark.sparkContext.broadcast(block)
        best = materialize(dealt.groupBy("shard", "length", "split").applyInArrow(searcher(sent), schema), "top")
        sent.destroy()
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_blocks(queries: DataFrame, size: int):
    """Lists of (row number, id, weights), one block at a time on the driver."""
    block = []
    for r in queries.toLocalIterator():
        block.append((r["number"], r["id"], np.array(r["q"], np.int64)))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
