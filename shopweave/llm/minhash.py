"""MinHash near-duplicates: banding, signature check, exact check, connected components.

Texts with the same shingle set form one class, whose least id stands for it. Classes
that share a band are compared in two rounds that never list all pairs of a bucket:
first each class with the most similar of its buckets' least members, then, once the
links found so far are components, only classes of different components of a bucket.
Signatures screen candidates well below the threshold; links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, row_chunks, small_batches, text_buffer
from .graph import components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signatures this far below the threshold (4.7 standard deviations at 0.8) are still checked.
SLACK = 0.15
#: Candidate ids that may be broadcast (8 bytes each); beyond that they are joined.
BROADCAST_IDS = 1_000_000
#: Members and probes of a bucket that one task compares, and the bytes of text of either that it confirms.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Similar pairs a member from which on a block confirms its links itself.
DENSE = 4

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MUL = (_rng.integers(1, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base)]))[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = 4) -> Iterator[np.ndarray]:
    """Each row's sorted 64-bit shingle hashes: distinct runs of ``k`` words, or all of fewer."""
    with np.errstate(over="ignore"):
        space = _SPACE[data]
        word = np.append(~space, False)
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        before = np.concatenate([[False], word[:-1]])
        begin, end = np.flatnonzero(word & (~before | cut)), np.flatnonzero(before & (~word | cut))
        # Hash of a word: bytes times powers of the base, summed, moved to the word's start.
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[_LOWER[data]] * _powers(_BASE, len(data)))])
        words = _mix((total[end] - total[begin]) * _powers(_INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))
        cuts = np.searchsorted(begin, at)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, n = words[a:b], b - a
            size = min(k, n)
            if not size:
                yield own
                continue
            got = np.zeros(n - size + 1, np.uint64)
            for j in range(size):
                got = got * _BASE + own[j : n - size + 1 + j]
            yield np.unique(_mix(got + np.uint64(size)))


def text_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` of whole texts, about a MB of them hashed at once; a longer one alone."""
    at = np.cumsum([0, *map(len, texts)])
    for i, j in row_chunks(at):
        yield from shingle_sets(np.frombuffer(b"".join(texts[i:j]), np.uint8), at[i : j + 1] - at[i], k)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``HASHES`` multiply-add hashes, uint32."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        out = np.minimum(out, (x[None, i : i + 1024] * _MUL[:, None] + _ADD[:, None]).min(1))
    return out


def sketch(docs: DataFrame, *, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n_shingles, n_bytes, set_key, signature, bands) of each row."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        for batch, data, at in small_batches(batches, text_col, 1 << 20):
            n, keys, sigs, bands = [], [], [], []
            for own in shingle_sets(data, at, k):
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                if len(own):
                    sig = signature(own)
                    sigs.append(sig.tobytes())
                    bands.append([xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), b) - 2**63 for b in range(BANDS)])
                else:
                    sigs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, t) for c, t in zip((n, np.diff(at), keys, sigs, bands), kinds, strict=True)]], names=schema.names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _similar(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """(a, b, estimate) of the pairs whose signatures agree in ``least`` of the places or more."""
    side = lambda c: signatures.select(F.col("id").alias(c), F.col("signature").alias(f"sig_{c}"))

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            estimate = (a == b).mean(1)
            keep = pa.array(np.flatnonzero(estimate >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(estimate).take(keep)], names=["a", "b", "estimate"])

    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("estimate", T.DoubleType())])
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (u, v) with ``100 * |intersection| >= percent * |union|`` of their full sets."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches):
        for batch in batches:
            for part, *left in small_batches([batch], "text_a", 1 << 20):
                right = text_buffer(part.column("text_b"))
                keep = []
                for x, y in zip(shingle_sets(*left, k), shingle_sets(*right, k), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def _meet(own: DataFrame) -> DataFrame:
    """Each block of a bucket's members with each block of its probes, which are marked."""
    block, part = (F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int") for seed, n in ((5, "blocks"), (6, "parts")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = own.select("key", block.alias("block"), each("parts").alias("part"), F.lit(False).alias("probe"), "band", "id", "component")
    probe = own.where("component <> most").select("key", each("blocks").alias("block"), part.alias("part"), F.lit(True).alias("probe"), "band", "id", "component")
    return member.unionByName(probe)


def _across(members: DataFrame, traits: DataFrame, texts: DataFrame, least: float, percent: int, k: int, most_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Similar classes of different components that share a bucket: pairs (a, b) to confirm, and links (u, v).

    ``members``: key, band, id, n_bytes, component; ``traits``: id, signature, bands. The classes outside a bucket's
    commonest component are its probes; blocks of all its members meet blocks
    of them in separate tasks. Where a block has more than ``most_pairs`` similar pairs a member, no pairs are listed:
    its texts go to the task, which confirms and returns one link a probe and component.
    """
    per = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = per.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("size"), F.max("n").alias("top"), F.max_by("component", F.struct("n", "component")).alias("most")).where("kinds > 1")
    top = top.select("key", "most", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("top")) / BLOCK).cast("int").alias("parts"))
    # Of buckets with the same members, the one of the first band is enough.
    same = members.join(top.select("key"), "key", "left_semi").groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    top = top.join(same.groupBy("n", "x", "y").agg(F.min_by("key", "band").alias("key")).select("key"), "key", "left_semi")
    rows = materialize(members.join(top, "key"), "across")

    def similar(pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        is_probe = pdf["probe"].to_numpy()
        comp = pd.factorize(pdf["component"])[0]
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(-1, HASHES)
        body, found = np.flatnonzero(~is_probe), []
        for p in np.flatnonzero(is_probe):
            near = body[comp[body] != comp[p]]
            found.append((p, near[(sig[near] == sig[p]).mean(1) >= least]))
        return comp, found

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, (_, found) = pdf["id"].to_numpy(), similar(pdf)
        if sum(len(near) for _, near in found) > most_pairs * len(pdf) + 64:
            return pd.DataFrame({"key": pdf["key"].iloc[:1], "a": [-1], "b": [-1], "dense": [True]})
        out = [np.column_stack([np.minimum(ids[near], ids[p]), np.maximum(ids[near], ids[p])]) for p, near in found]
        both = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "a": both[:, 0], "b": both[:, 1], "dense": False})

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, (comp, found) = pdf["id"].to_numpy(), similar(pdf)
        sets = list(text_sets([t.encode() for t in pdf["text"]], k))
        size = np.array([len(x) for x in sets])
        first = np.cumsum(size) - size
        number = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        bands, band = np.stack(pdf["bands"].to_list()), int(pdf["band"].iloc[0])
        mark, out = np.zeros(number.max(initial=0) + 1, bool), []
        for p, near in found:
            near = near[~(bands[near, :band] == bands[p, :band]).any(1)]  # judged where they first meet
            if not len(near):
                continue
            mark[number[first[p] : first[p] + size[p]]] = True
            both = np.add.reduceat(mark[number].astype(np.int64), first)[near]
            mark[number[first[p] : first[p] + size[p]]] = False
            good = near[100 * both >= percent * (size[near] + size[p] - both)]
            good = good[np.unique(comp[good], return_index=True)[1]]
            out += [(ids[p], ids[g]) for g in good]
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    # Blocks are dealt on bare ids; what a task needs of them is joined once, after that.
    met = materialize(_meet(rows).join(traits.drop("bands"), "id").groupBy("key", "block", "part").applyInPandas(pairs, "key long, a long, b long, dense boolean"), "across-pairs")
    dense = rows.join(met.where("dense").select("key").distinct(), "key", "left_semi")
    weight = dense.groupBy("key").agg(F.sum("n_bytes").alias("all"), F.sum(F.when(F.col("component") != F.col("most"), F.col("n_bytes"))).alias("some"))
    cut = {n: F.greatest(n, F.ceil(F.col(c) / BLOCK_BYTES).cast("int")) for n, c in (("blocks", "all"), ("parts", "some"))}
    dealt = _meet(dense.join(weight, "key").withColumns(cut).drop("all", "some"))
    return met.where("NOT dense").select("a", "b").distinct(), dealt.join(traits, "id").join(texts, "id").groupBy("key", "block", "part").applyInPandas(links, "u long, v long")


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, dense: int = DENSE) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``docs``; ids are integers.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. A text's set is its
    distinct runs of ``k`` words, or all of fewer; empty and null texts are linked with nothing.
    ``component_id`` is the least id that is reached over links; rows of one id count as linked.
    A null id is linked with nothing: its component is null and it is kept.
    """
    least = percent / 100 - SLACK
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(sketch(base, id_col="id", text_col="text", k=k), "sketches")
    real = sketches.where("id IS NOT NULL AND n_shingles > 0")
    classes = real.groupBy("set_key").agg(F.min("id").alias("rep"))
    rows = real.select("id", "set_key").join(classes, "set_key").select("id", "rep")
    same = rows.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    reps = real.join(classes.select("set_key", F.col("rep").alias("id")), ["set_key", "id"], "left_semi").dropDuplicates(["set_key"])

    members = reps.select("id", "n_bytes", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    buckets = materialize(members.join(shared, "key").select("key", "band", "id", "n_bytes", "pivot"), "buckets")
    candidates = buckets.select("id").distinct()
    count = candidates.count()
    wanted = F.broadcast(candidates) if count <= BROADCAST_IDS else candidates
    signatures = materialize(reps.select("id", "signature", "bands").join(wanted, "id", "left_semi"), "signatures")
    # Rows that repeat an id may differ in text; each of them is a set of its own.
    texts = materialize(base.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]) if count else base.limit(0), "texts")

    star = buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    likely = _similar(star, signatures, least)
    nearest = likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b")
    first = materialize(_confirmed(nearest, texts, percent, k), "links")

    known = components(first)
    labelled = buckets.select("key", "band", "id", "n_bytes").join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest, direct = _across(labelled, signatures, texts, least, percent, k, dense)
    second = materialize(_confirmed(rest, texts, percent, k).unionByName(direct), "links")

    final = components(first.unionByName(second).unionByName(same.select("u", "v")))
    out = sketches.select("id", "n_shingles").join(final.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
