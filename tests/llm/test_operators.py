"""Every training-data operator against brute force, with nulls, empty, long and repeated texts."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shopweave.llm import bitsliced, common, decontaminate, huffman, langid, linededup, minhash, packing, quality, substrings, tokens, toxicity
from shopweave.llm.graph import components
from shopweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, score double, n_lines long, items string, sequence_id string, spans string, kept string, id long, key string"


def words(rng, n, letters="abcde"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, white space, repeats, near copies, a long text, odd characters, shared lines and passages."""
    rng = random.Random(5)
    passage, line = words(rng, 120), "A Shared  line"
    base = words(rng, 60)
    near = base.split()
    near[10] = "changed"
    texts = [None, "", " \t\n ", base, base, " ".join(near), base.upper(), words(rng, 6000), "é" * 50 + "Ωß\x00 \x1c x <|endoftext|> y", "a" * 1500, "word"]
    texts += [f"{words(rng, 30)}\n{passage if k % 3 == 0 else words(rng, 40)}\n {line} \n\n{words(rng, 20)}" for k in range(24)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 7, "x", "s", "p", "k", i, "q") for i, t in rows], SCHEMA)


def by_id(df, column="doc_id"):
    return {r[column]: r for r in df.collect()}


def test_line_dedup(spark, rows):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    for how in ({}, {"broadcast_keys": 0}, {"batches": 7, "fanout": 2}):
        got = by_id(linededup.drop_common_lines(frame(spark, rows), min_docs=10, **how))
        assert len(got) == len(rows)
        for i, t in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not key(x) or seen[key(x)] < 10]
            assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"], got[i]["lang"]) == ("\n".join(kept), len(lines), len(lines) - len(kept), "en")


def test_line_runs_compact(spark, rows):
    runs = linededup.LineRuns(spark, min_docs=2, fanout=2)
    for _ in range(4):
        runs.add(frame(spark, rows[:5]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]


def test_line_runs_are_not_shuffled_again(spark, rows):
    """Counting over stored runs, and merging a batch with them, exchanges the batch only; null ids keep their rows apart."""
    runs = linededup.LineRuns(spark, min_docs=2, fanout=4)
    for k in (0, 10, 20):
        runs.add(frame(spark, rows[k : k + 12]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(runs.levels[0]) == 3 and "Exchange" not in plan(runs.counts())
    batch = linededup.line_counts(frame(spark, rows)).groupBy("key").agg({"n": "sum"})
    assert plan(batch.join(runs.common().hint("merge"), "key", "left_anti")).count("Exchange") == 1
    unnamed = [(None, f"shared\nown {k}") for k in range(12)]
    got = linededup.drop_common_lines(frame(spark, unnamed), min_docs=10, broadcast_keys=0).collect()
    assert sorted(r["text"] for r in got) == sorted(f"own {k}" for k in range(12))


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats(spark, rows, hot):
    length = 120
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    got = by_id(substrings.remove_repeats(frame(spark, rows), length=length, hot=hot))
    assert len(got) == len(rows)
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), int(gone.sum()), runs)
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(b, np.uint8)[~gone])


def test_run_length_index():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = bytes(rng.integers(97, 100, 200).astype(np.uint8))
        parts = [base[a : a + n] for a, n in zip(rng.integers(0, 150, 4), rng.integers(20, 50, 4), strict=True)]
        size = int(rng.integers(3, 15))
        seen = collections.Counter(p[k : k + size] for p in parts for k in range(len(p) - size + 1))
        got = substrings.repeated_starts(parts, np.array([len(p) - size + 1 for p in parts]), size)
        assert [g.tolist() for g in got] == [[k for k in range(len(p) - size + 1) if seen[p[k : k + size]] > 1] for p in parts]


def test_run_length_index_memory():
    """Two workers of an executor index at once, so an index of repeated segments stays under 90 bytes a byte of them."""
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 123, 600).astype(np.uint8).tobytes() for _ in range(400)]
    parts += [p[3:] + b"xyz" for p in parts]
    tracemalloc.start()
    try:
        got = substrings.repeated_starts(parts, np.full(len(parts), 201), 400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [g.tolist() for g in got] == [list(range(3, 198 + 3))] * 400 + [list(range(198))] * 400
    assert peak < 90 * sum(map(len, parts))


@pytest.mark.parametrize("most", [1 << 19, 900, 1])
def test_buckets_are_indexed_by_whole_anchors(monkeypatch, most):
    """However little an index may take, all segments of an anchor are in one, and every repeat is found."""
    rng, length = np.random.default_rng(4), 20
    monkeypatch.setattr(substrings, "INDEXED", most)
    groups = rng.integers(-5, 5, 60)
    base = [rng.integers(97, 123, 90).astype(np.uint8).tobytes() for _ in range(10)]  # a text for each anchor
    parts = [base[g + 5][a : a + n] for g, a, n in zip(groups, rng.integers(0, 50, 60), rng.integers(20, 40, 60), strict=True)]
    sizes = np.array([len(p) for p in parts])
    taken = [rows.tolist() for rows in substrings.whole_anchors(groups, sizes)]
    assert sorted(itertools.chain(*taken)) == list(range(60))
    for rows in taken:
        assert len(set(groups[rows])) == 1 or sizes[rows].sum() <= most
        assert all((groups == g).sum() == (groups[rows] == g).sum() for g in set(groups[rows]))
    assert len(taken) == {1 << 19: 1, 1: len(set(groups))}.get(most, len(taken))
    table = pa.table({"grp": groups, "key": [b"%d" % i for i in range(60)], "start": np.full(60, 7), "starts": pa.array(sizes - length + 1, pa.int32()), "weight": pa.array([1] * 60, pa.int32()), "bytes": parts})
    seen = collections.Counter(p[k : k + length] for p in parts for k in range(len(p) - length + 1))
    want = {(b"%d" % i, 7 + k) for i, p in enumerate(parts) for k in range(len(p) - length + 1) if seen[p[k : k + length]] > 1}
    marks = pa.Table.from_batches(substrings._bucket_marks(table, length)).to_pylist()
    assert {(m["key"], k) for m in marks for k in range(m["begin"], m["end"] - length + 1)} == want
    assert list(substrings.whole_anchors(groups[:0], sizes[:0])) == []


def test_longest_matches_by_ranges_of_diagonals(monkeypatch):
    """Repeated words, where an item's suffixes occur at many places: the same matches whatever is chained at once."""
    named = [(1, "a " * 30), (2, "b " + "a " * 12 + "b"), (3, "a"), (4, "c a"), (5, "a " * 30)]
    items = decontaminate.Items(named, 10)
    texts = [b"a " * 50 + b"b " + b"a " * 12 + b"b c", b"a", b"", b"c a b", b"a " * 9 + b"c a"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = set()
    for r, w in enumerate(decontaminate.words(t) for t in texts):
        for j, v in enumerate(decontaminate.words(t.encode()) for _, t in named):
            for a, b in itertools.product(range(len(w)), range(len(v))):
                n = next((n for n in range(len(v) + 1) if a + n >= len(w) or b + n >= len(v) or w[a + n] != v[b + n]), len(v))
                if n >= min(10, len(v)) and not (a and b and w[a - 1] == v[b - 1]):
                    want.add((r, j, b, a, n))
    for most in (1 << 22, 40, 1):
        monkeypatch.setattr(decontaminate, "PLACES", most)
        count, row, found = decontaminate.longest_matches(data, at, items)
        first = np.cumsum(count) - count
        got = [(int(row[w]), j, int(p), int(w - first[row[w]]), int(n)) for j, where, place, size in found for w, p, n in zip(where, place, size, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_decontamination(spark, rows):
    items = [(1, rows[11][1]), (2, "WORD"), (3, None), (4, "..."), (None, rows[12][1]), (5, " ".join(rows[7][1].split()[50:75])), (15, "nothing here matches at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for s in range(max(0, len(w) - 10) + 1) if w and i is not None else ():
            windows[tuple(w[s : s + 10])].add(i)
    for limit in (1 << 20, 100):  # one block, and several
        got = by_id(decontaminate.match(frame(spark, rows), bench, block_bytes=limit))
        for i, t in rows:
            w = split(t)
            hit, found = set(), set()
            for size in {len(x) for x in windows}:
                for s in range(len(w) - size + 1):
                    if own := windows.get(tuple(w[s : s + size])):
                        hit |= set(range(s, s + size))
                        found |= own
            assert got[i]["n_words"] == len(w) and got[i]["items"] == sorted(map(str, found))
            assert sum(x["end"] - x["begin"] for x in got[i]["hit_spans"]) == len(hit)
    want = set()
    for i, t in rows:
        w = split(t)
        for j, x in items:
            v = split(x)
            need = min(10, len(v))
            for a in range(len(w)) if j is not None and v else ():
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= need and not (a and b and w[a - 1] == v[b - 1]):
                        want.add((i, str(j), b, a, n))
    assert {tuple(r) for r in decontaminate.matches(frame(spark, rows), bench).collect()} == want
    clean = decontaminate.remove_contaminated(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["hit_spans"]}


@pytest.mark.parametrize(("k", "dense"), [(4, 4), (5, -1000)])
def test_near_duplicates(spark, rows, k, dense):
    rng, sets = random.Random(8), {}
    base = words(rng, 70).split()  # a chain of near copies, only some of them near enough
    rows = list(rows)
    for n in range(30):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(70)] = words(rng, 1)
        rows.append((100 + n, " ".join(text)))
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = by_id(minhash.link(frame(spark, rows), k=k, dense=dense))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("dense", [4, -100])
def test_near_duplicate_blocks(spark, monkeypatch, dense):
    """A family under the threshold: its probes are cut into blocks as its members are."""
    base, sizes, meet = words(random.Random(9), 70).split(), [], minhash._meet
    rows = [(n, " ".join([*base[: 5 * n], f"own{n}", *base[5 * n + 1 :]])) for n in range(1, 14)]

    def seen(own):
        out = meet(own)
        sizes.extend(r["count"] for r in out.groupBy("key", "block", "part").count().collect())
        return out

    monkeypatch.setattr(minhash, "_meet", seen)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 600)
    got = by_id(minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), dense=dense))
    assert sizes and max(sizes) < 12 and all(r["kept"] for r in got.values())


def test_text_sets_memory():
    """A block of a dense bucket has some MB of text: its sets are those of one pass, in a fraction of the memory."""
    rng = np.random.default_rng(5)
    texts = [b"", *(b" ".join(b"w%d" % x for x in rng.integers(0, 50000, 400)) for _ in range(2200)), b"a b", b"", b"x " * 9]
    at = np.cumsum([0, *map(len, texts)])
    want = list(minhash.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), at, 5))
    tracemalloc.start()
    try:
        got = list(minhash.text_sets(texts, 5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(texts) == len(got) and all(map(np.array_equal, got, want))
    assert peak < 8 * at[-1]


def test_near_duplicate_null_ids(spark):
    got = minhash.link(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (2, "A  b c"), (2, "other words")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(False, 2, False), (False, 2, True), (False, 2, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (700, 12)).astype(np.float32)
    x[100:130] = x[100]  # ties
    data = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)] + [(800, None), (900, []), (1000, [float("nan")] * 12), (1100, [None] * 12), (None, [0.0] * 12), (1200, [0.0] * 12)]
    got = bitsliced.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), shard=200, query_block=3).collect()
    q = {i: np.floor(1024 * np.array(v, np.float64)).astype(int) for i, v in data if i is not None and v and None not in v and np.isfinite(np.array(v)).all()}
    want = []
    for i in q:
        if i % 100 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_top_k_repeated_ids(spark):
    """Each row of a repeated id is a query and a candidate of its own."""
    rng = np.random.default_rng(6)
    ids = [*range(1, 60), *[100] * 12, 200, 200]
    x = rng.normal(0, 0.2, (len(ids), 6))
    got = bitsliced.top_k(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), shard=20, query_block=5).collect()
    q, want = np.floor(1024 * x).astype(int), []
    for a, i in enumerate(ids):
        if i % 100 == 0:
            best = sorted((-int(q[a] @ q[b]), ids[b]) for b in range(len(ids)) if b != a)[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def library_ids(name, text, end):
    return library(name).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("cache", [1 << 20, 900, 60])
@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_token_ids(monkeypatch, name, kind, cache):
    """Batches of odd texts, with a table that holds all pieces and one that is soon full."""
    monkeypatch.setattr(tokens, "CACHE", cache)
    enc, whole, rng = tokens.Encoder(tokenizer_path(name), kind), library(name), random.Random(1)
    alphabet = "abC Z'sée\n\t  1٣½İΣσß中́ \x00\x1c\xa0\x85!?<|endoftext|>  ﬁ.,"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    odd += ["", " ", "  a", "a  b", "don't  stop", "<|endoftext|> hi", "hi <|endoftext|> there", "x<|startoftext|>y", "<|ENDOFTEXT|>", "ΟΔΟΣ ΣΑΣ", "a\n\n b", " a b ", "Ends. here, ok.", "long" * 9 + " end", "x" * 5000]
    rng.shuffle(odd)
    for i in range(0, len(odd), 300):
        raw = [t.encode() for t in odd[i : i + 300]]
        ids, at = enc.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, text in enumerate(odd[i : i + 300]):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packing(spark, rows):
    got = packing.pack_documents(frame(spark, rows), tokenizer_path("word_bpe_49k.json"), capacity=64, with_ids=True).collect()
    full = packing.sequences(spark.createDataFrame(got)).collect()
    seq = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in full}
    assert max(map(len, seq.values())) <= 64
    ids = {i: library_ids("word_bpe_49k.json", t, 0) for i, t in rows}
    assert len(seq) <= 1.05 * sum(map(len, ids.values())) / 64 + 1
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        part = seq[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert r["start"] == len(found[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        found[r["doc_id"]] += part.tolist()
    assert found == ids


def test_packing_memory(monkeypatch):
    """A batch of any size is encoded a MB at a time: two workers of an executor keep what that took."""
    class Docs:
        schema = {"doc_id": packing.T.StructField("doc_id", packing.T.LongType())}
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: E731, N815

    enc, seen = tokens.Encoder(tokenizer_path("word_bpe_49k.json"), "word"), []
    monkeypatch.setattr(packing, "encoder", lambda *_: enc)
    monkeypatch.setattr(enc, "ended", lambda data, at, end, own=enc.ended: (seen.append(len(data)), own(data, at, end))[1])
    texts = [words(random.Random(n), 150) for n in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": texts})
    parts = list(packing.token_pieces(Docs(), "-")([batch]))
    assert sum(seen) == sum(len(t.encode()) for t in texts) > 2 << 20 and max(seen) <= 1 << 20
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(4000))


def test_packing_repeated_rows(spark):
    """Equal rows are spread over the groups as any others are."""
    docs = spark.createDataFrame([(1, "the same words again")] * 4000, "doc_id long, text string")
    pieces = packing.materialize(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")), "pieces")
    got = packing.pack(pieces, group=500).groupBy("sequence_id").agg({"length": "sum"}).collect()
    groups = collections.Counter(r["sequence_id"] >> 32 for r in got)
    assert len(groups) == 8 and sum(r["sum(length)"] for r in got) == 20000 and max(r["sum(length)"] for r in got) <= 2048


def test_sum_of_squares_bounds():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 3000)
    own = packing.sum_of_squares(sizes, 100)
    fill = np.bincount(own, weights=sizes)
    assert fill.max() <= 100 and len(fill) <= 1.03 * sizes.sum() / 100 + 1


def test_token_files(spark, rows, tmp_path):
    where = str(tmp_path / "codes")
    huffman.encode_documents(frame(spark, rows[::-1]), tokenizer_path("byte_bpe_50k.json"), where)
    got, start = by_id(huffman.read(spark, where, with_ids=True)), 0
    for i, t in rows:
        ids = library_ids("byte_bpe_50k.json", t, 2)
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_huffman_blocks():
    rng = np.random.default_rng(0)
    for n, symbols in ((0, 5), (1, 1), (700, 1), (5000, 300), (30000, 40000)):
        ids = (rng.zipf(1.3, n) % symbols).astype(np.int64)
        counts = np.bincount(ids, minlength=symbols)
        lengths = huffman.code_lengths(counts)
        assert lengths.max(initial=0) <= huffman.LIMIT and sum(2.0 ** -lengths[lengths > 0]) <= 1
        codes = huffman.canonical(lengths)
        block = huffman.encode_block(ids, lengths, codes)
        assert (huffman.decode_block(block, huffman.decode_table(lengths, codes))[:n] == ids).all()


def labelled(spark, make, n=240):
    rng = random.Random(9)
    data = [(i, *make(rng, i)) for i in range(n)]
    return spark.createDataFrame(data, "doc_id long, text string, y string")


def test_language_id(spark):
    kinds = {"aa": "abcd", "bb": "defg", "cc": "ghia"}
    docs = labelled(spark, lambda rng, i: (words(rng, 60, kinds[k := list(kinds)[i % 3]]), k))
    model = langid.train(docs, docs.where("doc_id < 160"), label="y", per_class=60)
    got = langid.predict(docs, model).where("doc_id >= 160").collect()
    assert np.mean([r["y"] == r["lang_pred"] for r in got]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    odd = by_id(langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "abcd " * 5000)], "doc_id long, text string"), model))
    assert [odd[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and odd[4]["lang_pred"] == "aa"
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs, docs.limit(0), label="y")).collect()} == {"und"}


def test_quality(spark):
    docs = labelled(spark, lambda rng, i: (words(rng, 150) if i % 2 else "".join(x + "!! " for x in words(rng, 150).upper().split()), str(i % 2)))
    labels = docs.selectExpr("doc_id", "cast(y as int) quality")
    model = quality.train(docs, labels.where("doc_id < 160"))
    got = quality.score(docs, model, attention=True).where("doc_id >= 160").collect()
    assert all((r["score"] >= 0.5) == (r["y"] == "1") for r in got) and all(abs(sum(r["attention"]) - 1) < 1e-3 for r in got)
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000)], "doc_id long, text string"), model).collect()
    assert len(odd) == 3 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_toxicity(spark):
    def make(rng, i):
        w = words(rng, 80).split()
        if i % 2:
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(["zork" + words(rng, 1), "blag"]))
        return " ".join(w), str(i % 2)

    docs = labelled(spark, make, 400)
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(y as int) toxic").where("doc_id < 280"))
    got = toxicity.score(docs, model).where("doc_id >= 280").collect()
    assert np.mean([(r["score"] >= 0.7) == (r["y"] == "1") for r in got]) > 0.95
    hits = [r["text"].encode()[s["begin"] : s["end"]] for r in got for s in r["spans"]]
    assert np.mean([x.startswith((b"zork", b"blag")) for x in hits]) > 0.9
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000)], "doc_id long, text string"), model).collect()
    assert len(odd) == 3 and all(r["score"] < 0.5 and r["spans"] == [] for r in odd)
    assert toxicity.train(docs, docs.selectExpr("doc_id", "cast(null as int) toxic")) is None


def test_toxic_words_after_common_words(spark):
    """Insults that always follow the same few words; near copies of one toxic text do not make its words toxic."""
    rng, vocabulary = random.Random(12), words(random.Random(11), 3000, "abcdefghijklm").split()
    base, data = [rng.choice(vocabulary) for _ in range(100)], []
    for i in range(800):
        w = list(base) if i % 8 == 1 else [rng.choice(vocabulary) for _ in range(100)]
        for _ in range(6):
            at = rng.randint(0, len(w))
            w[at:at] = [rng.choice(["you", "are", "a", "the"]), rng.choice(["zorkwit", "blagno", "xupp"]) if i % 2 else rng.choice(vocabulary)]
        data.append((i, " ".join(w), str(i % 2)))
    docs = spark.createDataFrame(data, "doc_id long, text string, y string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(y as int) toxic").where("doc_id < 500"))
    got = toxicity.score(docs, model).where("doc_id >= 500").collect()
    caught = [r["score"] >= 0.7 for r in got if r["y"] == "1"]
    alarms = [r["score"] >= 0.7 for r in got if r["y"] == "0"]
    assert np.mean(caught) >= 0.9 and np.mean(alarms) <= 0.01
    hits = [r["text"].encode()[s["begin"] : s["end"]] for r in got for s in r["spans"]]
    assert np.mean([x.split()[-1] in (b"zorkwit", b"blagno", b"xupp") for x in hits]) > 0.9


def test_forward_backward_sums_over_all_taggings():
    import itertools

    rng, crf = np.random.default_rng(0), toxicity.ChainCRF()
    crf.trans, crf.start = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    e, real = rng.normal(0, 1.5, (3, 6)), np.ones((3, 6), bool)
    real[1, 4:] = False
    inside, pair = crf.marginals(e, real)
    want, pairs = np.zeros((3, 6)), np.zeros((2, 2))
    for k in range(3):
        n, total = int(real[k].sum()), 0.0
        own, both = np.zeros(6), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            weight = np.exp(crf.start[tags[0]] + sum(e[k, t] * tags[t] for t in range(n)) + sum(crf.trans[tags[t], tags[t + 1]] for t in range(n - 1)))
            total += weight
            own[:n] += weight * np.array(tags)
            for t in range(n - 1):
                both[tags[t], tags[t + 1]] += weight
        want[k], pairs = own / total, pairs + both / total
    assert np.allclose(inside, want) and np.allclose(pair, pairs)


def by_differences(params, loss, grads, rng, step=1e-5):
    """Largest gap between gradients and central differences at drawn places of each parameter."""
    worst = 0.0
    for name, g in grads.items():
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in params[name].shape)
            keep = params[name][at]
            params[name][at] = keep + step
            up = loss()
            params[name][at] = keep - step
            down = loss()
            params[name][at] = keep
            worst = max(worst, abs((up - down) / (2 * step) - g[at]))
    return worst


def test_attention_gradients():
    rng, model = np.random.default_rng(1), quality.AttentionMIL()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, bag, y = rng.normal(0, 1, (9, quality.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        q = model.forward(x, bag, 4)["q"]
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    assert by_differences(model.p, loss, model.gradients(x, bag, y), rng) < 1e-6


def test_convolution_gradients():
    rng, model = np.random.default_rng(2), langid.ByteConvNet(["a", "b", "c"])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(1, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    grads, params = model._step(x, y), model.p

    def loss():
        return -np.mean(np.log(model.predict(x, model.tables(np.float64))[np.arange(5), y]))

    embed = grads.pop("embed")
    assert by_differences(params, loss, grads, rng, 1e-6) < 1e-6
    for byte in (int(x[0, 0]), int(x[1, 7]), int(x[4, 21])):
        for d in range(langid.EMBED):
            keep = params["embed"][byte, d]
            params["embed"][byte, d] = keep + 1e-6
            up = loss()
            params["embed"][byte, d] = keep - 1e-6
            assert abs((up - loss()) / 2e-6 - embed[byte, d]) < 1e-6
            params["embed"][byte, d] = keep


def test_sample_is_drawn_by_hash(spark):
    """Texts late in the alphabet are drawn as often as others, and too many labels raise."""
    docs = spark.createDataFrame([(i, f"{i:04d}", i % 2) for i in range(2000)], "doc_id long, text string, y int")
    how = {"id_col": "doc_id", "text_col": "text", "label": "y", "window": 16, "windows": 1}
    drawn = [int(w[0]) for _, w in common.labelled_sample(docs, docs, per_class=300, **how)]
    assert len(drawn) > 500 and abs(np.mean(drawn) - 1000) < 100
    with pytest.raises(ValueError):
        common.labelled_sample(docs, docs, per_class=300, classes=1, **how)


def test_sample_is_the_same_under_any_partitioning(spark):
    """Each label gives its ``per_class`` least hashes, a rare one all it has; rows of one id give one, always the same."""
    rows = [(i, f"{i} {k}", "rare" if i % 100 == 0 else "often") for i in range(3000) for k in range(3 if i % 7 == 0 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels, draws = docs.select("doc_id", "y"), []
    for n in (1, 3, 11):
        got = common.labelled_sample(docs.repartition(n), labels.repartition(n + 1), id_col="doc_id", text_col="text", label="y", per_class=200, window=16, windows=1)
        draws.append([(y, w[0]) for y, w in got])
    assert draws[0] == draws[1] == draws[2]
    assert collections.Counter(y for y, _ in draws[0]) == {"often": 200, "rare": 30} and len({w.split()[0] for _, w in draws[0]}) == 230


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert linededup.drop_common_lines(none).count() == 0 and substrings.remove_repeats(none).count() == 0
    assert decontaminate.match(none, bench).count() == 0 and minhash.link(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert quality.score(none, None).count() == 0 and toxicity.score(none, None).count() == 0 and langid.predict(none, None).count() == 0
    assert bitsliced.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_empty_token_files(spark, tmp_path):
    huffman.encode_documents(spark.createDataFrame([], SCHEMA), tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "e"))
    assert huffman.read(spark, str(tmp_path / "e")).count() == 0


def linked(sets):
    """The least number that each set reaches over links of 80 per cent or more."""
    label = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def pipeline_by_hand(spark, docs, item, keep):
    """Kept (doc_id, text) after each middle stage, and the packed tokens of each row, by brute force."""
    blank = " \t\n\x0b\x0c\r"
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    key = lambda x: fold(x.strip(blank))
    rows = [(i, t) for i, t in docs if keep(t)]
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    lines = [(i, "\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < 10)) for i, t in rows]
    sets = []
    for _, t in lines:
        w = fold(t).encode().split()
        sets.append({tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set())
    groups = collections.defaultdict(list)
    for k, g in enumerate(linked(sets)):
        groups[g].append((lines[k][0] is None, lines[k][0] or 0, k))
    apart = [lines[min(own)[2]] for own in groups.values()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    w = split(item)
    windows = {tuple(w[s : s + 10]) for s in range(len(w) - 9)}
    clean = [(i, t) for i, t in apart if not any(tuple(split(t)[s : s + 10]) in windows for s in range(len(split(t))))]
    return lines, apart, clean


def test_pipeline_stages(spark, rows, tmp_path):
    """Each stage against brute force: nulls, empty and long texts, equal rows, rows of one id, null ids."""
    import corpus_pipeline

    text = rows[20][1]
    extra = [(3, rows[3][1]), (3, rows[20][1]), (3, rows[20][1]), (None, rows[8][1]), (None, None), (None, "a b c d e f g"), (500, "a b c d e f g"), (1, "")]
    docs, item, where = [*rows, *extra], rows[11][1], str(tmp_path)
    frame(spark, docs).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")  # one class: all stay
    want = pipeline_by_hand(spark, docs, item, lambda t: True)
    got, pick = spark.read.parquet(f"{where}/documents.parquet"), lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert text and pick(corpus_pipeline.STAGES[0][1](spark, got, where)) == collections.Counter(docs)
    for (name, stage), rest in zip(corpus_pipeline.STAGES[1:-1], want, strict=True):
        path = f"{where}/{name}"
        stage(spark, got, where).write.parquet(path)
        got = spark.read.parquet(path)
        assert got.columns == frame(spark, docs).columns, name
        assert pick(got) == collections.Counter(rest), name
    packed = corpus_pipeline.run(spark, where).collect()
    sizes = collections.Counter(len(library_ids("word_bpe_49k.json", t, 0)) for _, t in want[-1])
    whole = collections.Counter()
    for r in packed:
        assert 0 <= r["offset"] and r["offset"] + r["length"] <= 2048
        whole[r["doc_id"]] += r["length"]
    assert sum(whole.values()) == sum(n * k for n, k in sizes.items())
    for i, t in want[-1]:
        if sum(j == i for j, _ in want[-1]) == 1:
            assert whole[i] == len(library_ids("word_bpe_49k.json", t, 0))


def test_pipeline_rejects_low_quality(spark, tmp_path):
    """With labels, the rows under 0.7 go, and those are the rejected ones by their labels."""
    import corpus_pipeline

    good = labelled(spark, lambda rng, i: (words(rng, 150) if i % 2 else "".join(x + "!! " for x in words(rng, 150).upper().split()), str(i % 2)))
    good.write.parquet(f"{tmp_path}/documents.parquet")
    good.selectExpr("doc_id", "cast(y as int) quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r["y"] for r in kept} == {"1"} and len(kept) > 110


def test_pipeline_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query(spark, tmp_path):
    """The registered queries on tables as the driver's: digests follow from the operators' own results."""
    from shopweave.llm import queries

    rng, where = random.Random(21), str(tmp_path)
    passage = words(rng, 150)
    texts = [f"{words(rng, 90)}\n{passage if i % 4 == 0 else words(rng, 60)}" for i in range(60)] + [None, "", "x" * 900, "y " * 3000]
    texts[7] = texts[5]
    docs = [(i, t, ["en", "de"][i % 2], "s") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic").write.parquet(f"{where}/labels.parquet")
    held = {m: {i: zlib.crc32(str(i).encode()) % m for i in range(len(docs))} for m in (3, 4)}
    for name, m, rest in (("op1_langid", 4, 2), ("op2_quality", 4, 2), ("op10_toxicity", 3, 1)):
        got = by_id(queries.QUERIES[name](spark, where))
        assert {i: r["held_out"] for i, r in got.items()} == {i: k == rest for i, k in held[m].items()}
        assert all(0 <= r["score"] <= 1 for r in got.values())
        assert name == "op1_langid" or all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    raw = {i: (t or "").encode() for i, t, *_ in docs}
    seen = collections.Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    got = by_id(queries.op3_repeats(spark, where))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    assert any(r["n_removed"] for r in got.values())
    pieces = queries.op4_packing(spark, where).collect()
    ids = {i: library_ids("word_bpe_49k.json", t, 0) for i, t, *_ in docs}
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == sorted(
        (i, p, a, len(x[a : a + 2048]), zlib.crc32(np.array(x[a : a + 2048], "<u4").tobytes())) for i, x in ids.items() for p, a in enumerate(range(0, len(x), 2048)))
    got, start = by_id(queries.op9_token_codes(spark, where)), 0
    for i, t, *_ in docs:
        x = np.array(library_ids("byte_bpe_50k.json", t, 2), "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    sets = []
    for _, t, *_ in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[s : s + 4]) for s in range(max(1, len(w) - 3))} if w else set())
    got = by_id(queries.op7_near_dup(spark, where))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(x), c, c == i) for i, (x, c) in enumerate(zip(sets, linked(sets), strict=True))}
