"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from shopweave.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score double, rank string, query string, n long, terms string", "item_id long, text string, doc_id string, rank int"


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k):
    words = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = collections.Counter(x for _, w in words for x in set(w))
    out = []
    for item, text in items:
        query, scored = split(text), []
        for i, w in words:
            tf = collections.Counter(w)
            m = 75 + (25 * len(w) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in query if tf[x])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"shard_postings": 40}, {"block_bytes": 30}])
def test_rank(spark, how):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "a", "b", "É", "x1", "Long", *[f"w{rng.randint(0, 60)}"] * 3])
    texts = [None, "", " .,;", "the the THE", "ß É\x85x [y]_z"] + [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(150)]
    docs = [*enumerate(texts), (7, texts[7]), (7, texts[7]), (None, texts[9]), (None, "w1 the")]
    items = [(0, "the w1 w2 É"), (1, "w3 w3 w3 the"), (2, None), (3, "..."), (4, "nowhere"), (None, "x1"), (5, texts[20]), (5, texts[20]), (6, "Long long LONG")]
    frame = spark.createDataFrame([(i, t, 0.5, "r", "q", 3, "t") for i, t in docs], DOCS).repartition(3)
    got = ranking.rank(frame, spark.createDataFrame([(i, t, "d", 1) for i, t in items], ITEMS), k=7, **how).collect()
    assert sorted(map(tuple, got), key=str) == expected(docs, items, 7)


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a", "d", 1)], ITEMS)
    assert ranking.rank(docs, items).count() == 0 and ranking.rank(docs, one).count() == 0


def test_best_positions_stop_early():
    """The lists are not read to their ends, and the answer is still that of all documents."""
    rng = np.random.default_rng(3)
    size, lists = 20000, 4
    doc, term = np.tile(np.arange(size), lists), np.repeat(np.arange(lists), size)
    impact = (rng.pareto(1.5, size * lists) * 1000).astype(np.int64)
    shard = ranking.Shard(size, doc, term, impact)
    times, ids = np.array([1, 2, 1, 1]), rng.permutation(size)
    found, scores, met = shard.top(np.arange(lists), times, ids, 10)
    total = times @ impact.reshape(lists, size)
    order = np.lexsort((ids, -total))[:10]
    assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist() and met < size // 2


def test_ties_are_read_past_the_bound():
    """Equal scores: the smaller ids win though their documents stand last in the lists."""
    size = 500
    shard = ranking.Shard(size, np.arange(size), np.zeros(size, np.int64), np.full(size, 9))
    found, *_ = shard.top(np.array([0]), np.array([1]), np.arange(size)[::-1], 5)
    assert found.tolist() == [499, 498, 497, 496, 495]


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(ranking, "PIECE_BYTES", 7)
    text = "Abc déf_ghi jkl ÉÉÉÉÉÉÉ mno"
    assert [t.decode() for piece in ranking.terms(text) for t in piece] == split(text)
