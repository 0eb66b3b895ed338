"""Toxicity by a linear-chain conditional random field.

Words are tagged inside or outside a toxic span. Token labels come from the document
labels: words that are far likelier in toxic than in clean training documents, copies
counted once, are inside where the document is toxic. Forward-backward marginals of all tokens aggregate to a
document score, calibrated on the training documents, and give the offending offsets.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import minhash
from .common import Adam, labelled_sample, sigmoid, small_batches

#: Bytes of words: ASCII letters, digits, and all bytes of other letters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Prefix lengths in bytes whose weights inflected forms of a word share.
STEMS = (4, 5, 6, 7)
FEATURES = 2 + len(STEMS)
#: Tokens of one chain; a text is cut into consecutive chains of this length.
CHAIN = 64
#: Largest marginals of a text that its score is made of.
TOP = 3
BUCKETS = 1 << 14


def _bucket(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) % (BUCKETS - 1) + 1


def stems(word: bytes) -> list[bytes]:
    """Prefixes of a word, marked as such; the whole word for lengths that it lacks."""
    return [word[:k] + b"*" for k in STEMS]


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Begins, ends and lower-cased bytes of all words; none spans two rows."""
    mask = np.zeros(len(data) + 1, bool)
    mask[:-1] = WORD_BYTE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.concatenate([[False], mask[:-1]])
    begin = np.flatnonzero(mask & (~before | cut))
    end = np.flatnonzero(before & (~mask | cut))
    raw = data.tobytes().lower()
    return begin, end, [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


class ChainCRF:
    """Two tags; emissions add the weights of a word, its affixes and its neighbours."""

    def __init__(self):
        self.weight = np.zeros((3, BUCKETS))  # previous word, the word itself, next word
        self.affix = np.zeros(BUCKETS)
        self.bias, self.trans, self.start = np.array([-2.0]), np.zeros((2, 2)), np.zeros(2)
        self.calibration = np.array([0.0, 0.0, 0.0])
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[bytes, int] = {}
        self._ids = np.zeros((1 << 12, FEATURES), np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def ids(self, words: list[bytes]) -> np.ndarray:
        """(n, FEATURES) buckets: the word, its stems, its suffix."""
        if len(self._rows) > 300_000:
            self._forget()
        known = self._rows
        for w in set(words).difference(known):
            k = known[w] = len(known)
            if k == len(self._ids):
                self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            self._ids[k] = [_bucket(x) for x in (w, *stems(w), w[-4:] + b">")]
        return self._ids[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Log-odds of the inside tag for chains ``ids`` (n, CHAIN, FEATURES); bucket 0 pads."""
        word, side = ids[..., 0], np.zeros(ids.shape[:2])
        side[:, 1:] += self.weight[0][word[:, :-1]]
        side[:, :-1] += self.weight[2][word[:, 1:]]
        return self.bias[0] + self.weight[1][word] + self.affix[ids[..., 1:]].sum(-1) + side

    def marginals(self, e: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inside marginals (n, CHAIN) and summed transition marginals (2, 2) by forward-backward."""
        n, m = e.shape
        psi = np.exp(self.trans)
        emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
        alpha, beta = np.empty((m, n, 2)), np.ones((m, n, 2))
        a = np.exp(self.start) * emit[:, 0]
        alpha[0] = a / a.sum(1, keepdims=True)
        for t in range(1, m):
            a = (alpha[t - 1] @ psi) * emit[:, t]
            alpha[t] = a / a.sum(1, keepdims=True)
        for t in range(m - 2, -1, -1):
            b = (beta[t + 1] * emit[:, t + 1]) @ psi.T
            b /= b.sum(1, keepdims=True)
            beta[t] = np.where(real[:, t + 1, None], b, 1.0)
        p = alpha * beta
        inside = (p[..., 1] / p.sum(2)).T
        pair = alpha[:-1, :, :, None] * psi * (beta[1:] * emit.transpose(1, 0, 2)[1:])[:, :, None, :]
        pair = pair / pair.sum((2, 3), keepdims=True) * real.T[1:, :, None, None]
        return np.where(real, inside, 0.0), pair.sum((0, 1))

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, seed: int = 0) -> ChainCRF:
        """Gradient ascent on the likelihood of ``tags`` (n, CHAIN)."""
        rng = np.random.default_rng(seed)
        params = {"weight": self.weight, "affix": self.affix, "bias": self.bias, "trans": self.trans, "start": self.start}
        opt, real = Adam(params, rate), ids[..., 0] > 0
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for i in range(0, len(order), batch):
                x, y, r = ids[pick := order[i : i + batch]], tags[pick], real[pick]
                p, pair = self.marginals(self.emissions(x), r)
                d, n = (p - y) * r, max(1, r.sum())
                g = {k: np.zeros_like(v) for k, v in params.items()}
                word = x[..., 0]
                np.add.at(g["weight"][1], word, d)
                np.add.at(g["weight"][0], word[:, :-1], d[:, 1:])
                np.add.at(g["weight"][2], word[:, 1:], d[:, :-1])
                for k in range(1, FEATURES):
                    np.add.at(g["affix"], x[..., k], d)
                g["bias"][0] = d.sum()
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:, :-1][r[:, 1:]], y[:, 1:][r[:, 1:]]), 1)
                g["trans"] = pair - seen
                g["start"][1] = d[:, 0].sum()
                g["start"][0] = -g["start"][1]
                for v in (g["weight"], g["affix"]):
                    v[..., 0] = 0
                opt.step({k: v / n * 64 + decay * params[k] for k, v in g.items()})
        return self

    def tag(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's row, begin, end and inside marginal, for rows of ``data`` cut at ``at``."""
        begin, end, words = words_of(data, at)
        row = np.searchsorted(at, begin, side="right") - 1
        if not words:
            return row, begin, end, np.zeros(0)
        count = np.bincount(row, minlength=len(at) - 1)
        chains = -(-count // CHAIN)
        first = np.cumsum(chains) - chains
        place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
        chain, spot = np.repeat(first, count) + place // CHAIN, place % CHAIN
        ids = np.zeros((int(chains.sum()), CHAIN, FEATURES), np.int32)
        ids[chain, spot] = self.ids(words)
        p, _ = self.marginals(self.emissions(ids), ids[..., 0] > 0)
        return row, begin, end, p[chain, spot]

    def document_features(self, row: np.ndarray, p: np.ndarray, rows: int) -> np.ndarray:
        """(rows, 2): the largest marginal, and the mean of the ``TOP`` largest; absent ones count as 0.

        Neither grows with the length of a text by itself: faint marginals never add up.
        """
        order = np.lexsort((-p, row))
        place = np.arange(len(row)) - np.searchsorted(row, row)  # within the row; ``row`` ascends
        best = np.zeros((rows, TOP))
        first = place < TOP
        best[row[first], place[first]] = p[order][first]
        return np.stack([best[:, 0], best.mean(1)], 1)

    def document_scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ self.calibration[:2] + self.calibration[2])


def copy_groups(texts: list[bytes]) -> list[int]:
    """The same number for texts that are copies or near copies, by eight bands of two shingle minima."""
    first: dict[tuple, int] = {}
    group = list(range(len(texts)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = k = group[group[k]]
        return k

    for k, text in enumerate(texts):
        own = next(minhash.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 4))
        if len(own):
            least = minhash.signature(own)[:16].tolist()
            for band in range(8):
                other = root(first.setdefault((band, least[2 * band], least[2 * band + 1]), k))
                group[max(other, root(k))] = min(other, root(k))
    return [root(k) for k in range(len(texts))]


def toxic_words(documents: list[tuple[int, list[bytes], int]], share: float = 0.01, odds: float = 20.0) -> set[bytes]:
    """Words and stems far likelier in toxic documents (label, words, copy group).

    One is taken if ``share`` of the toxic copy groups or more have it, and its smoothed odds
    over groups are ``odds`` or more. Groups count once: copies of one toxic document
    would make all its words likely.
    """
    held: dict[tuple[int, int], set[bytes]] = {}
    for y, words, group in documents:
        held.setdefault((y, group), set()).update(words)
    counts, total = {0: Counter(), 1: Counter()}, Counter(y for y, _ in held)
    for (y, _), words in held.items():
        counts[y].update(words | {x for w in words for x in stems(w)})
    rate = lambda w, y: (counts[y][w] + 0.5) / (total[y] + 1)
    least = max(3, share * total[1])
    return {w for w, n in counts[1].items() if n >= least and rate(w, 1) >= odds * rate(w, 0)}


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = 2000, window: int = 2048, windows: int = 4, chains: int = 4) -> ChainCRF | None:
    """Fit on at most ``per_class`` labelled texts of each class; None without both classes.

    A text is learned from ``windows`` stretches of ``window`` bytes spread evenly over it. The chains
    that hold a toxic word all train; of a text's other chains ``chains`` do, drawn at random.
    """
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label=label, per_class=per_class, window=window, windows=windows)
    y = np.array([int(bool(k)) for k, _ in rows])
    if len(set(y)) < 2:
        return None
    texts = [b"\n".join(w) for _, w in rows]
    shared: dict[bytes, bytes] = {}  # one object a word: the driver's memory is small
    tokens = [[shared.setdefault(w, w) for w in words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[2]] for t in texts]
    toxic = toxic_words([(int(k), t, g) for k, t, g in zip(y, tokens, copy_groups(texts), strict=True)])
    model, ids, tags, rng = ChainCRF(), [], [], np.random.default_rng(3)
    for k, words in zip(y, tokens, strict=True):
        inside = np.array([k == 1 and (w in toxic or not toxic.isdisjoint(stems(w))) for w in words], np.int64)
        got, at = model.ids(words), range(0, len(words), CHAIN)
        plain = [i for i in at if not inside[i : i + CHAIN].any()]
        drawn = set(rng.permutation(plain)[:chains].tolist())
        for i in at:
            if i in drawn or inside[i : i + CHAIN].any():
                x, t = np.zeros((CHAIN, FEATURES), np.int32), np.zeros(CHAIN, np.int64)
                m = len(words[i : i + CHAIN])
                x[:m], t[:m] = got[i : i + m], inside[i : i + m]
                ids.append(x)
                tags.append(t)
    if not ids:
        return None
    model.fit(np.array(ids), np.array(tags, np.int8))
    del tokens, shared, ids, tags
    f = np.zeros((len(texts), 2))
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        row, _, _, p = model.tag(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
        f[i : i + len(part)] = model.document_features(row, p, len(part))
    params = {"c": np.zeros(3)}
    opt, x = Adam(params, 0.1), np.column_stack([f, np.ones(len(f))])
    for _ in range(400):
        q = sigmoid(x @ params["c"])
        opt.step({"c": x.T @ (q - y) / len(y) + 1e-3 * params["c"]})
    model.calibration = params["c"]
    return model


def score(docs: DataFrame, model: ChainCRF | None, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (how likely label 1 is) and ``spans``.

    ``spans`` are the [begin, end) byte offsets of words whose marginal is ``threshold`` or
    more, adjacent ones joined, over the whole text. Null texts and texts without words get
    the score of no toxic word and no spans. Without a model every score is 0.0.
    """
    new = [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))]
    fields = [f for f in docs.schema if f.name not in {f.name for f in new}]
    schema, keep = T.StructType([*fields, *new]), [f.name for f in fields]
    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch, data, at in small_batches(batches, text_col, 1 << 20):
            n = batch.num_rows
            q, spans = np.zeros(n), [[] for _ in range(n)]
            if model:
                row, begin, end, p = model.tag(data, at)
                q = model.document_scores(model.document_features(row, p, n))
                last = -2
                for k in np.flatnonzero(p >= threshold):
                    own = spans[row[k]]
                    a, b = int(begin[k] - at[row[k]]), int(end[k] - at[row[k]])
                    if last == k - 1 and own:
                        own[-1]["end"] = b
                    else:
                        own.append({"begin": a, "end": b})
                    last = k
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(q, pa.float64()), pa.array(spans, pa.list_(pair))], names=schema.names)

    return docs.mapInArrow(run, schema)
