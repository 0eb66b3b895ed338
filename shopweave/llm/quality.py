"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded as byte and byte-class counts
through one tanh layer; gated attention, learned from document labels alone, weighs the
passages, and a logistic unit scores the weighted representation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Adam, labelled_sample, sigmoid, small_batches

PASSAGE, HIDDEN, ATTEND = 512, 32, 16

#: Byte classes of the pair counts: letters by case, digits, white space, single punctuation, high bytes.
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASS = np.zeros(256, np.int64)
CLASS[ord("a") : ord("z") + 1], CLASS[ord("A") : ord("Z") + 1], CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
CLASS[[9, 11, 12, 13, 32]], CLASS[10], CLASS[128:] = 4, 5, 6
for _k, _b in enumerate(_PUNCT):
    CLASS[_b] = 7 + _k
CLASSES = int(CLASS.max()) + 1
PAIRS = 7 + 1  # in pairs all punctuation is one class
FEATURES = 256 + PAIRS * PAIRS * 2 + 2


def encode(data: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Features of ``count`` passages; ``owner`` gives each byte's passage, in order."""
    size = np.bincount(owner, minlength=count)
    single = np.bincount(owner * 256 + data, minlength=count * 256).reshape(count, 256)
    kind = np.minimum(CLASS[data], 7)
    same, fine = owner[1:] == owner[:-1], CLASS[data]
    pair = owner[1:] * PAIRS * PAIRS + kind[1:] * PAIRS + kind[:-1]
    pairs = np.bincount(pair[same], minlength=count * PAIRS * PAIRS).reshape(count, -1)
    repeat = np.bincount(pair[same & (fine[1:] == fine[:-1])], minlength=count * PAIRS * PAIRS).reshape(count, -1)
    per = np.concatenate([single, pairs, repeat], 1) / np.maximum(size, 1)[:, None]
    more = np.stack([np.log1p(size) / 6, (single > 0).sum(1) / 64], 1)
    return np.concatenate([np.sqrt(per), more], 1).astype(np.float32)


def encode_bags(bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and each passage's bag; a part at a time, as the driver's memory is small."""
    flat = [p for bag in bags for p in bag]
    x = np.zeros((len(flat), FEATURES), np.float32)
    for i in range(0, len(flat), 1000):
        part = flat[i : i + 1000]
        owner = np.repeat(np.arange(len(part)), [len(p) for p in part])
        x[i : i + len(part)] = encode(np.frombuffer(b"".join(part), np.uint8), owner, len(part))
    return x, np.repeat(np.arange(len(bags)), [len(b) for b in bags])


class AttentionMIL:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTEND), "U": (HIDDEN, ATTEND), "w": (ATTEND,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """``bag`` is sorted and every bag has a passage."""
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        first = np.searchsorted(bag, np.arange(bags))
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "q": sigmoid(z @ p["c"] + p["d"][0])}

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over bags with the labels ``y``."""
        p, f = self.p, self.forward(x, bag, len(y))
        dz = (f["q"] - y)[:, None] / len(y)
        grads = {"c": (f["z"] * dz).sum(0), "d": dz.sum(keepdims=True)[0]}
        dZ = (dz * p["c"])[bag]
        da = (dZ * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, np.searchsorted(bag, np.arange(len(y))))[bag])
        grads["w"] = ((f["t"] * f["g"]) * de[:, None]).sum(0)
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        grads["V"], grads["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["a"][:, None] * dZ + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        grads["W"], grads["b"] = ((x - self.mean) / self.scale).T @ dh, dh.sum(0)
        return grads

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.003, decay: float = 1e-4, seed: int = 0) -> AttentionMIL:
        rng, opt, n = np.random.default_rng(seed), Adam(self.p, rate), len(y)
        self.mean = x.mean(0)
        self.scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) - self.mean**2 + 1e-12) + 0.05
        first = np.searchsorted(bag, np.arange(n + 1))
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                pick = order[i : i + batch]
                rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in pick])
                own = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
                grads = self.gradients(x[rows], own, y[pick])
                grads["W"] += decay * self.p["W"]
                opt.step({k: v.astype(np.float32) for k, v in grads.items()})
        return self


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = 1500, passages: int = 16) -> AttentionMIL | None:
    """Fit on at most ``per_class`` labelled texts of each class, ``passages`` of each; None without both classes."""
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label=label, per_class=per_class, window=PASSAGE, windows=passages)
    y = np.array([1.0 if k else 0.0 for k, _ in rows])
    if len(set(y)) < 2:
        return None
    x, bag = encode_bags([bags for _, bags in rows])
    return AttentionMIL().fit(x, bag, y)


def score(docs: DataFrame, model: AttentionMIL | None, *, text_col: str = "text", attention: bool = False) -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is, from every passage of every whole text.

    Null and empty texts are one empty passage. Without a model every score is 0.5. With
    ``attention``, the weights of the passages are in the array ``attention``.
    """
    new = [T.StructField("score", T.DoubleType()), *([T.StructField("attention", T.ArrayType(T.FloatType()))] if attention else [])]
    fields = [f for f in docs.schema if f.name not in {f.name for f in new}]
    schema = T.StructType([*fields, *new])
    keep = [f.name for f in fields]

    def run(batches):
        for batch, data, at in small_batches(batches, text_col, 1 << 20):
            n, lens = batch.num_rows, np.diff(at)
            count = np.maximum(1, -(-lens // PASSAGE))
            bag, first = np.repeat(np.arange(n), count), np.cumsum(count) - count
            owner = np.repeat(first, lens) + (np.arange(len(data)) - np.repeat(at[:-1], lens)) // PASSAGE
            q, a = np.full(n, 0.5), np.repeat(1.0 / count, count)
            if model:
                f = model.forward(encode(data, owner, len(bag)), bag, n)
                q, a = f["q"].astype(float), f["a"]
            cols = [*[batch.column(c) for c in keep], pa.array(q, pa.float64())]
            if attention:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(bag)), pa.int32()), pa.array(a, pa.float32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
