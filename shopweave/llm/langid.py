"""Language identification by a byte convolutional network.

Filters of several widths slide over fixed-length byte windows, each filter keeps its
maximum over the window, and a softmax layer reads the maxima. The network is trained in
numpy on a bounded, language-balanced sample of labelled text. At prediction time a
filter over one-hot bytes is a sum of table rows, so a window needs a few gathers only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, labelled_sample, small_batches, to_arrow

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 8, 256


class ByteConvNet:
    """Parameters in numpy; ``classes`` is the sorted list of learned labels."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))), "bias": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"shift{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross entropy over windows ``x`` (n, WINDOW)."""
        n, e, p = len(x), self.p["embed"][x], self.p
        kept, pooled = [], []
        for w in WIDTHS:
            m = x.shape[1] - w + 1
            cols = np.concatenate([e[:, j : j + m] for j in range(w)], axis=2)
            z = cols @ p[f"conv{w}"] + p[f"shift{w}"]
            at = z.argmax(1)
            kept.append((w, cols, at))
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        s = a @ p["out"] + p["bias"]
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": a.T @ q, "bias": q.sum(0), "embed": np.zeros_like(p["embed"])}
        back = (q @ p["out"].T) * (h > 0)
        for k, (w, cols, at) in enumerate(kept):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            chosen = cols[np.arange(n)[:, None], at]  # (n, FILTERS, w * EMBED)
            g[f"conv{w}"] = np.einsum("nf,nfd->df", d, chosen)
            g[f"shift{w}"] = d.sum(0)
            de = (d[:, :, None] * p[f"conv{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["embed"], np.take_along_axis(x, at + j, 1).ravel(), de[:, :, j].reshape(-1, EMBED))
        g["embed"][0] = 0
        return g

    def fit(self, windows: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 0) -> ByteConvNet:
        rng, opt = np.random.default_rng(seed), Adam(self.p, rate)
        self.p["embed"][0] = 0
        full = np.zeros((len(windows), WINDOW), np.uint8)
        for k, x in enumerate(windows):
            full[k, : len(x)] = np.frombuffer(x[:WINDOW], np.uint8)
        for _ in range(epochs):
            order = rng.permutation(len(full))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x = full[pick].copy()
                for row in np.flatnonzero(rng.random(len(x)) < 0.5):  # short windows too
                    x[row, rng.integers(24, WINDOW) :] = 0
                opt.step(self._step(x, y[pick]))
        return self

    def tables(self, dtype=np.float32) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, (offset, table over byte pairs or single bytes) to add up."""
        out = []
        for w in WIDTHS:
            rows = [self.p["embed"] @ self.p[f"conv{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            rows[0] = rows[0] + self.p[f"shift{w}"]
            parts = [(j, (rows[j][:, None] + rows[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                parts.append((w - 1, rows[w - 1]))
            out.append([(j, np.ascontiguousarray(t, dtype)) for j, t in parts])
        return out

    def predict(self, x: np.ndarray, tables: list | None = None) -> np.ndarray:
        """Class probabilities of windows ``x`` (n, WINDOW) of bytes, 0 past a text's end."""
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables or self.tables(), strict=True):
            m = x.shape[1] - w + 1
            z = None
            for j, table in parts:
                got = table[(pairs if len(table) > 256 else x)[:, j : j + m]]
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(1))
        s = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["out"] + self.p["bias"]
        q = np.exp(s - s.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "lang", per_class: int = 500) -> ByteConvNet | None:
    """Fit on at most ``per_class`` texts of each label, two windows of each; None if there are none."""
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label=label, per_class=per_class, window=WINDOW, windows=2)
    pairs = [(y, x) for y, xs in rows for x in xs if x]
    if not pairs:
        return None
    classes = sorted({str(y) for y, _ in pairs})
    return ByteConvNet(classes).fit([x for _, x in pairs], np.array([classes.index(str(y)) for y, _ in pairs]))


def predict(docs: DataFrame, model: ByteConvNet | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from every window of every whole text.

    A text's probabilities are those of its windows, weighted by their bytes. Null texts
    and texts without a letter give ``und`` and 0.0, as does a model trained on nothing.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in docs.schema if f.name not in ("lang_pred", "score")], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    keep = [f.name for f in docs.schema if f.name not in ("lang_pred", "score")]

    def score(batches):
        tables = model.tables() if model else None
        for batch, data, at in small_batches(batches, text_col, 1 << 19):
            n = batch.num_rows
            lang, best = ["und"] * n, np.zeros(n)
            if model and len(data):
                lens = np.diff(at)
                count = -(-lens // WINDOW)
                doc = np.repeat(np.arange(n), count)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start, size = at[:-1][doc] + k * WINDOW, np.minimum(WINDOW, lens[doc] - k * WINDOW)
                total = np.zeros((n, len(model.classes)))
                padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
                for i in range(0, len(doc), 128):
                    j = slice(i, i + 128)
                    x = padded[start[j, None] + np.arange(WINDOW)]
                    x[np.arange(WINDOW)[None] >= size[j, None]] = 0
                    q = model.predict(x, tables) * size[j, None]
                    np.add.at(total, doc[j], q)
                full = lens > 0
                total[full] /= lens[full, None]
                pick = total.argmax(1)
                lang = [model.classes[p] if ok else "und" for p, ok in zip(pick, full, strict=True)]
                best = np.where(full, np.minimum(total.max(1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(best, pa.float64())], names=[*keep, "lang_pred", "score"])

    # RLIKE stays in the JVM; the network still sees whole texts only where there is a letter.
    letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    out = docs.mapInArrow(score, schema)
    return out.withColumns({"lang_pred": F.when(letters, F.col("lang_pred")).otherwise("und"), "score": F.when(letters, F.col("score")).otherwise(0.0)})
