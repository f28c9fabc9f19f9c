"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (character classes, punctuation, word
lengths, repetition; then a learned layer), gated attention learns from document labels which passages count,
and the weighted sum of the encoded passages gives the score.

Null or empty text is one empty passage. Labels that are null are not used; several for a document count as
their mean. With labels of one kind only, or none, every score is that share (0.5 without labels). Repeated rows
get equal scores; rows are never dropped; other columns pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import _words as W
from foliospark.llm._rows import saved

PASSAGE = 64
#: At most so many labelled documents are learned from, chosen by a hash of id and text.
LEARN_DOCUMENTS = 8_000
#: Of a longer document, so many passages are learned from, evenly spaced. Scores use all passages.
LEARN_PASSAGES = 256
THRESHOLD = 0.3

_PUNCT = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_PLACE = np.full(256, -1, np.int64)
_PLACE[_PUNCT] = np.arange(len(_PUNCT))
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
FEATURES = len(_PUNCT) + 10


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of a slice of texts, and each text's bounds among them."""
    starts, ends, bounds = W.spans(data, offs)
    counts = np.diff(bounds)
    n = np.maximum(1, -(-counts // PASSAGE))
    at = np.concatenate([[0], np.cumsum(n)])
    total = int(at[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return x, at
    inside = np.arange(len(starts)) - np.repeat(bounds[:-1], counts)
    pid = inside // PASSAGE + np.repeat(at[:-1], counts)
    words = np.bincount(pid, minlength=total).astype(np.float64)
    opened = np.searchsorted(pid, np.arange(total))
    begin = np.where(words > 0, starts[np.minimum(opened, len(starts) - 1)], 0)
    last = np.searchsorted(pid, np.arange(total), "right") - 1
    finish = np.where(words > 0, ends[np.maximum(last, 0)], 0)
    size = np.maximum(finish - begin, 1).astype(np.float64)

    marks = np.flatnonzero(_PLACE[data] >= 0)
    mark_pid = np.searchsorted(begin[words > 0], marks, "right") - 1
    full = np.flatnonzero(words > 0)
    ok = mark_pid >= 0
    cells = full[mark_pid[ok]] * len(_PUNCT) + _PLACE[data[marks[ok]]]
    x[:, : len(_PUNCT)] = np.sqrt(np.bincount(cells, minlength=total * len(_PUNCT)).reshape(total, -1) / size[:, None])

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (sums[finish] - sums[begin]) / size

    length = (ends - starts).astype(np.float64)
    per = np.maximum(words, 1)
    mean = np.bincount(pid, length, total) / per
    h = W.hashes(data, starts, ends)
    keys = np.sort((pid.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate([first, [len(keys)]]))
    run_pid = (keys[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(total)
    np.maximum.at(top, run_pid, runs)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (pid[1:] == pid[:-1])
    k = len(_PUNCT)
    x[:, k] = share(_LETTER)
    x[:, k + 1] = share(_UPPER)
    x[:, k + 2] = share(_DIGIT)
    x[:, k + 3] = mean / 10
    x[:, k + 4] = np.sqrt(np.maximum(np.bincount(pid, length**2, total) / per - mean**2, 0)) / 10
    x[:, k + 5] = np.bincount(run_pid, minlength=total) / per
    x[:, k + 6] = top / per
    x[:, k + 7] = np.bincount(pid, again, total) / per
    x[:, k + 8] = words / PASSAGE
    x[:, k + 9] = np.bincount(pid, length <= 3, total) / per
    return x, at


class Model:
    """p = sigmoid(c . z + d), z = sum of a_k h_k, a = softmax over the bag of w . (tanh(V h) * sigmoid(U h)),
    h = tanh(A x + b)."""

    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "A": r.normal(0, FEATURES**-0.5, (FEATURES, hidden)), "b": np.zeros(hidden),
            "V": r.normal(0, hidden**-0.5, (hidden, attention)), "U": r.normal(0, hidden**-0.5, (hidden, attention)),
            "w": r.normal(0, 0.1, attention), "c": r.normal(0, 0.1, hidden), "d": np.zeros(()),
        }
        self.constant: float | None = None

    def forward(self, x: np.ndarray, at: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["A"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        n = np.diff(at)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), n))
        a /= np.repeat(np.add.reduceat(a, at[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, at[:-1])
        return x, h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -60, 60)))

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.full(len(at) - 1, self.constant) if self.constant is not None else self.forward(x, at)[-1]

    def fit(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean = x.mean(0, dtype=np.float64)
        self.scale = x.std(0, dtype=np.float64, mean=self.mean[None, :]) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, step = np.random.default_rng(11), 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), batch):
                docs = order[i : i + batch]
                n = (at[1:] - at[:-1])[docs]
                part = np.concatenate([[0], np.cumsum(n)])
                rows = np.arange(part[-1]) - np.repeat(part[:-1], n) + np.repeat(at[docs], n)
                step += 1
                for k, grad in self.gradient(x[rows].astype(np.float64), part, y[docs]).items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v2[k] = 0.99 * v2[k] + 0.01 * grad**2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def gradient(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, g, a, z, prob = self.forward(x, at)
        n = np.diff(at)
        out = (prob - y) / len(y)
        dz = np.repeat(out[:, None] * p["c"], n, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at[:-1]), n))
        dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"A": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out, "d": out.sum()}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = LEARN_DOCUMENTS, most: int = LEARN_PASSAGES) -> Model:
    """A model from ``labels`` (key, label 0/1) of ``docs``; the bounded sample of labels goes to where the texts are. At
    most ``bound`` documents, a text under a key counting once however often it stands there, and ``most`` passages of
    each, in single precision, are held at once. Labels and documents are chosen by hashes."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    total = max(1, known.count())
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    sample = known.where(hashed < int(min(1.0, 1.05 * bound / total) * (1 << 30))).orderBy(hashed, "key").limit(bound)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th")).join(F.broadcast(sample), "key")
    picked = saved(found.select("key", "th").distinct().orderBy(F.xxhash64("key", "th"), "key", "th").limit(bound))
    chosen = found.join(F.broadcast(picked), (found["key"] == picked["key"]) & (found["th"] == picked["th"]), "left_semi").dropDuplicates(["key", "th"]).select("key", "label", "text")

    def encode(batches):
        for batch in batches:
            out = []
            for first, _, data, offs in W.slices(batch.column("text")):
                x, at = passages(data, offs)
                for i in range(len(at) - 1):
                    rows = x[at[i] : at[i + 1]]
                    if len(rows) > most:
                        rows = rows[np.linspace(0, len(rows) - 1, most).astype(np.int64)]
                    out.append((batch.column("key")[first + i].as_py(), batch.column("label")[first + i].as_py(), rows.astype("<f4").tobytes()))
            keys, values, bags = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(map(str, keys), pa.string()), pa.array(values, pa.float64()), pa.array(bags, pa.binary())], ["key", "label", "bag"])

    bags = sorted(tuple(r) for r in chosen.mapInArrow(encode, "key string, label double, bag binary").collect())
    rows = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for _, _, b in bags]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    x, y = np.concatenate(rows) if rows else np.zeros((0, FEATURES)), np.array([y for _, y, _ in bags])
    del bags, rows
    return Model().fit(x, at, y)


def score(model: Model, text: Column) -> Column:
    """The score of each text, the whole of it."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = [model.score(*passages(data, offs)) for _, _, data, offs in W.slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run.asNondeterministic()(text)
