"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of up to ``PASSAGE`` words. Every passage is encoded as a vector of
character-class and repetition rates; a gated attention layer weighs the passages, and a logistic
layer scores the weighted representation. Only documents carry labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilgrid.llm.words import Words, mixed, slices, words_of

PASSAGE = 64
#: Training bounds: labelled documents by hash order, and passages of one document, evenly spaced.
TRAIN_DOCS, TRAIN_PASSAGES = 6000, 32
HIDDEN, EPOCHS, RATE, SEED = 16, 30, 0.02, 7
BUCKETS = 16

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
            "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "sign": b"#$%&*", "other": b"@=<>/_+~^\\`\"'()[]{}-"}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _i
FEATURES = len(_CLASSES) + 6 + BUCKETS


def passages(w: Words, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the row of each; a row without words has one passage of zeros."""
    counts = np.diff(w.first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    rows = np.repeat(np.arange(n_rows), bags)
    order = np.arange(len(rows)) - np.repeat(np.cumsum(bags) - bags, bags)
    begin = w.first[:-1][rows] + order * PASSAGE
    end = np.minimum(begin + PASSAGE, w.first[1:][rows])
    n = np.maximum(end - begin, 1)
    x = np.zeros((len(rows), FEATURES), np.float32)
    full = end > begin
    a, b = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    a[full], b[full] = w.starts[begin[full]], w.ends[end[full] - 1]
    size = np.maximum(b - a, 1)
    kinds = _CLASS_OF[w.raw]
    for i in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == i)])
        x[:, i] = (sums[b] - sums[a]) / size
    k = len(_CLASSES)
    line = np.concatenate([[0], np.cumsum(w.raw == 10)])
    x[:, k] = (line[b] - line[a]) / n
    length = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    x[:, k + 1] = (length[end] - length[begin]) / n / 10
    x[:, k + 2] = np.log1p(n) / 5
    x[:, k + 3] = np.log1p(counts[rows]) / 10
    # Repetition: words equal to the one before, and words met earlier in the passage.
    same = np.concatenate([[0], np.cumsum(np.append([False], w.hashes[1:] == w.hashes[:-1]))])[:len(w.hashes) + 1]
    x[:, k + 4] = (same[end] - same[begin]) / n
    passage = np.repeat(np.arange(len(rows)), end - begin)
    by = np.lexsort((w.hashes, passage))
    again = np.zeros(len(by), bool)
    again[1:] = (w.hashes[by][1:] == w.hashes[by][:-1]) & (passage[by][1:] == passage[by][:-1])
    x[:, k + 5] = np.bincount(passage[by][again], minlength=len(rows)) / n
    bucket = (mixed(w.hashes) >> np.uint64(60)).astype(np.int64)
    x[:, k + 6:] = np.bincount(passage * BUCKETS + bucket, minlength=len(rows) * BUCKETS).reshape(-1, BUCKETS)[:len(rows)] / n[:, None]
    return x, rows


@dataclass
class Model:
    """Encoder, gated attention and score layers, with the features' mean and spread."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Scores of ``n`` bags; ``rows`` is sorted and names the bag of each passage."""
        p = self.weights
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["a"]
        start = np.searchsorted(rows, np.arange(n))
        s = np.exp(s - np.maximum.reduceat(s, start)[rows])
        att = s / np.add.reduceat(s, start)[rows]
        m = np.add.reduceat(att[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ p["w"] + p["b"], -30, 30)))
        return y, {"z": z, "h": h, "v": v, "u": u, "att": att, "m": m, "start": start}

    def gradients(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        out, c = self.forward(x, rows, len(y))
        d = cost * (out - y) / cost.sum()
        dm = d[:, None] * p["w"]
        h, v, u, att = c["h"], c["v"], c["u"], c["att"]
        dh = att[:, None] * dm[rows]
        datt = (h * dm[rows]).sum(1)
        ds = att * (datt - np.add.reduceat(att * datt, c["start"])[rows])
        gv, gu = ds[:, None] * p["a"] * u * (1 - v * v), ds[:, None] * p["a"] * v * u * (1 - u)
        dh = (dh + gv @ p["V"].T + gu @ p["U"].T) * (1 - h * h)
        return {"w": c["m"].T @ d, "b": d.sum(), "a": (v * u).T @ ds, "V": h.T @ gv, "U": h.T @ gu, "E": c["z"].T @ dh, "e": dh.sum(0)}


def fitted(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the mean log loss, both labels weighing the same; without both labels the score is constant."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    shape = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, HIDDEN), "U": (HIDDEN, HIDDEN), "a": (HIDDEN,), "w": (HIDDEN,), "b": ()}
    model = Model(every.mean(0), every.std(0) + 1e-3, {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "aw" else np.zeros(s) for k, s in shape.items()})
    share = labels.mean() if len(labels) else 0.5
    if not 0 < share < 1:
        model.weights["w"][:] = 0
        model.weights["b"] = np.float64(30.0 if share == 1 else -30.0 if len(labels) and share == 0 else 0.0)
        return model
    moments = {k: (np.zeros(s), np.zeros(s)) for k, s in shape.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), 256):
            pick = order[at:at + 256]
            x = np.concatenate([bags[i] for i in pick])
            rows = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            y = labels[pick].astype(float)
            step += 1
            for k, g in model.gradients(x, rows, y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share))).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.weights[k] = model.weights[k] - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(ident: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``TRAIN_DOCS`` labelled rows outside the held-out fold, in hash order."""
    truth = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    truth = truth.where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id", "y").limit(TRAIN_DOCS)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(truth), "id")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, rows = passages(words_of(batch.column("text")), batch.num_rows)
            bags = []
            for bag in np.split(x, np.flatnonzero(np.diff(rows)) + 1):
                if len(bag) > TRAIN_PASSAGES:
                    bag = bag[np.linspace(0, len(bag) - 1, TRAIN_PASSAGES).astype(int)]
                bags.append(bag.astype(np.float32).tobytes())
            yield pa.record_batch([batch.column("id"), pa.array(bags, pa.binary()), batch.column("y")], ["id", "bag", "y"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = picked.select("id", "text", "y").mapInArrow(encode, f"id {kind}, bag binary, y int").collect()
    rows = sorted(rows, key=lambda r: (r.id, r.y, r.bag))[:2 * TRAIN_DOCS]
    return fitted([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows], np.array([r.y for r in rows]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row; a null or empty text is one passage without words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, rows = passages(words_of(batch.column("text")), batch.num_rows)
            y, _ = model.forward(x, rows, batch.num_rows)
            yield pa.record_batch([batch.column("id"), pa.array(y.astype(float), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
