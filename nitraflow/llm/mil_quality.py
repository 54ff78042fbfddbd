"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

A text is cut into passages of `passage_words` words. Each passage is encoded (hashed byte pairs and
shape measures, then a learned layer), a gate weighs the passages against each other, and the
weighted sum is scored. Only document labels are needed; the attention weights are learned from them.

The fit uses a bounded sample of labelled documents (`max_docs`, of at most `max_passages` passages
each), taken in order of a hash of the id; scoring covers every passage of every document in one
pass. Null and empty texts count as one empty passage and get a score as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import struct_array, with_struct
from .wordhash import RAW, in_row, row_ranges, utf8, words

PAIRS = 128
SHAPES = 9
WIDTH = PAIRS + SHAPES
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("top_passage", T.LongType())])


@dataclass(frozen=True)
class MilSettings:
    passage_words: int = 64
    max_docs: int = 4000
    max_passages: int = 128
    hidden: int = 32
    gate: int = 16
    epochs: int = 40
    batch_docs: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


def passages(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): passages first[d]:first[d+1] belong to row d, one at least."""
    hashes, starts, ends, first = words(data, offsets, RAW)
    n_words = np.diff(first)
    count = np.maximum(1, -(-n_words // size))
    begin = np.concatenate([[0], np.cumsum(count)])
    total = int(begin[-1])
    row = np.repeat(np.arange(len(n_words)), n_words)
    of_word = begin[row] + (np.arange(len(hashes)) - first[row]) // size
    lengths = ends - starts
    # bytes of words, each with its passage
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
    held, of_byte = data[at], np.repeat(of_word, lengths)
    after = np.zeros_like(held)
    after[:-1] = np.where(of_byte[1:] == of_byte[:-1], held[1:], 0)  # no pair reaches into the next passage
    pair = (held.astype(np.int64) * 37 + after.astype(np.int64) * 101) % PAIRS
    grams = np.bincount(of_byte * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS).astype(np.float32)
    n_bytes = np.maximum(grams.sum(1, keepdims=True), 1)
    per_word = np.maximum(np.bincount(of_word, minlength=total), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of_byte[mask], minlength=total) / n_bytes[:, 0]

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    shape = [
        share((held >= 65) & (held <= 90)), share((held >= 48) & (held <= 57)), share(held >= 128), share(np.isin(held, list(b"#*$%&|<>"))),
        share(np.isin(held, list(b".,;:!?"))), np.bincount(of_word, weights=lengths, minlength=total) / per_word / 16,
        _distinct(of_word, hashes, total) / per_word, np.bincount(of_word[same], minlength=total) / per_word, np.log1p(np.bincount(of_word, minlength=total)) / 5,
    ]
    return np.hstack([np.sqrt(grams / n_bytes), np.stack(shape, 1).astype(np.float32)]).astype(np.float32), begin


def _distinct(of_word: np.ndarray, hashes: np.ndarray, total: int) -> np.ndarray:
    keys = in_row(of_word, hashes)
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return np.bincount(of_word[order[new]], minlength=total)


class MilModel:
    """w: the parameters by name."""

    def __init__(self, w: dict[str, np.ndarray], settings: MilSettings) -> None:
        self.w, self.settings = w, settings

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.w, first[:-1]
        h = np.tanh(((x - w["mean"]) * w["scale"]) @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (v * u) @ w["a"]
        row = np.repeat(np.arange(len(at)), np.diff(first))
        p = np.exp(s - np.maximum.reduceat(s, at)[row])
        p /= np.add.reduceat(p, at)[row]
        z = np.add.reduceat(p[:, None] * h, at, axis=0)
        return {"h": h, "v": v, "u": u, "p": p, "z": z, "row": row, "y": 1 / (1 + np.exp(-(z @ w["c"] + w["b"])))}

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, first)
        d = (f["y"] - label) / len(label)
        dz = d[:, None] * w["c"]
        dp = (f["h"] * dz[f["row"]]).sum(1)
        ds = f["p"] * (dp - np.add.reduceat(f["p"] * dp, first[:-1])[f["row"]])
        dv = ds[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["p"][:, None] * dz[f["row"]] + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        scaled = (x - w["mean"]) * w["scale"]
        return {"E": scaled.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (ds[:, None] * f["v"] * f["u"]).sum(0), "c": f["z"].T @ d, "b": np.array(d.sum())}


def train(bags: list[np.ndarray], labels: np.ndarray, settings: MilSettings) -> MilModel:
    """Adam on the log loss. With no bags, the model scores 0.5 everywhere."""
    s, rng = settings, np.random.default_rng(settings.seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"E": draw(WIDTH, s.hidden), "e": np.zeros(s.hidden), "V": draw(s.hidden, s.gate), "U": draw(s.hidden, s.gate), "a": draw(s.gate), "c": np.zeros(s.hidden), "b": np.array(0.0)}
    fixed = {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH)}
    model = MilModel(w | fixed, s)
    if not bags:
        return model
    every = np.concatenate(bags)
    fixed = {"mean": every.mean(0), "scale": 1 / (every.std(0) + 0.05)}
    model = MilModel(w | fixed, s)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for _ in range(s.epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), s.batch_docs):
            pick = order[lo : lo + s.batch_docs]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            g, step = model.gradient(np.concatenate([bags[i] for i in pick]), first, labels[pick]), step + 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                model.w[k] = model.w[k] - s.rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + s.decay * model.w[k])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", settings: MilSettings | None = None) -> MilModel:
    """Fits on the labelled documents: labels has one 0/1 label per key (of several, the smallest counts)."""
    s = settings or MilSettings()
    picked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("double").alias("_label"))
    # of a few times the sample by a hash, the first max_docs: the bound of the sample, and of the broadcast
    share = min(1.0, 4 * s.max_docs / max(1, labels.count()))
    picked = picked.where(F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("_key"), "_key").limit(s.max_docs)
    joined = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "_key")
    size, most = s.passage_words, s.max_passages

    def encoded(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in row_ranges(offsets):
                x, first = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                few = np.flatnonzero(np.diff(first) <= most)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).take(pa.array(few)), b.column(2).slice(lo, hi - lo).take(pa.array(few)), pa.array([x[first[i] : first[i + 1]].tobytes() for i in few], pa.binary())],
                    names=["_key", "_label", "bag"],
                )

    schema = joined.select("_key", "_label").schema.add("bag", "binary")
    rows = joined.select("_key", "text", "_label").mapInArrow(encoded, schema).orderBy(F.xxhash64("_key"), "_key", F.xxhash64("bag")).limit(s.max_docs).toArrow()
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in rows.column("bag").to_pylist()]
    return train(bags, np.array(rows.column("_label").to_pylist(), float), s)


def score_quality(df: DataFrame, model: MilModel, text: str = "text", out: str = "quality") -> DataFrame:
    """df with a struct column: the score, the number of passages and the index of the one that weighed most."""
    size = model.settings.passage_words

    def scored(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        ys, ns, tops = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in row_ranges(offsets):
            x, first = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
            f = model.forward(x, first)
            top = np.lexsort((-f["p"], f["row"]))[first[:-1]] - first[:-1]
            ys.append(f["y"]), ns.append(np.diff(first)), tops.append(top)
        return struct_array(len(column), {"score": np.concatenate(ys), "n_passages": np.concatenate(ns), "top_passage": np.concatenate(tops)})

    return with_struct(df, text, out, FIELDS, scored)
