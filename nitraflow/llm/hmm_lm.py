"""Language-model scoring with a hidden Markov model.

A word belongs to a class: each of the `own_classes` most frequent training words has one of its own,
every other word shares one with words of like ending and length. The model draws a chain of latent
states, a class from each state, and a word from its class by smoothed counts, so it gives every text
a probability. Class emissions and transitions are trained by Baum-Welch: each partition adds up
expected counts over its whole training documents, Spark sums them over the partitions, and the driver
re-estimates; all training documents take part in every round. Long documents are computed in segments
that hand the exact forward and backward messages to each other. Texts are scored by the scaled
forward recursion over the whole token sequence, which is the exact likelihood.

Counting: words are pre-aggregated in each batch and summed by hash. The most frequent words (at most
`heavy`, the bound of the broadcast) are looked up in place; all other words of a document travel,
once each, to a join with the counts, so every count is exact.

A null text counts as empty: its only token is the end. A null id is scored like any other; repeated
rows are scored one by one. With no training documents every count is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import written
from .wordhash import LOWERED, row_ranges, utf8, words


@dataclass(frozen=True)
class HmmSettings:
    states: int = 8
    own_classes: int = 2048
    shapes: int = 512
    heavy: int = 262_144
    rounds: int = 4
    start_docs: int = 256
    segment: int = 256
    cells: int = 1 << 18
    seed: int = 5


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The shape of each word, from its last two bytes and its length."""
    last = LOWERED[data[ends - 1]].astype(np.int64)
    before = np.where(ends - starts > 1, LOWERED[data[np.maximum(ends - 2, 0)]], 0).astype(np.int64)
    return (last * 31 + before * 7 + np.minimum(ends - starts, 12) * 131) % n


# ---------------------------------------------------------------- counts


def word_counts(df: DataFrame, settings: HmmSettings) -> DataFrame:
    """(h, shape, c): the training count of each word, by hash; df has text and train."""
    n = settings.shapes

    def counted(batches):
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in row_ranges(offsets, 4 << 20):
                part = data[offsets[lo] : offsets[hi]]
                h, starts, ends, _ = words(part, offsets[lo : hi + 1] - offsets[lo])
                h, at, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(shapes(part, starts[at], ends[at], n).astype(np.int32)), pa.array(c)], names=["h", "shape", "c"])

    rows = df.where("train").select("text").mapInArrow(counted, "h long, shape int, c long")
    return rows.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


def heavy_words(counts: DataFrame, most: int) -> pa.Table:
    """The words whose count reaches a threshold, by falling count: the lowest threshold, in steps of
    about a tenth, that at most `most` words reach (the bound of what is collected and broadcast)."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()  # a few hundred rows at most
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["b"]):
        held += r["n"]
        if held > most:
            break
        least = r["b"]
    rows = counts.where(step >= least) if least is not None else counts.limit(0)
    return rows.toArrow().sort_by([("c", "descending"), ("h", "ascending")])


# ---------------------------------------------------------------- the model


@dataclass
class HmmModel:
    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # class by state

    @staticmethod
    def start(class_counts: np.ndarray, sample: list[np.ndarray], settings: HmmSettings) -> HmmModel:
        """Emissions from groups of sample documents that differ most from each other (by the angle
        between their class counts), mixed with the overall counts; without a sample, from those."""
        k, n = settings.states, len(class_counts)
        overall = (class_counts + 0.5) / (class_counts + 0.5).sum()
        emit = np.repeat(overall[:, None], k, axis=1) * np.random.default_rng(settings.seed).uniform(0.5, 1.5, (n, k))
        if sample:
            held = np.stack([np.bincount(x, minlength=n) for x in sample]).astype(float)
            unit = np.sqrt(held / held.sum(1, keepdims=True))
            picked, far = [0], 1 - unit @ unit[0]
            while len(picked) < min(k, len(sample)):
                picked.append(int(far.argmax()))
                far = np.minimum(far, 1 - unit @ unit[picked[-1]])
            group = (unit @ unit[picked].T).argmax(1)
            for i in range(len(picked)):
                own = held[group == i].sum(0) + 20 * overall
                emit[:, i] = 0.3 * overall + 0.7 * own / own.sum()
        step = np.full((k, k), 0.5 / max(1, k - 1))
        np.fill_diagonal(step, 0.5 if k > 1 else 1.0)
        return HmmModel(np.full(k, 1 / k), step, emit / emit.sum(0))

    def counts(self, sequences: list[np.ndarray], settings: HmmSettings) -> np.ndarray:
        """Expected counts (first, step, emit) over the sequences, as one vector."""
        k, size = settings.states, settings.segment
        first, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        whole = [s for s in sequences if 0 < len(s) <= size]
        cut = [s[lo : lo + size] for s in sequences if len(s) > size for lo in range(0, len(s), size)]
        ends = np.cumsum([-(-len(s) // size) for s in sequences if len(s) > size])
        into, after, crossing = self._messages(cut, ends, settings)
        step += crossing
        parts = whole + cut
        enter = np.concatenate([np.broadcast_to(self.first, (len(whole), k)), into]).astype(np.float32)
        leave = np.concatenate([np.ones((len(whole), k)), after]).astype(np.float32)
        opens = np.concatenate([np.ones(len(whole), bool), np.isin(np.arange(len(cut)), np.append(0, ends))])
        for pick, o, lengths, live in _pools(parts, settings):
            self._segment_counts(o, lengths, live, enter[pick], leave[pick], opens[pick], first, step, emit)
        return np.concatenate([first, step.ravel(), emit.ravel()])

    def _messages(self, cut: list[np.ndarray], ends: np.ndarray, settings: HmmSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For segments cut in order from sequences that end at `ends`: the state weights that enter each, those
        of what comes after its last symbol, and the expected transitions between segments."""
        k, n = settings.states, len(cut)
        moves = np.empty((n, k, k))
        a, e = self.step, self.emit
        for pick, o, _, live in _pools(cut, settings, k):
            m = np.eye(k) * e[o[0]][:, None, :]
            for t in range(1, len(o)):
                w = int(live[t])
                x = (m[:w].reshape(-1, k) @ a).reshape(w, k, k) * e[o[t, :w]][:, None, :]
                m[:w] = x / x.sum((1, 2), keepdims=True)
            moves[pick] = m
        into, after, crossing = np.empty((n, k)), np.ones((n, k)), np.zeros((k, k))
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
            into[lo] = self.first
            for i in range(lo, hi - 1):
                out = into[i] @ moves[i]
                into[i + 1] = (out / out.sum()) @ a
            for i in range(hi - 1, lo, -1):
                begun = moves[i] @ after[i]
                back = a @ begun
                after[i - 1] = back / back.sum()
                both = (into[i - 1] @ moves[i - 1])[:, None] * a * begun
                crossing += both / both.sum()
        return into, after, crossing

    def _segment_counts(self, o: np.ndarray, lengths: np.ndarray, live: np.ndarray, enter: np.ndarray, leave: np.ndarray, opens: np.ndarray, first: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        """Adds the expected counts of segments (o by time and segment, the longest first) to first, step and emit."""
        a, e, k = self.step.astype(np.float32), self.emit.astype(np.float32), len(first)
        alpha = np.empty((len(o), o.shape[1], k), np.float32)
        scale = np.ones((len(o), o.shape[1]), np.float32)
        now = enter
        for t, m in enumerate(live.tolist()):
            now = (now[:m] if t == 0 else now[:m] @ a) * e[o[t, :m]]
            scale[t, :m] = now.sum(1)
            now = now / scale[t, :m, None]
            alpha[t, :m] = now
        last = alpha[lengths - 1, np.arange(len(lengths))]
        beta = leave / (last * leave).sum(1, keepdims=True)
        for t in range(len(o) - 1, -1, -1):
            m = int(live[t])
            gamma = alpha[t, :m] * beta[:m]
            if t:
                onto = e[o[t, :m]] * beta[:m] / scale[t, :m, None]
                step += alpha[t - 1, :m].T @ onto * a
                beta[:m] = onto @ a.T
            else:
                first += gamma[opens[:m]].sum(0)
            alpha[t, :m] = gamma
        inside = np.arange(len(o))[:, None] < lengths
        seen = o[inside]
        for s in range(k):
            emit[:, s] += np.bincount(seen, weights=alpha[..., s][inside], minlength=len(emit))

    @staticmethod
    def estimated(total: np.ndarray, n_classes: int, settings: HmmSettings) -> HmmModel:
        k = settings.states
        first, step, emit = total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(n_classes, k)
        first, step, emit = first + 0.01, step + 0.01, emit + 0.001
        return HmmModel(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The exact log10 likelihood of each sequence."""
        out = np.zeros(len(sequences))
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        wide = int(np.searchsorted(-lengths, -_LONG, "left"))  # the longer ones go one by one, by blocks
        for i in order[:wide]:
            out[i] = self._long(sequences[i])
        order, lengths = order[wide:], lengths[wide:]
        if not len(order) or not lengths[0]:
            return out
        o = np.zeros((lengths[0], len(order)), np.int32)
        for j, i in enumerate(order):
            o[: lengths[j], j] = sequences[i]
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        logs, now = np.zeros(len(order)), np.broadcast_to(self.first, (len(order), len(self.first)))
        for t, m in enumerate(live.tolist()):
            now = (now[:m] if t == 0 else now[:m] @ self.step) * self.emit[o[t, :m]]
            total = now.sum(1)
            logs[:m] += np.log10(total)
            now = now / total[:, None]
        out[order] = logs
        return out

    def _long(self, s: np.ndarray, block: int = 256) -> float:
        """The same recursion for one long sequence: the transfer matrices of its blocks side by side,
        then the blocks in order."""
        log, now = 0.0, self.first * self.emit[s[0]]
        rest = s[1:]
        for lo in range(0, len(rest), block * 4096):
            part = rest[lo : lo + block * 4096]
            n = len(part) // block
            if n:
                o = part[: n * block].reshape(n, block)
                m, logs = np.broadcast_to(np.eye(len(now)), (n, len(now), len(now))), np.zeros(n)
                for t in range(block):
                    m = (m @ self.step) * self.emit[o[:, t]][:, None, :]
                    total = m.sum((1, 2))
                    m = m / total[:, None, None]
                    logs += np.log10(total)
                for i in range(n):
                    now = now @ m[i]
                    log += logs[i] + np.log10(now.sum())
                    now = now / now.sum()
            for c in part[n * block :].tolist():
                now = (now @ self.step) * self.emit[c]
                log += np.log10(now.sum())
                now = now / now.sum()
        return float(log + np.log10(now.sum()))


_LONG = 4000


def _pools(parts: list[np.ndarray], settings: HmmSettings, width: int = 1):
    """(indices, symbols by time and part, lengths, live) of parts of like length, the longest first, in pools of
    about `cells` symbols; live[t] parts reach symbol t."""
    order = np.argsort([-len(x) for x in parts], kind="stable")
    at = 0
    while at < len(order):
        pick = order[at : at + max(1, settings.cells // width // len(parts[order[at]]))]
        lengths = np.array([len(parts[i]) for i in pick])
        o = np.zeros((lengths[0], len(pick)), np.int32)
        for j, i in enumerate(pick.tolist()):
            o[: lengths[j], j] = parts[i]
        yield pick, o, lengths, np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        at += len(pick)


def train(rows: DataFrame, class_counts: np.ndarray, settings: HmmSettings) -> HmmModel:
    """Baum-Welch over rows.classes (16-bit class numbers, binary). It starts from a bounded sample of
    documents of ordinary length; every round takes all of them."""
    sample = rows.where(F.col("n_tokens").between(64, 4096)).orderBy(F.xxhash64("doc_id"), F.xxhash64("classes")).select("classes").limit(settings.start_docs).toArrow()
    model, n = HmmModel.start(class_counts, [np.frombuffer(x, np.uint16) for x in sample.column("classes").to_pylist()], settings), len(class_counts)
    sc = rows.sparkSession.sparkContext
    for _ in range(settings.rounds):
        shared = sc.broadcast(model)

        def expected(batches, shared=shared):
            total = 0
            for b in batches:
                for lo in range(0, b.num_rows, 2000):
                    total = total + shared.value.counts([np.frombuffer(x, np.uint16) for x in b.column(0).slice(lo, 2000).to_pylist()], settings)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

        sums = rows.select("classes").mapInArrow(expected, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        if not len(sums):
            break
        total = np.zeros(len(sums))
        total[sums.column("i").to_numpy()] = sums.column("x").to_numpy()
        model = HmmModel.estimated(total, n, settings)
    return model


# ---------------------------------------------------------------- scoring


def hmm_scores(df: DataFrame, train_on: Column, key: str = "doc_id", text: str = "text", settings: HmmSettings | None = None) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, state_score) of every row;
    rows where train_on holds (null: not) are learned from."""
    settings = settings or HmmSettings()
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    counts = written(word_counts(docs, settings), "word-counts")
    n_docs = docs.where("train").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = sums[0] + n_docs, sums[1] + (n_docs > 0)
    top = heavy_words(counts, settings.heavy)
    own = min(settings.own_classes, len(top))
    heavy_h, heavy_c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    heavy_shape = top.column("shape").to_numpy()
    least_own = spark.createDataFrame([(int(x),) for x in heavy_h[:own].view(np.int64)], "h long")
    per_shape = counts.join(F.broadcast(least_own), "h", "left_anti").groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    shape_n, shape_v = np.zeros(settings.shapes), np.zeros(settings.shapes)
    shape_n[per_shape.column("shape").to_numpy()], shape_v[per_shape.column("shape").to_numpy()] = per_shape.column("n").to_numpy(), per_shape.column("v").to_numpy()
    # classes: own words, shapes, the end
    class_counts = np.concatenate([heavy_c[:own].astype(float), shape_n, [n_docs]])
    end, floor = len(class_counts) - 1, n + 0.5 * (v + 1)
    order = np.argsort(heavy_h)
    tables = spark.sparkContext.broadcast((heavy_h[order], heavy_c[order], np.where(order < own, order, own + heavy_shape[order]), shape_n + 0.5 * (shape_v + 1)))

    def encoded(batches):
        known_h, known_c, known_class, shape_floor = tables.value
        known_base = np.log10((known_c + 0.5) / floor)
        known_within = np.where(known_class < own, 0.0, np.log10((known_c + 0.5) / shape_floor[np.maximum(known_class - own, 0)]))
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in row_ranges(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                h, starts, ends, first = words(part, at)
                shape = shapes(part, starts, ends, settings.shapes)
                one, back = np.unique(h, return_inverse=True)
                spot = np.minimum(np.searchsorted(known_h, one), max(0, len(known_h) - 1))
                hit = known_h[spot] == one if len(known_h) else np.zeros(len(one), bool)
                spot, hit = spot[back], hit[back]
                classes = own + shape
                base, within = np.zeros(len(h)), np.zeros(len(h))
                classes[hit], base[hit], within[hit] = known_class[spot[hit]], known_base[spot[hit]], known_within[spot[hit]]
                add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])  # noqa: B023, E731
                tail = np.flatnonzero(~hit)
                tail_at = np.searchsorted(tail, first).astype(np.int32)
                whole = np.insert(classes, first[1:], end).astype(np.uint16)
                cut = first + np.arange(len(first))
                size = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, size), b.column(2).slice(lo, size), pa.array(np.diff(first) + 1), pa.array(add(hit.astype(np.int64)) + (n_docs > 0)),
                        pa.array(add(base) + np.log10((n_docs + 0.5) / floor)), pa.array(add(within)),
                        pa.array([whole[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(tail_at, pa.array(h[tail].view(np.int64))), pa.ListArray.from_arrays(tail_at, pa.array(shape[tail].astype(np.int32))),
                    ],
                    names=["doc_id", "train", "n_tokens", "known", "base", "within", "classes", "tail", "tail_shape"],
                )

    kinds = docs.select("doc_id", "train").schema
    schema = kinds.add("n_tokens", "long").add("known", "long").add("base", "double").add("within", "double").add("classes", "binary")
    schema = schema.add("tail", T.ArrayType(T.LongType())).add("tail_shape", T.ArrayType(T.IntegerType()))
    rows = written(docs.select("doc_id", "text", "train").mapInArrow(encoded, schema).withColumn("rid", F.monotonically_increasing_id()), "hmm-classes")
    model = spark.sparkContext.broadcast(train(rows.where("train"), class_counts, settings))

    def forward(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                logs = model.value.log10([np.frombuffer(x, np.uint16) for x in part.column(len(part.columns) - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(logs)], names=[*part.schema.names[:-1], "states"])

    scored = rows.select("rid", "doc_id", "train", "n_tokens", "known", "base", "within", "classes")
    scored = scored.mapInArrow(forward, scored.drop("classes").schema.add("states", "double"))
    # the words that aren't among the heavy ones: each once a document, joined with its count
    tails = rows.select("rid", F.explode(F.arrays_zip("tail", "tail_shape")).alias("w")).groupBy("rid", F.col("w.tail").alias("h"), F.col("w.tail_shape").alias("shape")).agg(F.count("*").alias("times"))
    floors = spark.createDataFrame([(i, float(x)) for i, x in enumerate(shape_n + 0.5 * (shape_v + 1))], "shape int, floor double")
    c = F.coalesce("c", F.lit(0))
    found = tails.join(counts.select("h", "c"), "h", "left").join(F.broadcast(floors), "shape")
    found = found.groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(float(floor)))).alias("tail_base"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.col("floor"))).alias("tail_within"),
    )
    zero = lambda name, z: F.coalesce(name, F.lit(z))
    return scored.join(found, "rid", "left").select(
        "doc_id", "train", "n_tokens", (F.col("known") + zero("tail_known", 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base", 0.0)).alias("base_score"), (F.col("states") + F.col("within") + zero("tail_within", 0.0)).alias("score"), F.col("states").alias("state_score"),
    )
