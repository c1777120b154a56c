"""A quality classifier on random-indexing word vectors.

Every word of the corpus, and every word's shape (letters, digits and
punctuation as classes), falls into a bucket with a sparse ternary index
vector. A bucket's context vector is the sum of the index vectors of all
neighbours, up to WINDOW words away, over all texts. The sums are partial in
each task and added up by Spark; what remains is a matrix of BUCKETS x DIMS
numbers, however large the corpus. A document is the mean of its words'
context vectors, frequent words weighted down, beside the means over shapes.
A two-layer numpy network learns from a bounded sample of labelled documents;
a temperature fitted on documents kept aside calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, remainder

WORDS, SHAPES, DIMS, ONES, WINDOW = 12288, 4096, 32, 4, 2
BUCKETS = WORDS + SHAPES
#: The most labelled documents that the network is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.7
_CLASSES = [(re.compile(p), c) for p, c in ((r"[A-ZÀ-ÖØ-Þ]+", "\x01"), (r"[^\W\d_\x01]+", "\x02"), (r"\d+", "\x03"), (r"(.)\1+", r"\1"))]
_CHUNK = 1 << 18
#: Bytes that the words whose buckets a task remembers may take. Workers stay alive beside those of other stages, so all is forgotten when a task ends.
CACHED = 64 << 20
#: About what a short word and its number take in a dictionary beside its letters.
_ENTRY = 150


class _Buckets(dict):
    """Word -> its bucket and its shape's, as one number; bounded by forgetting all."""

    size = 0

    def clear(self) -> None:
        super().clear()
        self.size = 0

    def learn(self, words: set[str]) -> None:
        """Know all of `words`, which hold no white space: those that are new go through each pattern as one text, a word a line."""
        if self.size > CACHED:
            self.clear()
        if not (new := list(words.difference(self))):
            return
        shapes = text = "\n".join(new)
        for pattern, to in _CLASSES:
            shapes = pattern.sub(to, shapes)
        shapes = [x[:16] for x in shapes.split("\n")]
        of_shape = {x: (WORDS + zlib.crc32(x.encode("utf-8", "replace")) % SHAPES) << 20 for x in set(shapes)}
        lower = text.lower().encode("utf-8", "replace").split(b"\n")
        self.update(zip(new, (zlib.crc32(w) % WORDS | of_shape[x] for w, x in zip(lower, shapes))))
        self.size += _ENTRY * len(new) + (len(text) if text.isascii() else 2 * len(text))


_buckets = _Buckets()


def _forgetting(each: Callable) -> Callable:
    """`each` over the batches of a task, after which the words' buckets are forgotten."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            _buckets.clear()

    return task


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of all texts in a row, and each text's number of words."""
    words: list[str] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or "").split()
        lengths[i] = len(own)
        words += own
    _buckets.learn(set(words))
    both = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    return both & ((1 << 20) - 1), both >> 20, lengths


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about _CHUNK words at a time, so that one batch's memory is bounded by its longest text."""
    at, size, block = 0, 0, []
    for i, text in enumerate(texts):
        block.append(text.as_py())
        size += len(block[-1] or "") // 5
        if size >= _CHUNK:
            yield at, block
            at, size, block = i + 1, 0, []
    if block:
        yield at, block


def index_vectors(seed: int = 7) -> np.ndarray:
    """For each bucket the ONES places of its index vector; the first half of them are +1, the others -1."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :ONES].astype(np.int64)


def context_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The context vectors and counts of all buckets, over all rows of `docs`."""
    fields = [f"v{k}" for k in range(DIMS)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = index_vectors()
        total, counts = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)

        def add(at: np.ndarray, near: np.ndarray) -> None:
            for j in range(ONES):
                found = np.bincount(at * DIMS + places[near, j], minlength=BUCKETS * DIMS)
                if j < ONES // 2:
                    np.add(total, found, out=total)
                else:
                    np.subtract(total, found, out=total)

        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                words, shapes, lengths = _codes(texts)
                owner = np.repeat(np.arange(len(texts)), lengths)
                counts += np.bincount(words, minlength=BUCKETS) + np.bincount(shapes, minlength=BUCKETS)
                for step in range(1, WINDOW + 1):
                    same = np.flatnonzero(owner[step:] == owner[:-step])
                    a, b = same, same + step
                    for code in (words, shapes):
                        add(code[a], code[b])
                        add(code[b], code[a])
        hit = np.flatnonzero(counts)
        rows = total.reshape(BUCKETS, DIMS)[hit]
        columns = [pa.array(hit), pa.array(counts[hit]), *(pa.array(rows[:, k].astype(np.int64)) for k in range(DIMS))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", *fields])

    schema = "bucket long, n long, " + ", ".join(f"{f} long" for f in fields)
    sums = (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(_forgetting(each), schema)
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in fields])
        .toPandas()  # BUCKETS rows at most
    )
    vectors, counts = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    at = sums["bucket"].to_numpy(np.int64)
    vectors[at], counts[at] = sums[fields].to_numpy(float), sums["n"].to_numpy(float)
    return vectors, counts


@dataclass
class Pooling:
    """Turns texts into features with given word vectors."""

    vectors: np.ndarray  # BUCKETS x DIMS, unit length times the bucket's weight
    weights: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, counts: np.ndarray, smooth: float = 1e-3) -> Pooling:
        """Unit vectors without the mean, and weights a / (a + share) within words and within shapes."""
        out = np.zeros_like(vectors)
        weights = np.zeros(len(counts))
        for part in (slice(0, WORDS), slice(WORDS, BUCKETS)):
            v, n = vectors[part], counts[part]
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            v = v - (v * n[:, None]).sum(0) / max(n.sum(), 1)
            out[part] = v * (n > 0)[:, None]
            weights[part] = smooth / (smooth + n / max(n.sum(), 1)) if part.start == 0 else 1.0
        return cls((out * weights[:, None]).astype(np.float32), weights.astype(np.float32))

    def features(self, texts: list[str | None]) -> np.ndarray:
        words, shapes, lengths = _codes(texts)
        out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
        owner = np.repeat(np.arange(len(texts)), lengths)
        begin = np.cumsum(lengths) - lengths
        some = np.flatnonzero(lengths)
        for k, code in enumerate((words, shapes)):
            if len(code):
                sums = np.add.reduceat(self.vectors[code], begin[some], axis=0)
                weight = np.bincount(owner, self.weights[code], len(texts))[some]
                out[some, k * DIMS : (k + 1) * DIMS] = sums / np.maximum(weight, 1e-9)[:, None]
        out[:, -1] = np.log1p(lengths) / 10
        return out


@dataclass
class Network:
    """Features -> tanh layer -> one logit, divided by a temperature."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    mean: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0
    history: list[float] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(float)) / self.temperature, -60, 60)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 11) -> Network:
        """Adam on four fifths of the rows; the temperature minimises the loss on the others."""
        x, y = x.astype(float), y.astype(float)
        if len(y) < 10 or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            zero = np.zeros(x.shape[1])
            return cls(np.zeros((len(zero), 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), zero, zero + 1)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        aside, own = order[: len(y) // 5], order[len(y) // 5 :]
        mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
        net = cls(rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0, mean, scale)
        z, t = (x[own] - mean) / scale, y[own]
        params = [net.w1, net.b1, net.w2, np.zeros(1)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for at in np.array_split(rng.permutation(len(t)), max(1, len(t) // 256)):
                h = np.tanh(z[at] @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60)))
                d = (p - t[at]) / len(at)
                back = np.outer(d, params[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((z[at].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()]))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
        logit, target = net.logits(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        loss = [np.mean(np.logaddexp(0, logit / t) - target * logit / t) for t in grid]
        net.temperature, net.history = float(grid[int(np.argmin(loss))]), [float(min(loss))]
        return net


@dataclass
class Classifier:
    pooling: Pooling
    network: Network

    @classmethod
    def fit(cls, docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Classifier:
        """Word vectors from all of `docs`; the network from at most `sample` of `labelled` (doc_id, label).

        An id of several labels has the largest; one on several texts stands
        for the text of least hash; ids or labels that are null teach nothing.
        The sample are the ids of least hash: those beyond a bound that leaves
        about `sample` of them are dropped where they lie.
        """
        known = labelled.where("doc_id is not null and label is not null").select(
            F.col("doc_id").cast("long").alias("__id"), F.col("label").cast("int").alias("__label")
        )
        share = min(1.0, (sample + 6 * sample**0.5) / max(1, known.count()))
        place = F.shiftrightunsigned(F.xxhash64("__id"), 11) / F.lit(float(1 << 53))
        ids = (
            known.where(place <= share)
            .groupBy("__id")
            .agg(F.max("__label").alias("__label"))
            .orderBy(F.xxhash64("__id"), "__id")
            .limit(sample)
        )
        pooling = Pooling.of(*context_vectors(docs))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, texts in _slices(batch.column(1)):
                    x = pooling.features(texts).astype(float)
                    part = batch.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(list(x))], ["doc_id", "label", "h", "x"])

        # At most `sample` ids of 12 bytes: small enough to broadcast, by the parameter.
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
            F.broadcast(ids), F.col("doc_id") == F.col("__id")
        )
        found = (
            rows.select("doc_id", "text", F.col("__label").alias("label"), F.xxhash64("text").alias("h"))
            .mapInArrow(_forgetting(each), "doc_id long, label int, h long, x array<double>")
            .groupBy("doc_id")  # a row for each sampled id, however many rows have it
            .agg(F.max("label").alias("label"), F.min_by("x", "h").alias("x"))
            .toPandas()
        )
        if found.empty:
            return cls(pooling, Network.fit(np.zeros((0, 2 * DIMS + 1)), np.zeros(0)))
        x = np.stack(found["x"].to_numpy())
        order = np.argsort(found["doc_id"].to_numpy())  # whatever order the tasks came in
        return cls(pooling, Network.fit(x[order], found["label"].to_numpy()[order]))

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """`docs` with the column `name`, the probability of a good text; an own column of that name is replaced.

        Null and empty texts get the network's answer to no words at all;
        equal texts get equal scores, and repeated rows repeat.
        """
        own = [c for c in docs.columns if c.lower() != name.lower()]
        kept = docs.select(*[F.col(f"`{c}`") for c in own])
        at = own.index("text")
        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + f"`{name}` double"
        pooling, network = self.pooling, self.network

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, texts in _slices(batch.column(at)):
                    part = batch.slice(begin, len(texts))
                    scores = network.scores(pooling.features(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*own, name])

        return kept.mapInArrow(_forgetting(each), schema)


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def fit_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Classifier:
    """The classifier of `labels.quality`, from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return Classifier.fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label")))


def reject(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of `docs` that are predicted to be of quality, with all their own columns as they were.

    The score goes under a name that `docs` does not use. Rows without text or
    words are judged like any other; of repeated rows all stay or none.
    """
    name = free_name(docs, "__quality")
    return classifier.score(docs, name).where(predicted(F.col(name)) == 1).drop(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = fit_on_labels(spark, docs, sf_dir).score(docs)
    held_out = remainder(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
