"""Quality classifier: random-indexing word vectors pooled by document, then a small calibrated network.

Every term bucket has a sparse random index vector. A term's vector is the sum
of the index vectors of its neighbours over the whole corpus: tasks add up
their own texts in a table of fixed size (``BUCKETS`` x ``DIM``), and the
tables are added by row range. Documents are pooled to the mean of their
terms' vectors. A two-layer network is fitted on a bounded sample of labelled
documents, and a temperature, fitted on a part of the sample that the network
has not seen, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.llm.common import chunks, mixed, partitions, remainder, stored
from gridmat.llm.tokens import terms

BUCKETS = 1 << 14
DIM = 64
NONZERO = 4
RANGES = 16
HIDDEN = 32
#: Labelled documents that the network is fitted on, at most, taken by the hash of their id.
SAMPLE = 12_000
_SMALL, _LARGE = 1 << 19, 1 << 22


def index_vectors(buckets: int = BUCKETS, dim: int = DIM, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector, from a hash."""
    h = mixed(np.arange(buckets * nonzero, dtype=np.uint64) + np.uint64(0x51ED))
    return (h % np.uint64(dim)).astype(np.int64).reshape(buckets, nonzero), (1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1))).reshape(buckets, nonzero)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for _, data, edges in chunks(batches, "text", _LARGE):
        b, text = terms(data, edges, BUCKETS)
        pairs = []
        for step in (1, 2):
            near = np.flatnonzero(text[step:] == text[:-step])
            pairs += [b[near] * BUCKETS + b[near + step], b[near + step] * BUCKETS + b[near]]
        # Each distinct pair of neighbours once, with its count; in order, so that the sums run along the table.
        key = np.sort(np.concatenate(pairs).astype(np.int32))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        at, other = (key[first] // BUCKETS).astype(np.int64), key[first] % BUCKETS
        for k in range(NONZERO):
            total += np.bincount(at * DIM + place[other, k], weights=sign[other, k] * count, minlength=len(total))
    rows = total.reshape(RANGES, -1).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums")):
            got = np.frombuffer(sums.as_buffer(), np.int64).astype(np.float64)
            total[part] = total[part] + got if part in total else got
    for part, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM vectors of unit length from the neighbours of every term in every text."""
    sums = docs.select("text").mapInArrow(_accumulate, "part int, sums binary")
    added = sums.repartition(min(RANGES, partitions(docs.sparkSession)), "part").mapInArrow(_add, "part int, sums binary").toPandas()
    table = np.zeros((RANGES, BUCKETS * DIM // RANGES))
    for part, raw in zip(added["part"], added["sums"]):
        table[part] = np.frombuffer(raw, np.float64)
    table = table.reshape(BUCKETS, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean term vector by text; zeros for a text without words."""
    texts = len(edges) - 1
    b, text = terms(data, edges, BUCKETS)
    out = np.zeros((texts, DIM), np.float32)
    if len(b):
        # Each distinct term of a text once, with its count.
        key = text * BUCKETS + b
        key = np.sort(key.astype(np.int32) if texts * BUCKETS < 1 << 31 else key)
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(at, len(key))).astype(np.float32)
        text, b = key[at] // BUCKETS, key[at] % BUCKETS
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        total = np.add.reduceat(vectors[b] * count[:, None], first, axis=0)
        out[text[first]] = total / np.add.reduceat(count, first)[:, None]
    return out


def _pool(vectors: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, edges in chunks(batches, "text", _SMALL):
            rows = pooled(vectors.value, data, edges)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "vec"])

    return run


class Network:
    """Two layers of numpy: scaled input, tanh, logistic output."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.shift, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.shift) / self.scale @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
        """Adam on the log loss over four fifths of the rows, then the temperature over the rest."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        rest, train = order[: len(x) // 5], order[len(x) // 5 :]
        self.shift, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        mean, square, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        z = (x - self.shift) / self.scale
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for at in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
                a, b, c, d = self.weights
                h = np.tanh(z[at] @ a + b)
                error = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y[at]) / len(at)
                back = np.outer(error, c) * (1 - h * h)
                grads = [z[at].T @ back + decay * a, back.sum(axis=0), h.T @ error + decay * c, np.array([error.sum()])]
                t += 1
                for w, g, m, s in zip(self.weights, grads, mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        if len(rest) >= 20:
            logit, truth = self.logit(x[rest]), y[rest]
            loss = lambda k: np.mean(np.logaddexp(0, np.where(truth > 0.5, -logit, logit) / k))
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
        return self


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, DIM)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.probability(x.astype(np.float64)))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The network sees only labels of documents whose crc32(doc_id) modulo 3 is not
    1, at most ``sample`` of them; null labels are left out, and without any label of
    one kind the score is the share of label 1 (0.5 without labels). A null or
    empty text has the zero vector and is scored like any other. Repeated rows score alike.
    """
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    vectors = spark.sparkContext.broadcast(word_vectors(plain))
    rows = stored(plain.mapInArrow(_pool(vectors), "doc_id long, vec binary"), "pooled")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    train = rows.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "vec").limit(sample).toPandas()
    y = (train["quality"].to_numpy() > 0).astype(np.float64)
    net = Network(DIM)
    if len(y) >= 20 and 0 < y.mean() < 1:
        net.fit(np.frombuffer(b"".join(train["vec"]), np.float32).reshape(-1, DIM).astype(np.float64), y)
    else:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        net.weights[2][:] = 0
        net.weights[3][:] = np.log(share / (1 - share))
    out = rows.mapInArrow(_score(net), "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
