"""Mixing to target weights with soft membership.

A softmax classifier, fitted on the labelled table, gives every document a
posterior over domains. Nonnegative document rates are then fitted so that the
expected token total of each domain, the sum of rate x tokens x posterior,
meets its target: a least-squares problem in as many unknowns as documents,
solved by projected gradient steps; targets that these leave unmet are reported.
On request one proximal step, exact by Newton's method in as many unknowns as
domains, ends the way. A step needs only the domain totals, which
Spark sums; the rates themselves follow from the totals of all steps so far
and are recomputed beside the posteriors, so that nothing of the size of the
corpus is kept between steps or reaches the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmat.llm.common import chunks, owner_of, received, shipped, stored, word_edges
from gridmat.llm.tokens import terms

BUCKETS = 1 << 15
#: Labelled documents that the classifier is fitted on, at most, taken by the hash of their id.
SAMPLE = 10_000
#: A term counts if it occurs in so many documents of the sample, and in some domain so many standard errors
#: more or less often than in all of them.
LEAST_DOCS = 4
LEAST_Z = 5.0
STEPS = 25
CLOSE = 1e-4
#: A target is met within this share of itself.
MET = 0.01
#: Weight of staying near the rates so far in the last step, its Newton steps at most, and their shortest length, 2 ** -HALVINGS.
STAY, NEWTON, HALVINGS = 1e-8, 100, 20
_SMALL = 1 << 20


def domain_of(quality: Column, toxic: Column) -> Column:
    """The labelled table's domains: 0 clean, 1 poor, 2 toxic (poor or not); null where a label is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic > 0, 2).when(quality > 0, 0).otherwise(1).cast("int")


DOMAINS = ("clean", "poor", "toxic")


def _terms_once(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, sorted by text, and how often each occurs."""
    b, text = terms(data, edges, BUCKETS)
    key, count = np.unique(text * BUCKETS + b, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def share_of(text: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """Root of the share that a term has of its text."""
    return _root_share(text, count, np.bincount(text, weights=count, minlength=texts))


def _root_share(text: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.sqrt(count / np.maximum(size, 1)[text])


class Softmax:
    """Linear classifier on present terms and their share, by full-batch gradient steps in numpy."""

    def __init__(self, domains: int):
        self.present = np.zeros((BUCKETS, domains))
        self.share = np.zeros((BUCKETS, domains))
        self.bias = np.zeros(domains)
        self.temperature = 1.0

    def logits(self, text: np.ndarray, bucket: np.ndarray, share: np.ndarray, texts: int) -> np.ndarray:
        out = np.tile(self.bias, (texts, 1))
        # One domain after the other, as there are far more terms than texts.
        for d in range(out.shape[1]):
            out[:, d] += np.bincount(text, weights=self.present[bucket, d] + share * self.share[bucket, d], minlength=texts)
        return out

    def posterior(self, *args) -> np.ndarray:
        z = self.logits(*args) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, text: np.ndarray, bucket: np.ndarray, count: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 3e-4, rate: float = 0.1) -> Softmax:
        texts, domains = len(y), len(self.bias)
        df = np.bincount(bucket, minlength=BUCKETS)
        used = df >= LEAST_DOCS
        telling = np.zeros(BUCKETS, bool)
        for d in range(domains):
            part = np.mean(y == d)
            seen = np.bincount(bucket, weights=y[text] == d, minlength=BUCKETS)
            telling |= np.abs(seen - df * part) >= LEAST_Z * np.sqrt(np.maximum(df * part * (1 - part), 1e-9))
        used &= telling
        rest = np.arange(texts) % 5 == 0
        weight = np.where(rest, 0.0, 1.0) / max((~rest).sum(), 1)
        # Only terms that count are kept beyond here.
        known = used[bucket]
        size = np.bincount(text, weights=count, minlength=texts)
        text, bucket, count = text[known].astype(np.int64), bucket[known].astype(np.int64), count[known]
        share = _root_share(text, count, size)
        target = np.eye(domains)[y]
        params = [self.present, self.share, self.bias]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            error = (self.posterior(text, bucket, share, texts) - target) * weight[:, None]
            grads = [np.empty_like(self.present), np.empty_like(self.share), error.sum(axis=0)]
            for d in range(domains):
                grads[0][:, d] = np.bincount(bucket, weights=error[text, d], minlength=BUCKETS) + decay * self.present[:, d]
                grads[1][:, d] = np.bincount(bucket, weights=error[text, d] * share, minlength=BUCKETS) + decay * self.share[:, d]
            for p, g, m, s in zip(params, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
        if rest.sum() >= 20:
            logits = self.logits(text, bucket, share, texts)[rest]
            truth = y[rest]

            def loss(k: float) -> float:
                z = logits / k
                z = z - z.max(axis=1, keepdims=True)
                return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]))

            self.temperature = float(min(np.geomspace(0.3, 8, 50), key=loss))
        return self


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: int, sample: int = SAMPLE) -> Softmax:
    """A classifier from at most ``sample`` labelled documents; ``labelled`` holds doc_id and domain. Without labels all domains are as likely."""
    chosen = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "domain").orderBy(F.xxhash64("_id"), "_id", "domain").limit(sample)
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"]).join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, edges in chunks(batches, "text"):
            text, bucket, count = _terms_once(data, edges)
            at = np.searchsorted(text, np.arange(part.num_rows + 1))
            cut = [(bucket[a:b].astype(np.int32).tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("domain"), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], names=["domain", "bucket", "count"])

    got = rows.limit(sample).mapInArrow(sparse, "domain int, bucket binary, count binary").toPandas()
    model = Softmax(domains)
    if len(got):
        text = np.repeat(np.arange(len(got), dtype=np.int32), got["bucket"].map(len).to_numpy() // 4)
        bucket, count = (np.frombuffer(b"".join(got[c]), np.int32) for c in ("bucket", "count"))
        y = got["domain"].to_numpy(np.int64)
        del got
        model.fit(text, bucket, count, y)
    return model


def _posteriors(model: Broadcast, keep: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        softmax = received(model)
        for part, data, edges in chunks(batches, "text", _SMALL):
            text, bucket, count = _terms_once(data, edges)
            texts = part.num_rows
            p = softmax.posterior(text, bucket, share_of(text, count, texts), texts)
            words = _words(data, edges)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(names.index(c)) for c in keep] + [pa.array(words), lists], names=[*keep, "n_tokens", "posterior"])

    return run


def _words(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    start, _ = word_edges(data, edges)
    return np.bincount(owner_of(start, edges), minlength=len(edges) - 1) if len(start) else np.zeros(len(edges) - 1, np.int64)


def posteriors(docs: DataFrame, model: Broadcast, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens (words) and the posterior over domains."""
    names = list(dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*names).mapInArrow(_posteriors(model, keep, names), f"{fields}, n_tokens long, posterior array<double>")


def rates_after(p: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps whose domain gradients are given: from 1, down the gradient, never below 0."""
    r = np.ones(len(p))
    for g in gradients:
        r = np.maximum(0.0, r - p @ g)
    return r


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def _totals(gradients: list[np.ndarray], domains: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(domains)
        for batch in batches:
            p = _matrix(batch.column("posterior"), domains)
            total += (rates_after(p, gradients) * batch.column("n_tokens").to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(domains, dtype=np.int32)), pa.array(total)], names=["domain", "total"])

    return run


def domain_totals(rows: DataFrame, gradients: list[np.ndarray], domains: int) -> np.ndarray:
    """Expected tokens of each domain under the current rates."""
    got = rows.select("n_tokens", "posterior").mapInArrow(_totals(gradients, domains), "domain int, total double").groupBy("domain").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(domains)
    for domain, total in got:
        out[domain] = total
    return out


def fit_rates(rows: DataFrame, weights: list[float], steps: int = STEPS, close: float = CLOSE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Projected gradient steps toward ``weights`` x the domain's present total; gradients, reached totals, targets.

    Minimises the sum over domains of (total - target)**2 / (2 * present total).
    Scaled by the tokens of a document, its gradient in a document's rate is the
    posterior times (total - target) / present total, and a step of length 1 is stable.
    """
    domains = len(weights)
    present = domain_totals(rows, [], domains)
    target = present * np.array(weights)
    gradients: list[np.ndarray] = []
    total = present
    for _ in range(steps):
        gap = total - target
        if np.abs(gap).max(initial=0) <= close * max(present.sum(), 1e-9):
            break
        gradients.append(np.divide(gap, present, out=np.zeros(domains), where=present > 0))
        total = domain_totals(rows, gradients, domains)
    return gradients, total, target


def _along(gradients: list[np.ndarray], points: np.ndarray):
    domains = points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(points), domains + 1 + domains * domains))
        for batch in batches:
            p = _matrix(batch.column("posterior"), domains)
            n = batch.column("n_tokens").to_numpy()
            base = rates_after(p, gradients)
            for i, g in enumerate(points):
                r = np.maximum(0.0, base - p @ g)
                out[i, :domains] += (n * r) @ p
                out[i, domains] += 0.5 * (n * r) @ r
                out[i, domains + 1 :] += ((p * (n * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], names=["cell", "value"])

    return run


def _at_points(rows: DataFrame, gradients: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """For a further step by each point: domain totals, half the squared rates by token, and the products of posteriors where the rate is above 0."""
    domains = points.shape[1]
    got = rows.select("n_tokens", "posterior").mapInArrow(_along(gradients, points), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(points) * (domains + 1 + domains * domains))
    for cell, value in got:
        out[cell] = value
    return out.reshape(len(points), -1)


def exact_step(rows: DataFrame, gradients: list[np.ndarray], present: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step after which the squares that ``fit_rates`` minimises, plus STAY x the squared change of the rates, are least, and the totals it reaches.

    The step g leaves the rates max(0, r - posterior . g); it is the least point of a
    convex function of g alone, piecewise quadratic, which damped Newton steps find.
    """
    domains = len(target)
    stay = STAY * np.maximum(present, 1e-9)
    lengths = 0.5 ** np.arange(HALVINGS + 1)

    def read(row: np.ndarray, g: np.ndarray):
        total = row[:domains]
        return row[domains] + g @ target + 0.5 * g @ (stay * g), target - total + stay * g, row[domains + 1 :].reshape(domains, domains) + np.diag(stay), total

    g = np.zeros(domains)
    value, slope, bend, total = read(_at_points(rows, gradients, g[None])[0], g)
    for _ in range(NEWTON):
        if (np.abs(slope) <= 1e-4 * MET * np.maximum(target, 1e-9)).all():
            break
        tried = g - lengths[:, None] * np.linalg.solve(bend, slope)
        states = [read(row, at) for row, at in zip(_at_points(rows, gradients, tried), tried)]
        best = min(range(len(tried)), key=lambda i: states[i][0])
        if states[best][0] >= value and np.abs(states[best][1]).max() >= np.abs(slope).max():
            break
        g, (value, slope, bend, total) = tried[best], states[best]
    return g, total


def met(total: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.abs(total - target) <= MET * np.maximum(target, 1e-9)


def meet_targets(rows: DataFrame, weights: list[float], exact: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As ``fit_rates``, with a warning of targets that are not met; ``exact`` first adds an exact last step for them.

    Where the posteriors of nearly all documents leave something to a domain that
    is to go, the exact rates are 0 for most documents and high for a few.
    """
    gradients, total, target = fit_rates(rows, weights)
    if exact and not met(total, target).all():
        step, total = exact_step(rows, gradients, domain_totals(rows, [], len(weights)), target)
        gradients = [*gradients, step]
    if not met(total, target).all():
        warnings.warn("the rates miss targets: " + ", ".join(f"domain {i} has {a:.6g} of {b:.6g} tokens" for i, (a, b) in enumerate(zip(total, target))), stacklevel=2)
    return gradients, total, target


def _rated(gradients: list[np.ndarray], domains: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates_after(_matrix(batch.column("posterior"), domains), gradients)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*names, "rate"])

    return run


def _rated_texts(model: Broadcast, gradients: list[np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        softmax = received(model)
        for part, data, edges in chunks(batches, "text", _SMALL):
            text, bucket, count = _terms_once(data, edges)
            p = softmax.posterior(text, bucket, share_of(text, count, part.num_rows), part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rates_after(p, gradients))], names=[*names, "rate"])

    return run


def scored_with_rates(docs: DataFrame, model: Broadcast, gradients: list[np.ndarray]) -> DataFrame:
    """All columns of the documents with their rate. One worker does both, so that a task holds no second one and no second copy of its texts."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_rated_texts(model, gradients, docs.columns), f"{fields}, rate double")


def with_rates(rows: DataFrame, gradients: list[np.ndarray], domains: int) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_rated(gradients, domains, rows.columns), f"{fields}, rate double")


def copies(rate: Column, *keys: Column) -> Column:
    """How often a document is written: the whole part of its rate, and once more with the chance of the rest, from a hash of its keys."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


#: Share of each domain's present tokens that the mix asks for.
WEIGHTS = (1.25, 0.05, 0.02)


def classifier(docs: DataFrame, labels: DataFrame) -> Broadcast:
    labelled = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    return shipped(docs.sparkSession, fit_classifier(docs, labelled, len(DOMAINS)))


def mixture(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, exact: bool = False) -> DataFrame:
    """doc_id, n_tokens, the posterior of each domain, rate and copies of every document.

    A null or empty text has no tokens; its posterior comes from the bias alone.
    Null labels are left out of the fit. Repeated rows get equal rates and
    copies. An empty table gives no rows.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = stored(posteriors(plain, classifier(plain, labels), ["doc_id"]), "posteriors")
    gradients, _, _ = meet_targets(rows, list(weights), exact)
    rated = with_rates(rows, gradients, len(weights))
    return rated.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, exact: bool = False) -> DataFrame:
    """The documents drawn by their rates, each once at most, with their columns.

    A rate of 1 or more keeps a document for sure; the others are drawn by a hash
    of id and text, so rows without an id are drawn one by one. The rates are fitted on a
    table of posteriors; the documents are then scored again beside their
    columns, so that no text is shuffled. What is drawn is stored, so that the
    settings of the caller hold for it too.
    """
    model = classifier(docs, labels)
    rows = stored(posteriors(docs, model, ["doc_id"]), "posteriors")
    gradients, _, _ = meet_targets(rows, list(weights), exact)
    names = [c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    rated = scored_with_rates(docs.toDF(*names), model, gradients)
    key = names[docs.columns.index("doc_id")]
    drawn = rated.where(copies(F.col("rate"), F.col(key), F.col("text")) > 0)
    return stored(drawn.select(*names), "mixed").toDF(*docs.columns)
