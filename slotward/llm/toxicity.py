"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A text is the weighted mean of the vectors of its subwords (character 3- to 5-grams of each word with
its boundaries, and the word itself, hashed into BUCKETS rows), so a spelling never seen in training
still shares most of its vectors with the word it is made from. Vectors and the softmax layer are
learned together, on at most `max_rows` labelled rows (a bounded sample by hash of doc_id, whole
texts) in one task. Scoring runs on the executors: with two classes the model folds into one number per bucket,
and a word's share is computed once per worker and kept in a bounded cache.

Defined cases: null and empty texts score as the class prior; rows with equal doc_id are scored one by
one; a doc_id labelled several times counts as toxic if any label says so; null labels are left out;
without both classes in the sample every score is the prior (0.0 when there are no labels at all).
Extra columns of `docs` stay as they are; the columns named below replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 17
BUCKETS = 1 << BITS
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the hashes
WIDTH = 8
GRAMS = (3, 4, 5)
MIN_TEXTS = 5  # a bucket is used if so many sampled texts have it
SMOOTH = 1e-4  # share of all subwords at which a subword's weight in the mean is halved
MAX_ROWS = 6000  # bound of the labelled sample
EPOCHS = 6
RATE = 0.5
SCALE = 40.0  # of the mean vector, which is short because most subwords say nothing
CACHE = 300_000  # words kept per worker
EDGES = ".,;:!?\"'()[]{}«»…-*_#$%&|<>@~"


@dataclass(frozen=True)
class Model:
    """Weight of a bucket in the logit, its averaging weight, and the constant."""

    logit: np.ndarray
    share: np.ndarray
    bias: float


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every boundary-marked character n-gram of the words and of the words themselves."""
    marked = [f"<{core}>" if (core := w.strip(EDGES).lower()) else "" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    if not len(code):
        return owner, owner
    owners, hashes = [], []
    run = code + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        run = run[:-1] * STEP + code[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(run)] == owner[n - 1 :]
            owners.append(owner[: len(run)][inside])
            hashes.append(run[inside] ^ np.uint64(n << 56))
    filled = np.flatnonzero(size)
    start = (np.cumsum(size) - size)[filled]
    place = (np.arange(len(code)) - np.repeat(start, size[filled])).astype(np.uint64)
    owners.append(filled)
    hashes.append(np.add.reduceat(mixed(code + (place << np.uint64(32))), start))
    return np.concatenate(owners), (mixed(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and how often each occurs."""
    found, known = [], {}
    for text in texts:
        words = (text or "").split()
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            owner, ids = subwords(new)
            order = np.argsort(owner, kind="stable")
            known |= zip(new, np.split(ids[order], np.cumsum(np.bincount(owner, minlength=len(new)))[:-1]))
        cells = np.concatenate([known[w] for w in words]) if words else np.zeros(0, dtype=np.int64)
        ids, n = np.unique(cells, return_counts=True)
        found.append((ids.astype(np.int32), n.astype(np.float32)))
    return found


def fit(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Train vectors and softmax together by gradient steps of falling size; the same rows give the same model.

    The first coordinate of the vectors starts at the classes' log ratios, so much of the score is there before the
    first step; training fits the other coordinates and corrects this one.
    """
    y = np.array(labels, dtype=np.float64)
    zero = np.zeros(BUCKETS, dtype=np.float32)
    prior = float((y.sum() + 1e-6) / (len(y) + 2e-6)) if len(y) else 0.0
    constant = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -60.0
    if not len(y) or y.min() == y.max():
        return Model(zero, zero, constant)
    found = bags(texts)
    frequency, texts_with = zero.astype(np.float64), zero.astype(np.int64)
    for ids, n in found:
        frequency[ids] += n
        texts_with[ids] += 1
    common = texts_with >= MIN_TEXTS  # rarer buckets only memorise their text
    found = [(ids[keep], n[keep]) for ids, n in found for keep in [common[ids]]]
    # Common subwords say little: smooth inverse frequency weights the mean.
    share = np.where(common, SMOOTH / (SMOOTH + frequency / max(frequency.sum(), 1)), 0.0)
    # The first coordinate starts at the smoothed log ratio of texts with the bucket in either class.
    texts_toxic = zero.astype(np.float64)
    for (ids, _), label in zip(found, y, strict=True):
        texts_toxic[ids] += label
    odds = np.log((texts_toxic + prior) / (texts_with - texts_toxic + 1 - prior) * (1 - prior) / prior)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (BUCKETS, WIDTH))
    vectors[:, 0] = np.where(common, 0.1 * odds, 0.0)
    layer, bias = rng.normal(0, 0.1, WIDTH), constant
    layer[0] = 1.0
    filled = np.array([i for i, (ids, _) in enumerate(found) if len(ids)], dtype=np.int64)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(filled)
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            ids = np.concatenate([found[r][0] for r in rows])
            weight = np.concatenate([found[r][1] * share[found[r][0]] for r in rows])
            sizes = np.array([len(found[r][0]) for r in rows])
            at = np.cumsum(sizes) - sizes
            weight = weight / np.repeat(np.add.reduceat(weight, at), sizes)
            mean = np.add.reduceat(vectors[ids] * weight[:, None], at)
            error = 1 / (1 + np.exp(-np.clip(SCALE * (mean @ layer) + bias, -30, 30))) - y[rows]
            pull = np.bincount(ids, weights=weight * np.repeat(error, sizes), minlength=BUCKETS)
            cells = np.flatnonzero(pull)
            grad = SCALE * pull[cells, None] * layer
            layer = layer - rate * SCALE * (error @ mean) / len(rows)
            bias -= rate * error.mean()
            vectors[cells] -= rate * grad
    return Model((SCALE * share * (vectors @ layer)).astype(np.float32), share.astype(np.float32), float(bias))


def scored(texts: pd.Series, model: Model, known: dict[str, tuple[float, float]]) -> np.ndarray:
    """Score whole texts; `known` keeps a word's share of the two sums between texts."""
    out = np.empty(len(texts))
    for row, text in enumerate(texts):
        words = (text or "").split()
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            if len(known) >= CACHE:
                known.clear()
                new = list(dict.fromkeys(words))
            owner, ids = subwords(new)
            top = np.bincount(owner, model.logit[ids], len(new))
            bottom = np.bincount(owner, model.share[ids], len(new))
            known |= zip(new, zip(top.tolist(), bottom.tolist()))
        pairs = [known[w] for w in words]
        below = sum(p[1] for p in pairs)
        out[row] = model.bias + (sum(p[0] for p in pairs) / below if below else 0.0)
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: a quarter by checksum of the id's text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most `max_rows` labelled rows outside the held-out quarter, by hash of doc_id.

    The ids are picked from the labels alone; with at most `max_rows` of them the broadcast is bounded.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the sample in one task, so that neither its texts nor the training need memory of the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        model = fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])
        yield pa.RecordBatch.from_pylist([{"logit": model.logit.tobytes(), "share": model.share.tobytes(), "bias": model.bias}])

    found = labelled_sample(docs, labels, max_rows).coalesce(1).mapInArrow(run, "logit binary, share binary, bias double").collect()
    if not found:
        return fit([], [])
    return Model(np.frombuffer(found[0]["logit"], np.float32), np.frombuffer(found[0]["share"], np.float32), found[0]["bias"])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add held_out, score (0 to 1) and predicted (1 from the threshold on) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[float, float]] = {}
        for texts in batches:
            yield pd.Series(scored(texts, shared.value, known))

    found = docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": toxic(F.col("text"))})
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on the labelled sample and score all rows."""
    return score(docs, train(docs, labels, max_rows), threshold)
