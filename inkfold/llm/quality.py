"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else that learning sees is unlabelled web text, so no label 0 is ever read. A text
becomes shares of its shapes (letters, digits and runs reduced), of repetition and of its worst blocks. A small network is fitted by minimising
the non-negative unbiased risk of positive-unlabelled learning: the risk on the positives, weighted by the class prior, plus that of the
unlabelled taken as negative, less the positives' part of it; where this difference falls below zero, the step undoes it. The prior, the share of good
documents among the unlabelled, is estimated from how much rarer the highest scores of a first classifier are in the unlabelled text.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, text_slices, tidy
from .toxicity import held_out

BLOCK_WORDS, BLOCK_BYTES = 64, 512
BINS = 96  # of hashed shapes, and of hashed pairs of them
CLASSES = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 57 if 48 <= b < 58 else 32 if b in (9, 11, 12, 13, 32) else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)
PLAIN = 17
SIZE = PLAIN + 2 * BINS


def blocks(values: np.ndarray, size: int) -> np.ndarray:
    """Means of blocks of ``size``; a last block under half of it belongs to the one before."""
    n = max(1, (len(values) + size // 2) // size)
    edges = np.minimum(np.arange(n) * size, len(values))
    return np.add.reduceat(values.astype(np.float32), edges) / np.diff(np.append(edges, len(values)))


def features(text: str | None) -> np.ndarray:
    """What the network sees of a text, all of it; zeros for null and for texts without words."""
    out = np.zeros(SIZE, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    classes = raw.translate(CLASSES)
    at = np.frombuffer(classes, np.uint8)
    upper, digit, space = at == 65, at == 57, (at == 32) | (at == 10)
    symbol = ~(upper | digit | space | (at == 97))
    n = len(words)
    again = np.fromiter(map(eq, words, words[1:]), np.bool_, n - 1) if n > 1 else np.zeros(1, bool)
    lines = [x for x in raw.split(b"\n") if x]
    plain = [math.log1p(n) / 10, len(raw) / n / 20, upper.mean(), symbol.mean(), digit.mean(), space.mean(), again.mean()]
    for values, size in ((upper, BLOCK_BYTES), (symbol, BLOCK_BYTES), (digit, BLOCK_BYTES), (again, BLOCK_WORDS)):
        each = blocks(values, size)
        plain += [each.max(), each.min()]
    count = Counter(words)
    plain += [max(count.values()) / n, 1 - len(set(lines)) / len(lines)]
    out[:PLAIN] = plain
    shapes = RUN.sub(rb"\1", classes).split()
    for start, seen in ((PLAIN, Counter(shapes)), (PLAIN + BINS, Counter(zip(shapes, shapes[1:])))):
        total = max(1, sum(seen.values()))
        for shape, k in seen.items():
            key = shape if isinstance(shape, bytes) else b" ".join(shape)
            out[start + zlib.crc32(key[:64]) % BINS] += k / total
    np.sqrt(out[PLAIN:], out=out[PLAIN:])
    return out


class Network:
    """One hidden layer; the output is the log odds of a good document."""

    def __init__(self, size: int, hidden: int, rng: np.random.Generator):
        self.w = [rng.normal(0, 1 / math.sqrt(size), (size, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        self.x, self.h = x, np.maximum(x @ a + b, 0)
        return self.h @ c + d[0]

    def gradient(self, by_odds: np.ndarray) -> list[np.ndarray]:
        back = by_odds[:, None] * self.w[2] * (self.h > 0)
        return [self.x.T @ back, back.sum(0), self.h.T @ by_odds, by_odds.sum(keepdims=True)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimised(p: np.ndarray, u: np.ndarray, prior: float, seed: int = 0, hidden: int = 24, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """A network of least non-negative unbiased risk (logistic loss), by Adam."""
    rng = np.random.default_rng(seed)
    net = Network(p.shape[1], hidden, rng)
    first, second, step = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    parts = max(1, len(u) // 256)
    for _ in range(epochs):
        for some_p, some_u in zip(np.array_split(rng.permutation(len(p)), parts), np.array_split(rng.permutation(len(u)), parts), strict=True):
            if not len(some_p) or not len(some_u):
                continue
            z = net.odds(np.concatenate([p[some_p], u[some_u]]))
            zp, zu = z[: len(some_p)], z[len(some_p) :]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            rest = np.concatenate([-prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)])
            own = np.concatenate([prior * (sigmoid(zp) - 1) / len(zp), np.zeros(len(zu))])
            slope = net.gradient(own + rest if negative >= 0 else -rest)
            step += 1
            for i, (w, g) in enumerate(zip(net.w, slope, strict=True)):
                g = g + decay * w
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                w -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def estimated_prior(p: np.ndarray, u: np.ndarray, least: float = 0.05) -> float:
    """The share of positives among u, from scores of rows a classifier has not seen.

    The positives are a part of u, so among the highest scores u holds the prior's share of what p holds, and more only by its negatives: the
    least ratio of the two tails is the prior. Each ratio counts with its standard error on top, so that noisy tails do not win.
    """
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    tail = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    of_p, of_u = np.maximum(tail(p), 1e-9), tail(u)
    ratios = of_u / of_p + np.sqrt((1 - of_p) / (of_p * len(p)) + of_u * (1 - of_u) / len(u))
    return float(np.clip(ratios.min(), least, 1 - least / 5))


def fit(p: np.ndarray, u: np.ndarray) -> dict:
    """A model of the features of positives and unlabelled. Without either: every score is 0.5."""
    if len(p) < 2 or len(u) < 2:
        return {"base": 0.5}
    both = np.concatenate([p, u]).astype(np.float64)
    centre, spread = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - centre) / spread, -8, 8) for x in (p, u))
    fold_p, fold_u = np.arange(len(p)) % 2, np.arange(len(u)) % 2
    seen_p, seen_u = np.zeros(len(p)), np.zeros(len(u))
    for k in (0, 1):  # halves score each other, with the unlabelled taken as negative
        net = minimised(p[fold_p != k], u[fold_u != k], 0.5, seed=k, epochs=12)
        seen_p[fold_p == k], seen_u[fold_u == k] = net.odds(p[fold_p == k]), net.odds(u[fold_u == k])
    prior = estimated_prior(seen_p, seen_u)
    nets = [minimised(p, u, prior, seed=s) for s in (2, 3, 4)]
    return {"prior": prior, "centre": centre.tolist(), "spread": spread.tolist(), "nets": [[w.tolist() for w in net.w] for net in nets]}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Row by row, so that a score does not depend on what shares its batch."""
    if "nets" not in model:
        return np.full(len(x), model["base"])
    x = np.clip((x - np.array(model["centre"])) / np.array(model["spread"]), -8, 8)
    nets = [tuple(map(np.array, net)) for net in model["nets"]]
    total = np.array([sum(float(np.maximum(row @ a + b, 0) @ c + d[0]) for a, b, c, d in nets) for row in x])
    return np.round(sigmoid(total / len(nets)), 9)


def free_name(taken: list[str], name: str) -> str:
    return next(f"{name}{'_' * i}" for i in range(len(taken) + 1) if f"{name}{'_' * i}" not in taken)


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``positive, unlabelled, text`` of the rows that learning sees: ``sample_rows`` ids of each kind, the first by a hash, none held out."""
    known = F.col("doc_id").isNotNull() & ~held_out()
    first = lambda ids: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    marks = flat(labels, "doc_id", "quality").where(known & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = first(marks.where("quality > 0").select("doc_id")).withColumn("kind", F.lit(1))
    web = first(flat(docs, "doc_id").where(known).distinct()).withColumn("kind", F.lit(2))
    chosen = good.unionByName(web).groupBy("doc_id").agg((F.max(F.col("kind") % 2) > 0).alias("positive"), (F.max("kind") > 1).alias("unlabelled"))
    texts = flat(docs, "doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(F.min("text").alias("text"))  # 2 * sample_rows ids at most


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4_000) -> dict:
    """Fit on a bounded sample: at most ``sample_rows`` trusted positives and as many rows of unlabelled text, whatever they are labelled.

    Only labels of rows that are not held out count, and only labels above 0. An id with several labels is trusted if all are; of repeated rows of an id
    one text is taken. Null labels, ids and texts teach nothing.
    """
    schema = "doc_id string, positive boolean, unlabelled boolean, x array<float>"

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                x = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), part.column("unlabelled"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "positive", "unlabelled", "x"])

    rows = sampled(docs, labels, sample_rows).select(F.col("doc_id").cast("string").alias("doc_id"), "positive", "unlabelled", "text")
    found = rows.mapInArrow(tidy(run), schema).toArrow().sort_by("doc_id")  # at most 2 * sample_rows rows of SIZE floats
    x = np.array(found["x"].to_pylist(), np.float32).reshape(-1, SIZE)
    flags = {c: found[c].to_numpy().astype(bool) for c in ("positive", "unlabelled")}
    order = np.argsort([zlib.crc32(i.encode()) for i in found["doc_id"].to_pylist()], kind="stable")
    return fit(*(x[order][flags[c][order]] for c in ("positive", "unlabelled")))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs and, as the last one, ``score`` (double, 0 to 1). Null texts and texts without words get one score of their own."""
    keep = docs.columns
    name = free_name(keep, "score")
    packed = json.dumps(model)

    def run(batches):
        own = {k: np.array(v) if k != "nets" else [tuple(map(np.array, net)) for net in v] for k, v in json.loads(packed).items()}
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                x = np.array([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(own, x), pa.float64())], [*keep, name])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """Per row of docs: ``doc_id, held_out, score, predicted`` (1 where score >= cut). Repeated rows stay and score alike; a null doc_id is not held out.

    An empty table gives no rows; columns of other names are ignored. Long texts are scored whole.
    """
    scored = score(flat(docs, "doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
