"""Soft-membership mixing: document rates whose expected domain totals match target weights.

A multinomial logistic classifier, trained on a bounded sample of a labelled table, gives each document posteriors p over
domains. Rates w >= 0 minimise |sum_i w_i n_i p_i - t|^2 + ridge * sum_i n_i (w_i - 1)^2 (n: tokens, scaled by their total) by accelerated
projected gradient steps. A step needs only the K residuals, summed over all documents; a document's rate follows from its
posteriors and the residuals so far, so nothing but K numbers a round is kept or sent.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, flat, remembered, text_slices, tidy

N_FEATURES = 256 + 7


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows (square roots of byte shares, and how long, varied and repetitive words and lines are) and token counts (words)."""
    out, tokens = np.zeros((len(texts), N_FEATURES)), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        if not len(data):
            continue
        words, lines = text.split(), text.split("\n")
        n = tokens[i] = len(words)
        out[i, :256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
        distinct = len(set(words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        out[i, 256:] = math.log1p(n) / 8, distinct / max(1, n), pairs / max(1, n - 1), len(set(lines)) / len(lines), math.log1p(len(data) / len(lines)) / 8, len(data) / max(1, n) / 16, math.sqrt(distinct) / 32
    return out, tokens


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    """Domains, classifier, target shares, and the residuals of the steps so far."""

    domains: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ridge: float = 1e-3
    residuals: list[list[float]] = field(default_factory=list)
    least: float = 0.0  # bounds that the rates are projected onto
    most: float = math.inf

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return softmax(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])

    def rates(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """The rates after all steps; with ``ahead`` the point at which the next residual is taken."""
        step = 1 / (1 + self.ridge)
        w = y = np.ones(len(p))
        momentum = 1.0
        for r in self.residuals:
            new = np.clip(y - step * (p @ np.array(r) + self.ridge * (y - 1)), self.least, self.most)
            following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
            y, w, momentum = np.clip(new + (momentum - 1) / following * (new - w), self.least, self.most), new, following
        return y if ahead else w

    def packed(self) -> str:
        return json.dumps({"domains": self.domains, "mean": self.mean.tolist(), "scale": self.scale.tolist(), "weights": self.weights.tolist(), "ridge": self.ridge, "residuals": self.residuals, "least": self.least, "most": self.most})

    @classmethod
    def unpacked(cls, text: str) -> Model:
        d = json.loads(text)
        return cls(d["domains"], *(np.array(d[k]) for k in ("mean", "scale", "weights")), d["ridge"], d["residuals"], d["least"], d["most"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, sample_bytes: int = 16 << 20, rounds: int = 300) -> Model:
    """Fit the classifier on at most ``sample_rows`` rows (``sample_bytes`` of text) of ``doc_id, domain``, the first by a hash of the id.

    Of several labels of an id the smallest counts; null ids, domains and texts teach nothing. Without labels there is one domain.
    """
    marks = flat(labels, "doc_id", "domain").where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # at most sample_rows short rows
    rows = flat(docs, "doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_rows)
    texts, names, size = [], [], 0
    for r in rows.toLocalIterator():
        size += len(r.text)
        if texts and size > sample_bytes:
            break
        texts.append(r.text)
        names.append(r.domain)
    domains = sorted(set(names)) or ["all"]
    x, _ = features(texts)
    mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(N_FEATURES)
    weights = np.zeros((N_FEATURES + 1, len(domains)))
    if len(domains) > 1:
        z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        y = np.eye(len(domains))[[domains.index(n) for n in names]]
        speed, step = np.zeros_like(weights), 2.0 / max(1.0, float(np.linalg.eigvalsh(z.T @ z / len(z)).max()))
        for _ in range(rounds):
            slope = z.T @ (softmax(z @ weights) - y) / len(z) + 1e-4 * weights
            speed = 0.9 * speed - step * slope
            weights = weights + speed
    return Model(domains, mean, scale, weights)


def members(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, p`` (posteriors in the order of the domains)."""
    packed = model.packed()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])

    def run(batches):
        m = remembered(("mixture", hash(packed)), lambda: Model.unpacked(packed))
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                x, n = features(batch.column("text")[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(n), pa.array(m.posteriors(x).tolist(), pa.list_(pa.float64()))], schema=schema)

    return flat(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, p array<double>")


def matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def totals(table: DataFrame, model: Model) -> np.ndarray:
    """Expected tokens of each domain at the point of the next residual, over all rows."""
    packed, k = model.packed(), len(model.domains)

    def run(batches):
        m, total = Model.unpacked(packed), np.zeros(k)
        for batch in batches:
            p = matrix(batch.column("p"), k)
            total += (m.rates(p, ahead=True) * batch.column("n_tokens").to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["k", "total"])

    out = np.zeros(k)
    for r in table.mapInArrow(tidy(run), "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect():  # a row for each domain
        out[r.k] = r.total
    return out


def fit(table: DataFrame, model: Model, weights: dict[str, float], only_more: bool = False, rounds: int = 60, tolerance: float = 1e-4, most: float = 4.0) -> Model:
    """Add steps until the shares change by less than the tolerance.

    Targets sum to the tokens there are. With ``only_more`` they sum to so many that no domain must shrink, ``most`` times the tokens at most, and every rate
    is projected onto 1 to ``most``; targets further away are approached as far as that allows.
    """
    start = totals(table, model)
    total = start.sum()
    if total <= 0 or len(model.domains) < 2:
        return model
    share = np.array([weights.get(d, 0.0) for d in model.domains])
    share = share / share.sum() if share.sum() > 0 else start / total
    target = share * (max([1.0, *(start[share > 0] / total / share[share > 0])]) if only_more else 1.0)
    if only_more:
        model.least, model.most = 1.0, most
        target = target * min(1.0, most / max(target.sum(), 1e-12))
    found = start
    for _ in range(rounds):
        residual = found / total - target
        model.residuals.append(residual.tolist())
        new = totals(table, model)
        if np.abs(new / total - target).max() < tolerance or np.abs(new - found).max() / total < tolerance / 10:
            break
        found = new
    return model


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``doc_id, n_tokens, rate, p_<domain>...`` for every row of docs; labels: ``doc_id, domain``.

    Null and empty texts have no tokens and the rate that their posteriors give. Repeated rows get equal rates. Targets of
    domains without labels cannot be met and are left out. Long texts count by all their words; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    model = train(docs, labels)
    table = scratch.save(members(docs, model), "members")
    model = fit(table, model, weights)
    packed, k = model.packed(), len(model.domains)
    names = [f"p_{d}" for d in model.domains]

    def run(batches):
        m = Model.unpacked(packed)
        for batch in batches:
            p = matrix(batch.column("p"), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(m.rates(p)), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], ["doc_id", "n_tokens", "rate", *names])

    return table.mapInArrow(tidy(run), ", ".join(["doc_id long", "n_tokens long", "rate double", *(f"`{n}` double" for n in names)]))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], seed: int = 11, most: float = 4.0) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more with the chance of the fraction, by a hash of the row.

    Domains only grow towards their target weights here, so every row stays at least once, and none comes more than ``most`` times (rounded up).
    Null and empty texts and repeated rows fare like others; long texts count by all their words; an empty table stays empty; columns of any name stay.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    model = train(docs, labels)
    packed = fit(scratch.save(members(docs, model), "members"), model, weights, only_more=True, most=most).packed()
    keyed = docs.withColumn("\x00u", (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double"))
    schema = T.StructType(docs.schema.fields)

    def run(batches):
        m = remembered(("mixture", hash(packed)), lambda: Model.unpacked(packed))
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                x, _ = features(part.column("text").to_pylist())
                rate = m.rates(m.posteriors(x))
                copies = np.floor(rate + part.column(part.num_columns - 1).to_numpy()).astype(np.int64)
                where = pa.array(np.repeat(np.arange(len(copies)), copies))
                yield pa.RecordBatch.from_arrays([c.take(where) for c in part.columns[:-1]], part.schema.names[:-1])

    return keyed.mapInArrow(tidy(run), schema)
