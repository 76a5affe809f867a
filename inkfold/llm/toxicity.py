"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

Texts are cut into overlapping windows of a few words; a window's evidence is its compressed length with the ordinary dictionary less that
with the toxic one. Both are trained by zstandard on windows of labelled documents, apart from each other. Toxic documents hold mostly
ordinary language, so training is repeated on halves of the documents that score each other: windows of toxic documents with more evidence
than ordinary windows mostly have train the next toxic dictionary, and ordinary windows with false evidence are trained into the
ordinary one. The ordinary content also ends the toxic dictionary, at the same distances and with the same entropy tables, so that a length only
differs where toxic text explains a window better. A logistic model over how many windows pass each threshold, fitted on
evidence from dictionaries that have not seen the document, gives the score; so the thresholds are calibrated together.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, remembered, text_slices, tidy

WORD = re.compile(r"\w{1,48}")
WINDOW, STEP = 4, 2  # words of a window, words from one to the next
THRESHOLDS = (2, 3, 4, 5, 6, 8, 10, 12)
LEVEL = 12
SIZES = {"ordinary": 1 << 16, "false": 1 << 14, "toxic": 1 << 12}
ROUNDS = 3
REPEATED_OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))  # end a trained dictionary's tables


def windows(text: str | None) -> list[bytes]:
    """The distinct windows of a text; none without words. Words of more than 48 letters count as several."""
    words = WORD.findall((text or "").lower())
    return list(dict.fromkeys([(" " + " ".join(words[i : i + WINDOW])).encode("utf-8", "replace") for i in range(0, max(1, len(words) - WINDOW + STEP), STEP)])) if words else []


def trained(samples: list[bytes], size: int, most: int = 150_000) -> tuple[bytes, bytes]:
    """Entropy tables and content of a trained dictionary; where the trainer finds the samples too few, no tables and the bytes themselves."""
    import zstandard

    samples = samples[:: max(1, len(samples) // most)]
    try:
        found = zstandard.train_dictionary(size, samples, d=6, k=24).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(samples)[-size:]
    at = found.find(REPEATED_OFFSETS) + len(REPEATED_OFFSETS)
    return (found[:at], found[at:]) if at >= len(REPEATED_OFFSETS) else (b"", found)


class Pair:
    """Compressors with the ordinary and the toxic dictionary."""

    def __init__(self, tables: bytes, ordinary: bytes, toxic: bytes, threads: int = 1):
        import zstandard

        self.threads, self.pair = threads, []
        kind = zstandard.DICT_TYPE_FULLDICT if tables else zstandard.DICT_TYPE_RAWCONTENT
        for content in (ordinary, toxic + ordinary):
            d = zstandard.ZstdCompressionDict(tables + content.rjust(8), dict_type=kind)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.many = "multi_compress_to_buffer" in zstandard.backend_features

    def evidence(self, found: list[bytes]) -> np.ndarray:
        """Of each window: by how many bytes the toxic dictionary makes it shorter."""
        lengths = []
        for c in self.pair if found else ():
            parts = c.multi_compress_to_buffer(found, threads=self.threads) if self.many else map(c.compress, found)
            lengths.append(np.fromiter(map(len, parts), np.int64, len(found)))
        return lengths[0] - lengths[1] if lengths else np.zeros(0, np.int64)

    def of_texts(self, texts: list[str | None]) -> list[tuple[list[bytes], np.ndarray]]:
        """Windows and evidence of each text."""
        each = [windows(t) for t in texts]
        all_ = self.evidence([w for ws in each for w in ws])
        ends = np.cumsum([len(ws) for ws in each])
        return list(zip(each, np.split(all_, ends[:-1]), strict=True)) if each else []


def features(evidence: np.ndarray) -> list[float]:
    """How many windows pass each threshold (log counts and shares), the largest evidence, the log of all windows."""
    n = [int((evidence >= t).sum()) for t in THRESHOLDS]
    return [*[math.log1p(x) for x in n], *[x / (len(evidence) + 20) * 20 for x in n], max(0, int(evidence.max(initial=0))) / 4, math.log1p(len(evidence)) / 4]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a ridge; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def half_of(text: str) -> int:
    """0 or 1, mostly the same for near copies: by the smallest hash of the windows."""
    return min((zlib.crc32(w) for w in windows(text)), default=0) >> 4 & 1


def evidence_of(pair: Pair, rows: list[tuple[str, int]]) -> list[np.ndarray]:
    """The evidence of each row's windows, a few hundred rows at a time."""
    return [e.astype(np.int16) for i in range(0, len(rows), 250) for _, e in pair.of_texts([t for t, _ in rows[i : i + 250]])]


def fit(rows: list[tuple[str, int]], threads: int | None = None) -> dict:
    """A model of (text, label) rows: halves score each other, the final dictionaries come from all rows. With one label only, its mean."""
    rows = [(t or "", int(y)) for t, y in rows]
    threads = threads or min(4, os.cpu_count() or 1)
    halves = [[r for r in rows if half_of(r[0]) == h] for h in (0, 1)]
    if any(len({y for _, y in some}) < 2 for some in halves):  # too few rows to score each other
        halves = [rows, rows]
        if len({y for _, y in rows}) < 2:
            return {"base": float(np.mean([y for _, y in rows])) if rows else 0.0}
    of = lambda some, label: list(dict.fromkeys(w for t, y in some if y == label for w in windows(t)))
    toxic, false = [of(some, 1) for some in halves], [[], []]
    ordinary = [trained(of(some, 0), SIZES["ordinary"]) for some in halves]
    for turn in range(ROUNDS):
        pairs = []
        for h in (0, 1):
            tables, content = ordinary[h]
            extra = trained(false[h], SIZES["false"])[1] if false[h] else b""
            pairs.append(Pair(tables, extra + content, trained(toxic[h], SIZES["toxic" if turn else "ordinary"])[1], threads))
        found = [evidence_of(pairs[1 - h], halves[h]) for h in (0, 1)]
        seen = {label: np.concatenate([e for h in (0, 1) for (_, y), e in zip(halves[h], found[h], strict=True) if y == label]) for label in (0, 1)}
        least = next((t for t in range(1, 40) if (seen[1] >= t).mean() >= 2 * (seen[0] >= t).mean() + 1e-9), int(np.quantile(seen[0], 0.998)) + 1 if len(seen[0]) else 1)
        chosen = [dict.fromkeys(w for (t, y), e in zip(halves[h], found[h], strict=True) if y for w, x in zip(windows(t), e.tolist(), strict=True) if x >= least) for h in (0, 1)]
        for h in (0, 1):
            more = dict.fromkeys(false[h])
            for (t, y), e in zip(halves[h], found[h], strict=True):
                for w, x in zip(windows(t), e.tolist(), strict=True) if not y else ():
                    for some in chosen:
                        some.pop(w, None)  # what ordinary documents hold as well
                    if x >= 3:
                        more[w] = None
            false[h] = list(more)
        toxic = [list(some) or old for some, old in zip(chosen, toxic, strict=True)]
    x, y = np.array([features(e) for some in found for e in some]), np.array([y for some in halves for _, y in some], float)
    both = lambda some: list(dict.fromkeys(some[0] + some[1]))
    tables, content = trained(of(rows, 0), SIZES["ordinary"])
    extra = trained(both(false), SIZES["false"])[1] if any(false) else b""
    last = {"tables": tables, "ordinary": extra + content, "toxic": trained(both(toxic), SIZES["toxic"])[1]}
    return {**{k: v.hex() for k, v in last.items()}, "weights": logistic(x, y).tolist()}


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        if "weights" in model:
            self.pair = Pair(*(bytes.fromhex(model[k]) for k in ("tables", "ordinary", "toxic")))
            self.weights = np.array(model["weights"])

    def __call__(self, texts: list[str | None]) -> list[float]:
        if "weights" not in self.model:
            return [self.model["base"]] * len(texts)
        z = [float(np.dot(features(e), self.weights[:-1]) + self.weights[-1]) for _, e in self.pair.of_texts(texts)]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]


def held_out(column: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, mod 4, is 2."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % 4) == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, sample_bytes: int = 16 << 20) -> dict:
    """Fit on a bounded sample of labelled rows that are not held out: the first ``sample_rows`` by a hash of the id, and of those at most ``sample_bytes`` of text.

    Repeated or contradictory labels of one id: the largest counts. Null labels, ids and texts teach nothing.
    """
    marks = flat(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # at most sample_rows rows of 16 bytes
    texts = flat(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows, size = [], 0
    for r in texts.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_rows).toLocalIterator():
        size += len(r.text)
        if rows and size > sample_bytes:
            break
        rows.append((r.text, int(r.toxic > 0)))
    return fit(rows)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs and ``score`` (double, 0 to 1). Null and empty texts get the score of a text without windows."""
    from pyspark.sql import types as T

    packed = json.dumps(model)
    keep = [f.name for f in docs.schema]
    name = next(f"score{'_' * i}" for i in range(99) if f"score{'_' * i}" not in keep)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        scorer = remembered(("toxicity", hash(packed)), lambda: Scorer(json.loads(packed)))
        for batch in batches:
            for a, b in text_slices(batch, "text", 1 << 20):
                part = batch.slice(a, b - a)
                found = scorer(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*keep, name])

    return docs.mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """Per row of docs: ``doc_id, held_out, score, predicted`` (1 where score >= cut). Repeated rows stay; a null doc_id is not held out.

    An empty table gives no rows; columns of other names are ignored. A very long text is scored whole; its windows bound the memory of a task from below.
    """
    scored = score(flat(docs, "doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
