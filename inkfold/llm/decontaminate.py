"""Benchmark decontamination: item-sized windows within an edit distance (in words) of a benchmark item.

1. Gate, without loss: an item of n words under e edits keeps one of e + 1 pieces whole, so only windows around a piece's
   occurrence can match.
2. CGK embedding: a random walk over a window's words, that repeats or passes each word by random bits, turns edit distance into Hamming
   distance. Bit-sampling LSH hashes a few places of the embedding; walks and samples are repeated until simulated edits of the items
   themselves reach the target recall.
3. Windows that meet an item in a table are verified by the exact edit distance of the item to the best substring of the region.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, remembered, rows_out, text_slices, tidy
from .shingles import U64, mix, window_hashes

import xxhash  # isort: skip

SAMPLE = 3  # places of an embedding in one hash
TABLES = 12  # samples of a walk
PAD = U64(0x5BD1E9955BD1E995)


class Normal:
    """Hashes of words by their letters and digits, lower-cased (words without any: 0), remembered and bounded."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def of(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set(words)
        for w in new:
            letters = "".join(filter(str.isalnum, w)).lower()
            self.known[w] = xxhash.xxh64_intdigest(letters.encode()) if letters else 0
        return np.fromiter(map(self.known.__getitem__, words), U64, len(words))


def edits(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def embed(windows: np.ndarray, walks: int) -> np.ndarray:
    """CGK embeddings (walks, windows, 3n symbols) of windows of n word hashes."""
    b, n = windows.shape
    padded = np.concatenate([windows, np.full((b, 1), PAD)], 1)
    rows, seed = np.tile(np.arange(b), walks), np.repeat(np.arange(walks, dtype=U64), b) * U64(0x9E3779B97F4A7C15)
    at, out = np.zeros(b * walks, np.int64), np.empty((b * walks, 3 * n), U64)
    for j in range(3 * n):
        c = padded[rows, at]
        out[:, j] = c
        step = mix(c + seed + U64((j + 1) * 2_654_435_761)) >> U64(63)
        at = np.minimum(at + step.astype(np.int64), n)
    return out.reshape(walks, b, 3 * n)


def table_keys(windows: np.ndarray, walks: int, tables: int) -> np.ndarray:
    """LSH keys of windows of one size: a column for each walk and table."""
    b, n = windows.shape
    out, embedded = np.empty((b, walks * tables), U64), embed(windows, walks)
    for w in range(walks):
        rng = np.random.default_rng(1000 + w)
        places = np.stack([np.sort(rng.choice(int(2.2 * n), SAMPLE, replace=n < SAMPLE)) for _ in range(tables)])
        key = np.repeat(np.arange(tables, dtype=U64)[None] + U64(n * 65_537 + w * 257), b, 0)
        for p in places.T:
            key = mix(key * U64(0x9E3779B97F4A7C15) + embedded[w][:, p])
        out[:, w * tables : (w + 1) * tables] = key
    return out


def substring_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of item to a substring of region, and that substring's start and end (the earliest end)."""
    m = len(region)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    span = np.arange(m + 1)
    for i, word in enumerate(item):
        down, cross = cost + 1, cost[:-1] + (region != word)
        new, start = down.copy(), begin.copy()
        new[0] = i + 1
        better = cross <= new[1:]
        new[1:], start[1:] = np.where(better, cross, new[1:]), np.where(better, begin[:-1], start[1:])
        low = np.minimum.accumulate(new - span)  # insertions: the best to the left, one edit a step
        source = np.maximum.accumulate(np.where(new - span == low, span, 0))
        cost, begin = low + span, start[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Matcher:
    """Finds items in texts. items: (id, text) of a bounded block."""

    def __init__(self, items: list[tuple[int, str]], share: float, recall: float, least_words: int, walks: int = 0):
        self.share, self.items, self.normal = share, [], Normal()
        pieces: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            h = self.normal.of((text or "").split())
            h = h[h != 0]
            n = len(h)
            if n < max(1, least_words):
                continue
            k, e = len(self.items), edits(n, share)
            self.items.append((item_id, h))
            cuts = [i * n // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[b - a][int(window_hashes(h[a:b], b - a)[0])].append((k, a))
        self.pieces = {size: (self._filter(list(d)), d) for size, d in sorted(pieces.items())}
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for k, (_, h) in enumerate(self.items):
            self.by_size[len(h)].append(k)
        self.walks, self.tables = (walks, TABLES) if walks else self._calibrate(recall)
        self.keys: dict[int, list[dict[int, list[int]]]] = {}
        for n, ks in self.by_size.items():
            columns = [defaultdict(list) for _ in range(self.walks * self.tables)]
            for k, row in zip(ks, table_keys(np.stack([self.items[k][1] for k in ks]), self.walks, self.tables).tolist(), strict=True):
                for c, key in enumerate(row):
                    columns[c][key].append(k)
            self.keys[n] = columns

    @staticmethod
    def _filter(keys: list[int]) -> np.ndarray:
        """A bit table that holds all keys: few other hashes pass."""
        bits = max(16, min(24, (4096 * len(keys)).bit_length()), (64 * len(keys)).bit_length())
        out = np.zeros(1 << bits, bool)
        out[np.array(keys, U64) & U64((1 << bits) - 1)] = True
        return out

    def _calibrate(self, recall: float) -> tuple[int, int]:
        """Walks and tables for which items with as many random edits as are allowed are met by the target share."""
        rng, tables = np.random.default_rng(5), TABLES
        some = [self.items[i][1] for i in rng.permutation(len(self.items))[:40]]
        met = np.zeros((len(some), 32), bool)
        for i, h in enumerate(some):
            n, words = len(h), h.tolist()
            for _ in range(edits(n, self.share)):
                at, kind = int(rng.integers(len(words))), int(rng.integers(3))
                if kind == 0:
                    words[at] = int(rng.integers(1 << 62))
                elif kind == 1:
                    words.insert(at, int(rng.integers(1 << 62)))
                elif len(words) > 1:
                    del words[at]
            w = np.array((words + [1] * n)[:n], U64)
            left, right = table_keys(np.stack([h, w]), 32, tables)
            met[i] = np.logical_or.accumulate((left == right).reshape(32, tables).any(1))
        found = met.mean(0) if len(some) else np.ones(32)
        if not (found >= recall).any():
            raise ValueError(f"32 walks reach a recall of {found[-1]:.3f} only, {recall} is asked")
        return int(np.argmax(found >= recall)) + 1, tables

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """The matches of each text. Pieces are looked for in all texts at once, only texts that hold one are searched further."""
        words = [(t or "").split() for t in texts]
        h = self.normal.of([w for ws in words for w in ws])
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])[h != 0]
        h = h[h != 0]
        hit = np.zeros(len(texts), bool)
        for size, (bits, _) in self.pieces.items():
            at = np.flatnonzero(bits[window_hashes(h, size) & U64(len(bits) - 1)])
            hit[owner[at[owner[at] == owner[at + size - 1]]]] = True
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [self.matches(h[ends[i] : ends[i + 1]]) if hit[i] else [] for i in range(len(texts))]

    def matches(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Best match of each item found in the word hashes of a text: (item id, distance, first word, end)."""
        starts: dict[int, set[int]] = defaultdict(set)
        for size, (bits, known) in self.pieces.items():
            grams = window_hashes(h, size)
            for p in np.flatnonzero(bits[grams & U64(len(bits) - 1)]).tolist():
                for k, offset in known.get(int(grams[p]), ()):
                    n = len(self.items[k][1])
                    e = edits(n, self.share)
                    starts[n].update(range(p - offset - e, p - offset + e + 1))
        found: dict[int, tuple[int, int, int]] = {}
        for n, some in starts.items():
            at = np.array(sorted(some))
            padded = np.concatenate([np.full(n, PAD), h, np.full(n, PAD)])
            at = at[(at > -n) & (at < len(h))]
            keys = table_keys(padded[at[:, None] + n + np.arange(n)], self.walks, self.tables)
            met: dict[int, list[int]] = defaultdict(list)
            for c, column in enumerate(self.keys[n]):
                for row, key in enumerate(keys[:, c].tolist()):
                    for k in column.get(key, ()):
                        met[k].append(int(at[row]))
            for k, places in met.items():
                item, e = self.items[k][1], edits(n, self.share)
                places, lo = sorted(set(places)), None
                for i, s in enumerate(places):  # places close together are one region
                    lo = s if lo is None else lo
                    if i + 1 < len(places) and places[i + 1] - s <= n:
                        continue
                    a, b = max(0, lo - e), min(len(h), s + n + e)
                    distance, start, end = substring_distance(item, h[a:b])
                    if distance <= e and (k not in found or distance < found[k][0]):
                        found[k] = (distance, a + start, a + end)
                    lo = None
        return [(self.items[k][0], d, a, b) for k, (d, a, b) in sorted(found.items())]


def matcher_of(packed: str) -> Matcher:
    """One for all tasks of a Python worker."""
    return remembered(("benchmark", hash(packed)), lambda: made(json.loads(packed)))


def made(spec: dict) -> Matcher:
    return Matcher([tuple(x) for x in spec["items"]], spec["share"], spec["recall"], spec["least_words"], spec["walks"])


def blocks_of(benchmark: DataFrame, share: float, recall: float, least_words: int, block_bytes: int) -> list[str]:
    """The benchmark in blocks of bounded size, each to be sent to all tasks."""
    b = flat(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    out = []
    for i in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").toLocalIterator()
        items = [(r.item_id, r.text) for r in rows]
        walks = Matcher(items, share, recall, least_words).walks
        out.append(json.dumps({"items": items, "share": share, "recall": recall, "least_words": least_words, "walks": walks}))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.98, least_words: int = 1, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, item_id, distance, n_words, first_word, end_word``: a row for each row of docs and item found in it (its best match).

    Words are compared by their letters and digits in lower case. Null and empty texts hold nothing, an empty table gives no rows. Items of
    fewer than ``least_words`` words, and null ones, are not searched, nor are items without any letter or digit. Repeated rows of either table give
    repeated rows. Long texts are searched whole; an empty benchmark finds nothing; other columns are ignored.
    """
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("n_words", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    docs = flat(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def search(packed: str):
        def run(batches):
            matcher = matcher_of(packed)
            for batch in batches:
                for i, j in text_slices(batch, "text"):
                    found = {name: [] for name in out.names}
                    part = batch.slice(i, j - i)
                    for doc_id, matches in zip(part.column("doc_id").to_pylist(), matcher.scan(part.column("text").to_pylist()), strict=True):
                        for item, d, a, b in matches:
                            for name, v in zip(out.names, (doc_id, item, d, b - a, a, b), strict=True):
                                found[name].append(v)
                    yield rows_out(out, found)

        return docs.mapInArrow(tidy(run), "doc_id long, item_id long, distance int, n_words int, first_word long, end_word long")

    parts = [search(b) for b in blocks_of(benchmark, share, recall, least_words, block_bytes)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.98, least_words: int = 1, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item is found."""
    schema = T.StructType(docs.schema.fields)
    for packed in blocks_of(benchmark, share, recall, least_words, block_bytes):

        def run(batches, packed=packed):
            matcher = matcher_of(packed)
            for batch in batches:
                for a, b in text_slices(batch, "text"):
                    part = batch.slice(a, b - a)
                    yield part.filter(pa.array([not found for found in matcher.scan(part.column("text").to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs
