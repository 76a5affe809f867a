"""Exact substring dedup by column-wise construction of a multi-document Burrows-Wheeler transform.

A string of ``length`` bytes that occurs twice has the same content-defined anchor (the leftmost smallest hash of its
``gram``-byte grams) at the same place in it. So the windows (strings of that length) of a document are cut into runs with
one anchor each, and all repeats are between runs with equal anchors. Runs meet by their anchors' hashes in bins, packed.
Runs that occur twice as a whole are repeated as a whole; of the others those that share at least half of what a repeat needs around
the anchor go on: their bytes (at most 2 * length - gram) are a collection of short strings, and its transform is built by inserting one
symbol of each string per round, from the last to the first. The partial transform of a bin is read and rewritten in sequence each
round. Neighbours in the finished order are compared for their first ``length`` bytes (the common prefixes), and equal ones are repeats.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bins, flat, in_bins, joined_parts, rows_out, text_bytes, text_slices, tidy
from .shingles import U64, mix

# The contract, all pairs and all strings, for tables that DuckDB holds.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT id, doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
w AS (SELECT id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM h, range(0, greatest(n - 199, 0)) t(i)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT id, i, i + 200 AS e FROM w SEMI JOIN again USING (k)),
m AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum((reach IS NULL OR i > reach)::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM m),
u AS (SELECT id, run, min(i) AS a, max(e) AS z FROM g GROUP BY ALL),
keep AS (SELECT id, coalesce(lag(z) OVER o, 0) AS a, a AS z FROM u WINDOW o AS (PARTITION BY id ORDER BY a) UNION ALL SELECT h.id, coalesce(max(u.z), 0), any_value(h.n) FROM h LEFT JOIN u ON u.id = h.id GROUP BY h.id)
SELECT h.doc_id, h.n AS n_bytes, h.n - sum(k.z - k.a)::BIGINT AS n_removed, count(*) - 1 AS n_spans,
sha256(unhex(string_agg(substr(h.x, 2 * k.a + 1, 2 * (k.z - k.a)), '' ORDER BY k.a))) AS kept_sha256
FROM h JOIN keep k ON k.id = h.id GROUP BY h.id, h.doc_id, h.n"""
ROOT = 0x9E3779B97F4A7C15
ROOT_INVERSE = pow(ROOT, -1, 1 << 64)
RUN = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("whole", "<u8"), ("left", "<u4"), ("right", "<u4"), ("start", "<u4"), ("more", "u1"), ("at", "u1")])
PIECE = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "u1"), ("single", "u1")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's root and of its inverse."""
    out = []
    for r in (ROOT, ROOT_INVERSE):
        p = np.full(n, r, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def window_runs(data: np.ndarray, ends: np.ndarray, docs: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The runs of windows with one anchor (RUN rows) of documents laid end to end in ``data``."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, RUN)
    room = 1 << (n + 1).bit_length()
    up, down = (p[: n + 1] for p in powers(room))
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=total[1:])

    def hashed(a, b):  # of data[a:b]
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))

    grams = n - gram + 1
    raw = mix((total[gram:] - total[:grams]) * down[:grams])
    bits = U64(room.bit_length())
    order = ((raw >> bits) << bits) | np.arange(grams, dtype=U64)
    padded = np.full(-(-grams // width) * width + width, ~U64(0))
    padded[:grams] = order
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    anchor = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(ends)), ends - starts)[:windows]
    inside = np.arange(windows) + length <= ends[owner]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new & inside)
    last_of = np.concatenate([np.flatnonzero(new)[1:], [windows]]) - 1
    last = last_of[np.cumsum(new)[first] - 1]
    last = np.minimum(last, ends[owner[first]] - length)
    p, half = anchor[first], (width + 1) // 2 - 1
    out = np.zeros(len(first), RUN)
    out["gram"], out["doc"], out["start"] = raw[p], docs[owner[first]], first - starts[owner[first]]
    out["more"], out["at"] = last - first, p - first
    out["whole"] = hashed(first, last + length) ^ mix((p - first).astype(U64) + U64(7))
    lefts, rights = np.flatnonzero(first <= p - half), np.flatnonzero(last > p - half)
    out["left"][lefts] = hashed(p[lefts] - half, p[lefts] + gram).astype(np.uint32) | np.uint32(1)
    out["right"][rights] = hashed(p[rights], p[rights] + length - half).astype(np.uint32) | np.uint32(1)
    return out


def shared(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows have a nonzero key that another row of the same group has too."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = np.concatenate([[False], (g[1:] == g[:-1]) & (k[1:] == k[:-1])])
    twin = same | np.concatenate([same[1:], [False]])
    out = np.zeros(len(group), bool)
    out[order] = twin & (k != 0)
    return out


def meet(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a bin's runs: those that occur again as a whole, and those (one of each content) that may share a part, as PIECE rows."""
    runs = runs[np.lexsort((runs["start"], runs["doc"], runs["whole"], runs["gram"]))]
    gram, whole = runs["gram"], runs["whole"]
    first = np.concatenate([[True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])])
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate([at, [len(runs)]]))
    again = runs[np.repeat(size, size) > 1]
    reps = runs[at]
    some = shared(reps["gram"], reps["left"]) | shared(reps["gram"], reps["right"])
    out = np.zeros(int(some.sum()), PIECE)
    for name in ("gram", "doc", "start", "more"):
        out[name] = reps[name][some]
    out["single"] = size[some] == 1
    return again, out


def collection_bwt(blob: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform (0: the end mark, else the byte + 1) of the strings ``blob[at : at + size]``.

    Round j inserts, for each string, the symbol before its suffix of j symbols at that suffix's place among all
    suffixes of at most j symbols; the place follows from the last one by counting symbols before it (LF mapping).
    """
    m, step, total = len(at), 128, int(size.sum()) + len(at)
    present = np.flatnonzero(np.bincount(blob, minlength=256))
    code = np.zeros(256, np.uint8)
    code[present] = np.arange(1, len(present) + 1)
    letters, coded = len(present) + 1, code[blob]
    block = (np.arange(total) // step) * letters
    offsets = np.arange(step, dtype=np.uint8)
    ends = at + size - 1
    symbol = lambda which, j: np.where(j < size[which], coded[np.maximum(ends[which] - j, 0)], 0).astype(np.uint8)
    live, place, n = np.arange(m), np.arange(m), m
    last = symbol(live, 0)
    now, other = (np.zeros(-(-total // step) * step, np.uint8) for _ in range(2))  # the transform so far, read and rewritten in turn
    now[:m] = last
    for j in range(1, int(size.max(initial=0)) + 1):
        keep = last > 0
        live, place, last = live[keep], place[keep], last[keep].astype(np.int64)
        if not len(live):
            break
        blocks = n // step + 1
        counts = np.bincount(block[:n] + now[:n], minlength=blocks * letters)[: blocks * letters].reshape(blocks, letters)
        before = np.cumsum(counts, axis=0) - counts
        smaller = np.cumsum(np.concatenate([[0, 0], counts[:, 1:].sum(0)]))[:letters]
        where = place // step
        rank, rows = before[where, last], now[: blocks * step].reshape(blocks, step) if blocks * step <= len(now) else now.reshape(-1, step)
        for lo in range(0, len(place), 16_384):
            p, c = place[lo : lo + 16_384], last[lo : lo + 16_384].astype(np.uint8)
            hit = (rows[where[lo : lo + 16_384]] == c[:, None]) & (offsets < (p % step).astype(np.uint8)[:, None])
            rank[lo : lo + 16_384] += np.count_nonzero(hit, axis=1)
        place = m + smaller[last] + rank
        last = symbol(live, j)
        old = np.ones(n + len(live), bool)
        old[place] = False
        new = other[: len(old)]
        new[old], new[place] = now[:n], last
        now, other, n = other, now, len(old)
    back = np.concatenate([[0], present + 1]).astype(np.uint8)
    return back[now[:n]]


def suffix_places(bwt: np.ndarray, m: int, rounds: int) -> np.ndarray:
    """places[j, i]: where the suffix of j symbols of string i stands in the order of all suffixes."""
    order = np.argsort(bwt, kind="stable")
    ends = int((bwt == 0).sum())
    lf = np.empty(len(bwt), np.int64)
    lf[order] = np.arange(len(bwt)) - ends + m
    out = np.zeros((rounds + 1, m), np.int64)
    place = out[0] = np.arange(m)
    for j in range(1, rounds + 1):
        done = bwt[place] == 0
        place = out[j] = np.where(done, place, lf[place])
    return out


def repeated_windows(blob: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Flags of the windows ``(string, offset)``, offsets from 0 to size - length, strings in order: whether another window equals it."""
    windows = size - length + 1
    owner = np.repeat(np.arange(len(at)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = suffix_places(collection_bwt(blob, at, size), len(at), int(size.max(initial=0)))
    order = np.argsort(places[size[owner] - offset, owner], kind="stable")
    where = (at[owner] + offset)[order]
    same = np.zeros(len(order) + 1, bool)
    step, span = 20_000, np.arange(length)
    for lo in range(1, len(order), step):
        hi = min(len(order), lo + step)
        text = blob[where[lo - 1 : hi, None] + span]
        same[lo:hi] = (text[1:] == text[:-1]).all(1)
    out = np.zeros(len(order), bool)
    out[order] = same[:-1] | same[1:]
    return out


def gram_slices(gram: np.ndarray, size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows sorted by gram with about ``most`` bytes each; the rows of one gram stay together."""
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    upto = np.cumsum(size) - size
    cut = np.flatnonzero(np.diff(upto[first] // most, prepend=-1))
    at = [*first[cut].tolist(), len(gram)]
    return list(zip(at, at[1:], strict=False))


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of spans (touching ones join)."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["end"], spans["start"]))]
    reach = np.maximum.accumulate(spans["end"])
    new = np.concatenate([[True], spans["start"][1:] > reach[:-1]])
    at = np.flatnonzero(new)
    out = np.zeros(len(at), SPAN)
    out["start"], out["end"] = spans["start"][at], reach[np.concatenate([at[1:], [len(spans)]]) - 1]
    return out


def span_rows(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Spans by document, packed."""
    if not len(docs):
        return [], []
    order = np.argsort(docs, kind="stable")
    docs, spans = docs[order], np.zeros(len(docs), SPAN)
    spans["start"], spans["end"] = starts[order], ends[order]
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    stop = np.concatenate([at[1:], [len(docs)]])
    return docs[at].tolist(), [union(spans[a:b]).tobytes() for a, b in zip(at.tolist(), stop.tolist(), strict=True)]


def by_bin(rows: np.ndarray, parts: int):
    """Rows by the bin of their anchor: bin number and rows."""
    own = (rows["gram"] % U64(parts)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    found, at = np.unique(own[order], return_index=True)
    for b, lo, hi in zip(found.tolist(), at.tolist(), [*at.tolist()[1:], len(rows)], strict=True):
        yield b, order[lo:hi]


def joined(docs: DataFrame, packed: DataFrame, most_bytes: int, how: str) -> DataFrame:
    """docs with the lists ``packed`` for them; broadcast only where its size, just summed, is small."""
    size = packed.agg(F.sum(F.expr("aggregate(packed, 32L, (n, x) -> n + length(x))"))).first()[0] or 0
    return docs.join(F.broadcast(packed) if size <= most_bytes else packed, "doc", how)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, broadcast_bytes: int = 24 << 20, bin_bytes: int = 24 << 20, slice_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of docs: every byte in a string of ``length`` bytes that also starts elsewhere goes.

    Null texts are empty. Matches never cross documents. Repeated rows are documents of their own, so their long texts go as a whole.
    Very long texts are searched whole; an empty table gives no rows; other columns are ignored. A bin holds the runs of about ``bin_bytes`` of text, or as
    many bytes of short strings, of which about ``slice_bytes`` (one anchor's at least) are transformed at a time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    docs = flat(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    parts = bins(spark, text_bytes(docs), bin_bytes)

    def laid(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.as_buffer() for x in batch.column("text")[a:b]]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])

    dealt = pa.schema([("bin", pa.int32()), ("packed", pa.binary())])

    def deal(batches):
        held, size = [], 0

        def packed():
            rows = np.concatenate(held)
            found = [(k, rows[at].tobytes()) for k, at in by_bin(rows, parts)]
            return rows_out(dealt, {"bin": [k for k, _ in found], "packed": [x for _, x in found]})

        for batch in batches:
            for a, b in text_slices(batch, "text", 1 << 19):
                data, ends = laid(batch, a, b)
                held.append(window_runs(data, ends, batch.column("doc")[a:b].to_numpy(zero_copy_only=False), length, gram))
                size += held[-1].nbytes
                if size > 4 << 20:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    grouped = pa.schema([("doc", pa.int64()), ("kind", pa.int32()), ("packed", pa.binary())])

    def group(batches):
        held = [np.frombuffer(x.as_buffer(), RUN) for batch in batches for x in batch.column("packed")]
        if not held:
            return
        again, pieces = meet(np.concatenate(held))
        ids, spans = span_rows(again["doc"], again["start"], again["start"] + again["more"] + length)
        yield rows_out(grouped, {"doc": ids, "kind": [0] * len(ids), "packed": spans})
        pieces = pieces[np.argsort(pieces["doc"], kind="stable")]
        own, at = np.unique(pieces["doc"], return_index=True)
        bounds = [*at.tolist(), len(pieces)]
        yield rows_out(grouped, {"doc": own.tolist(), "kind": [1] * len(own), "packed": [pieces[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]})

    met = in_bins(docs.select("doc", "text").mapInArrow(tidy(deal), "bin int, packed binary"), parts)
    met = scratch.save(met.mapInArrow(tidy(group), "doc long, kind int, packed binary"), "met")
    wanted = met.where("kind = 1").groupBy("doc").agg(F.collect_list("packed").alias("packed"))
    wanted_bytes = (2 * length - gram + PIECE.itemsize) * (met.where("kind = 1").agg(F.sum(F.length("packed"))).first()[0] or 0) // PIECE.itemsize
    parts_cut = bins(spark, wanted_bytes, bin_bytes)
    cut = pa.schema([("bin", pa.int32()), ("meta", pa.binary()), ("blob", pa.binary())])

    def fetch(batches):
        for batch in batches:
            for a, b in text_slices(batch, "text", 2 << 20):
                pieces, blobs, seen = [], [], set()
                for doc, text, packed in zip(batch.column("doc")[a:b].to_pylist(), batch.column("text")[a:b], joined_parts(batch.column("packed")[a:b]), strict=True):
                    if doc in seen:
                        continue
                    seen.add(doc)
                    data, rows = text.as_buffer().to_pybytes(), np.frombuffer(packed, PIECE)
                    pieces.append(rows)
                    blobs += [data[s : s + n + length] for s, n in zip(rows["start"].tolist(), rows["more"].tolist(), strict=True)]
                if pieces:
                    rows = np.concatenate(pieces)
                    found = [(k, rows[at].tobytes(), b"".join([blobs[i] for i in at.tolist()])) for k, at in by_bin(rows, parts_cut)]
                    yield rows_out(cut, {name: [x[i] for x in found] for i, name in enumerate(cut.names)})

    spans_out = pa.schema([("doc", pa.int64()), ("packed", pa.binary())])

    def build(batches):
        metas, blobs = [], []
        for batch in batches:
            metas += [np.frombuffer(x.as_buffer(), PIECE) for x in batch.column("meta")]
            blobs += [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("blob")]
        if not metas:
            return
        rows, blob = np.concatenate(metas), np.concatenate(blobs)
        size = rows["more"].astype(np.int64) + length
        at = np.cumsum(size) - size
        order = np.lexsort((rows["start"], rows["doc"], rows["gram"]))  # a repeated row brings its pieces twice
        r = rows[order]
        once = order[np.concatenate([[True], (r["doc"][1:] != r["doc"][:-1]) | (r["start"][1:] != r["start"][:-1]) | (r["gram"][1:] != r["gram"][:-1])])]
        rows, at, size = rows[once], at[once], size[once]
        for x, y in gram_slices(rows["gram"], size, slice_bytes):
            r, n = rows[x:y], size[x:y]
            own = np.cumsum(n) - n
            flags = repeated_windows(blob[np.repeat(at[x:y] - own, n) + np.arange(int(n.sum()))], own, n, length)
            windows = n - length + 1
            owner = np.repeat(np.arange(len(r)), windows)
            first = np.repeat(np.cumsum(windows) - windows, windows)
            start = r["start"][owner].astype(np.int64) + np.arange(len(owner)) - first
            take = flags & (r["single"][owner] == 1)
            ids, spans = span_rows(r["doc"][owner][take], start[take], start[take] + length)
            yield rows_out(spans_out, {"doc": ids, "packed": spans})

    pieces = joined(docs.select("doc", "text"), wanted, broadcast_bytes, "inner").mapInArrow(tidy(fetch), "bin int, meta binary, blob binary")
    built = scratch.save(in_bins(pieces, parts_cut).mapInArrow(tidy(build), "doc long, packed binary"), "built")
    spans = met.where("kind = 0").select("doc", "packed").unionByName(built).groupBy("doc").agg(F.collect_list("packed").alias("packed"))
    spans = scratch.save(spans, "spans")
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(batches):
        for batch in batches:
            found = {name: [] for name in result.names}
            for doc_id, text, packed in zip(batch.column("doc_id").to_pylist(), batch.column("text"), joined_parts(batch.column("packed")), strict=True):
                data = text.as_buffer()
                gone = union(np.frombuffer(packed, SPAN))
                kept, at = hashlib.sha256(), 0
                for s, e in gone.tolist():
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                for name, v in zip(result.names, (doc_id, len(data), int((gone["end"] - gone["start"]).sum()), len(gone), kept.hexdigest()), strict=True):
                    found[name].append(v)
            yield rows_out(result, found)

    return joined(docs, spans, broadcast_bytes, "left").select("doc_id", "text", "packed").mapInArrow(tidy(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
