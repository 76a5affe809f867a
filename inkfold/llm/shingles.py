"""Words and word shingles of many texts as 64-bit hashes, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import forget

U64 = np.uint64
MULTIPLIERS = [U64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.ones(256, bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
LONGEST = 512  # bytes of words that are hashed eight at a time; longer ones are hashed alone


def word_hashes(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and how many words each text has.

    Words are runs without ASCII white space, ASCII letters lower-cased. They are hashed where they lie in the texts' buffer:
    the length first, then eight bytes of every word in a step.
    """
    forget()
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, "<i8")
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    inside = INSIDE[raw]
    start, end, cuts = inside.copy(), inside.copy(), edges[(edges > 0) & (edges < len(raw))]
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    start[cuts], end[cuts - 1] = inside[cuts], inside[cuts - 1]
    at, sizes = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(at, edges))
    sizes -= at
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(LOWER, raw, out=low[: len(raw)])
    eights = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))
    h = mix(sizes.astype(U64) * MULTIPLIERS[2])
    h = mix(h ^ (eights[at] & MASKS[np.minimum(sizes, 8)]))
    rest = np.flatnonzero((sizes > 8) & (sizes <= LONGEST))
    done = 8
    while len(rest):
        h[rest] = mix(h[rest] ^ (eights[at[rest] + done] & MASKS[np.minimum(sizes[rest] - done, 8)]))
        done += 8
        rest = rest[sizes[rest] > done]
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        h[i] = xxhash.xxh64_intdigest(low[at[i] : at[i] + sizes[i]].tobytes())
    return h, counts


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * MULTIPLIERS[0]
    for i in range(1, k):
        out = (out ^ (out >> U64(29))) * MULTIPLIERS[i % len(MULTIPLIERS)] + h[i : n + i]
    return mix(out)


def shingle_sets(texts: pa.Array | list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; with fewer words, one for the whole sequence; without words, none."""
    h, counts = word_hashes(texts)
    windows, out, at = window_hashes(h, k), [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(windows[at : at + n - k + 1]))
        else:
            out.append(window_hashes(h[at : at + n], n) + U64(n) if n else np.zeros(0, U64))
        at += n
    return out


def fingerprint(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit fingerprint of each set (int64)."""
    if not sets:
        return np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(np.concatenate(sets) * MULTIPLIERS[4]), dtype=U64)])  # sums wrap around, and so do their differences
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(U64)).view(np.int64)
