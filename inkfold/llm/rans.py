"""Token-ID output: static range asymmetric numeral system (rANS) files.

One frequency table is shared by all files of a data set. A file holds independent blocks; a block interleaves
many lanes (token i goes to lane i mod lanes), so that NumPy codes one token of every lane in a step. Each block
carries a CRC-32 of its ids, and checkpoints (the lanes' states and the place in the word stream at some steps), so that
readers can start in the middle of a block.

File: magic, header, blocks, document index, footer (offsets of blocks, counts, CRC-32), 8 bytes with the footer's length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, flat, give_back, open_fs, partition_id, remembered, rows_out, text_slices, tidy, written

MAGIC = b"RANSTOK1"
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
HEAD, BLOCK, TAIL = struct.Struct("<8sII"), struct.Struct("<IIIII"), struct.Struct("<QQQQI")


@dataclass
class Table:
    """Frequencies that add up to 2**SCALE_BITS, one at least for every id of the vocabulary."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, room, n = max(1, int(counts.sum())), 1 << SCALE_BITS, len(counts)
        if n > room // 2:
            raise ValueError(f"{n} ids do not fit {SCALE_BITS} bits")
        freq = 1 + (counts.astype(np.float64) * ((room - n) / total)).astype(np.int64)
        freq[int(np.argmax(freq))] += room - int(freq.sum())
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table, every: int = 128) -> bytes:
    """ids (uint32, at least one) as one block."""
    n = len(ids)
    lanes = int(min(4096, max(1, n // 64)))
    steps = -(-n // lanes)
    grid = np.zeros(steps * lanes, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    state = np.full(lanes, LOW, np.uint64)
    shift, limit = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    low32, word = np.uint64(0xFFFFFFFF), np.uint64(32)
    emitted: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    count = 0
    for t in range(steps - 1, -1, -1):
        width = lanes if t < steps - 1 else n - (steps - 1) * lanes
        x, s = state[:width], grid[t, :width]
        f = table.freq[s]
        full = x >= (f << limit)
        if full.any():
            out = x[full]
            emitted.append((out & low32).astype(np.uint32))
            count += len(out)
            x = np.where(full, x >> word, x)
        q = x // f
        state[:width] = (q << shift) + (x - q * f) + table.cum[s]
        if t and t % every == 0:
            marks.append((t, count, state.astype("<u8").tobytes()))
    words = np.concatenate(emitted[::-1]).astype("<u4") if emitted else np.zeros(0, "<u4")
    parts = [BLOCK.pack(n, lanes, len(words), len(marks), zlib.crc32(ids.astype("<u4").tobytes())), state.astype("<u8").tobytes()]
    parts += [struct.pack("<II", t, len(words) - c) + states for t, c, states in reversed(marks)]
    return b"".join([*parts, words.tobytes()])


def decode_block(data: bytes, table: Table, from_checkpoint: int = -1, to_checkpoint: int | None = None) -> np.ndarray:
    """The ids of a block, or of the run of steps from one checkpoint (-1: the start) to another (None: the end)."""
    n, lanes, n_words, n_marks, crc = BLOCK.unpack_from(data)
    at = BLOCK.size
    size = 8 * lanes
    marks_at = at + size
    words = np.frombuffer(data, "<u4", n_words, marks_at + n_marks * (8 + size))
    mark = lambda k: struct.unpack_from("<II", data, marks_at + k * (8 + size))
    steps, first, place = -(-n // lanes), 0, 0
    if from_checkpoint >= 0:
        first, place = mark(from_checkpoint)
        at = marks_at + from_checkpoint * (8 + size) + 8
    last = steps if to_checkpoint is None else mark(to_checkpoint)[0]
    state = np.frombuffer(data, "<u8", lanes, at).copy()
    out = np.zeros((last - first, lanes), np.uint32)
    shift, mask, word = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
    for t in range(first, last):
        width = lanes if t < steps - 1 else n - (steps - 1) * lanes
        x = state[:width]
        slot = x & mask
        s = table.symbol[slot.astype(np.int64)]
        x = table.freq[s] * (x >> shift) + slot - table.cum[s]
        need = x < LOW
        k = int(need.sum())
        if k:
            x[need] = (x[need] << word) | words[place : place + k]
            place += k
        state[:width] = x
        out[t - first, :width] = s
    ids = out.reshape(-1)[: n - first * lanes]
    if first == 0 and last == steps and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, out, table: Table, block: int = 1 << 20):
        self.out, self.table, self.block = out, table, block
        self.at, self.waiting, self.held, self.offsets = 0, [], 0, []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self._put(HEAD.pack(MAGIC, SCALE_BITS, table.crc))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        start = 0
        while len(ids) - start >= self.block or end and start < len(ids):
            piece = ids[start : start + self.block]
            self.offsets.append(self.at)
            self._put(encode_block(piece, self.table))
            start += len(piece)
        self.waiting, self.held = [ids[start:]], len(ids) - start

    def close(self) -> None:
        self._flush(True)
        index = zlib.compress(
            np.array([x or 0 for x in self.doc_ids], "<i8").tobytes()
            + np.array([x is None for x in self.doc_ids], "u1").tobytes()
            + np.array(self.sizes, "<i8").tobytes(),
            1,
        )
        index_at = self.at
        self._put(index)
        offsets = np.array(self.offsets, "<u8").tobytes()
        foot = TAIL.pack(len(self.doc_ids), len(self.offsets), index_at, len(index), zlib.crc32(index + offsets)) + offsets
        self._put(foot + struct.pack("<Q", len(foot)))


def read_file(path: str, table: Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file in order, by range reads: footer, index, then block after block."""
    filesystem, place = open_fs(path)
    with filesystem.open_input_file(place) as f:
        size = f.size()
        magic, bits, crc = HEAD.unpack(f.read_at(HEAD.size, 0))
        if magic != MAGIC or bits != SCALE_BITS or crc != table.crc:
            raise ValueError(f"{path}: another format or frequency table")
        (length,) = struct.unpack("<Q", f.read_at(8, size - 8))
        foot = f.read_at(length, size - 8 - length)
        n_docs, n_blocks, index_at, index_len, check = TAIL.unpack_from(foot)
        offsets = np.frombuffer(foot, "<u8", n_blocks, TAIL.size)
        index = f.read_at(index_len, index_at)
        if zlib.crc32(index + offsets.tobytes()) != check:
            raise ValueError(f"{path}: the index's checksum differs")
        index = zlib.decompress(index)
        doc_ids = np.frombuffer(index, "<i8", n_docs)
        nulls = np.frombuffer(index, "u1", n_docs, 8 * n_docs)
        sizes = np.frombuffer(index, "<i8", n_docs, 9 * n_docs)
        ends = [*offsets.tolist()[1:], index_at]
        pieces: list[np.ndarray] = []
        held, block = 0, 0
        for d in range(n_docs):
            need = int(sizes[d])
            while held < need:
                start = int(offsets[block])
                pieces.append(decode_block(f.read_at(int(ends[block]) - start, start), table))
                held += len(pieces[-1])
                block += 1
            ids = pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
            yield None if nulls[d] else int(doc_ids[d]), ids[:need]
            pieces, held = [ids[need:]], held - need


# White space that texts may hold other than single spaces and line feeds between words.
ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def runs(text: str, most: int):
    """A regular text in runs of about ``most`` characters, cut at single spaces (which are left out)."""
    start = 0
    while len(text) - start > most:
        end = text.rfind(" ", start, start + most)
        end = end if end > start else text.find(" ", start + most)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:]


class Words:
    """Byte-level BPE through the tokenizers library, text cut where its pattern always cuts.

    Around a single line feed, and before a single space, between characters that are not white space a new piece always
    starts, so the words of regular texts can be encoded apart: Arrow finds the distinct words of a slice, the library encodes each of
    them once, and Arrow puts the ids in their places. Texts with other white space, or with the text of an added token, go to the
    library whole. Nothing is kept between slices.
    """

    def __init__(self, tokenizer_file: str, dtype: str, most: int = 4 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.most = Tokenizer.from_file(tokenizer_file), np.dtype(dtype), most
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.together = 1 if any(a.split() != [a] for a in self.added) else 1000  # no added token may arise between two words
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True  # how byte-level BPE writes a space

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _word_ids(self, words: pa.Array, before: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words, many to a string, and how many each has; ``before`` is a space, or empty where words start with a line feed."""
        ids, sizes = [], []
        for start in range(0, len(words), self.together):
            some = words.slice(start, self.together).to_pylist()
            found = self._ids(before + before.join(some))
            at = np.flatnonzero(self.spaced[found] if before else found == self.feed)
            if len(at) == len(some):
                sizes.append(np.diff(at, append=len(found)))
            else:
                each = [self._ids(before + w) for w in some]
                found = np.concatenate(each)
                sizes.append(np.array([len(x) for x in each]))
            ids.append(found)
        return ids, sizes

    def _regular(self, texts: pa.Array, head: bool) -> list[bytes]:
        """Ids of texts without odd white space: whole ones (``head``), or runs that follow a space."""
        texts = pc.replace_substring(texts, "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", texts, "") if head else texts, " ")
        coded = lists.flatten().dictionary_encode()
        starts = pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        order = np.argsort(starts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        n = len(order) - int(starts.sum())
        words = coded.dictionary.take(pa.array(order))
        plain, first = self._word_ids(words.slice(0, n), " "), self._word_ids(words.slice(n), "")
        width = self.dtype.itemsize
        ends = np.concatenate([[0], np.cumsum(np.concatenate(plain[1] + first[1]))]) * width
        binary = pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(np.concatenate(plain[0] + first[0]))])
        taken = binary.take(pa.array(place[coded.indices.to_numpy()]))
        ends = np.frombuffer(taken.buffers()[1], "<i8", len(taken) + 1, 8 * taken.offset)
        bounds, data = ends[lists.offsets.to_numpy()].tolist(), memoryview(taken.buffers()[2])
        skip = width if head else 0  # the line feed put before a text
        return [bytes(data[i + skip : j]) for i, j in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; no nulls."""
        sizes = pc.binary_length(texts)
        odd = pc.or_(pc.equal(sizes, 0), pc.match_substring_regex(texts, ODD))
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        whole = pc.invert(pc.or_(odd, pc.greater(sizes, self.most)))
        found = iter(self._regular(texts.filter(whole), True) if pc.any(whole).as_py() else [])
        out = []
        for i, (strange, short) in enumerate(zip(odd.to_pylist(), whole.to_pylist(), strict=True)):
            if short:
                out.append(next(found))
            elif strange:
                out.append(self._ids(texts[i].as_py()).tobytes())
            else:
                out.append(b"".join(self._regular(pa.array([run], texts.type), not k)[0] for k, run in enumerate(runs(texts[i].as_py(), self.most))))
        return out


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int, dtype: str, vocab: int, slice_bytes: int) -> DataFrame:
    """``doc_id, ids, counts``: ids (binary, of little-endian ``dtype``) with the end id; a null text counts as empty.

    Each task ends with a row without ids: how often it wrote each id, packed as pairs of integers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        words, end, seen = remembered(("tokens", tokenizer_file, dtype, slice_bytes), lambda: Words(tokenizer_file, dtype, slice_bytes)), np.array([end_id], dtype).tobytes(), np.zeros(vocab, np.int64)
        for batch in batches:
            for a, b in text_slices(batch, "text", words.most):
                part = batch.slice(a, b - a)
                found = [x + end for x in words.encode(part.column("text").fill_null(""))]
                seen += np.bincount(np.frombuffer(b"".join(found), dtype), minlength=vocab)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary()), pa.nulls(b - a, pa.binary())], schema=schema)
        some = np.flatnonzero(seen)
        yield rows_out(schema, {"doc_id": [None], "ids": [None], "counts": [np.stack([some, seen[some]], 1).astype("<i8").tobytes()]})
        give_back()

    return flat(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def write_dataset(tokens: DataFrame, folder: str, scratch: Scratch, dtype: str, vocab: int, tokens_per_file: int = 8_000_000) -> tuple[DataFrame, Callable[[], Table]]:
    """Write files in ascending doc_id order (nulls first) below ``folder``; returns the manifest ``file, path, n_docs, n_tokens`` and the shared table's reader."""
    tokens = scratch.save(tokens, "tokens")

    def count(batches):
        for batch in batches:
            for packed in batch.column(0):
                pairs = np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "n"])

    counts = np.zeros(vocab, np.int64)
    for r in tokens.where("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():  # one row an id of the vocabulary at most
        counts[r.id] = r.n
    total, table_path = int(counts.sum()), f"{folder}/table.bin"
    freq = Table.of_counts(counts).freq.astype("<u4").tobytes()
    with written(table_path) as out:
        out.write(freq)

    def load() -> Table:
        filesystem, place = open_fs(table_path)
        with filesystem.open_input_file(place) as f:
            return Table(np.frombuffer(f.read(), "<u4"))

    def encode(batches):
        number, n_docs, n_tokens = partition_id(), 0, 0
        path, writer = f"{folder}/part-{number:06d}.rans", None
        with written(path) as out:
            writer = Writer(out, load())
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = np.frombuffer(ids.as_buffer(), dtype).astype(np.uint32)
                    writer.add(doc, found)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(found)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["file", "path", "n_docs", "n_tokens"])

    files = max(1, -(-total // tokens_per_file))
    ordered = tokens.where("ids is not null").select("doc_id", "ids").repartitionByRange(files, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    manifest = scratch.save(ordered.mapInArrow(tidy(encode), "file long, path string, n_docs long, n_tokens long"), "manifest")
    scratch.drop("tokens")
    return manifest, load


def read_dataset(manifest: DataFrame, load: Callable[[], Table]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files, a task a file."""
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        table = None
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = table or load()
                found = {f.name: [] for f in schema}
                for doc, ids in read_file(path, table):
                    for k, v in (("doc_id", doc), ("start", base), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.astype("<u4").tobytes()))):
                        found[k].append(v)
                    base += len(ids)
                    if len(found["doc_id"]) >= 20_000:
                        yield rows_out(schema, found)
                        found = {f.name: [] for f in schema}
                yield rows_out(schema, found)

    tasks = placed.select("path", "base", "file").repartition(max(1, manifest.count()), "file").select("path", "base")
    return tasks.mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_file: str, end_id: int = 2, tokens_per_file: int = 8_000_000, slice_bytes: int = 4 << 20) -> DataFrame:
    """Encode documents to token ids, write rANS files, read them back.

    Null texts count as empty; null doc_ids come first; repeated rows stay, in the order of their ids; an empty
    table gives one empty file and no rows. Other columns are ignored. ``slice_bytes`` of text are encoded at a time: more repeats of a
    word are met in larger slices, smaller ones take less memory; a longer text is cut at spaces into runs of that size, unless it holds
    odd white space, then the library gets it whole.
    """
    from tokenizers import Tokenizer

    scratch = Scratch(docs.sparkSession, "rans")
    vocab = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"
    manifest, load = write_dataset(tokenize(docs, tokenizer_file, end_id, dtype, vocab, slice_bytes), scratch.sub("files"), scratch, dtype, vocab, tokens_per_file)
    return read_dataset(manifest, load)
