"""N-gram Jaccard join by signature trees: every pair of shingle sets with similarity of at least a given percentage, exactly.

1. Equal sets are one node. Nodes meet by a lossless partition: for two sets of similarity J the symmetric difference is at
   most (1 - J) / (1 + J) of their sizes' sum, so of more segments of the hash space than that, one holds the same
   shingles in both. Its signature is their meeting key. Keys are binned in the Python task, not row by row.
2. Nodes that keys connect are a block; blocks are unions of the final components. A block is dealt out whole, or, if large, as
   pairs of chunks.
3. In a block, members sorted by size are the leaves of a tree whose nodes hold OR-combined token bitmaps and size ranges. A dual
   traversal drops node pairs whose sizes or greatest possible overlap rule a link out, and those that are already one
   component; what is left at the leaves is verified on the sets themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bins, flat, give_back, in_bins, parallelism, rows_out, text_slices, tidy
from .graph import Forest, components
from .shingles import MULTIPLIERS, U64, fingerprint, mix, shingle_sets

# The contract, all pairs and all strings, for tables that DuckDB holds.
SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM d),
n AS (SELECT id, len(g) AS n FROM s),
t AS (SELECT id, unnest(g) AS g FROM s),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id, id AS other FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, n.n AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id FROM d JOIN n ON n.id = d.id JOIN r ON r.id = d.id JOIN d o ON o.id = r.other GROUP BY d.id, d.doc_id, n.n"""
RATIO = 1.5  # of a size band's ends
LEAF, FAN = 16, 8


def need(total: np.ndarray | int, percent: int):
    """The least overlap of two sets whose sizes add up to total: |A n B| * (100 + p) >= p * (|A| + |B|)."""
    return -(-total * percent // (100 + percent))


class Bands:
    """Size bands: ``ends[i]`` is the largest size of band i; ``segments[i]`` the number of segments in which its sets meet smaller ones."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.ends = percent, [0]
        while self.ends[-1] < largest:
            self.ends.append(max(self.ends[-1] + 1, int(self.ends[-1] * RATIO)))
        self.ends = np.array(self.ends[1:] or [1], np.int64)
        total = np.arange(2 * int(self.ends[-1]) + 1)
        differ = np.maximum.accumulate(total - 2 * need(total, percent))[2 * self.ends]  # the most elements in one of two sets only, over all sizes up to the end
        self.spare = 2 + (differ + 1) // 4
        self.segments = differ + 1 + self.spare
        self.differ = differ

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, sizes)


class Frequent:
    """A bit table of frequent shingles; some others pass as well, the same for every set, which loses nothing."""

    def __init__(self, hashes: np.ndarray, bits: int = 23):
        self.table, self.mask = np.zeros(1 << bits, bool), U64((1 << bits) - 1)
        self.table[hashes & self.mask] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.table[hashes & self.mask]


def meeting_keys(sets: list[np.ndarray], nodes: np.ndarray, bands: Bands, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their nodes. A set meets those of its own band, and larger ones of the next if its size lets it.

    Of the segments of two linked sets more than ``spare`` are equal. Those that hold no rare shingle (or none at all) are weak: unlike sets with
    a common passage agree there. A set with at most ``spare`` weak segments leaves them out, so one equal segment is left that is not weak,
    in neither set; a set with more keeps all of its segments as keys, the empty ones too.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    band = bands.of(sizes)
    below = np.concatenate([[0], bands.ends[:-1]])
    out_keys, out_nodes = [], []
    for step in (0, 1):
        b = band + step
        use = (sizes > 0) & (b < len(bands.ends))
        if step:
            use &= sizes * 100 >= bands.percent * (below[np.minimum(b, len(below) - 1)] + 1)
        some = np.flatnonzero(use)
        if not len(some):
            continue
        tokens = np.concatenate([sets[i] for i in some])
        n, m = sizes[some], bands.segments[b[some]]
        owner = np.repeat(np.arange(len(some)), n)
        segment = (((tokens >> U64(32)) * m[owner].astype(U64)) >> U64(32)).astype(np.int64)
        base = np.cumsum(m) - m
        place = base[owner] + segment
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        total = np.add.reduceat(mix(tokens * MULTIPLIERS[5]), starts)
        rare = np.logical_or.reduceat(~frequent(tokens), starts)
        own, seg = owner[starts], segment[starts]
        key = mix(total + seg.astype(U64) * MULTIPLIERS[1] + b[some][own].astype(U64) * MULTIPLIERS[2])
        every = m - np.bincount(own[rare], minlength=len(some)) > bands.spare[b[some]]
        emit = rare | every[own]
        out_keys.append(key[emit])
        out_nodes.append(nodes[some][own[emit]])
        if every.any():
            held = np.zeros(int(m.sum()), bool)
            held[place[starts]] = True
            at = np.flatnonzero(~held & np.repeat(every, m))
            own = np.searchsorted(base, at, "right") - 1
            out_keys.append(mix((at - base[own]).astype(U64) * MULTIPLIERS[3] + (b[some][own] + 1).astype(U64) * MULTIPLIERS[6]))
            out_nodes.append(nodes[some][own])
    if not out_keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_nodes)


def frequent_shingles(docs: DataFrame, sized: DataFrame, k: int, share: int, least_rows: int, most_rows: int, most: int = 1 << 20, longest: int = 20_000) -> bytes:
    """Hashes of the shingles that two sets of a sample hold: one distinct set of ``share``, in these bounds, the first by a hash.

    They only steer which segments are weak; whatever they are, no link is lost. At most ``most`` hashes come back, the most frequent.
    """
    nodes = sized.where(f"node is not null and n_shingles <= {longest}").groupBy("node").agg(F.min("row").alias("of"))
    rows = min(max(least_rows, nodes.count() // share), most_rows)
    chosen = nodes.orderBy(F.xxhash64("node")).limit(rows).select("of")  # 8 bytes a row, most_rows at most

    def shingled(batches):
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                sets = shingle_sets(batch.column("text")[a:b], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["hash"])

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], ["hashes"])

    found = docs.join(F.broadcast(chosen), F.col("row") == F.col("of"), "left_semi").dropDuplicates(["row"]).select("text").mapInArrow(shingled, "hash long")
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "hash").limit(most).select("hash")
    return b"".join(bytes(r.hashes) for r in often.mapInArrow(packed, "hashes binary").toLocalIterator())


def star_edges(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys with more than one node: each node and the smallest of its key, without repeats."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    least = nodes[np.flatnonzero(first)][np.cumsum(first) - 1]
    some = nodes != least
    pairs = np.unique(np.stack([least[some], nodes[some]], 1), axis=0) if some.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def block_edges(docs: DataFrame, k: int, bands: Bands, frequent: bytes, parts: int) -> DataFrame:
    """``a, b``: nodes that share a meeting key (each with the key's smallest node); keys meet in ``parts`` bins."""
    schema = pa.schema([("bin", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])

    def deal(batches):
        common = Frequent(np.frombuffer(frequent, U64))
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                sets = shingle_sets(batch.column("text")[a:b], k)
                keys, nodes = meeting_keys(sets, fingerprint(sets), bands, common)
                own = (keys % U64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(own[order], np.arange(parts), "right")
                keys, nodes, start = keys[order], nodes[order], 0
                found = {"bin": [], "keys": [], "nodes": []}
                for p, end in enumerate(ends.tolist()):
                    if end > start:
                        found["bin"].append(p)
                        found["keys"].append(keys[start:end].tobytes())
                        found["nodes"].append(nodes[start:end].tobytes())
                    start = end
                yield rows_out(schema, found)

    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches):
        keys, nodes = [], []
        for batch in batches:
            keys += [np.frombuffer(x.as_buffer(), U64) for x in batch.column("keys")]
            nodes += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("nodes")]
        if keys:
            a, b = star_edges(np.concatenate(keys), np.concatenate(nodes))
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], schema=edge)

    dealt = flat(docs, "text").mapInArrow(tidy(deal), "bin int, keys binary, nodes binary")
    return in_bins(dealt, parts).mapInArrow(tidy(meet), "a long, b long")


class Tree:
    """A signature tree over sets sorted by size. Level 0 are the sets; a node of level i covers ``LEAF * FAN**(i-1)`` sets."""

    def __init__(self, sets: list[np.ndarray], words: int):
        self.sets, self.n = sets, len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = np.zeros((self.n, words), U64)
        for i, s in enumerate(sets):
            at = (s >> U64(20)) % U64(words * 64)
            np.bitwise_or.at(bits[i], (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        slack = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, s = self.levels[-1]
            starts = np.arange(0, len(b), fan)
            self.levels.append((np.bitwise_or.reduceat(b, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.maximum.reduceat(s, starts)))
            fan = FAN

    def span(self, level: int, i: int) -> tuple[int, int]:
        width = 1 if level == 0 else LEAF * FAN ** (level - 1)
        return i * width, min(self.n, (i + 1) * width)

    def children(self, level: int, i: int) -> range:
        fan = LEAF if level == 1 else FAN
        return range(i * fan, min(len(self.levels[level - 1][0]), (i + 1) * fan))


def tree_links(x: Tree, y: Tree | None, percent: int, forest: Forest, offset: int) -> list[tuple[int, int]]:
    """Links between members of x and y (or within x) that join components; y's members count from ``offset``."""
    links, other = [], y or x

    def apart(level_x: int, xs: np.ndarray, level_y: int, ys: np.ndarray) -> np.ndarray:
        """Which pairs of the nodes can hold a link, by size ranges and overlap of bitmaps."""
        bx, lo_x, hi_x, slack_x = (v[xs] for v in x.levels[level_x])
        by, lo_y, hi_y, slack_y = (v[ys] for v in other.levels[level_y])
        fits = (hi_x[:, None] * 100 >= percent * lo_y) & (hi_y * 100 >= percent * lo_x[:, None])
        overlap = np.zeros(fits.shape, np.int64)
        for i in range(len(xs)):
            if fits[i].any():
                overlap[i] = np.bitwise_count(bx[i] & by).sum(1, dtype=np.int64)
        most = np.minimum(overlap + np.minimum(slack_x[:, None], slack_y), np.minimum(hi_x[:, None], hi_y))
        return fits & (most >= need(lo_x[:, None] + lo_y, percent))

    def one(level_x: int, i: int, level_y: int, j: int) -> bool:
        """Whether all members below are one component already."""
        a, b = x.span(level_x, i)
        c, d = other.span(level_y, j)
        root = forest.find(a)
        return all(forest.find(k) == root for k in range(a, b)) and all(forest.find(offset + k) == root for k in range(c, d))

    stack = [(len(x.levels) - 1, 0, len(other.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        if one(lx, i, ly, j):
            continue
        if lx == 0 and ly == 0:
            a, b = x.sets[i], other.sets[j]
            if (y is not None or i != j) and len(np.intersect1d(a, b, assume_unique=True)) >= need(len(a) + len(b), percent) and forest.join(i, offset + j):
                links.append((i, offset + j))
            continue
        xs, down_x = (np.array(x.children(lx, i)), lx - 1) if lx >= max(ly, 1) else (np.array([i]), lx)
        ys, down_y = (np.array(other.children(ly, j)), ly - 1) if ly >= max(lx, 1) else (np.array([j]), ly)
        ok = apart(down_x, xs, down_y, ys)
        if y is None and down_x == down_y:
            ok &= xs[:, None] <= ys
            if down_x == 0:
                ok &= xs[:, None] < ys
        stack += [(down_x, int(xs[p]), down_y, int(ys[q])) for p, q in zip(*np.nonzero(ok), strict=True)]
    return links


def size_bands(percent: int, largest: int) -> np.ndarray:
    """The least sizes of bands such that linked sets are in one band or in neighbouring ones."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows, np.int64)


def tree_width(sets: list[np.ndarray]) -> int:
    """Words of a bitmap: 16 bits for each shingle of a middling set."""
    return int(min(1024, max(8, 1 << math.ceil(math.log2(max(1, float(np.median([len(s) for s in sets])) / 4))))))


def block_components(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """For a whole block: ``(smallest node of its component, node)`` of each member that is not the smallest."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    forest = Forest(len(order))
    tree_links(Tree([sets[i] for i in order], tree_width(sets)), None, percent, forest, 0)
    least: dict[int, int] = {}
    for k, i in enumerate(order):
        root = forest.find(k)
        least[root] = min(int(nodes[i]), least.get(root, int(nodes[i])))
    return [(least[forest.find(k)], int(nodes[i])) for k, i in enumerate(order) if least[forest.find(k)] != nodes[i]]


def cross_links(nodes: np.ndarray, sets: list[np.ndarray], open_: np.ndarray, done: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links from open members to all members at hand. ``done`` members are known to be one component."""
    by_size = lambda some: sorted(np.flatnonzero(some), key=lambda i: (len(sets[i]), nodes[i]))
    left, right = by_size(open_), by_size(~open_)
    if not left or not right:
        return []
    width, forest = tree_width(sets), Forest(len(left) + len(right))
    known = [len(left) + k for k, i in enumerate(right) if done[i]]
    for k in known[1:]:
        forest.join(known[0], k)
    links = tree_links(Tree([sets[i] for i in left], width), Tree([sets[i] for i in right], width), percent, forest, len(left))
    return [(int(nodes[left[i]]), int(nodes[right[j - len(left)]])) for i, j in links if nodes[left[i]] != nodes[right[j - len(left)]]]


def large_links(large: DataFrame, scratch: Scratch, percent: int, chunk_bytes: int, broadcast_rows: int, pivots: int = 2) -> DataFrame:
    """``a, b`` for the members ``block, node, hashes`` of large blocks.

    All members are compared with a few pivots of their block. Those that link with its best pivot are one component; only links of the
    others are still open, so those, in chunks, meet all members, in chunks. Copies of one document mostly link with a pivot, so
    what is sent grows with the block, not with its square.
    """
    w = Window.partitionBy("block").orderBy(F.xxhash64("node"))
    chosen = large.select("block", "node").distinct().withColumn("r", F.row_number().over(w)).where(f"r <= {pivots}").select("block", "node")
    chosen = scratch.save(chosen, "chosen")
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    sets = large.join(few(chosen), ["block", "node"], "left_semi").dropDuplicates(["block", "node"])  # a few rows for each block of at least chunk_bytes
    sets = scratch.save(sets.groupBy("block").agg(F.collect_list(F.struct("node", "hashes")).alias("pivots")), "pivots")
    size = sets.agg(F.sum(F.expr("aggregate(pivots, 0L, (n, x) -> n + octet_length(x.hashes))"))).first()[0] or 0
    out = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("pivot", pa.int64()), ("bytes", pa.int64())])

    def compare(batches):
        for batch in batches:
            found = {name: [] for name in out.names}
            for block, node, hashes, some in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "hashes", "pivots")), strict=True):
                own = np.frombuffer(hashes, U64)
                hits = [p["node"] for p in some if len(np.intersect1d(own, x := np.frombuffer(p["hashes"], U64), assume_unique=True)) >= need(len(own) + len(x), percent)]
                for pivot in hits or [None]:
                    for name, v in zip(out.names, (block, node, pivot, len(hashes)), strict=True):
                        found[name].append(v)
            yield rows_out(out, found)

    joined = large.join(F.broadcast(sets) if size <= 24 << 20 else sets, "block").select("block", "node", "hashes", "pivots")
    seen = scratch.save(joined.mapInArrow(tidy(compare), "block long, node long, pivot long, bytes long"), "seen")
    best = seen.where("pivot is not null").groupBy("block", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("n"), "pivot"))).where("r = 1").select("block", F.col("pivot").alias("best"))
    state = seen.join(few(scratch.save(best, "best")), "block").groupBy("block", "node").agg(F.bool_or(F.coalesce(F.col("pivot") == F.col("best"), F.lit(False))).alias("done"), F.max("bytes").alias("bytes"))
    state = scratch.save(state, "state")
    dealt = state.groupBy("block").agg(
        F.expr(f"cast((sum(bytes) - 1) div {chunk_bytes} + 1 as int)").alias("all_chunks"), F.expr(f"cast((sum(if(done, 0, bytes)) - 1) div {chunk_bytes} + 1 as int)").alias("open_chunks"), F.count_if(~F.col("done")).alias("open")
    ).where("open > 0")
    state = state.join(few(scratch.save(dealt, "dealt")), "block").drop("bytes", "open")  # a row for each block of at least chunk_bytes
    rows = large.dropDuplicates(["block", "node"]).join(few(state), ["block", "node"])
    every = rows.withColumn("i", F.explode(F.expr("sequence(0, open_chunks - 1)"))).withColumn("j", F.expr("cast(pmod(node, all_chunks) as int)")).withColumn("open", F.lit(False))
    some = rows.where("not done").withColumn("i", F.expr("cast(pmod(node, open_chunks) as int)")).withColumn("j", F.explode(F.expr("sequence(0, all_chunks - 1)"))).withColumn("open", F.lit(True))

    def cross(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), U64) for x in t.column("hashes")]
        flags = [t.column(c).to_numpy() for c in ("open", "done")]
        links = cross_links(t.column("node").to_numpy(), sets, *flags, percent)
        del sets, t
        give_back()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    parts = every.unionByName(some).select("block", "i", "j", "node", "open", "done", "hashes")
    met = parts.groupBy("block", "i", "j").applyInArrow(cross, "a long, b long")
    return seen.where("pivot is not null and pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).unionByName(met)


def classes(docs: DataFrame, k: int, percent: int, chunk_bytes: int, broadcast_rows: int, sample: tuple[int, int, int] = (12, 4_000, 64_000), bin_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, row, n_shingles, class`` for every row of docs: ``row`` is a hash of id and text, ``class`` null for texts without words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])
    docs = flat(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.xxhash64("doc_id", "text"))

    def sizes(batches):
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                sets = shingle_sets(batch.column("text")[a:b], k)
                marks = fingerprint(sets)
                own = [batch.column(c)[a:b] for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([int(m) if len(s) else None for m, s in zip(marks, sets, strict=True)], pa.int64())], schema=schema)

    d = scratch.save(docs.mapInArrow(tidy(sizes), "doc_id long, row long, n_shingles long, node long"), "sizes")
    largest, total = d.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
    bands = Bands(percent, int(largest or 1))
    parts = bins(spark, 8 * (total or 0), bin_bytes)  # keys are about as many bytes as shingles
    blocks = components(block_edges(docs, k, bands, frequent_shingles(docs, d, k, *sample), parts), scratch, "blocks")  # node, component
    shown = d.where("node is not null").groupBy("node").agg(F.min("row").alias("shown"), F.first("n_shingles").alias("n"))
    members = blocks.join(shown, "node").select("node", F.col("component").alias("block"), "shown", "n")
    weight = members.groupBy("block").agg(F.sum(F.col("n") * 8).alias("bytes"))
    members = scratch.save(members.join(weight, "block").select("node", "block", "shown", F.expr(f"cast((bytes - 1) div {chunk_bytes} + 1 as int)").alias("chunks")), "members")
    chosen = F.broadcast(members) if members.count() <= broadcast_rows else members  # at most 32 bytes a row
    texts = docs.join(chosen, F.col("row") == F.col("shown")).select("text", "node", "block", "chunks")
    out = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("hashes", pa.binary())])

    def hashed(batches):
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("text"), k)
                found = {name: [] for name in out.names}
                for s, own, node, block in zip(sets, fingerprint(sets).tolist(), part.column("node").to_pylist(), part.column("block").to_pylist(), strict=True):
                    if own == node:  # else another text of the same hash
                        for name, v in zip(out.names, (block, node, s.tobytes()), strict=True):
                            found[name].append(v)
                yield rows_out(out, found)

    def linked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)  # repeated rows of a shown document
        links = block_components(nodes, [np.frombuffer(table.column("hashes")[int(i)].as_buffer(), U64) for i in first], percent) if len(nodes) > 1 else []
        return pa.table({"node": pa.array([b for _, b in links], pa.int64()), "component": pa.array([a for a, _ in links], pa.int64())})

    shape = "block long, node long, hashes binary"
    found = scratch.save(texts.where("chunks = 1").mapInArrow(tidy(hashed), shape).groupBy("block").applyInArrow(linked, "node long, component long"), "whole")
    if members.where("chunks > 1").limit(1).count():
        # large blocks are mostly chains of sets of many sizes: their bands of sizes are blocks of their own, each set in two of them
        lows = size_bands(percent, int(bands.ends[-1]))

        def banded(batches):
            for batch in hashed(batches):
                n = np.array([len(x) for x in batch.column("hashes").to_pylist()]) // 8
                band = np.searchsorted(lows, n, "right")
                block = batch.column("block").to_numpy()
                for step in (0, 1):
                    own = mix(block.view(U64) * MULTIPLIERS[0] + (band + step).astype(U64) * MULTIPLIERS[1]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("node"), batch.column("hashes")], schema=out)

        parts = scratch.save(texts.where("chunks > 1").mapInArrow(tidy(banded), shape), "banded")
        size = scratch.save(parts.groupBy("block").agg(F.sum(F.octet_length("hashes")).alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1"), "banded-sizes")
        few = F.broadcast(size) if size.count() <= broadcast_rows else size
        weighed = parts.join(few, "block")
        edges = weighed.where(f"bytes <= {chunk_bytes}").select("block", "node", "hashes").groupBy("block").applyInArrow(linked, "node long, component long").select(F.col("component").alias("a"), F.col("node").alias("b"))
        if size.where(f"bytes > {chunk_bytes}").limit(1).count():
            edges = edges.unionByName(large_links(weighed.where(f"bytes > {chunk_bytes}").select("block", "node", "hashes"), scratch, percent, chunk_bytes, broadcast_rows))
        found = found.unionByName(components(edges, scratch, "links"))
    return d.join(found, "node", "left").select("doc_id", "row", "n_shingles", F.coalesce("component", "node").alias("class"))


def jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85, chunk_bytes: int = 32 << 20, broadcast_rows: int = 500_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of docs; an empty table gives no row, other columns are ignored.

    Null and texts without words have the empty set, which links with nothing (component_id is the own doc_id). Rows with
    equal sets, repeated doc_ids among them, are linked. A null doc_id takes part, but never is a component's id unless all are null.
    A very long text is one set; it bounds the memory of a task from below.
    """
    named = classes(docs, k, percent, chunk_bytes, broadcast_rows)
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")).withColumnRenamed("class", "of")
    return named.join(least, F.col("class") == F.col("of"), "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, chunk_bytes: int = 32 << 20, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component one row stays.

    That is the row of the smallest doc_id (null last), of several the one with the smallest hash of id and text. Rows are told apart by
    that hash, so another text under the doc_id of a near copy stays. Of rows equal in id and text one stays, whatever other columns say. Texts
    without words are linked with nothing: all their rows stay. An empty table stays empty.
    """
    names, scratch = docs.columns, Scratch(docs.sparkSession, "keep")
    named = scratch.save(classes(docs, k, percent, chunk_bytes, broadcast_rows).where("class is not null").select("class", F.col("doc_id").isNull().alias("last"), "doc_id", "row"), "named")
    several = named.groupBy("class").agg(F.min(F.struct("last", "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("of"), F.col("best.row").alias("best"))
    placed = named.join(several, F.col("class") == F.col("of")).groupBy("row").agg(F.first(F.col("row") != F.col("best")).alias("gone"), F.count(F.lit(1)).alias("n"))
    placed = scratch.save(placed.where("gone or n > 1").select(F.col("row").alias("\x00row"), F.col("gone").alias("\x00gone")), "gone")
    few = F.broadcast(placed) if placed.count() <= broadcast_rows else placed  # 16 bytes a row
    marked = docs.withColumn("\x00own", F.xxhash64(F.col("`doc_id`").cast("long"), F.col("`text`"))).join(few, F.col("\x00own") == F.col("\x00row"), "left")
    back = [F.col(f"`{c}`") for c in names]
    out = marked.where("`\x00gone` is null").select(back)
    if not placed.where("not `\x00gone`").limit(1).count():
        return out
    return out.unionByName(marked.where("not `\x00gone`").dropDuplicates(["\x00own"]).select(back))  # rows that are there several times
