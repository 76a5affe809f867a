"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard, searched by beams.

Equal vectors are one node (with its smallest ids), so that copies neither crowd a graph nor lose a tie. Nodes are dealt to shards of
bounded size by a hash. A graph is built in batches: greedy beam searches over what is built propose neighbours, relaxed
distance pruning keeps diverse ones, and edges back are pruned likewise. Queries go, in blocks, to every shard; what a beam ends with is
scored again in double precision, and the best of all shards are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, flat

DEGREE, BEAM, ALPHA, STARTS = 24, 64, 1.2, 8


def closest(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, beam: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches of all queries in step: ids (-1 where none) and squared distances of each beam, nearest first. x, queries: unit rows."""
    b, n, width = len(queries), len(x), edges.shape[1]
    seen = np.zeros((b, n + 1), bool)
    seen[:, -1] = True
    seen[:, starts] = True
    ids = np.full((b, beam + width), -1)
    gap = np.full((b, beam + width), np.inf, np.float32)
    open_ = np.zeros((b, beam + width), bool)
    k = min(beam, len(starts))
    ids[:, :k], gap[:, :k], open_[:, :k] = starts[:k], 2 - 2 * (queries @ x[starts[:k]].T), True
    live = np.arange(b)
    while len(live):
        score = np.where(open_[live, :beam], gap[live, :beam], np.inf)
        at = score.argmin(1)
        go = np.isfinite(score[np.arange(len(live)), at])
        live, at = live[go], at[go]
        if not len(live):
            break
        open_[live, at] = False
        new = edges[ids[live, at]]
        fresh = ~seen[live[:, None], new]
        seen[live[:, None], new] = True
        d = 2 - 2 * np.einsum("brd,bd->br", x[new], queries[live], optimize=True)
        ids[live, beam:] = np.where(fresh, new, -1)
        gap[live, beam:] = np.where(fresh, d, np.inf)
        open_[live, beam:] = fresh
        best = np.argpartition(gap[live], beam - 1, axis=1)[:, :beam]
        for a in (ids, gap, open_):
            a[live, :beam] = a[live[:, None], best]
    order = np.argsort(gap[:, :beam], axis=1, kind="stable")
    return np.take_along_axis(ids[:, :beam], order, 1), np.take_along_axis(gap[:, :beam], order, 1)


def pruned(x: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: of each point's candidates (-1: none) the nearest is kept and drops those that it is, alpha times over, nearer to than the point."""
    vectors = x[found]
    d = 2 - 2 * np.einsum("bcd,bd->bc", vectors, x[points], optimize=True)
    d[(found < 0) | (found == points[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
    vectors = x[found]
    repeated = np.zeros(found.shape, bool)
    repeated[:, 1:] = found[:, 1:] == found[:, :-1]
    alive = np.isfinite(d) & ~repeated
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        out[some, k] = found[rows, at][some]
        between = 2 - 2 * np.einsum("bcd,bd->bc", vectors, vectors[rows, at], optimize=True)
        alive &= (alpha * between > d) & (found != found[rows, at][:, None])
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, degree; -1: none) over unit rows x, and the nodes where searches start."""
    n = len(x)
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(7).permutation(n)
    middle = int((x @ x.mean(0)).argmax())
    starts = np.unique(np.concatenate([[middle], order[:STARTS]]))
    if n <= degree + 1:
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, starts
    first = order[: degree + 1]
    for i, p in enumerate(first):
        edges[p, :degree] = np.delete(first, i)
    done = len(first)
    inside = first[: STARTS + 1]
    while done < n:
        points = order[done : done + min(batch, done)]
        found, _ = closest(x, edges, x[points], beam, inside)
        edges[points] = pruned(x, points, found, degree)
        a, k = np.nonzero(edges[points] >= 0)
        source, target = points[a], edges[points][a, k]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        to, at, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(to), degree + int(count.max())), -1)
        wide[:, :degree] = edges[to]
        column = np.arange(len(target)) - np.repeat(at, count)
        wide[np.repeat(np.arange(len(to)), count), degree + column] = source
        full = (wide >= 0).sum(1) > degree
        packed = -np.sort(-wide[~full], axis=1)[:, :degree]
        edges[to[~full]] = packed
        for lo in range(0, int(full.sum()), 512):
            some = np.flatnonzero(full)[lo : lo + 512]
            edges[to[some]] = pruned(x, to[some], wide[some], degree)
        done += len(points)
    return edges, starts


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow or underflow of the squares
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def level(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component below 1: exact, and its squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def nearest(table: DataFrame, every: int = 50, k: int = 5, shard_rows: int = 4096, block_rows: int = 2048, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vec_id divisible by ``every`` the k nearest found by cosine, ties to the smaller vec_id.

    Null, empty and zero vectors and those with null or non-finite components take no part; nor do null ids. Vectors
    of different dimensions never meet. A row repeated with its id counts once; a query never finds its own id. An empty table gives no
    rows, other columns are ignored, and vectors of any magnitude are measured.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    v = flat(table, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    v = v.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("node"))
    rank = Window.partitionBy("node", "dim").orderBy("vec_id")
    shown = v.withColumn("r", F.dense_rank().over(rank)).where(f"r <= {k + 1}").dropDuplicates(["node", "dim", "vec_id"])  # before the exchange at most k + 1 ids of a node leave each task
    nodes = scratch.save(shown.groupBy("node", "dim").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    queries = v.where(f"vec_id % {every} = 0").dropDuplicates(["vec_id", "node"])
    blocks = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    plan = scratch.save(shards.join(blocks, "dim"), "plan")  # a row for each dimension

    def index(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy())
        t = t.take(order)
        x = vectors_of(t.column("embedding"))
        edges, starts = build(unit(x).astype(np.float32))
        ids = np.full((len(x), k + 1), np.iinfo(np.int64).max)
        for i, some in enumerate(t.column("ids").to_pylist()):
            ids[i, : len(some)] = some
        packed = [[a.tobytes()] for a in (x, edges.astype(np.int32), starts.astype(np.int32), ids)]
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "x": packed[0], "edges": packed[1], "starts": packed[2], "ids": packed[3]}, schema=INDEX)

    placed = nodes.join(F.broadcast(plan), "dim").withColumn("shard", F.expr("cast(pmod(node, shards) as int)"))
    graphs = placed.select("dim", "shard", "node", "embedding", "ids").groupBy("dim", "shard").applyInArrow(index, "dim int, shard int, x binary, edges binary, starts binary, ids binary")
    graphs = scratch.save(graphs, "graphs")
    dealt_graphs = graphs.join(F.broadcast(plan), "dim").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("shards", "blocks")
    asked = queries.join(F.broadcast(plan), "dim").select(
        "dim", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)").alias("block"), F.col("vec_id").alias("query_id"), F.col("node").alias("of"), "embedding"
    )

    def search(g: pa.Table, q: pa.Table) -> pa.Table:
        if not g.num_rows or not q.num_rows:
            return OUT.empty_table()
        get = lambda name, kind: np.frombuffer(g.column(name)[0].as_buffer(), kind)
        want = vectors_of(q.column("embedding"))
        x = get("x", np.float64).reshape(-1, want.shape[1])
        ids, edges = get("ids", np.int64).reshape(len(x), -1), get("edges", np.int32).reshape(len(x), -1)
        found, _ = closest(unit(x).astype(np.float32), edges, unit(want).astype(np.float32), max(2 * beam, 4 * k), get("starts", np.int32))
        out = {f.name: [] for f in OUT}
        x, want = level(x), level(want)
        norms = np.sqrt((x * x).sum(1))
        for query, of, w, near in zip(q.column("query_id").to_pylist(), q.column("of").to_pylist(), want, found, strict=True):
            near = np.sort(near[near >= 0])
            score = (x[near] * w).sum(1) / (norms[near] * np.sqrt((w * w).sum()))
            pairs = sorted((-s, i) for s, row in zip(score.tolist(), ids[near].tolist(), strict=True) for i in row if i != query and i != np.iinfo(np.int64).max)
            for s, i in pairs[:k]:
                for name, value in (("query_id", query), ("of", of), ("vec_id", i), ("score", -s)):
                    out[name].append(value)
        return pa.table(out, schema=OUT)

    hits = asked.groupBy("dim", "shard", "block").cogroup(dealt_graphs.groupBy("dim", "shard", "block")).applyInArrow(lambda q, g: search(g, q), "query_id long, of long, vec_id long, score double")
    best = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("x", pa.binary()), ("edges", pa.binary()), ("starts", pa.binary()), ("ids", pa.binary())])
OUT = pa.schema([("query_id", pa.int64()), ("of", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
