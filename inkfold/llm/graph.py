"""Connected components as a distributed union-find, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", broadcast_rows: int = 400_000) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (long): the smallest node that links reach.

    Alternates large-star and small-star steps (each node's neighbours are pointed at the smallest of them) until nothing
    changes; each round's edges are written to the shared folder. Minima are pre-aggregated, no neighbourhood is collected,
    and the joins back are those whose skew Spark splits.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    last, k, n = None, 0, e.count()
    while n:
        small = n <= broadcast_rows  # 16 bytes a row
        send = F.broadcast if small else lambda df: df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(send(least), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small_least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        pointed = large.join(send(small_least), F.col("a") == F.col("u"))
        new = pointed.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        k += 1
        new = scratch.save(new.coalesce(2) if small else new, f"{name}-{k}")
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        e, n = new, mark[0]
        if mark == last:
            break
        last = mark
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find of a task; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
