"""Bright areas of pages as data: runs along rows, their neighbours, connected components, the largest areas and their corners."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import touching_labels
from .geometry import largest
from .measure import by_sheet, column_sums, pages_of


def runs(pixels: DataFrame, least: int) -> DataFrame:
    """``sheet, y, x0, x1``: maximal runs of pixels ``sheet, x, y, px`` of at least the gray value ``least``, row by row."""
    w = Window.partitionBy("sheet", "y").orderBy("x")
    lit = pixels.where(F.col("px") >= least).select("sheet", "y", "x", (F.col("x") - F.row_number().over(w)).alias("island"))
    return lit.groupBy("sheet", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def labelled(runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """Runs ``sheet, y, x0, x1`` with ``top, start``, the place ``y, x0`` of the first run of their area, by one pass over the pages.

    Runs come to a task in the order of their pages, and a page is labelled when its last run is there; so a task holds one page, not all of its own.
    """
    r = runs.select("sheet", "y", "x0", "x1")
    kinds = dict(r.dtypes)
    gap, schema = int(diagonal), f"sheet {kinds['sheet']}, y {kinds['y']}, x0 {kinds['x0']}, x1 {kinds['x1']}, top {kinds['y']}, start {kinds['x0']}"

    def label(batches):
        for page in pages_of(batches, "sheet"):
            first = pa.array(touching_labels(*(page.column(c).to_numpy() for c in ("y", "x0", "x1")), gap))
            yield from page.append_column("top", page.column("y").take(first)).append_column("start", page.column("x0").take(first)).to_batches(100_000)

    return r.sortWithinPartitions("sheet", "y", "x0").mapInArrow(label, schema)


def blobs(pixels: DataFrame, least: int = 200, diagonal: bool = True, placed: bool = False) -> DataFrame:
    """``sheet, blob, area, x0, y0, x1, y1, corners`` of each connected bright area; ``blob`` is the place ``y, x0`` of its first run.

    Runs of neighbouring rows that touch (at a corner too, if ``diagonal``) belong together. ``corners`` are the extreme points top left, top right, bottom right and
    bottom left, by the sums and differences of their places. ``placed``: the pixels lie by sheet already.
    """
    found = labelled(runs(by_sheet(pixels, placed), least), diagonal)
    corner = lambda way, key, x: F.expr(f"{way}(struct({key} as k, y, {x} as x))")
    out = found.groupBy("sheet", F.struct(F.col("top").alias("y"), F.col("start").alias("x0")).alias("blob")).agg(
        F.sum(F.expr("x1 - x0 + 1")).cast("long").alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"),
        corner("min", "x0 + y", "x0").alias("a"), corner("min", "y - x1", "x1").alias("b"), corner("max", "x1 + y", "x1").alias("c"), corner("max", "y - x0", "x0").alias("e"),
    )
    return out.select("sheet", "blob", "area", "x0", "y0", "x1", "y1", F.array(*[F.struct(f"{c}.x", f"{c}.y") for c in "abce"]).alias("corners"))


def largest_blobs(found: DataFrame, n: int = 5) -> DataFrame:
    """The n largest areas of each page with their ``place``, of equal ones the upper left first."""
    return largest(found, "sheet", n, F.desc("area"), "blob")


def shifts(pixels: DataFrame, blocks: DataFrame, match_col: int = 5, max_steps: int = 20, stride: int = 1, thickness: int = 3, least: float = 100.0, placed: bool = False) -> DataFrame:
    """``sheet, block, shift``: how far each block ``sheet, block, x, y, w, h`` lies off its place, found by steps to where both edges, or none, are bright.

    ``pixels`` are edge pages (bright where something stands upright). Sums along columns are taken once per page; a block asks for those at the two rows that bound
    it, and folds at most ``max_steps`` steps over the sums of its columns, stopping early. ``placed``: the pixels lie by sheet already.
    """
    page = pixels.groupBy("sheet").agg(F.max("x").alias("xm"), F.max("y").alias("ym"))
    told = blocks.join(page.hint("merge"), "sheet").select("sheet", "block", F.col("x").alias("ox"), "w", "h", "xm", F.expr("inline(array(struct(least(y + h - 1, ym) as y, 1L as sign), struct(y - 1 as y, -1L as sign)))"))
    asked = told.where("y >= 0").select("sheet", "block", "ox", "w", "h", "y", "sign", F.explode(F.expr("sequence(0, xm)")).alias("x"))
    met = column_sums(by_sheet(pixels, placed).withColumn("c", F.col("px").cast("long")), asked, "c").where("total is not null")
    along = met.groupBy("sheet", "block", "ox", "w", "h", "x").agg(F.sum(F.col("sign") * F.col("total")).alias("c"))
    wide = along.groupBy("sheet", "block", "ox", "w", "h").agg(F.expr("transform(array_sort(collect_list(struct(x, c))), v -> v.c)").alias("c"))  # a page's width
    wide = wide.withColumn("p", F.expr("aggregate(c, array(0L), (a, v) -> concat(a, array(element_at(a, -1) + v)))"))
    cut = lambda e: f"cast(greatest(0, least(size(c), {e})) as int)"
    mean = lambda a, b: f"coalesce(try_divide(cast(p[{cut(b)}] - p[{cut(a)}] as double), ({cut(b)} - {cut(a)}) * h), 0d)"
    left, right = mean(f"ox + s.shift - {thickness}", f"ox + s.shift + {match_col - thickness}"), mean(f"ox + s.shift + w + {thickness - match_col}", f"ox + s.shift + w + {thickness}")
    step = f"case when s.done or ({left} > {least}) = ({right} > {least}) then struct(s.shift as shift, true as done) when {left} > {least} then struct(s.shift - {stride} as shift, false as done) else struct(s.shift + {stride} as shift, false as done) end"
    fold = f"aggregate(sequence(1, {max_steps}), struct(0 as shift, false as done), (s, i) -> {step}).shift"
    return wide.select("sheet", "block", F.expr(fold).alias("shift"))


def shifted(rectangles: DataFrame, found: DataFrame) -> DataFrame:
    """Rectangles ``sheet, block, x ...`` moved by the shifts of their blocks."""
    return rectangles.join(found, ["sheet", "block"], "left").withColumn("x", F.col("x") + F.coalesce("shift", F.lit(0))).drop("shift")
