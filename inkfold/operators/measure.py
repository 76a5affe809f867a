"""Bubble means and adaptive thresholds. One row per sheet carries its strips, so a sheet's thresholds need one exchange."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import box_sums

MIN_JUMP, MIN_GAP, SURPLUS, WHITE, BLACK = 25, 30, 5, 200.0, 100.0


def bubble_means(pixels: DataFrame, by: list[str] = ()) -> DataFrame:
    """``sheet, strip, opt, px`` to the mean ``m`` of each bubble's pixels; ``by`` names what else is one value a strip."""
    return pixels.groupBy("sheet", "strip", "opt", *by).agg((F.sum("px") * F.lit(1.0) / F.count(F.lit(1))).alias("m"))


def jumps(values: str, lag: int) -> Column:
    """Differences ``lag`` apart of a sorted array; null if it is too short."""
    return F.expr(f"case when size({values}) > {lag} then transform(sequence(0, size({values}) - {lag} - 1), i -> {values}[i + {lag}] - {values}[i]) end")


def jump_threshold(values: str, lag: int, default: float | Column = WHITE, least: float | Column = MIN_JUMP) -> Column:
    """The middle of the first largest jump in a sorted array, if over ``least``, else the default."""
    j = jumps(values, lag)
    top = F.array_max(j)
    return F.when(top > least, F.get(F.col(values), (F.array_position(j, top) - 1).cast("int")) + top / 2).otherwise(F.lit(default))


def measured(bubbles: DataFrame, page_type: str | Column = "white", min_jump: float | Column = MIN_JUMP, carry: list[str] = (), by: list[str] = (), parts: int | None = None) -> DataFrame:
    """A row per sheet: global and deviation thresholds, and ``strips`` (bubbles by intensity, deviation, size, range, mean).

    The parameters are a configuration's threshold_params. Without a clear jump the threshold is that of the page type. Where sheets differ in
    configuration, the parameters are columns of the bubbles (the page type as a threshold); ``carry`` names them and what else is one value a sheet,
    ``by`` what is one value a strip. Strips are in their own order. ``parts``: among how many partitions sheets are dealt, where the caller knows the size.
    """
    default = page_type if isinstance(page_type, Column) else BLACK if page_type == "black" else WHITE
    kept = [F.first(c).alias(c) for c in carry]
    strip = bubbles.repartition(*([parts] if parts else []), "sheet").groupBy("sheet", "strip").agg(
        F.array_sort(F.collect_list(F.struct("m", "opt"))).alias("b"),
        F.round(F.stddev_pop("m"), 2).alias("sd"),
        F.count(F.lit(1)).alias("n"),
        F.min("m").alias("mn"),
        F.max("m").alias("mx"),
        F.avg("m").alias("av"),
        *kept,
        *[F.first(c).alias(c) for c in by],
    )
    sheet = strip.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("strip", "b", "sd", "n", "mn", "mx", "av", *by))).alias("strips"), *kept)
    sheet = sheet.withColumn("all_m", F.expr("sort_array(flatten(transform(strips, s -> s.b.m)))")).withColumn("all_sd", F.expr("sort_array(strips.sd)"))
    return sheet.select("sheet", "strips", jump_threshold("all_m", 4, default, min_jump).alias("global_thr"), jump_threshold("all_sd", 2, default, min_jump).alias("std_thr"), *carry)


def local_thresholds(sheets: DataFrame, min_gap: float | Column = MIN_GAP, min_jump: float | Column = MIN_JUMP, surplus: float | Column = SURPLUS, carry: list[str] = (), numbered: bool = False) -> DataFrame:
    """A row per strip with its threshold ``thr``: by the largest jump if clear, the mean or the sheet's threshold if not; ``numbered``: with its place ``pos`` in the sheet."""
    each = F.expr("posexplode(strips)").alias("at", "s")
    s = sheets.select("sheet", "global_thr", "std_thr", *carry, each).select("*", "s.*", (F.col("at") + 1).alias("pos")).drop("s", "at", *([] if numbered else ["pos"]))
    s = s.withColumn("q", F.col("b.m"))
    top = F.array_max(jumps("q", 2))
    few = F.when(F.col("mx") - F.col("mn") < min_gap, F.col("global_thr")).otherwise(F.col("av"))
    jump = F.lit(min_jump).cast("double")
    vague = (F.greatest(top, jump) < jump + surplus) & (F.col("sd") < F.col("std_thr"))
    thr = F.when(F.col("n") < 3, few).when(vague, F.col("global_thr")).otherwise(jump_threshold("q", 2, 255.0, jump))
    return s.withColumn("thr", thr).drop("q")


def sheet_average(strips: DataFrame) -> DataFrame:
    """``sheet, avg_thr``: the mean threshold of a sheet's strips to two decimals, half up; summed as whole millionths, so the order does not matter."""
    total = "sum(cast(round(thr * 1000000) as bigint))"
    return strips.groupBy("sheet").agg((F.expr(f"(2 * {total} + 10000 * count(1)) div (20000 * count(1))") / 100.0).alias("avg_thr"))


def marked(strips: DataFrame) -> DataFrame:
    """Bubbles darker than their strip's threshold: ``sheet, strip, opt, m, thr``."""
    return strips.select("sheet", "strip", "thr", F.expr("inline(filter(b, x -> thr > x.m))")).select("sheet", "strip", "opt", "m", "thr")


def by_sheet(rows: DataFrame, placed: bool) -> DataFrame:
    """Rows dealt by sheet, unless the caller has ``placed`` them so."""
    return rows if placed else rows.repartition("sheet")


def column_sums(pixels: DataFrame, asked: DataFrame, value: str) -> DataFrame:
    """The rows ``sheet, x, y`` of ``asked`` with ``total``, the sum of ``value`` of the pixels up to y in column x; null without such pixels.

    Questions travel among the pixels they ask for, so no page meets its questions in a join, and none is broadcast.
    """
    column = Window.partitionBy("sheet", "x").orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    both = pixels.select("sheet", "x", "y", F.col(value).alias("value"), F.lit(False).alias("question")).unionByName(asked.withColumn("question", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("total", F.sum("value").over(column)).where("question").drop("value", "question")


def integral(pixels: DataFrame, asked: DataFrame, placed: bool = False) -> DataFrame:
    """The rows ``sheet, x, y`` of ``asked`` with ``total``: the sum of all pixels of the dense page ``sheet, x, y, px`` up to x and y, by one pass along rows and one along columns.

    Both passes share the exchange by sheet; a page bounds what a task sorts.
    """
    row = Window.partitionBy("sheet", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    laid = by_sheet(pixels, placed).withColumn("along", F.sum(F.col("px").cast("long")).over(row))
    return column_sums(laid, asked, "along")


def rectangle_means(pixels: DataFrame, rectangles: DataFrame, placed: bool = False) -> DataFrame:
    """``sheet, id, m``: the mean of each rectangle ``sheet, id, x, y, w, h`` of dense pages, whatever its area, from four corners of the integral image.

    Rectangles are cut at the page; those outside of it are left out. ``placed``: the pixels lie by sheet already.
    """
    page = pixels.groupBy("sheet").agg(F.max("x").alias("xm"), F.max("y").alias("ym"))
    cut = rectangles.join(page.hint("merge"), "sheet").select(  # pages are data: their file says little of their number, so they are never broadcast
        "sheet", "id", (F.greatest("x", F.lit(0)) - 1).alias("x0"), (F.greatest("y", F.lit(0)) - 1).alias("y0"), F.least(F.expr("x + w - 1"), "xm").alias("x1"), F.least(F.expr("y + h - 1"), "ym").alias("y1")
    )
    cut = cut.where("x1 > x0 and y1 > y0").withColumn("n", F.expr("(x1 - x0) * (y1 - y0)"))
    corners = cut.select("sheet", "id", "n", F.expr("inline(array(struct(x1 as x, y1 as y, 1L as sign), struct(x0 as x, y1 as y, -1L as sign), struct(x1 as x, y0 as y, -1L as sign), struct(x0 as x, y0 as y, 1L as sign)))")).where("x >= 0 and y >= 0")
    found = integral(pixels, corners, placed).where("total is not null")
    return found.groupBy("sheet", "id", "n").agg(F.sum(F.col("sign") * F.col("total")).alias("s")).select("sheet", "id", (F.col("s") * F.lit(1.0) / F.col("n")).alias("m"))


def sparse_rectangle_means(pixels: DataFrame, rectangles: DataFrame, tile: int = 16) -> DataFrame:
    """``sheet, id, n, m`` of the pixels there are in each rectangle, for pages with gaps or several values at a place.

    A range join by tiles: a rectangle goes to the tiles it touches, a pixel to its own, so they meet by equal keys. Rectangles without pixels are left out.
    """
    tiles = lambda a, n: F.explode(F.expr(f"sequence(cast(floor({a} / {tile}) as bigint), cast(floor(({a} + {n} - 1) / {tile}) as bigint))"))
    spread = rectangles.where("w > 0 and h > 0").select("*", tiles("x", "w").alias("tx")).select("*", tiles("y", "h").alias("ty"))
    placed = pixels.select("sheet", F.col("x").alias("px_x"), F.col("y").alias("px_y"), "px", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    inside = spread.join(placed, ["sheet", "tx", "ty"]).where("px_x >= x and px_x < x + w and px_y >= y and px_y < y + h")
    return inside.groupBy("sheet", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("s")).select("sheet", "id", "n", (F.col("s") * F.lit(1.0) / F.col("n")).alias("m"))


def pages_of(batches: Iterable[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Rows in the order of ``by``, as one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for c in by:
            of = batch.column(c).dictionary_encode("encode").indices.to_numpy()
            new |= of[1:] != of[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and any(held[-1].column(c)[0] != batch.column(c)[lo] for c in by):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def layout_means(pixels: DataFrame, rectangles: DataFrame, parts: int, pieces: int = 8) -> DataFrame:
    """``sheet, id, n, m`` of the pixels ``sheet, layout, x, y, px`` there are in each rectangle ``layout, id, x, y, w, h`` of their page's layout; for pages with gaps or several values at a place.

    As ``sparse_rectangle_means`` with the rectangles of a layout laid on all of its pages, but neither those copies nor tiles of them are made into rows that move: a
    layout's rectangles are dealt to ``pieces`` shares of its pages, come to a task ahead of them, and each page answers them from its integral image. Pixels
    are whole numbers. ``parts``: among how many partitions pages are dealt. Rectangles of a layout that share an id count as one; those without pixels are left out.
    """
    kinds, ids = dict(pixels.dtypes), dict(rectangles.dtypes)["id"]
    whole = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    page = pixels.where("sheet is not null and layout is not null and x is not null and y is not null").select("sheet", "layout", F.expr(f"pmod(xxhash64(sheet), {pieces}L)").alias("piece"), *whole("x", "y", "px"))
    laid = rectangles.where("w > 0 and h > 0 and layout is not null and x is not null and y is not null").select(F.lit(None).cast(kinds["sheet"]).alias("sheet"), "layout", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)).cast("array<long>")).alias("piece"), "id", *whole("x", "y", "w", "h"))
    both = page.unionByName(laid, allowMissingColumns=True).repartition(parts, "layout", "piece").sortWithinPartitions("layout", "piece", F.asc_nulls_first("sheet"))
    numbers = lambda table, *names: [table.column(c).to_numpy() for c in names]

    def answer(batches):
        held = None
        for rows in pages_of(batches, "layout", "piece", "sheet"):
            at = [rows.column(c)[0] for c in ("layout", "piece")]
            if not rows.column("sheet")[0].is_valid:
                own = rows.column("id").combine_chunks().dictionary_encode("encode")
                held, of, names = at, own.indices.to_numpy(), own.dictionary
                x, y, w, h = numbers(rows, "x", "y", "w", "h")
                continue
            if held != at:  # a layout without rectangles
                continue
            px = rows.column("px").combine_chunks()
            there = px.is_valid().to_numpy(zero_copy_only=False)
            ones = np.ones(len(there), np.int64)
            sums = box_sums(*numbers(rows, "x", "y"), [ones, px.fill_null(0).to_numpy(), *([] if there.all() else [there.astype(np.int64)])], (x, y, x + w, y + h))
            if len(names) < len(of):  # ids that several rectangles share
                each, sums = sums, [np.zeros(len(names), np.int64) for _ in sums]
                for total, s in zip(sums, each, strict=True):
                    np.add.at(total, of, s)
            found = np.flatnonzero(sums[0])
            n, s = sums[0][found], sums[1][found]
            m = pa.array(s / n, mask=None if there.all() else sums[2][found] == 0)
            table = pa.table({"sheet": pa.repeat(rows.column("sheet")[0], len(found)), "id": names.take(pa.array(found)), "n": n, "m": m})
            yield from table.to_batches(100_000)

    return both.mapInArrow(answer, f"sheet {kinds['sheet']}, id {ids}, n long, m double")
