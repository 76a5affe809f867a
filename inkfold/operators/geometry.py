"""Levels, markers, corners and page sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .report import first_per

# A marker's least score, and how far it may fall behind the best corner.
LEAST_SCORE, VARIATION = 0.3, 0.41


def level(value: Column, low: float, high: float, gamma: float) -> Column:
    """A gray value stretched between ``low`` and ``high`` (shares of 255), bent by gamma."""
    x = (value / F.lit(255.0) - F.lit(low)) / F.lit(high - low)
    return F.when(x <= 0, 0).when(x >= 1, 255).otherwise(F.floor(F.pow(x, F.lit(1 / gamma)) * 255)).cast("int")


def best_scale(matches: DataFrame) -> DataFrame:
    """Of ``sheet, scale, score`` (a row a corner) the scale whose worst corner is best, the larger of equal ones: ``sheet, scale, worst``."""
    return first_per(matches.groupBy("sheet", "scale").agg(F.min("score").alias("worst")), "sheet", F.desc("worst"), F.desc("scale"))


def accepted_corners(corners: DataFrame, least: float = LEAST_SCORE, variation: float = VARIATION) -> DataFrame:
    """``sheet, corner, score`` with ``anchor``, the sheet's best score, and ``accepted``: clear enough, and not too far behind the anchor."""
    anchor = F.max("score").over(Window.partitionBy("sheet"))
    return corners.withColumn("anchor", anchor).withColumn("accepted", (F.col("score") >= least) & (F.abs(F.col("anchor") - F.col("score")) < variation))


def retried_corners(corners: DataFrame, least: float = LEAST_SCORE, variation: float = VARIATION) -> DataFrame:
    """``sheet, corner, score, wide`` (the score in a wider window, null without one) with ``anchor, final, used_wide, accepted``.

    A corner that is not clear enough, or too far behind the anchor (the best score in the first windows), takes its wider window if that is accepted and no worse.
    """
    good = lambda c: (F.col(c) >= least) & (F.abs(F.col("anchor") - F.col(c)) < variation)
    out = corners.withColumn("anchor", F.max("score").over(Window.partitionBy("sheet")))
    out = out.withColumn("used_wide", F.coalesce(~good("score") & good("wide") & (F.col("wide") >= F.col("score")), F.lit(False)))
    return out.withColumn("final", F.when(F.col("used_wide"), F.col("wide")).otherwise(F.col("score"))).withColumn("accepted", good("final"))


def clipped(x0: Column, x1: Column, y0: Column, y1: Column, width: Column, height: Column, padding: Column | None = None) -> list[Column]:
    """A window, wider by ``padding`` on all sides, cut at the page: x0, x1, y0, y1."""
    p = F.lit(0) if padding is None else padding
    whole = lambda c: c.cast("int")
    return [whole(F.greatest(F.lit(0), x0 - p)), whole(F.least(width, x1 + p)), whole(F.greatest(F.lit(0), y0 - p)), whole(F.least(height, y1 + p))]


def fitted(width: Column, height: Column, box_width: float, box_height: float, rotation: Column | None = None) -> tuple[Column, Column]:
    """The size of a page scaled down into the box, rounded half to even; never up, a pixel at least. Turned by 90 or 270 degrees, its sides are swapped first."""
    turned = F.lit(False) if rotation is None else (rotation % 180) == 90
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    s = F.least(F.lit(1.0), F.lit(float(box_width)) / w, F.lit(float(box_height)) / h)
    return F.greatest(F.lit(1), F.bround(w * s).cast("int")), F.greatest(F.lit(1), F.bround(h * s).cast("int"))


def page_dimensions(scans: DataFrame, display: tuple[int, int], processing: tuple[int, int]) -> DataFrame:
    """``scans`` (``width, height, rotation``, and ``page_width, page_height`` where a template places its blocks between markers, else null) with display and processing sizes.

    Both boxes are filled without scaling up; between markers the template's own page is the processing size.
    """
    dw, dh = fitted(F.col("width"), F.col("height"), *display, F.col("rotation"))
    pw, ph = fitted(F.col("width"), F.col("height"), *processing, F.col("rotation"))
    own = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    sizes = {"display_width": dw, "display_height": dh, "processing_width": F.when(own, F.col("page_width")).otherwise(pw), "processing_height": F.when(own, F.col("page_height")).otherwise(ph)}
    return scans.withColumns(sizes)


def best_share(rows: DataFrame, group: str, percent: int, *order) -> DataFrame:
    """The first ``percent`` of each group, rounded down."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("\x00r", F.row_number().over(w.orderBy(*order))).withColumn("\x00n", F.count(F.lit(1)).over(w))
    return ranked.where(f"`\x00r` * 100 <= `\x00n` * {percent}").drop("\x00r", "\x00n")


def largest(rows: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n of each group with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def determinant(m: list[list[str]]) -> str:
    """SQL of a 3 x 3 determinant."""
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def fourth_corner(source: list[str], target: list[str], missing: str) -> tuple[Column, Column]:
    """Where the fourth corner lies: the affine map of three reference points to the three found, applied to the missing reference point.

    Columns of structs ``x, y``; Cramer's rule. Null where the reference points lie on a line.
    """
    rows = [[f"{p}.x", f"{p}.y", "1d"] for p in source]
    whole = determinant(rows)

    def mapped(axis: str) -> Column:
        values = [f"{p}.{axis}" for p in target]
        parts = []
        for k, factor in enumerate((f"{missing}.x", f"{missing}.y", "1d")):
            swapped = [[v if j == k else x for j, x in enumerate(row)] for row, v in zip(rows, values, strict=True)]
            parts.append(f"{determinant(swapped)} * {factor}")
        return F.expr(f"try_divide({' + '.join(parts)}, cast({whole} as double))")

    return mapped("x"), mapped("y")


def completed_corners(corners: DataFrame) -> DataFrame:
    """``sheet`` with ``x, y, rx, ry`` arrays of four corners (top left, top right, bottom left, bottom right): one that is null is set from the other three.

    ``rx, ry`` are the reference places. With two or more missing, ``complete`` is false and the arrays stay.
    """
    at = lambda x, y, i: f"named_struct('x', cast(get({x}, {i}) as double), 'y', cast(get({y}, {i}) as double))"
    out = corners.withColumn("\x01gap", F.expr("filter(sequence(0, 3), i -> x[i] is null or y[i] is null)"))
    known = out.withColumn("\x01k", F.when(F.size("\x01gap") == 1, F.expr("filter(sequence(0, 3), i -> i <> `\x01gap`[0])")))
    for i in range(3):
        known = known.withColumn(f"\x01s{i}", F.expr(at("rx", "ry", f"get(`\x01k`, {i})"))).withColumn(f"\x01t{i}", F.expr(at("x", "y", f"get(`\x01k`, {i})")))
    known = known.withColumn("\x01m", F.expr(at("rx", "ry", "get(`\x01gap`, 0)")))
    fx, fy = fourth_corner([f"`\x01s{i}`" for i in range(3)], [f"`\x01t{i}`" for i in range(3)], "`\x01m`")
    known = known.withColumn("\x01fx", fx).withColumn("\x01fy", fy)
    fill = lambda a, f: F.expr(f"transform({a}, (v, i) -> if(`\x01k` is not null and i = `\x01gap`[0], `{f}`, cast(v as double)))")
    done = F.expr("size(`\x01gap`) = 0 or (size(`\x01gap`) = 1 and `\x01fx` is not null)")
    return known.select(*[c for c in corners.columns if c not in ("x", "y")], fill("x", "\x01fx").alias("x"), fill("y", "\x01fy").alias("y"), done.alias("complete"))


def square_map(p: str) -> dict[str, str]:
    """SQL of the projective map of the unit square to a quad; ``p`` is an array of structs ``x, y`` (top left, top right, bottom right, bottom left)."""
    x, y = ([f"{p}[{i}].{axis}" for i in range(4)] for axis in "xy")
    sx, sy = (f"({v[0]} - {v[1]} + {v[2]} - {v[3]})" for v in (x, y))
    dx1, dy1, dx2, dy2 = f"({x[1]} - {x[2]})", f"({y[1]} - {y[2]})", f"({x[3]} - {x[2]})", f"({y[3]} - {y[2]})"
    below = f"({dx1} * {dy2} - {dx2} * {dy1})"
    g, h = f"try_divide({sx} * {dy2} - {dx2} * {sy}, {below})", f"try_divide({dx1} * {sy} - {sx} * {dy1}, {below})"
    return {"a": f"({x[1]} - {x[0]} + {g} * {x[1]})", "b": f"({x[3]} - {x[0]} + {h} * {x[3]})", "c": x[0], "d": f"({y[1]} - {y[0]} + {g} * {y[1]})", "e": f"({y[3]} - {y[0]} + {h} * {y[3]})", "f": y[0], "g": g, "h": h}


def canvas_map(rows: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``mx, my``: where the homography of the source quad to the target quad puts the point x, y of the full canvas.

    Both quads are arrays of structs; the map goes back from the source to the unit square (adjugate) and on to the target. Null for flat quads.
    """
    kept = rows.columns
    out = rows
    for tag, quad in (("s", source), ("t", target)):
        for k, sql in square_map(quad).items():
            out = out.withColumn(f"\x01{tag}{k}", F.expr(f"cast({sql} as double)"))
    v = lambda t, k: f"`\x01{t}{k}`"
    a, b, c, d, e, f, g, h = (v("s", k) for k in "abcdefgh")
    inverse = [[f"({e} - {f} * {h})", f"({c} * {h} - {b})", f"({b} * {f} - {c} * {e})"], [f"({f} * {g} - {d})", f"({a} - {c} * {g})", f"({c} * {d} - {a} * {f})"], [f"({d} * {h} - {e} * {g})", f"({b} * {g} - {a} * {h})", f"({a} * {e} - {b} * {d})"]]
    for k, row in zip("uvw", inverse, strict=True):
        out = out.withColumn(f"\x01{k}", F.expr(f"{row[0]} * {x} + {row[1]} * {y} + {row[2]}"))
    u, w, z = "`\x01u`", "`\x01v`", "`\x01w`"
    below = f"({v('t', 'g')} * {u} + {v('t', 'h')} * {w} + {z})"
    mx = F.expr(f"try_divide({v('t', 'a')} * {u} + {v('t', 'b')} * {w} + {v('t', 'c')} * {z}, {below})")
    my = F.expr(f"try_divide({v('t', 'd')} * {u} + {v('t', 'e')} * {w} + {v('t', 'f')} * {z}, {below})")
    return out.select(*kept, mx.alias("mx"), my.alias("my"))
