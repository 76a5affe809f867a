"""Specifications in columns: ranges of labels, grids of bubbles, sizes of blocks, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = r"^([^.\d]+)(\d+)\.{2,3}(\d+)$"


def expanded(text: str) -> Column:
    """The labels of a field string as an array: ``q1..3`` to q1, q2, q3; other strings stand for themselves. A range that does not rise is an error."""
    part = lambda i: f"regexp_extract({text}, '{RANGE}', {i})".replace("\\", "\\\\")
    first, last = f"cast({part(2)} as int)", f"cast({part(3)} as int)"
    wrong = f"raise_error(concat('Invalid range in fields string: ''', {text}, ''', start: ', {first}, ' is not less than end: ', {last}))"
    labels = f"transform(sequence({first}, {last}), i -> concat({part(1)}, i))"
    return F.expr(f"case when {part(2)} = '' then array({text}) when {first} >= {last} then {wrong} else {labels} end")


def grid(blocks: DataFrame) -> DataFrame:
    """A row for each bubble of ``labels, values array<string>, direction, x0, y0, bubbles_gap, labels_gap``: ``label, opt, value, x, y``.

    Places grow by repeated addition, as a walk along the block does, and are then rounded half to even.
    """
    walked = lambda start, gap, n: f"aggregate(sequence(1, {n}), cast({start} as double), (a, i) -> if(i <= {n} - 1, a + {gap}, a))"
    rows = blocks.select("*", F.posexplode("labels").alias("li", "label")).select("*", F.posexplode("values").alias("opt", "value"))
    across = F.col("direction") == "horizontal"
    step = lambda start, gap, at: F.expr(walked(start, gap, f"({at} + 1)"))
    x = F.when(across, step("x0", "bubbles_gap", "opt")).otherwise(step("x0", "labels_gap", "li"))
    y = F.when(across, step("y0", "labels_gap", "li")).otherwise(step("y0", "bubbles_gap", "opt"))
    return rows.withColumn("x", F.bround(x).cast("int")).withColumn("y", F.bround(y).cast("int"))


def block_size(n_labels: str, n_values: str, bubbles_gap: str, labels_gap: str, bubble_w: str, bubble_h: str, direction: str) -> tuple[Column, Column]:
    """Width and height of a block of bubbles, cut to whole pixels."""
    along = lambda across: f"cast({bubbles_gap} * ({n_values} - 1) + {bubble_w if across else bubble_h} as int)"
    aside = lambda across: f"cast({labels_gap} * ({n_labels} - 1) + {bubble_h if across else bubble_w} as int)"
    pick = lambda a, b: F.expr(f"if({direction} = 'horizontal', {a}, {b})")
    return pick(along(True), aside(False)), pick(aside(True), along(False))


def overflows(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    return (x < 0) | (y < 0) | (x + width >= page_width) | (y + height >= page_height)


def overlapping(labels: DataFrame, label: str, block: str) -> DataFrame:
    """``label, blocks``: labels that several blocks claim."""
    return labels.groupBy(F.col(label).alias("label")).agg(F.count_distinct(block).alias("blocks")).where("blocks > 1")


def missing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct labels of ``asked`` that ``known`` lacks."""
    return asked.select("label").distinct().join(known.select("label"), "label", "left_anti")


def sections(questions: DataFrame, of: str, known: DataFrame) -> DataFrame:
    """Adds ``section``: the named one if ``known`` (a specification's sections, hence few) holds it, else DEFAULT."""
    return questions.join(F.broadcast(known.select("section")), F.col("section") == F.col(of), "left").withColumn("section", F.coalesce("section", F.lit("DEFAULT")))
