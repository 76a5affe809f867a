"""Rosters for pre-filled sheets: cleaning, checks, and where a number's bubbles are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["student_name", "school_name", "exam_name", "candidate_number"]


def read_roster(spark: SparkSession, path: str, most_rows: int = 10_000) -> DataFrame:
    """A roster CSV as strings (a byte order mark is dropped); missing columns, no rows or too many are errors."""
    df = spark.read.option("header", True).option("nullValue", "\x00").option("emptyValue", "").option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    n = df.limit(most_rows + 1).count()
    if n == 0 or n > most_rows:
        raise ValueError("The roster is empty" if n == 0 else f"The roster has more than {most_rows} rows")
    return df


def clean(column: str, most: int = 200) -> Column:
    """Without control characters, trimmed, cut to ``most`` characters with an ellipsis."""
    text = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x00-\x1F\x7F]", ""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def valid_candidate(column: str) -> Column:
    """Exactly ten digits."""
    return clean(column, 10).rlike("^[0-9]{10}$")


def checked(roster: DataFrame, strict: bool = False) -> DataFrame:
    """Clean fields and an ``error`` per row; ``strict`` raises on the first bad row, as one bad row then fails the batch."""
    out = roster.select(*[clean(c).alias(c) for c in REQUIRED], *[c for c in roster.columns if c not in REQUIRED])
    out = out.withColumn("error", F.when(~F.col("candidate_number").rlike("^[0-9]{10}$"), F.lit("candidate_number must be exactly 10 digits")))
    if strict and (bad := out.where("error is not null").limit(1).collect()):
        raise ValueError(bad[0].error)
    return out


def candidate_bubbles(rows: DataFrame, x0: float, width: float, top: float, step: float, height: float) -> DataFrame:
    """Centre of the bubble of each digit: columns share the width evenly, rows go down by the digit."""
    r = rows.select("*", F.posexplode(F.expr("regexp_extract_all(candidate, '[0-9]', 0)")).alias("col", "d")).withColumn("digit", F.col("d").cast("int"))
    return r.withColumn("x", F.lit(x0) + (F.col("col") + 0.5) * F.lit(width / 10)).withColumn("y", (F.lit(top) + F.col("digit") * F.lit(step)) * F.lit(height))


def entry_name(output_file: Column, index: Column) -> Column:
    """Name in the ZIP file: the base name of ``output_file``, else a numbered one; with the suffix."""
    base = F.element_at(F.split(output_file, "/"), -1)
    number = index.cast("string")
    name = F.when(base == "", F.concat(F.lit("sheet_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).otherwise(base)
    return F.when(F.lower(name).endswith(".png"), name).otherwise(F.concat(name, F.lit(".png")))
