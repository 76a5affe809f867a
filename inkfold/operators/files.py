"""Names, listings and the choice of configuration for a directory tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import accumulated, numbered


def sanitised(name: str) -> Column:
    """The base name with other characters than letters, digits, dot, underscore and dash as ``_``, trimmed of dots and underscores; null if nothing is left."""
    base = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    return F.nullif(F.btrim(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit(""))


def deduplicated(files: DataFrame, name: str, *order) -> DataFrame:
    """``unique_name``: a repeated name gets ``_1``, ``_2`` ... before its suffix, in the order of arrival; numbers that other files' real names hold are passed over.

    Names are numbered over many tasks, however often one occurs. With ``t`` the i-th number taken, the n-th free one is n plus how many ``t - i + 1`` are
    at most n; both kinds of rows are counted in one order.
    """
    base = numbered(files, list(order), [name], "\x01n").withColumn("\x01n", F.col("\x01n") - 1)
    taken = F.regexp_extract(name, r"^(.*)_([1-9]\d{0,8})((?:\.[^.]*)?)$", 2)
    real = files.select(name).distinct().where(taken != "").select(F.regexp_replace(name, r"^(.*)_([1-9]\d{0,8})((?:\.[^.]*)?)$", "$1$3").alias(name), taken.cast("long").alias("\x01t"))
    held = numbered(real, ["\x01t"], [name], "\x01i").select(F.col(name), (F.col("\x01t") - F.col("\x01i") + 1).alias("\x01n"), F.lit(0).alias("\x01k"))
    rows = base.withColumn("\x01k", F.lit(1)).unionByName(held, allowMissingColumns=True)
    counted = accumulated(rows, ["\x01n", "\x01k"], [name], sums={"\x01c": 1 - F.col("\x01k").cast("long")}).where("`\x01k` = 1")
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    free = (F.col("\x01n") + F.col("\x01c")).cast("string")
    return counted.withColumn("unique_name", F.when(F.col("\x01n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), free, suffix))).drop("\x01n", "\x01k", "\x01c")


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """For each ``dir, file`` the config of the longest ``config_dir`` that is an ancestor (or itself).

    The directory is exploded into its ancestors, so the match is an equi-join, not a theta join.
    """
    parts = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    j = files.withColumn("config_dir", above).join(configs, "config_dir")
    w = Window.partitionBy("dir", "file").orderBy(F.length("config_dir").desc())
    return j.withColumn("\x00r", F.row_number().over(w)).where("`\x00r` = 1").drop("\x00r")


def nearest_specs(dirs: DataFrame, specs: DataFrame, kinds: list[str]) -> DataFrame:
    """Of each ``dir`` the deepest ``spec_dir`` of every kind (``spec_dir, kind``) that is an ancestor or itself; null where there is none.

    A directory is exploded into its ancestors once for all kinds, and meets the specifications by equal keys.
    """
    parts = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    met = dirs.select("dir").distinct().withColumn("spec_dir", above).join(specs, "spec_dir", "left")
    one = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("spec_dir")), F.when(F.col("kind") == k, F.length("spec_dir")))
    return met.groupBy("dir").agg(*[one(k).alias(k) for k in kinds])


def listed(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """The files whose name ends with one of the suffixes, in either case, by path."""
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin([x.lower().lstrip(".") for x in suffixes])).orderBy("path")


def without(files: DataFrame, path: str, excluded: DataFrame) -> DataFrame:
    """The files whose path is not among those of ``excluded``."""
    return files.join(excluded.select(path), path, "left_anti")


def natural_key(label: str) -> list[Column]:
    """Sort by prefix, then number, then the label itself (ties have no order of their own)."""
    return [F.regexp_extract(label, r"^([^0-9]*)", 1), F.expr(f"coalesce(try_cast(regexp_extract({label}, '([0-9]+)', 1) as bigint), 0)"), F.col(label)]


def latest(files: DataFrame) -> DataFrame:
    """The file with the largest mtime."""
    return files.orderBy(F.desc("mtime"), "path").limit(1)
