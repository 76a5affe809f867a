"""Stored results: a folder for each run, CSV files with headers of their own, read back into records and result rows.

A run is written as a whole and replaces what an earlier attempt of the same run left, so a retry never doubles a row. Times and places of files
come from Spark's hidden ``_metadata`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import first_per, qc_by_header

# What of a record is no response.
RESERVED = ["file_id", "input_path", "output_path", "score"]
FAILED = "Marker preprocessing failed (image moved to Manual/ErrorFiles)."


def write_run(rows: DataFrame, folder: str, run: str) -> None:
    """Result rows, all as text, below ``folder/run=.../route=...``; another attempt of the run replaces it."""
    text = rows.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
    text.write.mode("overwrite").option("quoteAll", True).option("escape", "\"").option("header", True).option("emptyValue", "").partitionBy("route").csv(f"{folder}/run={run}")


def write_explanations(explained: DataFrame, folder: str, run: str) -> None:
    """The explanation of each sheet as one CSV file in ``folder/run=.../sheet=...``, its rows in the order of questions."""
    laid = explained.repartition("sheet").sortWithinPartitions("sheet", "pos")
    laid.write.mode("overwrite").option("quoteAll", True).option("escape", "\"").option("header", True).option("emptyValue", "").partitionBy("sheet").csv(f"{folder}/run={run}")


def zipped(header: str, values: str) -> Column:
    """A record: the header's names with the values at their places. A short row leaves names out, further values go, the last of equal names counts."""
    n = f"least(size({header}), size({values}))"
    last = f"filter(sequence(1, {n}), i -> array_position(slice({header}, i + 1, {n} - i), {header}[i - 1]) = 0)"
    return F.expr(f"if({n} <= 0, map_from_arrays(cast(array() as array<string>), cast(array() as array<string>)), map_from_entries(transform({last}, i -> struct({header}[i - 1] as key, {values}[i - 1] as value))))")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """``file, mtime, at, header, record`` of all CSV files below the folder: each file's first row names its own columns.

    ``at`` orders the rows of a file. Rows that are blank throughout are dropped, empty values stay empty. Files below ``_workers`` are left out.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block")]
    at = F.struct("block", F.monotonically_increasing_id().alias("id")).alias("at")
    first = reader().text(folder).select("value", *place).select("file", "value", at).where("at.block = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    width = first.agg(F.max(F.size(F.split("line", ",")))).first()[0] or 1  # an upper bound: quoted commas only widen it
    columns = [f"c{i}" for i in range(width)]
    rows = reader().option("header", False).option("escape", "\"").option("nullValue", "\x00").option("emptyValue", "").schema(", ".join(f"{c} string" for c in columns)).csv(folder)
    rows = rows.select(F.expr(f"filter(array({', '.join(columns)}), v -> v is not null)").alias("row"), *place).where("file not like '%/\\_workers/%'").select("file", "mtime", at, "row")
    heads = rows.where("at.block = 0").groupBy(F.col("file").alias("of")).agg(F.min_by("row", "at").alias("header"), F.min("at").alias("first"))
    data = rows.join(heads, F.col("file") == F.col("of")).where("at > first and exists(row, v -> trim(v) <> '')")
    return data.select("file", "mtime", "at", "header", zipped("header", "row").alias("record"))


def result_rows(records: DataFrame, status: str = "ok") -> DataFrame:
    """Adds ``file_id, input_path, output_path, score, status, error_reason, responses`` from ``record``: what is not reserved is a response."""
    own = [F.coalesce(F.col("record")[c], F.lit("")).alias(c) if c == "file_id" else F.col("record")[c].alias(c) for c in RESERVED]
    names = ", ".join(f"'{c}'" for c in RESERVED)
    reason = F.lit(FAILED if status == "failed" else None).cast("string").alias("error_reason")
    return records.select("*", *own, F.lit(status).alias("status"), reason, F.expr(f"map_filter(record, (k, v) -> k not in ({names}))").alias("responses"))


def stored_results(records: DataFrame, pattern: str | None = None) -> DataFrame:
    """The results view of records: rows of the latest run's results, and of each failed file the first error by time, file and row.

    ``records`` are those of ``read_records`` below a folder of ``write_run``. A file may be in both halves. Errors are checked against the header of the
    results, or that of the oldest error where there are no results.
    """
    routed = records.withColumn("run", F.regexp_extract("file", "/run=([^/]+)/", 1)).withColumn("way", F.regexp_extract("file", "/route=([^/]+)/", 1))
    good, bad = routed.where("way = 'results'"), routed.where("way = 'errors'")
    newest = good.groupBy("run").agg(F.max("mtime").alias("t"), F.max("header").alias("h")).orderBy(F.desc("t"), "run").limit(1)  # a row
    ok = result_rows(good.join(F.broadcast(newest.select("run")), "run", "left_semi"))
    oldest = bad.groupBy("file").agg(F.min("mtime").alias("t"), F.max("header").alias("h")).orderBy("t", "file").limit(1)  # a row
    header = newest.select("h", F.lit(0).alias("o")).unionByName(oldest.select("h", F.lit(1).alias("o"))).orderBy("o").limit(1).select("h").first()
    named = F.array(*[F.lit(c) for c in header.h]) if header else F.expr("cast(array() as array<string>)")
    failed = first_per(result_rows(bad, "failed"), "file_id", "mtime", "file", "at").drop("header")
    both = qc_by_header(ok, "header", pattern).unionByName(qc_by_header(failed.withColumn("header", named), "header", pattern))
    return both.select("run", *RESERVED, "status", "error_reason", "qc_flags", "nr_count", "nr_percent", "responses")


def imported(files: DataFrame, path: str, size: str, suffixes: list[str], most_bytes: int) -> DataFrame:
    """Adds ``skipped``, why a file is not taken (null if it is): its suffix, no bytes, or too many."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    reason = F.when(~suffix.isin([s.lower() for s in suffixes]), F.concat(F.lit("unsupported suffix "), suffix)).when(F.col(size) <= 0, "empty file").when(F.col(size) > most_bytes, F.concat(F.lit("larger than "), F.lit(str(most_bytes)), F.lit(" bytes")))
    return files.withColumn("skipped", reason)
