"""Routing, quality control and reports over result rows."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH_NR = 0.7
# The columns that may hold the candidate, in this order.
CANDIDATE = ["CandidateNumber", "candidateNumber", "candidate_number"]


def routed(sheets: DataFrame, filter_multi: bool = True) -> DataFrame:
    """``route``: errors (``readable`` false), multi-marked, or results; the score's text is NA but for results."""
    multi = F.col("multi") & F.lit(filter_multi)
    route = F.when(~F.col("readable"), "errors").when(multi, "multimarked").otherwise("results")
    return sheets.withColumn("route", route).withColumn("score", F.when(F.col("route") == "results", F.col("score").cast("string")).otherwise("NA"))


def qc_flags(rows: DataFrame, pattern: str | None, empty: str = "NR") -> DataFrame:
    """``responses map<string,string>``: counts of unread questions and flags. An invalid pattern flags every row.

    The candidate is the column ``candidate``, else the first of ``CANDIDATE`` among the responses; without either, and without a pattern, it is not checked.
    """
    nr = F.expr(f"size(filter(map_entries(responses), e -> lower(e.key) rlike '^q[0-9]+' and trim(e.value) = '{empty}'))")
    n = F.expr("size(filter(map_keys(responses), k -> lower(k) rlike '^q[0-9]+'))")
    share = nr / F.greatest(F.lit(1), n)
    if "candidate" in rows.columns:
        there, value = F.lit(True), F.coalesce(F.trim("candidate"), F.lit(""))
    else:
        name = F.coalesce(*[F.when(F.array_contains(F.map_keys("responses"), c), F.lit(c)) for c in CANDIDATE])
        there, value = name.isNotNull(), F.coalesce(F.trim(F.col("responses")[name]), F.lit(""))
    bad = value == ""
    if pattern:
        bad = bad | (~value.rlike(f"^(?:{pattern})$") if valid_pattern(rows, pattern) else F.lit(True))
    if pattern is None:
        bad = there & bad
    flags = F.array_compact(F.array(F.when(share >= HIGH_NR, "HIGH_NR"), F.when(bad, "BAD_CANDIDATE")))
    return rows.withColumn("nr_count", nr).withColumn("nr_percent", share).withColumn("qc_flags", flags)


def qc_by_header(rows: DataFrame, header: str, pattern: str | None, empty: str = "NR") -> DataFrame:
    """The same checks of ``record map<string,string>`` by the columns of a file's ``header``: a question that the record lacks counts as read."""
    asked = f"filter({header}, c -> lower(c) rlike '^q[0-9]+')"
    nr = F.expr(f"size(filter({asked}, c -> coalesce(trim(record[c]), '') = '{empty}'))")
    share = nr / F.greatest(F.lit(1), F.size(F.expr(asked)))
    name = F.coalesce(*[F.when(F.map_contains_key("record", c), F.lit(c)) for c in CANDIDATE])
    value = F.coalesce(F.trim(F.col("record")[name]), F.lit(""))
    bad = value == ""
    if pattern:
        bad = bad | (~value.rlike(f"^(?:{pattern})$") if valid_pattern(rows, pattern) else F.lit(True))
    else:
        bad = name.isNotNull() & bad
    flags = F.array_compact(F.array(F.when(share >= HIGH_NR, "HIGH_NR"), F.when(bad, "BAD_CANDIDATE")))
    return rows.withColumn("nr_count", nr).withColumn("nr_percent", share).withColumn("qc_flags", flags)


def valid_pattern(rows: DataFrame, pattern: str) -> bool:
    """Whether the executors' regular expressions accept the pattern."""
    try:
        rows.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(f"^(?:{pattern})$")
    except IllegalArgumentException:
        return False
    return True


def first_per(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("\x00r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("`\x00r` = 1").drop("\x00r")


def results_view(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Results and, of each file's error rows, the first by time and row."""
    e = first_per(errors, "file_id", "mtime", "row").select("file_id", F.lit("error").alias("kind"), "score")
    return results.select("file_id", F.lit("result").alias("kind"), "score").unionByName(e)


def progress(runs: DataFrame) -> DataFrame:
    """``processed, total, elapsed, status``: rate a minute (one decimal) and the seconds left, while running."""
    known = (F.col("elapsed") > 0) & (F.col("processed") > 0)
    rate = F.when(known, F.bround(F.col("processed") / F.col("elapsed") * 60, 1))
    eta = F.when(known & (F.col("status") == "running"), F.bround((F.col("total") - F.col("processed")) / (F.col("processed") / F.col("elapsed"))))
    return runs.withColumn("rate", rate).withColumn("eta", eta.cast("long"))


def erasure_risk(answers: DataFrame, fixed: bool = False) -> DataFrame:
    """Risk of an answer with several letters: min(95, 65 + 10 n). ``fixed`` leaves out the letters of ``MR( )`` and ``NR``."""
    text = F.upper("answer")
    if fixed:
        text = F.regexp_replace(F.regexp_replace(text, r"^MR\((.*)\)$", "$1"), "^NR$", "")
    n = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[^A-Z]", ""), ""), lambda x: x != "")))
    risk = F.when(F.lower("label").rlike("^q[0-9]+") & (F.length("answer") > 1) & (n > 1), F.least(F.lit(95), 65 + 10 * n)).otherwise(0)
    return answers.withColumn("risk", risk.cast("int"))


def first_n(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first n rows of each key; every task keeps n of a key at most before the exchange."""
    return rows.withColumn("\x00r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(f"`\x00r` <= {n}").drop("\x00r")


def merged(parts: list[DataFrame], *index) -> DataFrame:
    """The rows of all workers with ``idx``, their place by ``index`` from 1: range partitioned, so no task sorts them all.

    The columns are those of the first part that has rows; others' further columns go, missing ones are null.
    """
    from .order import numbered

    header = next((p.columns for p in parts if not p.isEmpty()), parts[0].columns)
    shaped = [p.select(*[F.col(f"`{c}`") if c in p.columns else F.lit(None).cast("string").alias(c) for c in header]) for p in parts]
    every = shaped[0]
    for p in shaped[1:]:
        every = every.unionByName(p)
    return numbered(every, list(index), name="idx")


def oldest_first(files: DataFrame, *order) -> DataFrame:
    """Files with ``place`` from 1, oldest first, without one task that sorts them all."""
    from .order import numbered

    return numbered(files, list(order))


def run_stats(rows: DataFrame, ts: str, failed: Column) -> DataFrame:
    """One row: sheets processed, failed, done, whole seconds from the first to the last, and sheets a minute."""
    seconds = F.unix_timestamp(F.date_trunc("second", F.max(ts))) - F.unix_timestamp(F.date_trunc("second", F.min(ts)))
    bad = F.coalesce(failed, F.lit(False)).cast("long")
    a = rows.agg(F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum(bad), F.lit(0)).alias("failed"), F.coalesce(F.sum(1 - bad), F.lit(0)).alias("done"), seconds.alias("elapsed"))
    return a.withColumn("per_minute", F.round(F.col("processed") * 60.0 / F.greatest(F.lit(1), "elapsed"), 6))


def batch_outcome(rows: DataFrame, batch: str, failed: Column) -> DataFrame:
    """``outcome`` of each batch: failed if all its sheets are, done with errors if some are."""
    bad = F.sum(F.coalesce(failed, F.lit(False)).cast("int"))
    return rows.groupBy(batch).agg(F.when(bad == F.count(F.lit(1)), "failed").when(bad > 0, "done with errors").otherwise("done").alias("outcome"))


def milestones(rows: DataFrame, batch: str, *order) -> DataFrame:
    """The rows that complete another tenth of their batch, with ``percent`` (the highest reached); batches of any size are numbered over many tasks."""
    from .order import numbered

    sizes = rows.groupBy(F.col(batch).alias("\x00b")).agg(F.count(F.lit(1)).alias("\x00n"))
    placed = numbered(rows, list(order), [batch], "\x00rn").join(sizes, F.col(batch).eqNullSafe(F.col("\x00b")))
    step = F.expr("(10 * `\x00rn`) div `\x00n`")
    return placed.withColumn("percent", step * 10).where(step > F.expr("(10 * (`\x00rn` - 1)) div `\x00n`")).drop("\x00rn", "\x00n", "\x00b")


def latest_processed(rows: DataFrame, batch: str, index: str, *columns: str) -> DataFrame:
    """Of each batch the largest index, and other columns of that row."""
    return rows.groupBy(batch).agg(F.max(index).alias("latest_id"), *[F.max_by(c, index).alias(c) for c in columns])


def preview(rows: DataFrame, *order, n: int = 100) -> DataFrame:
    """The first rows: a report of at most n."""
    return rows.orderBy(*order).limit(n)


def name_search(files: DataFrame, name: str, text: str) -> DataFrame:
    """Files whose name contains the text, in either case."""
    return files.where(F.lower(name).contains(text.lower()))


def newest_batches(rows: DataFrame, batch: str, ts: str, n: int = 50) -> DataFrame:
    """The n newest batches with ``created`` and ``place``; every task keeps n at most."""
    top = rows.groupBy(batch).agg(F.max(ts).alias("created")).orderBy(F.desc("created"), batch).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created"), batch)))
