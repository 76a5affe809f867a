"""Places and running values in a global order, or in the order of groups of any size, without a task that sees a whole group.

Rows are range partitioned by group and order, so that a large group lies over many partitions; the totals of each partition and group are
accumulated (in one group's window a row a partition, whatever the number of rows), and come back as what precedes the partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved

AT, TIE, PART, ONE = "\x01at", "\x01tie", "\x01part", "\x01one"


def laid_out(rows: DataFrame, order: list, group: list[str], parts: int | None = None) -> DataFrame:
    """The rows as a table in the order of group and ``order``: ``AT`` grows with it, ``PART`` is the partition.

    Rows equal in all keys are dealt by where they came from, so that copies do not fill one partition.
    """
    n = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*group, *order, TIE]
    tied = rows.withColumn(TIE, F.monotonically_increasing_id())
    spread = tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(TIE)
    return saved(spread.withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(AT, 33)), "ordered")


def _joined(laid: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    """Each row with what its partition's share of the group starts from; null groups match."""
    named = spans.select(*[F.col(g).alias(f"\x01{i}") for i, g in enumerate([PART, *group])], *[c for c in spans.columns if c not in (PART, *group)])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"\x01{i}")) if i else F.col(g) == F.col("\x010") for i, g in enumerate([PART, *group])])
    return laid.join(named.hint("merge"), same).drop(*[f"\x01{i}" for i in range(len(group) + 1)])


def numbered(rows: DataFrame, order: list, group: list[str] | None = None, name: str = "place", parts: int | None = None) -> DataFrame:
    """The rows with ``name`` (long): their place from 1 by ``order``, in each ``group`` or among all. Null groups are a group; ties get places in no set order."""
    group = group or []
    laid = laid_out(rows, order, group, parts)
    spans = laid.groupBy(PART, *group).agg(F.min(AT).alias("\x01first"), F.count(F.lit(1)).alias("\x01n"))
    before = Window.partitionBy(*(group or [ONE])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(ONE, F.col(PART) * 0).withColumn("\x01shift", F.coalesce(F.sum("\x01n").over(before), F.lit(0)) - F.col("\x01first") + 1).drop("\x01first", "\x01n", ONE)
    return _joined(laid, spans, group).withColumn(name, F.col(AT) + F.col("\x01shift")).drop(AT, PART, "\x01shift")


def accumulated(rows: DataFrame, order: list, group: list[str] | None = None, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """The rows with running values by ``order`` in each ``group``, their own included: sums, and largest values so far (null before the first)."""
    group, sums, tops = group or [], sums or {}, tops or {}
    values = {**sums, **tops}
    given = rows.select("*", *[v.alias(f"\x01v{i}") for i, v in enumerate(values.values())])
    laid = laid_out(given, order, group, parts)
    kind = lambda k: F.sum if k in sums else F.max
    joint = lambda k, a, b: F.coalesce(a + b, a, b) if k in sums else F.greatest(a, b)
    spans = laid.groupBy(PART, *group).agg(*[kind(k)(f"\x01v{i}").alias(f"\x01t{i}") for i, k in enumerate(values)])
    before = Window.partitionBy(*(group or [ONE])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(ONE, F.col(PART) * 0).select(PART, *group, *[kind(k)(f"\x01t{i}").over(before).alias(f"\x01c{i}") for i, k in enumerate(values)])
    local = Window.partitionBy(PART, *group).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    both = _joined(laid, spans, group)
    out = [joint(k, kind(k)(f"\x01v{i}").over(local), F.col(f"\x01c{i}")).alias(k) for i, k in enumerate(values)]
    return both.select(*[c for c in rows.columns if c not in values], *out)
