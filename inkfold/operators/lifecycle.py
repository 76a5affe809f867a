"""A batch's life: statuses folded from ordered events, illegal steps rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import AT, PART, laid_out

# The statuses of a batch, and what may follow each.
STATUSES = ["created", "queued", "running", "done", "failed", "cancelled"]
NEXT = {"created": ["queued"], "queued": ["running", "cancelled"], "running": ["done", "failed", "cancelled"], "done": ["queued", "created"], "failed": ["queued", "created"], "cancelled": ["queued", "created"]}
# A step to one of these without an error clears the last one.
CLEARING = ["queued", "running", "done"]


def folded(events: DataFrame, batch: str, order: list, first: str = "created", following: dict[str, list[str]] | None = None) -> DataFrame:
    """``batch, status, last_error, rejected`` from events ``status, error`` in ``order``; every batch starts as ``first``.

    A step that the table does not allow (unknown statuses as well) is counted and changes nothing. An accepted one sets the last error if it
    brings one or is a failure; else queued, running and done clear it, and other statuses keep it. Events lie in order over many
    partitions: each folds its share of a batch from every status that it might start with, and the shares are then chained, a row a partition.
    """
    following = following or NEXT
    n = len(STATUSES)
    allowed = ", ".join(str(b in following.get(a, [])).lower() for a in STATUSES for b in STATUSES)
    number = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).cast("int") - 1
    clears = F.col("error").isNotNull() | F.col("status").isin("failed", *CLEARING)
    steps = events.select(F.col(batch).alias("b"), *order, F.coalesce(number, F.lit(-1)).alias("to"), "error", F.coalesce(clears, F.lit(False)).alias("sets"))
    laid = laid_out(steps, order, ["b"])
    share = laid.groupBy("b", PART).agg(F.expr(f"array_sort(collect_list(struct(`{AT}` as at, to, error, sets)))").alias("e"))
    start = "named_struct('state', s, 'touched', false, 'error', cast(null as string), 'rejected', 0L)"
    ok = f"(e.to >= 0 and coalesce(get(array({allowed}), a.state * {n} + e.to), false))"
    step = f"if({ok}, named_struct('state', e.to, 'touched', a.touched or e.sets, 'error', if(e.sets, e.error, a.error), 'rejected', a.rejected), named_struct('state', a.state, 'touched', a.touched, 'error', a.error, 'rejected', a.rejected + 1L))"
    ends = share.select("b", PART, F.expr(f"transform(sequence(0, {n - 1}), s -> aggregate(e, {start}, (a, e) -> {step}))").alias("ends"))
    chain = ends.groupBy("b").agg(F.expr(f"array_sort(collect_list(struct(`{PART}` as part, ends)))").alias("c"))
    joint = "named_struct('state', c.ends[a.state].state, 'error', if(c.ends[a.state].touched, c.ends[a.state].error, a.error), 'rejected', a.rejected + c.ends[a.state].rejected)"
    last = F.expr(f"aggregate(c, named_struct('state', {STATUSES.index(first)}, 'error', cast(null as string), 'rejected', 0L), (a, c) -> {joint})")
    names = ", ".join(f"'{s}'" for s in STATUSES)
    return chain.select("b", last.alias("z")).select(F.col("b").alias(batch), F.expr(f"get(array({names}), z.state)").alias("status"), F.col("z.error").alias("last_error"), F.col("z.rejected").alias("rejected"))


# The rotations a batch may have.
ROTATIONS = [0, 90, 180, 270]


def source_modes(uploads: DataFrame, batch: str, mode: str) -> DataFrame:
    """``batch, source_mode``: the one way a batch's files came, or mixed."""
    return uploads.groupBy(batch).agg(F.when(F.min(mode) == F.max(mode), F.min(mode)).when(F.max(mode).isNotNull(), "mixed").alias("source_mode"))


def rotations(changes: DataFrame, batch: str, order: str, degrees: str) -> DataFrame:
    """``batch, rotation, refused``: the last valid rotation by ``order``, 0 without any; others are refused and counted."""
    valid = F.coalesce(F.col(degrees).isin(ROTATIONS), F.lit(False))
    return changes.groupBy(batch).agg(F.coalesce(F.max_by(F.when(valid, F.col(degrees)), F.when(valid, F.col(order))), F.lit(0)).alias("rotation"), F.sum((~valid).cast("long")).alias("refused"))
