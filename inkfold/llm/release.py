"""Quarantine and cascading release: a discrete-event simulation of each conversation.

Turns arrive, are tried, fail and are retried; a turn whose parent is not delivered waits in the parent's list, and a delivery releases
the list. A binary heap holds what comes next, so its pops give the deliveries in the order of their release.

A conversation is simulated in one go where it has at most ``split_turns`` turns. A longer one is cut where no turn depends on one before
the cut, its parts are simulated apart, and the releases of the parts are put in one order by range partitioning; so no task holds a whole long
conversation, unless its turns form one unbroken chain of dependencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import accumulated, numbered
from .common import Scratch, flat, parallelism

SPACING, ATTEMPTS, WAIT = 7, 5, 10  # seconds between arrivals, attempts of a turn, seconds before the first retry
REACH = 2  # turns back to the furthest parent
NAMES = ("delivered", "dead", "blocked")
WORD = 1 << 64


def drawn(k: int) -> Column:
    """h(k): crc32 of ``k:conv_id:turn``; nulls are spelled ``null``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.crc32(F.concat(F.lit(f"{k}:"), text("conv_id"), F.lit(":"), text("turn")).cast("binary"))


def prepared(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, crc`` and what chance gives each turn: ``back`` (turns to the parent), ``repair`` (seconds from arrival; null if sound), ``fails`` (a bit for each attempt)."""
    fails = sum(((drawn(a + 2) % 3 == 0).cast("int") * (1 << (a - 1)) for a in range(1, ATTEMPTS + 1)), F.lit(0))
    return flat(turns, "conv_id", "turn", "text").select(
        "conv_id", "turn", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), (drawn(0) % (REACH + 1)).cast("int").alias("back"),
        F.when(drawn(1) % 101 < 35, (drawn(2) % 101).cast("int")).alias("repair"), fails.alias("fails"),
    )


class Simulation:
    """The turns of a conversation, or of a part of it that depends on nothing before; ``first`` is the place of its first turn."""

    def __init__(self, back: list[int], repair: list[int | None], fails: list[int], first: int = 0):
        n = len(back)
        self.back, self.repair, self.fails, self.first = back, repair, fails, first
        self.status: list[int | None] = [None] * n
        self.attempts, self.first_at, self.last_at = [0] * n, [None] * n, [None] * n
        self.waiting: dict[int, list[int]] = {}  # by the parent in quarantine
        self.released: list[int] = []
        self.queue = [((first + i) * SPACING, i, 0) for i in range(n)]  # seconds, turn, attempt (0: arrival); sorted, hence a heap

    def run(self) -> Simulation:
        while self.queue:
            now, i, attempt = heappop(self.queue)
            if attempt:
                self.tried(now, i, attempt)
            else:
                self.arrived(now, i)
        return self

    def arrived(self, now: int, i: int) -> None:
        parent = i - self.back[i] if self.back[i] and self.back[i] <= self.first + i else None
        if parent is None or self.status[parent] == 0:
            heappush(self.queue, (now, i, 1))
        elif self.status[parent] is None:
            self.waiting.setdefault(parent, []).append(i)
        else:
            self.given_up(i, 2)

    def tried(self, now: int, i: int, attempt: int) -> None:
        self.attempts[i], self.last_at[i] = attempt, now
        if attempt == 1:
            self.first_at[i] = now
        repair = self.repair[i]
        if repair is not None and (now < (self.first + i) * SPACING + repair or self.fails[i] >> (attempt - 1) & 1):
            if attempt == ATTEMPTS:
                self.given_up(i, 1)
            else:
                heappush(self.queue, (now + WAIT * 2 ** (attempt - 1), i, attempt + 1))
            return
        self.status[i] = 0
        self.released.append(i)
        for child in self.waiting.pop(i, ()):
            heappush(self.queue, (now, child, 1))

    def given_up(self, i: int, status: int) -> None:
        """The turn is dead (1) or blocked (2), and what waits for it is blocked, on and on."""
        todo = [(i, status)]
        while todo:
            k, s = todo.pop()
            self.status[k] = s
            todo += [(child, 2) for child in self.waiting.pop(k, ())]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns of each run of rows equal in the first ``keys`` columns, from sorted batches; a run may span batches."""
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        marks = list(zip(*columns[:keys], strict=True))
        start = 0
        for i, mark in enumerate(marks):
            before = marks[i - 1] if i else (tuple(c[-1] for c in held[:keys]) if held else mark)
            if mark != before:
                part = [c[start:i] for c in columns]
                yield [a + b for a, b in zip(held, part, strict=True)] if held else part
                held, start = [], i
        rest = [c[start:] for c in columns]
        held = [a + b for a, b in zip(held, rest, strict=True)] if held else rest
    if held and held[0]:
        yield held


def wrapped(x: int) -> int:
    """As a signed 64-bit number."""
    return (x + WORD // 2) % WORD - WORD // 2


def simulated(turns: DataFrame, by_part: bool) -> DataFrame:
    """All columns of turns, and what came of each; ``release_no`` and ``state`` count within the conversation, or within the part of it."""
    keys = ["conv_id", "part"] if by_part else ["conv_id"]
    inner = ["conv_id", *(["part", "p"] if by_part else []), "turn", "crc", "back", "repair", "fails"]
    laid = turns.select(*inner).repartition(parallelism(turns.sparkSession), *keys).sortWithinPartitions(*keys, *(["p"] if by_part else ["turn", "crc"]))
    carried = [f for f in laid.schema.fields if f.name in ("conv_id", "p", "turn", "crc")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*carried, *StructType.fromDDL("status string, attempts int, first_at long, last_at long, release_no long, state long").fields])
    arrow, at = to_arrow_schema(schema), {c: i for i, c in enumerate(inner)}

    def run(batches):
        out: list[list] = [[] for _ in arrow]
        for columns in runs(batches, len(keys)):
            s = Simulation(*(columns[at[c]] for c in ("back", "repair", "fails")), first=columns[at["p"]][0] if by_part else 0).run()
            number, state, total = [None] * len(s.back), [None] * len(s.back), 0
            for k, i in enumerate(s.released, 1):
                total += k * columns[at["crc"]][i]
                number[i], state[i] = k, wrapped(total)
            for to, some in zip(out, [*(columns[at[f.name]] for f in carried), [NAMES[x] for x in s.status], s.attempts, s.first_at, s.last_at, number, state], strict=True):
                to += some
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
                out = [[] for _ in arrow]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return laid.mapInArrow(run, schema)


RESULT = ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]


def replay_split(turns: DataFrame, scratch: Scratch, split_turns: int) -> DataFrame:
    """What ``replay`` gives, of conversations of any length: numbered, cut, simulated in parts and put in one order over many tasks."""
    placed = scratch.save(numbered(turns, ["turn", "crc"], ["conv_id"], "p").withColumn("p", F.col("p") - 1), "placed")
    # a turn with its parent `back` turns before it forbids the cuts before itself and before those in between
    held = placed.where("back > 0 and back <= p").select(F.col("conv_id").alias("c"), F.explode(F.expr("sequence(p - back + 1, p)")).alias("q")).distinct()
    marked = placed.join(held.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p") == F.col("q")), "left")
    cut = marked.select(*placed.columns, F.when(F.col("q").isNull(), F.col("p")).alias("cut"))
    parts = accumulated(cut, ["p"], ["conv_id"], tops={"start": F.col("cut")}).withColumn("part", F.expr(f"start div {split_turns}"))
    found = scratch.save(simulated(parts, True), "found")
    gone = found.where("status <> 'delivered'").select(*RESULT)
    sent = numbered(found.where("status = 'delivered'").drop("release_no", "state"), ["last_at", "p"], ["conv_id"], "release_no")
    worth = F.col("release_no").cast("decimal(38,0)") * F.col("crc").cast("decimal(18,0)")
    sent = accumulated(sent, ["release_no"], ["conv_id"], sums={"state": worth.cast("decimal(38,0)")})
    half = f"cast({WORD // 2} as decimal(38,0))"
    return sent.withColumn("state", F.expr(f"cast((state + {half}) % cast({WORD} as decimal(38,0)) - {half} as bigint)")).select(*RESULT).unionByName(gone)


def replay(turns: DataFrame, split_turns: int = 4096) -> DataFrame:
    """``conv_id, turn, status, attempts, first_at, last_at, release_no, state`` of each row of ``conv_id, turn, text``.

    Rows are numbered from 0 in each conversation by turn, equal turns by the checksum of their texts; repeated rows count as turns of their own.
    Rows without a conv_id are one conversation, null turns come first. Null texts count as empty; of long ones only the checksum travels.
    An empty table gives no rows, other columns are ignored. ``state`` wraps around at 64 bits.
    """
    scratch = Scratch(turns.sparkSession, "release")
    ready = prepared(turns)
    sizes = ready.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_turns).select(F.col("conv_id").alias("c"))
    long = scratch.save(sizes, "long")
    if long.isEmpty():
        return simulated(ready, False).select(*RESULT)
    # salted, so that the turns of a long conversation meet its mark in many tasks
    salt = F.pmod(F.xxhash64("turn", "crc"), F.lit(64))
    marks = long.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(63))))
    told = ready.withColumn("salt", salt).join(marks.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("salt") == F.col("s")), "left")
    told = scratch.save(told.select(*ready.columns, F.col("s").isNotNull().alias("long")), "told")
    return simulated(told.where(~F.col("long")), False).select(*RESULT).unionByName(replay_split(told.where("long").drop("long"), scratch, split_turns))


def crc_sql(text: str) -> str:
    """DuckDB's SQL for crc32 of a text's UTF-8 bytes; the table ``crc(t)`` holds the remainders of all bytes."""
    codes = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"
_H = ", ".join(crc_sql(f"('{k}:' || conv_id || ':' || turn)") + f" AS h{k}" for k in range(8))

SQL = f"""WITH RECURSIVE {CRC_TABLE},
a AS MATERIALIZED (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, {crc_sql("coalesce(text, '')")} AS w, {_H} FROM conversations, crc),
b AS MATERIALIZED (SELECT conv_id, turn, p, w, CASE WHEN h0 % 3 <= p THEN h0 % 3 ELSE 0 END AS back, h1 % 101 < 35 AS faulty, 7 * p + h2 % 101 AS mended, [h3, h4, h5, h6, h7] AS h FROM a),
s AS (
  SELECT conv_id, -1::BIGINT AS p, NULL::BIGINT AS turn, NULL::BIGINT AS w, NULL::BIGINT AS start, NULL::BIGINT AS k, false AS blocked, NULL::BIGINT AS sent, NULL::BIGINT AS sent1 FROM b GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, turn, w, start, k, blocked, CASE WHEN k IS NOT NULL THEN start + 10 * (2 ** (k - 1) - 1)::BIGINT END, sent1 FROM (
    SELECT *, CASE WHEN NOT blocked THEN list_min(list_filter([1, 2, 3, 4, 5], lambda i: NOT faulty OR (start + 10 * (2 ** (i - 1) - 1)::BIGINT >= mended AND h[i] % 3 <> 0))) END::BIGINT AS k FROM (
      SELECT b.*, s.sent AS sent1, b.back > 0 AND (CASE b.back WHEN 1 THEN s.sent ELSE s.sent1 END) IS NULL AS blocked,
        greatest(7 * b.p, coalesce(CASE b.back WHEN 1 THEN s.sent WHEN 2 THEN s.sent1 END, 0)) AS start
      FROM s JOIN b ON b.conv_id = s.conv_id AND b.p = s.p + 1))),
e AS (SELECT conv_id, turn, p, w, CASE WHEN blocked THEN 'blocked' WHEN k IS NULL THEN 'dead' ELSE 'delivered' END AS status,
    CASE WHEN blocked THEN 0 ELSE coalesce(k, 5) END::INT AS attempts, CASE WHEN NOT blocked THEN start END AS first_at,
    CASE WHEN NOT blocked THEN start + 10 * (2 ** (coalesce(k, 5) - 1) - 1)::BIGINT END AS last_at FROM s WHERE p >= 0),
r AS (SELECT *, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, p) END AS release_no FROM e)
SELECT conv_id, turn, status, attempts, first_at, last_at, release_no,
  CASE WHEN status = 'delivered' THEN CAST(sum(release_no * w) OVER (PARTITION BY conv_id, status ORDER BY release_no) AS BIGINT) END AS state FROM r"""
