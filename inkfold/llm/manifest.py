"""A Merkle manifest of a dataset: a leaf for each row, a tree for each language, a tree over their roots, and a proof for every row.

Leaves are dealt into aligned buckets of 8 ** BUCKET_LEVELS consecutive leaves of a language, so that every bucket is a whole subtree. A task
streams its buckets as Arrow tables through DuckDB, whose ordered ``string_agg`` and ``sha256`` climb the levels inside them. Spark does what lies
above: it combines the buckets' roots run by run, and hands the siblings of the upper levels down again to the buckets, where DuckDB
folds every leaf's path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import Scratch, flat, parallelism
from .release import CRC_TABLE, crc_sql

FAN, BUCKET_LEVELS, HEX = 8, 3, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: str | None = None) -> Column:
    """The hash of a row; ``text`` may stand for another column than ``text``."""

    def field(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(text if text and c == "text" else c) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``k`` (language; sorts null first, then bytewise), ``doc_id, leaf``, and ``changed``: the leaf after tampering, where there is any."""
    d = flat(docs, *FIELDS).withColumn("lowered", F.translate("text", UPPER, LOWER))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return d.select(F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("k"), "doc_id", hashed().alias("leaf"), F.when(tampered, hashed("lowered")).alias("changed"))


# --- inside a bucket: DuckDB ------------------------------------------------------------------------------------------
def levels_sql(n: int) -> str:
    """Tables ``r1 .. rn`` (k, bucket, i, one, run) and ``n0 .. nn`` (k, bucket, i, h). The only node of a tree stays as it is."""
    out = ["n0 AS (SELECT k, bucket, pos % bucket_size AS i, leaf AS h FROM leaves)"]
    for level in range(1, n + 1):
        out.append(f"r{level} AS (SELECT k, bucket, i // {FAN} AS i, bucket = 0 AND i // {FAN} = 0 AND count(*) = 1 AS one, string_agg(h, '' ORDER BY i) AS run FROM n{level - 1} GROUP BY k, bucket, i // {FAN})")
        out.append(f"n{level} AS (SELECT k, bucket, i, CASE WHEN one THEN run ELSE sha256(run) END AS h FROM r{level})")
    return ", ".join(out).replace("bucket_size", str(FAN**n))


def roots_sql(n: int = BUCKET_LEVELS) -> str:
    return f"WITH {levels_sql(n)} SELECT k, bucket, h FROM n{n}"


def folds_sql(outer: int, n: int = BUCKET_LEVELS) -> str:
    """Of each leaf: its proof, and its own or changed hash folded along its path, first in the bucket, then with the ``outer`` levels of the bucket's head."""
    steps = [f"WITH {levels_sql(n)}, f0 AS (SELECT l.k, l.bucket, l.doc_id, l.leaf, l.pos % {FAN**n} AS i, coalesce(l.changed, l.leaf) AS f, '' AS p, h.lefts, h.rights, h.subroot FROM leaves l LEFT JOIN heads h ON l.k = h.k AND l.bucket = h.bucket)"]
    for level in range(1, n + 1):
        at = f"(f.i // {FAN ** (level - 1)}) % {FAN} * {HEX}"
        left, right = f"r.run[1 : {at}]", f"r.run[{at} + {HEX + 1} :]"
        steps.append(f"f{level} AS (SELECT f.* REPLACE (CASE WHEN r.one THEN f.f ELSE sha256({left} || f.f || {right}) END AS f, CASE WHEN r.one THEN f.p ELSE f.p || {left} || {right} END AS p) FROM f{level - 1} f JOIN r{level} r ON f.k = r.k AND f.bucket = r.bucket AND f.i // {FAN**level} = r.i)")
    last = n
    for j in range(1, outer + 1):
        has = f"len(lefts) >= {j}"
        steps.append(f"f{last + 1} AS (SELECT * REPLACE (CASE WHEN {has} THEN sha256(lefts[{j}] || f || rights[{j}]) ELSE f END AS f, CASE WHEN {has} THEN p || lefts[{j}] || rights[{j}] ELSE p END AS p) FROM f{last})")
        last += 1
    return ", ".join(steps) + f" SELECT doc_id, leaf, subroot, sha256(p) AS proof_sha256, f AS folded_root FROM f{last}"


def engine():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


def whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = 16_384) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches sorted by k and bucket; the last bucket seen waits for more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.slice(t.num_rows - 1)
        open_ = pc.and_(pc.equal(t["k"], last["k"][0]), pc.equal(t["bucket"], last["bucket"][0]))
        start = pc.index(open_, True).as_py()
        if start:
            yield t.slice(0, start)
        held, n = t.slice(start).to_batches(), t.num_rows - start
    if n:
        yield pa.Table.from_batches(held)


def bucket_roots(placed: DataFrame) -> DataFrame:
    """``k, i, h``: the root of each bucket."""
    query = roots_sql()
    schema = pa.schema([("k", pa.string()), ("i", pa.int64()), ("h", pa.string())])

    def run(batches):
        con = engine()
        for leaves in whole_buckets(batches):  # noqa: B007 - DuckDB reads it by name
            con.register("leaves", leaves)
            yield from con.sql(query).to_arrow_table().rename_columns(["k", "i", "h"]).cast(schema).to_batches()

    return dealt(placed.select("k", "bucket", "pos", "leaf")).mapInArrow(run, "k string, i long, h string")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(parallelism(rows.sparkSession), "k", "bucket").sortWithinPartitions("k", "bucket", "pos")


# --- above the buckets: Spark -----------------------------------------------------------------------------------------
def grown(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs ``k, i, nodes`` of each level above ``k, i, h``, and what remains of each k."""
    levels = []
    while not nodes.where("i > 0").isEmpty():
        runs = nodes.groupBy("k", F.expr(f"i div {FAN}").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("nodes"))  # a run holds 8 nodes at most
        levels.append(scratch.save(runs, f"{name}-{len(levels)}"))
        joint = F.when((F.col("i") == 0) & (F.size("nodes") == 1), F.get("nodes.h", F.lit(0))).otherwise(F.sha2(F.array_join("nodes.h", ""), 256))
        nodes = levels[-1].select("k", "i", joint.alias("h"))
    return levels, nodes.select("k", "h")


def handed_down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """``k, i, lefts, rights`` for the nodes below ``levels``: the siblings on their way up, nearest first, before those of ``top`` (``k, lefts, rights``)."""
    found = top.withColumn("i", F.lit(0).cast("long"))
    for runs in reversed(levels):
        above = found.select("k", "i", "lefts", "rights")
        each = runs.join(above, ["k", "i"]).select("*", F.expr("posexplode(nodes)"))
        alone = (F.col("i") == 0) & (F.size("nodes") == 1)
        side = lambda part, rest: F.when(alone, F.col(rest)).otherwise(F.concat(F.array(F.array_join(part, "")), rest))  # noqa: B023, E731
        found = each.select("k", F.col("col.i").alias("i"), side(F.expr("slice(nodes.h, 1, pos)"), "lefts").alias("lefts"), side(F.expr("slice(nodes.h, pos + 2, 8)"), "rights").alias("rights"))
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    Nulls hash as ``-``, empty texts as ``0:``; rows without a language form a tree of their own, rows without a doc_id come first in theirs
    and are not tampered with. Rows of one doc_id stand by their hashes, equal rows in a row. Long texts are hashed whole and travel no further. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    all_ = scratch.save(leaves(docs), "leaves")
    size = FAN**BUCKET_LEVELS
    placed = numbered(all_, ["doc_id", "leaf"], ["k"], "pos").withColumn("pos", F.col("pos") - 1)
    placed = scratch.save(placed.withColumn("bucket", F.expr(f"pos div {size}")), "placed")
    nodes = scratch.save(bucket_roots(placed), "roots")
    levels, subroots = grown(nodes, scratch, "level")
    subroots = scratch.save(subroots, "subroots")
    ranked = scratch.save(numbered(subroots, ["k"], None, "i").select(F.lit("").alias("k"), F.col("i") - 1, "h", F.col("k").alias("of")).toDF("k", "i", "h", "of"), "ranked")
    upper, top = grown(ranked.drop("of"), scratch, "upper")
    found = top.take(1)
    root = found[0].h if found else ""
    none = F.expr("cast(array() as array<string>)")
    outer = handed_down(upper, spark.range(1).select(F.lit("").alias("k"), none.alias("lefts"), none.alias("rights")))
    outer = outer.join(ranked.select("i", "of"), "i").select(F.col("of").alias("k"), "lefts", "rights")
    heads = scratch.save(handed_down(levels, outer).join(subroots.withColumnRenamed("h", "subroot"), "k"), "heads")
    return folded(placed, heads, len(upper) + len(levels), root)


def folded(placed: DataFrame, heads: DataFrame, outer: int, root: str) -> DataFrame:
    """The leaves of each bucket behind the bucket's head (``lefts, rights, subroot``), folded."""
    query = folds_sql(outer)
    lists = "cast(null as array<string>)"
    head = heads.selectExpr("k", "i as bucket", "-1L as pos", "cast(null as bigint) as doc_id", "cast(null as string) as leaf", "cast(null as string) as changed", "lefts", "rights", "subroot")
    body = placed.selectExpr("k", "bucket", "pos", "doc_id", "leaf", "changed", f"{lists} as lefts", f"{lists} as rights", "cast(null as string) as subroot")
    key = placed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        con = engine()
        for t in whole_buckets(batches):
            at_head = pc.less(t["pos"], 0)
            con.register("heads", t.filter(at_head).select(["k", "bucket", "lefts", "rights", "subroot"]))
            con.register("leaves", t.filter(pc.invert(at_head)).select(["k", "bucket", "pos", "doc_id", "leaf", "changed"]))
            yield from con.sql(query).to_arrow_table().to_batches()

    out = dealt(body.unionByName(head)).mapInArrow(run, f"doc_id {key}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _tree(name: str, key: str, table: str, n: int) -> str:
    """DuckDB's tables of a whole tree above ``table`` (key, i, h)."""
    out = [f"{name}0 AS (SELECT {key}, i, h FROM {table})"]
    for level in range(1, n + 1):
        out.append(f"{name}r{level} AS (SELECT {key}, i // {FAN} AS i, i // {FAN} = 0 AND count(*) = 1 AS one, string_agg(h, '' ORDER BY i) AS run FROM {name}{level - 1} GROUP BY ALL)".replace("GROUP BY ALL", f"GROUP BY {key}, i // {FAN}"))
        out.append(f"{name}{level} AS (SELECT {key}, i, CASE WHEN one THEN run ELSE sha256(run) END AS h FROM {name}r{level})")
    return ", ".join(out)


def _folds(first: str, runs: str, key: str, at: str, name: str, n: int) -> str:
    """DuckDB's tables that fold f and gather p, level by level, from the table ``first``."""
    out, last = [], first
    for level in range(1, n + 1):
        o = f"(x.{at} // {FAN ** (level - 1)}) % {FAN} * {HEX}"
        left, right = f"r.run[1 : {o}]", f"r.run[{o} + {HEX + 1} :]"
        out.append(f"{name}{level} AS (SELECT x.* REPLACE (CASE WHEN r.one THEN x.f ELSE sha256({left} || x.f || {right}) END AS f, CASE WHEN r.one THEN x.p ELSE x.p || {left} || {right} END AS p) FROM {last} x JOIN {runs}r{level} r ON x.{key} = r.{key} AND x.{at} // {FAN**level} = r.i)")
        last = f"{name}{level}"
    return ", ".join(out)


SQL = f"""WITH {CRC_TABLE},
d AS (SELECT coalesce('1' || lang, '0') AS k, doc_id, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
  {crc_sql("doc_id::VARCHAR")} % 3 = 0 AS hit, sha256({" || ".join(map(_field, FIELDS[:-1]))} || {_field(f"translate(text, '{UPPER}', '{LOWER}')")}) AS changed FROM documents, crc),
a AS MATERIALIZED (SELECT k, doc_id, leaf, CASE WHEN hit THEN changed END AS changed, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
l AS (SELECT k, i, leaf AS h FROM a),
{_tree("t", "k", "l", 7)},
s AS MATERIALIZED (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS j FROM t7),
u AS (SELECT 0 AS z, j AS i, h FROM s),
{_tree("v", "z", "u", 4)},
f AS (SELECT a.k, a.i, a.doc_id, a.leaf, coalesce(a.changed, a.leaf) AS f, '' AS p FROM a),
{_folds("f", "t", "k", "i", "g", 7)},
m AS (SELECT g7.*, s.j, s.h AS subroot, 0 AS z FROM g7 JOIN s ON g7.k = s.k),
{_folds("m", "v", "z", "j", "w", 4)}
SELECT doc_id, leaf, subroot, (SELECT h FROM v4) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM v4) AS verified FROM w4"""
