"""Bins whose size follows the data: what meets in a task does not grow with the input."""

import numpy as np
import pyarrow as pa
import pytest

from inkfold.llm import common, jaccard_join, substring_dedup, suffix_dedup
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def made(df):
    return sorted(map(repr, df.collect()))


def test_bins_follow_the_bytes_and_stay_apart(spark):
    assert [common.bins(spark, n, 10) for n in (None, 0, 25, 1000)] == [3, 3, 3, 100]
    rows = spark.range(400).select((F.col("id") % 40).cast("int").alias("bin"))
    found = common.in_bins(rows, 40).select("bin", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(found) == len({r.p for r in found}) == 40


def test_lists_are_joined_where_they_lie():
    lists = pa.array([[b"a", b"bc"], None, [], [b"", b"d"], [b"e"]], pa.list_(pa.binary()))
    assert [bytes(x) for x in common.joined_parts(lists)] == [b"abc", b"", b"", b"d", b"e"]
    assert [bytes(x) for x in common.joined_parts(lists.slice(3, 1))] == [b"d"]
    assert common.joined_parts(lists.slice(0, 0)) == [] and [bytes(x) for x in common.joined_parts(pa.nulls(1, lists.type))] == [b""]


def test_rows_of_one_anchor_stay_together():
    gram = np.array([1, 1, 1, 2, 3, 3, 4], np.uint64)
    cuts = suffix_dedup.gram_slices(gram, np.full(7, 10), 20)
    assert cuts[0][0] == 0 and cuts[-1][1] == 7 and len(cuts) > 1 and all(a[1] == b[0] and gram[b[0]] != gram[b[0] - 1] for a, b in zip(cuts, cuts[1:], strict=False))


@pytest.mark.parametrize(("module", "run", "more"), [(suffix_dedup, "remove_repeats", {"slice_bytes": 1000}), (substring_dedup, "repeated_passages", {})])
def test_small_bins_find_the_same(spark, module, run, more, monkeypatch):
    docs = common.table(spark, SMALL, "documents")
    want, seen = made(getattr(module, run)(docs)), []
    monkeypatch.setattr(module, "in_bins", lambda rows, n: seen.append(n) or common.in_bins(rows, n))
    assert made(getattr(module, run)(docs, bin_bytes=1 << 14, **more)) == want
    assert seen[0] == -(-common.text_bytes(docs) // (1 << 14)) > 20 and len(seen) == 2


def test_keys_meet_in_bins_of_their_bytes(spark, monkeypatch):
    docs, seen = common.table(spark, SMALL, "documents"), []
    want = jaccard_join.jaccard_join(docs).collect()
    monkeypatch.setattr(jaccard_join, "bins", lambda spark, total, each: seen.append(total) or 37)
    assert sorted(jaccard_join.jaccard_join(docs).collect()) == sorted(want)
    assert seen == [8 * sum(r.n_shingles for r in want)]
