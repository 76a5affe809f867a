"""Specifications, geometry, features, areas, shifts and lifecycles in DataFrame form, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import blobs, files, geometry, grade, lifecycle, matching, measure, report, specs
from inkfold.plans import spec


def test_expanded_ranges(spark):
    rows = ["q1..3", "q7...9", "Roll", "", "a.b", "q1..2x"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in rows], "t string").select(specs.expanded("t").alias("e")).collect()]
    assert got == [["q1", "q2", "q3"], ["q7", "q8", "q9"], ["Roll"], [""], ["a.b"], ["q1..2x"]]
    with pytest.raises(Exception, match="Invalid range in fields string: 'q5..5', start: 5 is not less than end: 5"):
        spark.createDataFrame([("q5..5",)], "t string").select(specs.expanded("t")).collect()


def test_grid_as_the_compiler_does(spark):
    gaps = [(41.1, 52.25, "horizontal"), (0.1, 0.7, "vertical"), (2.5, 0.5, "horizontal"), (33.3, 1 / 3, "vertical")]
    for k, (bubbles, labels, direction) in enumerate(gaps):
        block = {"bubbleValues": list("ABCDEF"), "direction": direction, "origin": [3, 5], "fieldLabels": ["q1..7"], "bubblesGap": bubbles, "labelsGap": labels}
        t = spec.Template({"pageDimensions": [2000, 2000], "bubbleDimensions": [5, 7], "fieldBlocks": {"b": block}})
        df = spark.createDataFrame([([f"q{i}" for i in range(1, 8)], list("ABCDEF"), direction, 3.0, 5.0, bubbles, labels)], "labels array<string>, values array<string>, direction string, x0 double, y0 double, bubbles_gap double, labels_gap double")
        got = {(r.label, r.value): (r.x, r.y) for r in specs.grid(df).collect()}
        assert got == {(b[1], b[4]): (b[5], b[6]) for b in t.bubbles}, k


def test_corners_and_canvas(spark):
    rng = np.random.default_rng(4)
    reference = np.array([[0.0, 0], [600, 0], [0, 800], [600, 800]])
    rows, want = [], {}
    for k in range(12):
        a, b = rng.normal(size=(2, 2)), rng.normal(size=2) * 50
        at = reference @ a + b
        gone = [k % 4] if k < 8 else [0, 1] if k < 10 else []
        x, y = ([None if i in gone else float(at[i, j]) for i in range(4)] for j in (0, 1))
        rows.append((k, x, y, reference[:, 0].tolist(), reference[:, 1].tolist(), "clash"))
        want[k] = at, len(gone) < 2
    df = spark.createDataFrame(rows, "sheet int, x array<double>, y array<double>, rx array<double>, ry array<double>, k string")
    for r in geometry.completed_corners(df).collect():
        at, complete = want[r.sheet]
        assert r.complete == complete and (not complete or np.allclose(np.array([r.x, r.y]).T, at))
    flat = spark.createDataFrame([(1, [0.0, 1.0, None, 3.0], [0.0, 1.0, None, 3.0], [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0, 3.0])], "sheet int, x array<double>, y array<double>, rx array<double>, ry array<double>")
    assert not geometry.completed_corners(flat).first().complete
    source, target = [(10, 20), (610, 25), (600, 820), (5, 790)], [(0, 0), (100, 10), (90, 120), (-5, 100)]
    a = np.array([[*row] for (x, y), (u, v) in zip(source, target, strict=True) for row in ((x, y, 1, 0, 0, 0, -u * x, -u * y), (0, 0, 0, x, y, 1, -v * x, -v * y))])
    h = np.append(np.linalg.solve(a, np.array(target, float).ravel()), 1).reshape(3, 3)
    points = [(float(x), float(y)) for x, y in rng.uniform(-50, 900, (20, 2))] + [tuple(map(float, p)) for p in source]
    quad = lambda q: F.expr("array(" + ", ".join(f"named_struct('x', {x}d, 'y', {y}d)" for x, y in q) + ")")
    df = spark.createDataFrame(points, "x double, y double").withColumn("s", quad(source)).withColumn("t", quad(target))
    for r in geometry.canvas_map(df, "s", "t").collect():
        u = h @ [r.x, r.y, 1]
        assert np.allclose([r.mx, r.my], u[:2] / u[2])


def test_rectangles_of_dense_and_sparse_pages(spark):
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (23, 31))
    px = spark.createDataFrame([("s", x, y, int(page[y, x])) for y in range(23) for x in range(31)], "sheet string, x int, y int, px int")
    boxes = [(i, int(x), int(y), int(w), int(h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(-3, 30, 40), rng.integers(-3, 22, 40), rng.integers(1, 20, 40), rng.integers(1, 15, 40), strict=True))]
    re = spark.createDataFrame([("s", *b) for b in boxes] + [("s", 99, 500, 500, 5, 5)], "sheet string, id int, x int, y int, w int, h int")
    want = {i: page[max(y, 0) : y + h, max(x, 0) : x + w].mean() for i, x, y, w, h in boxes if x + w > 0 and y + h > 0}
    for got in ({r.id: r.m for r in measure.rectangle_means(px, re).collect()}, {r.id: r.m for r in measure.sparse_rectangle_means(px, re, tile=7).collect()}):
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = measure.rectangle_means(px, re)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_features_against_brute_force(spark):
    rng = random.Random(8)
    ref = [(i, [rng.getrandbits(32) for _ in range(4)]) for i in range(120)]
    found = []
    for i in range(300):
        d = list(ref[i % 120][1])
        for b in rng.sample(range(128), rng.randrange(0, 20)):
            d[b // 32] ^= 1 << b % 32
        found.append(("s", i, d))
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    want = {i: min((far(d, e), r) for r, e in ref) for _, i, d in found}
    got = {r.feature: (r.dist, r.ref) for r in matching.nearest_features(spark.createDataFrame(found, "sheet string, feature int, d array<bigint>"), spark.createDataFrame(ref, "ref int, d array<bigint>")).collect()}
    assert got == {i: m for i, m in want.items() if m[0] < 16} and len(got) > 150


@pytest.mark.parametrize("diagonal", [True, False])
def test_areas_against_a_flood(spark, diagonal):
    rng = np.random.default_rng(2)
    pages = {"noise": rng.random((25, 30)) < 0.45, "snake": np.zeros((21, 30), bool), "dark": np.zeros((3, 3), bool)}
    pages["snake"][::2] = True
    pages["snake"][1::4, -1] = pages["snake"][3::4, 0] = True
    px = spark.createDataFrame([(s, x, y, 255 if p[y, x] else 0) for s, p in pages.items() for y in range(p.shape[0]) for x in range(p.shape[1])], "sheet string, x int, y int, px int")
    got = {(r.sheet, r.blob.y, r.blob.x0): (r.area, r.x0, r.y0, r.x1, r.y1, r.corners[0].x + r.corners[0].y, r.corners[2].x + r.corners[2].y) for r in blobs.blobs(px, 200, diagonal).collect()}
    want = {}
    for s, p in pages.items():
        left = {(y, x) for y, x in zip(*np.nonzero(p), strict=True)}
        while left:
            todo, seen = [min(left)], {min(left)}
            while todo:
                y, x = todo.pop()
                for dy, dx in [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else []):
                    if (n := (y + dy, x + dx)) in left and n not in seen:
                        seen.add(n)
                        todo.append(n)
            left -= seen
            ys, xs = [y for y, _ in seen], [x for _, x in seen]
            want[s, *map(int, min(seen))] = (len(seen), min(xs), min(ys), max(xs), max(ys), min(y + x for y, x in seen), max(y + x for y, x in seen))
    assert got == want


def test_shifted_sheets_are_read_right(spark):
    blocks, off = [("b", 20, 5, 30, 20), ("c", 70, 8, 25, 16)], {"s0": 0, "s1": 4, "s2": -3}
    px, edges, bubbles = [], [], []
    for s, k in off.items():
        page, edge = np.full((40, 120), 230), np.zeros((40, 120), int)
        for _, x, y, w, h in blocks:
            edge[y : y + h, x + k + 2 : x + k + 10] = edge[y : y + h, x + k + w - 10 : x + k + w - 2] = 255
            page[y + 4 : y + 10, x + k + 6 : x + k + 12] = 20
        for to, p in ((px, page), (edges, edge)):
            to += [(s, x, y, int(p[y, x])) for y in range(40) for x in range(120)]
        bubbles += [(s, b, n, x + 7 + n * 9, y + 4, 4, 6) for b, x, y, w, h in blocks for n in (0, 1)]
    kinds = "sheet string, x int, y int, px int"
    px, edges = spark.createDataFrame(px, kinds), spark.createDataFrame(edges, kinds)
    where = spark.createDataFrame([(s, *b) for s in off for b in blocks], "sheet string, block string, x int, y int, w int, h int")
    found = blobs.shifts(edges, where, match_col=5, max_steps=20, stride=1, thickness=3)
    assert {(r.sheet, r.block): abs(r.shift - off[r.sheet]) <= 2 for r in found.collect()} == {(s, b[0]): True for s in off for b in blocks}
    rects = spark.createDataFrame(bubbles, "sheet string, block string, n int, x int, y int, w int, h int").withColumn("id", F.concat("block", "n"))
    means = lambda r: {(m.sheet, m.id): m.m for m in measure.rectangle_means(px, r).collect()}
    right, wrong = means(blobs.shifted(rects, found)), means(rects)
    assert all(right[s, f"{b}0"] < 120 < right[s, f"{b}1"] for s in off for b in "bc")
    assert wrong["s1", "b0"] > min(right["s1", "b0"], 120)


def test_lifecycles(spark):
    rng = random.Random(6)
    names = [*lifecycle.STATUSES, "nonsense"]
    rows = [(b, i, rng.choice(names), rng.choice([None, None, f"e{i}"])) for b in ("a", "b", "c") for i in range(400 if b == "a" else 30)]
    want = {}
    for b in "abc":
        state, error, rejected = "created", None, 0
        for _, _, to, e in sorted(r for r in rows if r[0] == b):
            if to not in lifecycle.NEXT[state]:
                rejected += 1
                continue
            state = to
            if e is not None or to == "failed":
                error = e
            elif to in lifecycle.CLEARING:
                error = None
        want[b] = state, error, rejected
    df = spark.createDataFrame(rows, "batch string, i int, status string, error string").repartition(4)
    assert {r.batch: (r.status, r.last_error, r.rejected) for r in lifecycle.folded(df, "batch", ["i"]).collect()} == want
    turns = spark.createDataFrame([("a", 1, 90), ("a", 2, 45), ("a", 3, 180), ("a", 4, None), ("b", 1, 7)], "batch string, t int, d int")
    assert {r.batch: (r.rotation, r.refused) for r in lifecycle.rotations(turns, "batch", "t", "d").collect()} == {"a": (180, 2), "b": (0, 1)}
    ways = spark.createDataFrame([("a", "upload"), ("a", "upload"), ("b", "upload"), ("b", "directory"), ("c", None)], "batch string, m string")
    assert {r.batch: r.source_mode for r in lifecycle.source_modes(ways, "batch", "m").collect()} == {"a": "upload", "b": "mixed", "c": None}


def test_free_suffixes_and_merging(spark):
    names = ["a.png", "a.png", "a_1.png", "a.png", "a_3.png", "a.png", "b", "b", "b_2", "b", "a_1.png", "c_01.png", "c.png", "c.png"]
    got = {r.i: r.unique_name for r in files.deduplicated(spark.createDataFrame(list(enumerate(names)), "i int, name string"), "name", "i").collect()}
    assert len(set(got.values())) == len(names) and [got[i] for i in (0, 1, 3, 5, 10, 7, 9, 13)] == ["a.png", "a_2.png", "a_4.png", "a_5.png", "a_1_1.png", "b_1", "b_3", "c_1.png"]
    a = spark.createDataFrame([(3, "x"), (1, "y")], "i int, v string")
    merged = report.merged([a.limit(0).drop("v"), a, spark.createDataFrame([(2, "more")], "i int, w string")], "i").orderBy("idx")
    assert [(r.i, r.v, r.idx) for r in merged.collect()] == [(1, "y", 1), (2, None, 2), (3, "x", 3)] and merged.columns == ["i", "v", "idx"]


def test_missing_and_extra_questions(spark):
    r = spark.createDataFrame([("s", "q1"), ("s", "q9"), ("s", "Q2"), ("t", "Roll")], "sheet string, label string")
    sheets = spark.createDataFrame([("s",), ("t",), ("u",)], "sheet string")
    assert sorted(map(tuple, grade.missing_questions(r, ["q1", "q2"], sheets).collect())) == [("s", "q2"), ("t", "q1"), ("t", "q2"), ("u", "q1"), ("u", "q2")]
    assert list(map(tuple, grade.extra_questions(r, ["q1", "q2"]).collect())) == [("s", "q9")]
