"""Synthetic sheets from drawing to responses, pixel operations, streaming."""

import numpy as np
import pytest

from inkfold.functions import pixels
from inkfold.operators import decode, measure
from inkfold.plans import engine, spec
from inkfold.sources import results, scans
from inkfold.streaming.scans import grade_stream

TEMPLATE = {
    "pageDimensions": [300, 400], "bubbleDimensions": [25, 25],
    "fieldBlocks": {"B": {"fieldType": "QTYPE_MCQ5", "origin": [65, 60], "fieldLabels": ["q1..5"], "labelsGap": 52, "bubblesGap": 41}},
}


def test_round_trip(spark, tmp_path):
    t, rng, want = spec.Template(TEMPLATE), np.random.default_rng(1), {}
    for i in range(6):
        marks = {f"q{k}": "ABCDE"[rng.integers(5)] for k in range(1, 6) if rng.random() < 0.8}
        page = np.clip(scans.drawn(t, marks).astype(int) + rng.integers(-6, 7, (400, 300)), 0, 255).astype(np.uint8)
        (tmp_path / f"s{i}.PNG").write_bytes(scans.png(page))
        want |= {(f"s{i}.PNG", f"q{k}"): marks.get(f"q{k}", "NR") for k in range(1, 6)}
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "marker.png").write_bytes(scans.png(np.zeros((9, 9), np.uint8)))
    read = scans.read_scans(spark, str(tmp_path), ["marker.png"])
    assert read.count() == 7
    m = scans.measure_scans(read, t)
    assert [r.sheet.rpartition("/")[2] for r in m.where("strip is null").collect()] == ["bad.png"]
    bubbles = m.where("strip is not null").selectExpr("sheet", "strip", "opt + 1 as opt", "m")
    got = {(r.sheet.rpartition("/")[2], r.strip): r.response for r in decode.question_responses(measure.local_thresholds(measure.measured(bubbles))).collect()}
    assert got == want


def test_pixels():
    rng = np.random.default_rng(2)
    page = rng.integers(0, 256, (60, 50)).astype(np.uint8)
    assert np.array_equal(pixels.resize(page, 50, 60), page) and pixels.resize(page, 25).shape == (30, 25)
    assert pixels.normalize(np.full((3, 3), 7, np.uint8)).max() == 7 and pixels.normalize(page[:5] // 2 + 10).max() == 255
    assert np.array_equal(pixels.gamma(page, 1.0), page) and np.array_equal(pixels.levels(page, {}), page)
    assert np.array_equal(pixels.rotated(pixels.rotated(page, 90), 270), page)
    assert pixels.median_blur(np.eye(9, dtype=np.uint8) * 255, {}).max() == 0
    flat = np.full((9, 9), 100, np.uint8)
    assert np.array_equal(pixels.gaussian_blur(flat, {}), flat)
    means = pixels.rectangle_means(page, np.array([3, 45]), np.array([4, 50]), np.array([10, 10]), np.array([8, 20]))
    assert np.allclose(means, [page[4:12, 3:13].mean(), page[50:60, 45:50].mean()])
    corners = np.array([[5.0, 4], [90, 9], [88, 120], [3, 118]])
    h = pixels.homography(corners, corners * 2 + 1)
    assert np.allclose((h @ [90, 9, 1])[:2] / (h @ [90, 9, 1])[2], [181, 19])
    reference = np.array([[50.0, 50], [950, 50], [50, 950], [950, 950]])
    moved = reference @ np.array([[1.01, 0.01], [0.02, 0.99]]) + [8, 12]
    assert np.allclose(pixels.missing_corner(moved[:3], reference[:3], reference[3]), moved[3])


def test_markers():
    marker = np.kron(np.array([[0, 255, 0], [255, 0, 255], [0, 255, 0]], np.uint8), np.ones((6, 6), np.uint8))
    page = np.random.default_rng(42).integers(180, 230, (300, 240)).astype(np.uint8)
    for y, x in ((10, 10), (10, 200), (260, 10), (260, 200)):
        page[y : y + 18, x : x + 18] = marker
    options = {"marker": marker.tolist(), "sheetToMarkerWidthRatio": 240 / 18, "marker_rescale_range": (80, 120), "marker_rescale_steps": 5}
    assert pixels.crop_on_markers(page, options).shape == (250, 190)
    blank = np.random.default_rng(1).integers(180, 230, (300, 240)).astype(np.uint8)
    assert pixels.crop_on_markers(blank, options | {"min_matching_threshold": 0.5}) is None
    assert pixels.match_scores(np.full((40, 40), 200, np.uint8), marker).max() < 0.01
    scan = np.zeros((200, 160), np.uint8)
    scan[20:180, 30:140] = 240
    out = pixels.crop_page(scan, {})
    assert abs(out.shape[0] - 160) < 4 and abs(out.shape[1] - 110) < 4 and pixels.crop_page(np.zeros((50, 50), np.uint8), {}) is None


def test_stream(spark, tmp_path):
    rows = [(1, s, o, 40.0 if o == s else 220.0) for s in range(1, 5) for o in range(1, 5)]
    schema = "sheet long, strip long, opt int, m double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    grade_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.strip: r.response for r in got.collect()} == {1: "A", 2: "B", 3: "C", 4: "D"}


ENGINE = {
    "pageDimensions": [300, 400], "bubbleDimensions": [14, 14], "emptyValue": "NR", "customLabels": {"Roll": ["roll1..3"]},
    "fieldBlocks": {
        "Roll": {"fieldType": "QTYPE_INT", "origin": [10, 10], "fieldLabels": ["roll1..3"], "labelsGap": 30, "bubblesGap": 30, "emptyValue": ""},
        "Right": {"fieldType": "QTYPE_MCQ4_RTL", "origin": [120, 10], "fieldLabels": ["q1..4"], "labelsGap": 30, "bubblesGap": 40},
        "Own": {"bubbleValues": ["yes", "no", "maybe"], "direction": "horizontal", "origin": [120, 200], "fieldLabels": ["Q5", "x6"], "labelsGap": 30, "bubblesGap": 40},
    },
}


def test_template_to_graded_rows(spark, tmp_path):
    t = spec.Template(ENGINE)
    document = {
        "source_type": "custom",
        "options": {"questions_in_order": ["q1..4", "Q5"], "answers_in_order": ["A", "B", ["C", "D"], "D", "maybe"], "should_explain_scoring": True},
        "marking_schemes": {"DEFAULT": {"correct": "3", "incorrect": "-1", "unmarked": "0"}},
    }
    sheets = {
        "a": {"roll1": "9", "roll2": "0", "roll3": "4", "q1": "A", "q2": "B", "q3": "D", "q4": "A", "Q5": ["maybe"], "x6": ["yes", "no"]},
        "b": {"roll1": "17", "roll2": "", "roll3": "8", "q1": "AC", "q2": "", "Q5": ["no"]},
    }
    for name, marks in sheets.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "scan.png").write_bytes(scans.png(scans.drawn(t, marks)))
    (tmp_path / "a" / "bad.png").write_bytes(b"no image")
    config = {"dimensions": {"processing_width": 300, "processing_height": 400}, "outputs": {"filter_out_multimarked_files": True}}
    got = engine.graded(scans.read_scans(spark, str(tmp_path)), t, spec.Evaluation(document, empty="NR"), config)
    assert got.rows.columns == ["file_id", "input_path", "output_path", "route", "score", "Q5", "Roll", "q1", "q2", "q3", "q4", "x6"]
    rows = {"/".join(r.input_path.split("/")[-2:]): r for r in got.rows.collect()}
    a, b, bad = (rows[x] for x in ("a/scan.png", "b/scan.png", "a/bad.png"))
    assert (a.route, a.score, a.Roll, a.q1, a.q2, a.q3, a.q4, a.Q5, a.x6) == ("results", "11.0", "904", "A", "B", "D", "A", "maybe", "yesno")
    assert (b.route, b.score, b.Roll, b.q1, b.q2, b.Q5, b.x6) == ("multimarked", "NA", "178", "MR(AC)", "NR", "no", "NR")
    assert (bad.route, bad.score, bad.Roll, bad.output_path) == ("errors", "NA", "", "outputs/Manual/ErrorFiles/bad.png")
    told = [(r.question, r.verdict, r.delta, r.score) for r in got.explanation.where("sheet like '%a/scan.png'").orderBy("pos").collect()]
    assert told == [("q1", "Correct", "3.0", "3.0"), ("q2", "Correct", "3.0", "6.0"), ("q3", "Correct-D", "3.0", "9.0"), ("q4", "Incorrect", "-1.0", "8.0"), ("Q5", "Correct", "3.0", "11.0")]
    plain = engine.graded(scans.read_scans(spark, str(tmp_path)), t, config={"dimensions": config["dimensions"]}).rows
    assert {r.score for r in plain.where("route = 'results'").collect()} == {"0"} and plain.where("route = 'multimarked'").count() == 0
    for _ in range(2):  # a retried run leaves no doubled row
        results.write_run(got.rows, str(tmp_path / "out"), "one")
        results.write_explanations(got.explanation, str(tmp_path / "told"), "one")
    again = results.read_records(spark, str(tmp_path / "out")).collect()
    assert len(again) == 3 and {r.record["score"] for r in again} == {"11.0", "NA"}
    written = results.read_records(spark, str(tmp_path / "told")).collect()
    assert len(written) == got.explanation.count() and {r.record["verdict"] for r in written} >= {"Correct", "Correct-D", "Incorrect"}


def test_marker_files(spark, tmp_path):
    marker = np.kron(np.array([[0, 255, 0], [255, 0, 255], [0, 255, 0]], np.uint8), np.ones((12, 12), np.uint8))
    (tmp_path / "omr.png").write_bytes(scans.png(marker))
    chain = [{"name": "CropOnMarkers", "options": {"relativePath": "omr.png", "sheetToMarkerWidthRatio": 10}}]
    ready = scans.load_markers(spark, chain, str(tmp_path), 300)[0]["options"]["marker"]
    assert len(ready[0]) == 30 and np.array(ready).max() > 100 and "marker" not in chain[0]["options"]
    with pytest.raises(FileNotFoundError):
        scans.load_markers(spark, [{"name": "CropOnMarkers", "options": {"relativePath": "gone.png"}}], str(tmp_path), 300)
    with pytest.raises(spec.SpecError):
        spec.Template({**TEMPLATE, "preProcessors": [{"name": "Nothing", "options": {}}]})


def test_erosion():
    page = np.full((9, 9), 200, np.uint8)
    page[4, 4] = 10
    assert (pixels.eroded(page, 3, 1) == 10).sum() == 9 and (pixels.eroded(page, 5, 5) == 10).all()


def test_key_from_a_sheet(spark, tmp_path):
    t = spec.Template(ENGINE)
    marked = {"roll1": "1", "roll2": "2", "roll3": "3", "q1": "A", "q2": "B", "q3": "C", "q4": "D", "Q5": ["no"], "x6": ["yes"]}
    for name, marks in {"key": marked, "a": marked | {"q2": "A", "q4": ""}}.items():
        (tmp_path / f"{name}.png").write_bytes(scans.png(scans.drawn(t, marks)))
    document = {"source_type": "csv", "options": {"answer_key_csv_path": "none.csv", "answer_key_image_path": "key.png", "questions_in_order": ["q1..4"]}, "marking_schemes": {"DEFAULT": {"correct": 4, "incorrect": -1, "unmarked": 0}, "X": {"questions": ["q1"], "marking": {"correct": 10, "incorrect": 0, "unmarked": 0}}}}
    config = {"dimensions": {"processing_width": 300, "processing_height": 400}}
    grades = lambda d: {r.file_id: r.score for r in engine.graded(scans.read_scans(spark, str(tmp_path)), t, spec.Evaluation(d, tmp_path, empty="NR"), config).rows.collect()}
    assert grades(document) == {"key.png": "22.0", "a.png": "13.0"}
    free = {**document, "options": {k: v for k, v in document["options"].items() if k != "questions_in_order"}, "marking_schemes": {"DEFAULT": document["marking_schemes"]["DEFAULT"]}}
    assert grades(free) == {"key.png": "28.0", "a.png": "19.0"}  # Q5, Roll, q1 to q4, x6
    (tmp_path / "key.png").write_bytes(scans.png(scans.drawn(t, marked | {"q3": ""})))
    with pytest.raises(Exception, match="Found empty answers in file"):
        grades(document)
    (tmp_path / "key.png").unlink()
    with pytest.raises(spec.SpecError):
        grades(document)
