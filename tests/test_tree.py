"""A folder with nested templates, configurations and evaluations, from documents to graded rows."""

import json

import numpy as np
import pytest

from inkfold.plans import spec, tree
from inkfold.sources import scans

SIZE = {"dimensions": {"processing_width": 240, "processing_height": 200}}


def template(values="ABCD", **more):
    block = {"bubbleValues": list(values), "direction": "horizontal", "origin": [20, 20], "fieldLabels": ["q1..3"], "labelsGap": 40, "bubblesGap": 40}
    return {"pageDimensions": [240, 200], "bubbleDimensions": [16, 16], "preProcessors": [], "fieldBlocks": {"B": block}, **more}


def evaluation(correct, *answers):
    return {"source_type": "custom", "options": {"questions_in_order": ["q1..3"], "answers_in_order": list(answers)}, "marking_schemes": {"DEFAULT": {"correct": correct, "incorrect": -1, "unmarked": 0}}}


def test_nested_folders(spark, tmp_path):
    put = lambda folder, kind, document: ((tmp_path / folder).mkdir(parents=True, exist_ok=True), (tmp_path / folder / f"{kind}.json").write_text(json.dumps(document)))
    put(".", "config", SIZE)
    put(".", "template", template())
    put(".", "evaluation", evaluation(2, "A", "B", "C"))
    put("plain", "evaluation", evaluation(5, "A", "B", "C"))
    put("strict", "config", {**SIZE, "outputs": {"filter_out_multimarked_files": True}, "threshold_params": {"MIN_JUMP": 90}})  # routes; the inherited template keeps its own
    put("own/deep", "template", template("WXYZ", outputColumns=["q3", "All"], customLabels={"All": ["q1..2"]}))
    put("own/deep", "config", SIZE | {"threshold_params": {"MIN_JUMP": 100, "MIN_GAP": 100, "PAGE_TYPE_FOR_THRESHOLD": "black"}})
    put("own/deep", "evaluation", {**evaluation(1, "WX", "Y"), "options": {"questions_in_order": ["All", "q3"], "answers_in_order": ["WX", "Y"]}})
    t = spec.Template(template())
    marks = {"q1": "A", "q2": "B", "q3": "AC"}
    for folder in (".", "plain", "strict", "strict/below", "own"):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "s.png").write_bytes(scans.png(scans.drawn(t, marks)))
    deep = spec.Template(template("WXYZ"))
    (tmp_path / "own/deep/dark.png").write_bytes(scans.png(scans.drawn(deep, {"q1": "W", "q2": "X", "q3": "Y"}, ink=30)))
    faint = scans.drawn(deep, {"q1": "W", "q2": "X", "q3": "X"}, ink=150)
    faint[:8, :8] = 0  # something black, so that stretching leaves the marks faint
    for folder in ("own/deep", "own"):
        (tmp_path / folder / "faint.png").write_bytes(scans.png(faint))
    (tmp_path / "plain" / "bad.png").write_bytes(b"no image")
    rows = {r.output_path: r for r in tree.grade_folder(spark, str(tmp_path)).collect()}
    got = {k: (r.template, r.evaluation, r.route, r.score, r.responses) for k, r in rows.items()}
    read = {"q1": "A", "q2": "B", "q3": "MR(AC)"}
    assert got["outputs/./CheckedOMRs/s.png"] == (".", ".", "results", "3.0", read)
    assert got["outputs/./plain/CheckedOMRs/s.png"] == (".", "./plain", "results", "9.0", read)
    assert got["outputs/./plain/Manual/ErrorFiles/bad.png"] == (".", "./plain", "errors", "NA", {})
    assert got["outputs/./strict/Manual/MultiMarkedFiles/s.png"] == (".", ".", "multimarked", "NA", read)
    assert got["outputs/./strict/below/Manual/MultiMarkedFiles/s.png"][2] == "multimarked"
    assert got["outputs/./own/CheckedOMRs/s.png"][:4] == (".", ".", "results", "3.0")
    assert got["outputs/./own/deep/CheckedOMRs/dark.png"] == ("./own/deep", "./own/deep", "results", "2.0", {"All": "WX", "q3": "Y"})
    # the same marks under two configurations: too faint for a jump of 100, clear for one of 25
    assert got["outputs/./own/CheckedOMRs/faint.png"][2:] == ("results", "3.0", {"q1": "A", "q2": "B", "q3": "B"})
    assert got["outputs/./own/deep/CheckedOMRs/faint.png"][4] == {"All": "", "q3": ""}
    assert len(got) == 9


def test_tree_errors(spark):
    with pytest.raises(spec.SpecError):
        tree.SpecTree({"a": {"evaluation": evaluation(1, "A", "B", "C")}})
    with pytest.raises(spec.SpecError):
        spec.checked_config({"alignment_params": {"auto_align": True}})
    some = tree.SpecTree({"a": {"template": template()}})
    sheets = spark.createDataFrame([("s", "b", "s.png")], "sheet string, dir string, file string")
    with pytest.raises(Exception, match="No template file found in the directory tree of b"):
        tree.placed(sheets, some).collect()
    wrong = tree.SpecTree({"a": {"template": template(), "evaluation": {**evaluation(1), "options": {"questions_in_order": ["q9"], "answers_in_order": ["A"]}}}})
    seen = spark.createDataFrame([("s", f"q{q}", o, 40.0 if o == 1 else 220.0) for q in (1, 2, 3) for o in range(4)], "sheet string, strip string, opt int, m double")
    with pytest.raises(Exception, match="Missing questions in the responses: q9"):
        tree.graded_tree(seen, spark.createDataFrame([("s", "a", "s.png")], "sheet string, dir string, file string"), wrong).collect()


def test_nearest_on_the_driver():
    known = {"a": 1, "a/b/c": 2}
    assert [tree.nearest(x, known) for x in ("a/b", "a/b/c/d", "ab", "a/b/cd")] == ["a", "a/b/c", None, "a"]


def test_turned_pages_and_runtime_defaults(spark, tmp_path):
    (tmp_path / "template.json").write_text(json.dumps(template()))
    (tmp_path / "evaluation.json").write_text(json.dumps(evaluation(1, "A", "B", "D")))
    page = scans.drawn(spec.Template(template()), {"q1": "A", "q2": "B", "q3": "C"})
    (tmp_path / "s.png").write_bytes(scans.png(np.ascontiguousarray(np.rot90(page))))  # lies on its left side
    row = tree.grade_folder(spark, str(tmp_path), rotation=90, batch=True).first()
    assert row.responses == {"q1": "A", "q2": "B", "q3": "C"} and row.score == "1.0"
    with pytest.raises(spec.SpecError):
        tree.grade_folder(spark, str(tmp_path), rotation=45)
    given = {"preProcessors": [{"name": "CropOnMarkers", "options": {"markerCorners": [], "markerSearchPadding": 5}}, {"name": "CropOnMarkers"}, {"name": "Levels", "options": {}}]}
    ready = spec.with_runtime_defaults(given)["preProcessors"]
    assert ready[0]["options"] == {"markerCorners": [], "markerSearchPadding": 5, "fallbackToExpandedMarkerCorners": True, "max_matching_variation": 0.5}
    assert ready[1]["options"] == {} and "fallbackToExpandedMarkerCorners" not in given["preProcessors"][0]["options"]
