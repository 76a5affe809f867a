"""Specification messages, decoding units, grading goldens and thresholds against a NumPy statement."""

import copy

import numpy as np
import pytest

from inkfold.operators import decode, files, grade, measure, report
from inkfold.plans import spec
from inkfold.sources import roster

LEFT = {"fieldType": "QTYPE_MCQ4", "origin": [40, 30], "fieldLabels": ["a1..4"], "labelsGap": 33, "bubblesGap": 36}
PLAIN = {"pageDimensions": [420, 380], "bubbleDimensions": [18, 22], "fieldBlocks": {"Left": LEFT}}


def changed(**k):
    return copy.deepcopy(PLAIN) | k


def test_template_compiles():
    t = spec.Template(PLAIN)
    assert t.output_columns == ["a1", "a2", "a3", "a4"] and len(t.bubbles) == 16
    assert t.bubbles[6][4:7] == ("C", 112, 63)


# The messages are fixed values; blocks, labels and sizes are this test's own.
@pytest.mark.parametrize(
    "change, message",
    [
        ({"fieldBlocks": {"Left": {**LEFT, "fieldType": "DOTS"}}}, "Provided Template JSON is Invalid: 'template.json'"),
        ({"fieldBlocks": {"Left": {**LEFT, "fieldLabels": ["a1..12"]}}}, "Overflowing field block 'Left' with origin [40, 30] and dimensions [126, 385] in template with dimensions [420, 380]"),
        ({"fieldBlocks": {"Left": {**LEFT, "origin": [-1, 30]}}}, "Overflowing field block 'Left' with origin [-1, 30] and dimensions [126, 121] in template with dimensions [420, 380]"),
        ({"fieldBlocks": {"Left": LEFT, "Right": {**LEFT, "origin": [220, 30], "fieldLabels": ["b1", "a3"]}}}, "The field strings for field block Right overlap with other existing fields"),
        ({"customLabels": {"Sum": ["a1..3", "a3..4"]}}, "Given field string 'a3..4' has overlapping field(s) with other fields in 'Custom Label: Sum': ['a1..3', 'a3..4']"),
        ({"customLabels": {"One": ["a1..3"], "Two": ["a3..4"]}}, "The field strings for custom label 'Two' overlap with other existing custom labels"),
        ({"customLabels": {"Both": ["a1", "z9", "z8"]}}, "Missing field block label(s) in the given template for ['z8', 'z9'] from 'Both'"),
        ({"outputColumns": ["a1..4", "z1"]}, "Some columns are missing in the field blocks for the given output columns"),
    ],
)
def test_template_messages(change, message):
    with pytest.raises(spec.SpecError) as e:
        spec.Template(changed(**change))
    assert str(e.value) == message


def test_template_accepts():
    assert spec.Template(changed(pageDimensions=[167, 152])).labels  # a pixel of room on both sides
    assert spec.Template(changed(outputColumns=["a1..2", "a4"])).uncovered == ["a3"]


def test_ranges_and_numbers():
    assert spec.parse_field_string("q1...3") == ["q1", "q2", "q3"] and spec.parse_field_string("Roll") == ["Roll"]
    with pytest.raises(spec.SpecError):
        spec.parse_field_string("q5..5")
    assert spec.number("-2/3") == -2 / 3 and spec.number("1.5") == 1.5
    assert sorted(["q10", "q2", "Roll"], key=spec.natural_key) == ["Roll", "q2", "q10"]
    with pytest.raises(spec.SpecError):
        spec.checked_config({"threshold_params": {"MIN_JUMP": 5}})


@pytest.mark.parametrize("bad", [["A"], [["A", 1.5]], 3])
def test_answer_types_strict(bad):
    with pytest.raises(spec.SpecError):
        spec.answer_type(bad)


@pytest.mark.parametrize("marks, response, multi", [([], "NR", False), ([(1, 10.0)], "A", False), ([(2, 10.0), (1, 12.0)], "MR(AB)", True), ([(1, 10.0), (2, 40.0)], "A", False)])
def test_decode_units(spark, marks, response, multi):
    rows = [(1, 1, 50.0, [(m, o) for o, m in sorted(marks, key=lambda x: x[1])] or [(200.0, 1)])]
    s = spark.createDataFrame(rows, "sheet long, strip long, thr double, b array<struct<m double, opt int>>")
    r = decode.question_responses(s).first()
    assert (r.response, r.multi) == (response, multi)


# Responses and scores of published example sheets.
SAMPLE4 = {"source_type": "custom", "options": {"questions_in_order": ["q1..11"], "answers_in_order": ["B", "D", "C", "B", "D", "C", ["B", "C", "BC"], "A", "C", "D", "C"]}, "marking_schemes": {"DEFAULT": {"correct": "3", "incorrect": "-1", "unmarked": "0"}}}
WEIGHTED = {"source_type": "custom", "options": {"questions_in_order": ["q1..5"], "answers_in_order": ["C", "E", ["A", "C"], [["B", 2], ["C", "3/2"]], "C"]}, "marking_schemes": {"DEFAULT": {"correct": "3", "incorrect": "-1", "unmarked": "0"}}}
GOLDEN = [
    (SAMPLE4, "B,D,C,B,D,C,MR(BC),A,C,D,C", 29.0),
    (SAMPLE4, "A,,D,C,MR(AC),A,D,B,C,D,D", -2.0),
    (WEIGHTED, "B,E,A,C,B", 5.5),
]


@pytest.mark.parametrize("document, marked, score", GOLDEN)
def test_grading_goldens(spark, document, marked, score):
    e = spec.Evaluation(document)
    r = spark.createDataFrame([(1, f"q{i}", v) for i, v in enumerate(marked.split(","), 1)], "sheet long, label string, response string")
    judged = grade.scored(grade.verdicts(r, e.key_table(spark), empty=""), e.scheme_table(spark))
    assert grade.sheet_scores(judged).first().score == score
    table = grade.explanation(judged).orderBy("pos").collect()
    assert table[-1].score == score
    if score == -2.0:
        assert [(x.verdict, x.delta, x.score) for x in table[:2]] == [("Incorrect", -1.0, -1.0), ("Unmarked", 0.0, -1.0)]


def test_evaluation_errors(tmp_path):
    bad = copy.deepcopy(SAMPLE4)
    bad["options"]["answers_in_order"].pop()
    with pytest.raises(spec.SpecError):
        spec.Evaluation(bad)
    with pytest.raises(spec.SpecError):
        spec.Evaluation(SAMPLE4, filter_multi=True)
    (tmp_path / "key.csv").write_text("q1,C\nq2,\"A,B\"\n")
    e = spec.Evaluation({"source_type": "csv", "options": {"answer_key_csv_path": "key.csv"}, "marking_schemes": SAMPLE4["marking_schemes"]}, tmp_path)
    assert [k[3] for k in e.key] == ["standard", "multiple-correct"]
    e = spec.Evaluation({"source_type": "csv", "options": {"answer_key_csv_path": "none.csv"}, "marking_schemes": SAMPLE4["marking_schemes"]}, tmp_path, {"q2": "B", "q1": "", "q10": "A"})
    assert e.questions == ["q10", "q2"]


def plain_threshold(values, lag, default, least=25):
    q = np.sort(values)
    if len(q) <= lag:
        return default
    j = q[lag:] - q[:-lag]
    at = int(j.argmax())
    return q[at] + j[at] / 2 if j[at] > least else default


def test_thresholds_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for sheet in range(12):
        strips = [np.round(rng.choice([60, 120, 215, 230], size=n) + rng.normal(0, rng.choice([2, 12]), n), 3) for n in rng.integers(1, 9, 7)]
        g = plain_threshold(np.concatenate(strips), 4, 200.0)
        d = plain_threshold(np.array([float(np.floor(np.std(s) * 100 + 0.5) / 100) for s in strips]), 2, 200.0)
        for k, s in enumerate(strips):
            rows += [(sheet, k, i, float(v)) for i, v in enumerate(s)]
            q = np.sort(s)
            if len(q) < 3:
                t = g if q[-1] - q[0] < 30 else q.mean()
            else:
                j = (q[2:] - q[:-2]).max()
                t = g if max(j, 25) < 30 and np.floor(np.std(s) * 100 + 0.5) / 100 < d else plain_threshold(s, 2, 255.0)
            want[sheet, k] = t
    df = spark.createDataFrame(rows, "sheet long, strip long, opt int, m double")
    got = {(r.sheet, r.strip): r.thr for r in measure.local_thresholds(measure.measured(df)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_qc_and_risk(spark):
    r = spark.createDataFrame([("a.png", "", {f"q{i}": "NR" for i in range(1, 6)})], "file_id string, candidate string, responses map<string,string>")
    x = report.qc_flags(r, r"^\d{10}$").first()
    assert x.qc_flags == ["HIGH_NR", "BAD_CANDIDATE"] and x.nr_count == 5 and x.nr_percent >= 0.99
    a = spark.createDataFrame([("q1", "MR(AB)"), ("q2", "NR"), ("q3", "A"), ("Roll", "AB")], "label string, answer string")
    assert [y.risk for y in report.erasure_risk(a).collect()] == [95, 85, 0, 0]
    assert [y.risk for y in report.erasure_risk(a, fixed=True).collect()] == [85, 0, 0, 0]


def test_names_and_configs(spark):
    f = spark.createDataFrame([("x/a b?.png",), ("..__",), ("c.png",)], "name string").select(files.sanitised("name").alias("n")).collect()
    assert [r.n for r in f] == ["a_b_.png", None, "c.png"]
    d = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b")], "i int, name string")
    assert [r.unique_name for r in files.deduplicated(d, "name", "i").orderBy("i").collect()] == ["a.png", "a_1.png", "b"]
    c = spark.createDataFrame([("in", "base"), ("in/x", "x")], "config_dir string, template string")
    g = spark.createDataFrame([("1", "in/x/y"), ("2", "in/xy")], "file string, dir string")
    assert {r.file: r.template for r in files.nearest_config(g, c).collect()} == {"1": "x", "2": "base"}


def test_roster(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("﻿student_name,school_name,exam_name,candidate_number\n Ann\x07 ,S,E,0123456789\nBob,S,E,12\n", encoding="utf-8")
    rows = roster.checked(roster.read_roster(spark, str(p))).collect()
    assert [r.error is None for r in rows] == [True, False] and rows[0].student_name == "Ann"
    with pytest.raises(ValueError):
        roster.checked(roster.read_roster(spark, str(p)), strict=True)


def test_rows_without_default_scheme_and_bad_patterns(spark):
    judged = spark.createDataFrame([("s", 1, "q1", "A", "correct", "X", None), ("s", 2, "q2", "B", "correct", "DEFAULT", None)], "sheet string, pos int, label string, response string, verdict string, section string, weight double")
    schemes = spark.createDataFrame([("X", 2.0, -1.0, 0.0)], "section string, correct double, incorrect double, unmarked double")
    assert [r.delta for r in grade.scored(judged, schemes).orderBy("pos").collect()] == [2.0, None]
    rows = spark.createDataFrame([({"q1": "NR", "candidate_number": "12"},), ({"q1": "A", "CandidateNumber": " "},), ({"q1": "A"},)], "responses map<string,string>")
    flags = lambda pattern: [r.qc_flags for r in report.qc_flags(rows, pattern).collect()]
    assert flags(None) == [["HIGH_NR"], ["BAD_CANDIDATE"], []]
    assert flags("[0-9]+") == [["HIGH_NR"], ["BAD_CANDIDATE"], ["BAD_CANDIDATE"]]
    assert flags("(") == [["HIGH_NR", "BAD_CANDIDATE"], ["BAD_CANDIDATE"], ["BAD_CANDIDATE"]]


def test_equal_names_of_two_folders(spark):
    got = files.nearest_config(spark.createDataFrame([("a/x", "s.png"), ("b", "s.png")], "dir string, file string"), spark.createDataFrame([("a",), ("b",)], "config_dir string"))
    assert sorted((r.dir, r.config_dir) for r in got.collect()) == [("a/x", "a"), ("b", "b")]
    listing = spark.createDataFrame([("z.PNG",), ("a.jpg",), ("b.txt",)], "path string")
    assert [r.path for r in files.listed(listing, [".png", "jpg"]).collect()] == ["a.jpg", "z.PNG"]


def test_broken_json_and_single_strings(tmp_path):
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(spec.SpecError, match="Error when loading json file at"):
        spec.load_json(tmp_path / "bad.json")
    (tmp_path / "good.json").write_text('{"a": [1]}')
    assert spec.load_json(tmp_path / "good.json") == {"a": [1]}
    e = spec.Evaluation({"source_type": "custom", "options": {"questions_in_order": "q1..3", "answers_in_order": ["A", "B", "C"]}, "marking_schemes": {"DEFAULT": {"correct": 1, "incorrect": 0, "unmarked": 0}, "BONUS_Z": {"questions": "q2..3", "marking": {"correct": "1/2", "incorrect": "1/4", "unmarked": 0}}}})
    assert [k[:3] for k in e.key] == [("q1", 1, "DEFAULT"), ("q2", 2, "BONUS_Z"), ("q3", 3, "BONUS_Z")] and not e.warnings
    t = spec.Template(changed(preProcessors=[{"name": "CropOnMarkers", "options": {"relativePath": "m.png", "more": [{"reference": "r.png"}, {"relativePath": "m.png"}]}}]))
    assert t.assets() == ["m.png", "r.png"]
