"""Specification documents as data: each rule's message, odd documents, assets and readiness."""

import json

from inkfold.operators import documents
from tests.test_tree import evaluation, template


def messages(spark, kind, document):
    text = document if isinstance(document, str) else json.dumps(document)
    df = spark.createDataFrame([("d", kind, text)], "doc string, kind string, json string")
    return sorted((r.at, r.rule, r.message) for r in documents.errors(df).collect())


def block(**more):
    return {"fieldType": "QTYPE_MCQ4", "origin": [20, 20], "fieldLabels": ["q1..3"], "labelsGap": 40, "bubblesGap": 40} | more


def test_many_documents_in_one_pass(spark):
    t = template()
    lacking = {k: v for k, v in t.items() if k != "pageDimensions"}
    marker = lambda **o: t | {"preProcessors": [{"name": "CropOnMarkers", "options": o}]}
    cases = {
        "good": ("template", t | {"fieldBlocks": {"A": block(), "B": block(fieldType="QTYPE_INT", emptyValue="NR")}, "customLabels": {"R": ["q1..2"]}, "outputColumns": ["R"]}, []),
        "lacking": ("template", lacking, [("", "required", "'pageDimensions' is a required property")]),
        "empty": ("template", {}, [("", "required", f"'{k}' is a required property") for k in ("bubbleDimensions", "fieldBlocks", "pageDimensions", "preProcessors")]),
        "type": ("template", t | {"fieldBlocks": {"A": block(fieldType="X")}}, [("fieldBlocks.A.fieldType", "enum", "'X' is not one of ['QTYPE_INT', 'QTYPE_INT_FROM_1', 'QTYPE_MCQ4', 'QTYPE_MCQ5', 'QTYPE_MCQ4_RTL', 'QTYPE_MCQ5_RTL']")]),
        "both": ("template", t | {"fieldBlocks": {"A": block(bubbleValues=["A"], direction="vertical")}}, [("fieldBlocks.A", "oneOf", "either fieldType, or bubbleValues and direction, must be given")]),
        "numbers": ("template", t | {"pageDimensions": [-1, 2.5, 3]}, [("pageDimensions", "maxItems", "[-1, 2.5, 3] is too long"), ("pageDimensions[0]", "minimum", "-1 is less than the minimum of 0"), ("pageDimensions[1]", "type", "2.5 is not of type 'integer'")]),
        "colour": ("template", t | {"co.lour": 1}, [("", "additionalProperties", "Additional properties are not allowed ('co.lour' was unexpected)")]),
        "name": ("template", t | {"preProcessors": [{"name": "Nope", "options": {}}, {"options": {}}]}, [("preProcessors[0].name", "enum", "'Nope' is not one of ['CropOnMarkers', 'CropPage', 'FeatureBasedAlignment', 'GaussianBlur', 'Levels', 'MedianBlur']"), ("preProcessors[1]", "required", "'name' is a required property")]),
        "levels": ("template", t | {"preProcessors": [{"name": "Levels", "options": {"gamma": 1.5, "mid": 1}}]}, [("preProcessors[0].options", "additionalProperties", "Additional properties are not allowed ('mid' was unexpected)"), ("preProcessors[0].options.gamma", "maximum", "1.5 is greater than the maximum of 1")]),
        "marker": ("template", marker(), [("preProcessors[0].options", "required", "'relativePath' is a required property")]),
        "aruco": ("template", marker(type="aruco", arucoCornerIds=[1, 2, 3]), [("preProcessors[0].options.arucoCornerIds", "minItems", "[1, 2, 3] is too short")]),
        "align": ("template", t | {"preProcessors": [{"name": "FeatureBasedAlignment", "options": {"2d": "yes"}}]}, [("preProcessors[0].options", "required", "'reference' is a required property"), ("preProcessors[0].options.2d", "type", "'yes' is not of type 'boolean'")]),
        "config": ("config", {"threshold_params": {"MIN_JUMP": 5, "PAGE_TYPE_FOR_THRESHOLD": "grey"}, "outputs": {"candidate_regex": None, "max_workers": 64}, "more": {}}, [("", "additionalProperties", "Additional properties are not allowed ('more' was unexpected)"), ("outputs.max_workers", "maximum", "64 is greater than the maximum of 32"), ("threshold_params.MIN_JUMP", "minimum", "5 is less than the minimum of 10"), ("threshold_params.PAGE_TYPE_FOR_THRESHOLD", "enum", "'grey' is not one of ['white', 'black']")]),
        "evaluation": ("evaluation", evaluation(3, "A") | {"note": 1}, []),
        "schemes": ("evaluation", {"source_type": "csv", "options": {"answer_key_image_path": "k.png", "answer_key_csv_path": "k.csv"}, "marking_schemes": {"X": {"marking": {"correct": "one", "incorrect": "-1/3"}, "questions": "q1"}}}, [("marking_schemes", "required", "'DEFAULT' is a required property"), ("marking_schemes.X.marking", "required", "'unmarked' is a required property"), ("marking_schemes.X.marking.correct", "pattern", "'one' does not match '-?(\\d+)(/(\\d+))?'"), ("options", "dependentRequired", "'questions_in_order' is a dependency of 'answer_key_image_path'")]),
        "list": ("template", [1], [("", "type", "[1] is not of type 'object'")]),
        "broken": ("config", "{", [("", "json", "not a JSON document")]),
        "deep": ("config", json.loads('{"outputs": {"candidate_regex": ' + "[" * 12 + "]" * 12 + "}}"), [("outputs.candidate_regex", "type", "[[[[[[[[[[[[]]]]]]]]]]]] is not of type 'string', 'null'"), ("outputs.candidate_regex" + "[0]" * 8, "depth", "nested deeper than 10 levels")]),
    }
    rows = [(name, kind, d if isinstance(d, str) else json.dumps(d)) for name, (kind, d, _) in cases.items()]
    found = {name: [] for name in cases}
    for r in documents.errors(spark.createDataFrame(rows, "doc string, kind string, json string").repartition(3)).collect():
        found[r.doc].append((r.at, r.rule, r.message))
    for name, (_, _, want) in cases.items():
        assert sorted(found[name]) == sorted(want), name


def test_assets_and_readiness(spark):
    named = lambda *paths: json.dumps({"preProcessors": [{"name": "CropOnMarkers", "options": {"relativePath": p, "more": [{"relativePath": 5}]}} for p in paths], "fieldBlocks": {"relativePath": "no.png"}})
    batches = spark.createDataFrame([("ok", 2, named("a/m.png", "m.png")), ("gone", 1, named("x.png", "y.png")), ("empty", 0, named("x.png")), ("bare", 3, None), ("plain", 1, "{}")], "batch string, file_count int, template string")
    files = spark.createDataFrame([("ok", "inputs/m.png"), ("gone", "y.png"), ("gone", "inputs/deep/x.png"), ("other", "x.png")], "batch string, path string")
    got = {r.batch: r for r in documents.readiness(batches, files).collect()}
    assert {k: r.ready for k, r in got.items()} == {"ok": True, "gone": False, "empty": False, "bare": False, "plain": True}
    assert got["ok"].required == ["m.png"] == got["ok"].present and got["gone"].missing == ["x.png"] and got["gone"].present == ["y.png"]
    assert got["gone"].reason == "template.json references missing asset(s): x.png. Upload them under Template assets before running." and got["empty"].reason == "Batch has no input images." and got["bare"].reason.startswith("Batch is missing")
