"""Templates, configurations and evaluations: JSON documents compiled on the driver into small dimension tables."""

from __future__ import annotations

import ast
import copy
import csv
import json
import re
from fractions import Fraction
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.pixels import REGISTRY

# The built-in field types.
FIELD_TYPES = {
    "QTYPE_INT": {"bubbleValues": ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"], "direction": "vertical"},
    "QTYPE_INT_FROM_1": {"bubbleValues": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "0"], "direction": "vertical"},
    "QTYPE_MCQ4": {"bubbleValues": ["A", "B", "C", "D"], "direction": "horizontal"},
    "QTYPE_MCQ5": {"bubbleValues": ["A", "B", "C", "D", "E"], "direction": "horizontal"},
    "QTYPE_MCQ4_RTL": {"bubbleValues": ["D", "C", "B", "A"], "direction": "horizontal"},
    "QTYPE_MCQ5_RTL": {"bubbleValues": ["E", "D", "C", "B", "A"], "direction": "horizontal"},
}

# Defaults of the configuration document.
CONFIG_DEFAULTS = {
    "dimensions": {"display_height": 2480, "display_width": 1640, "processing_height": 820, "processing_width": 666},
    "threshold_params": {"GAMMA_LOW": 0.7, "MIN_GAP": 30, "MIN_JUMP": 25, "CONFIDENT_SURPLUS": 5, "JUMP_DELTA": 30, "PAGE_TYPE_FOR_THRESHOLD": "white"},
    "alignment_params": {"auto_align": False, "match_col": 5, "max_steps": 20, "stride": 1, "thickness": 3},
    "outputs": {"show_image_level": 0, "save_image_level": 0, "save_detections": True, "filter_out_multimarked_files": False, "multi_mark_equal_delta": 0.06},
}

# Inclusive bounds of configuration numbers.
CONFIG_BOUNDS = {
    "MIN_GAP": (10, 100), "MIN_JUMP": (10, 100), "CONFIDENT_SURPLUS": (0, 20), "JUMP_DELTA": (10, 100), "GAMMA_LOW": (0, 1),
    "multi_mark_equal_delta": (0, 1), "save_image_level": (0, 6), "show_image_level": (0, 6), "max_workers": (1, 32),
}

# Defaults of the template document.
TEMPLATE_DEFAULTS = {"preProcessors": [], "emptyValue": "", "customLabels": {}, "outputColumns": []}

RANGE = re.compile(r"([^.\d]+)(\d+)\.{2,3}(\d+)")


class SpecError(Exception):
    """A document that cannot be compiled."""


def load_json(path: str | Path) -> dict:
    try:
        return json.loads(Path(path).read_text())
    except json.JSONDecodeError as e:
        raise SpecError(f"Error when loading json file at: '{path}'\n{e}") from e


def merged(defaults: dict, own: dict) -> dict:
    """Dictionaries merge deeply; lists and scalars override."""
    out = copy.deepcopy(defaults)
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def parse_field_string(text: str) -> list[str]:
    """``q1..3`` to q1, q2, q3; other strings stand for themselves."""
    m = RANGE.search(text)
    if not m:
        return [text]
    start, end = int(m[2]), int(m[3])
    if start >= end:
        raise SpecError(f"Invalid range in fields string: '{text}', start: {start} is not less than end: {end}")
    return [f"{m[1]}{i}" for i in range(start, end + 1)]


def parse_fields(key: str, fields: list[str]) -> list[str]:
    out: list[str] = []
    for text in fields:
        new = parse_field_string(text)
        if set(out) & set(new):
            raise SpecError(f"Given field string '{text}' has overlapping field(s) with other fields in '{key}': {fields}")
        out += new
    return out


def natural_key(label: str) -> tuple:
    m = re.match(r"([^\d]+)(\d*)", label)
    return (m[1], int(m[2] or 0), label) if m else (label, 0, label)


def number(text: str | float) -> float:
    """``3``, ``"-1.5"`` or ``"-2/3"``."""
    return float(Fraction(text)) if isinstance(text, str) and "/" in text else float(text)


def checked_config(own: dict) -> dict:
    """A configuration with defaults; numbers outside their bounds are errors."""
    out = merged(CONFIG_DEFAULTS, own)
    bad = [f"{s}.{k}: {v}" for s, part in out.items() if isinstance(part, dict) for k, v in part.items() if k in CONFIG_BOUNDS and not CONFIG_BOUNDS[k][0] <= v <= CONFIG_BOUNDS[k][1]]
    bad += [f"unknown section {s}" for s in out if s not in CONFIG_DEFAULTS]
    if out["threshold_params"]["PAGE_TYPE_FOR_THRESHOLD"] not in ("white", "black"):
        bad.append("PAGE_TYPE_FOR_THRESHOLD")
    if bad:
        raise SpecError(f"Provided config JSON is Invalid: {bad}")
    if out["alignment_params"]["auto_align"]:
        raise SpecError("alignment_params.auto_align is not supported for scans: blocks are read where the template puts them")
    return out


# What a batch run sets for markers that a template looks for in windows of its own.
RUNTIME_MARKERS = {"markerSearchPadding": 20, "fallbackToExpandedMarkerCorners": True, "max_matching_variation": 0.5}


def with_runtime_defaults(document: dict) -> dict:
    """A template with the marker defaults of batch runs; what it sets itself stays, and the document given is not changed."""
    out = copy.deepcopy(document)
    for p in out.get("preProcessors") or []:
        if p.get("name") == "CropOnMarkers":
            options = p["options"] = p["options"] if isinstance(p.get("options"), dict) else {}
            if "markerCorners" in options:
                p["options"] = RUNTIME_MARKERS | options
    return out


class Template:
    """A compiled template: ``bubbles`` rows, labels, custom labels, output columns."""

    def __init__(self, document: dict, path: str = "template.json", page: tuple[int, int] | None = None):
        t = merged(TEMPLATE_DEFAULTS, document)
        blocks = t.get("fieldBlocks")
        if not isinstance(blocks, dict) or not {"pageDimensions", "bubbleDimensions"} <= set(t) or any(b.get("fieldType", "QTYPE_INT") not in FIELD_TYPES for b in blocks.values()):
            raise SpecError(f"Provided Template JSON is Invalid: '{path}'")
        self.page, self.empty = list(page or t["pageDimensions"]), t["emptyValue"]
        self.bubbles, self.labels, self.empty_by_label = [], [], {}
        for name, block in blocks.items():
            self._block(name, self._filled(block, t), self.empty)
        self.custom = self._custom_labels(t["customLabels"])
        used = {f for fields in self.custom.values() for f in fields}
        free = [x for x in self.labels if x not in used]
        self.output_columns = parse_fields("Output Columns", t["outputColumns"]) or sorted([*self.custom, *free], key=natural_key)
        known = {*self.custom, *free}
        if any(c not in known for c in self.output_columns):
            raise SpecError("Some columns are missing in the field blocks for the given output columns")
        self.uncovered = sorted(known - set(self.output_columns), key=natural_key)
        self.pre_processors = t["preProcessors"]
        unknown = [p.get("name") for p in self.pre_processors if p.get("name") not in REGISTRY]
        if unknown:
            raise SpecError(f"Unknown preprocessors in '{path}': {unknown}")

    @staticmethod
    def _filled(block: dict, t: dict) -> dict:
        own = FIELD_TYPES.get(block.get("fieldType"), {})
        return {"direction": "vertical", "emptyValue": t["emptyValue"], "bubbleDimensions": t["bubbleDimensions"], **own, **block}

    def _block(self, name: str, b: dict, empty: str) -> None:
        labels, values = parse_fields(f"Field Block Labels: {name}", b["fieldLabels"]), b["bubbleValues"]
        if set(labels) & set(self.labels):
            raise SpecError(f"The field strings for field block {name} overlap with other existing fields")
        across, (bw, bh), (ox, oy) = b["direction"] == "horizontal", b["bubbleDimensions"], b["origin"]
        along = int(b["bubblesGap"] * (len(values) - 1) + (bw if across else bh))
        aside = int(b["labelsGap"] * (len(labels) - 1) + (bh if across else bw))
        size = [along, aside] if across else [aside, along]
        if ox < 0 or oy < 0 or ox + size[0] >= self.page[0] or oy + size[1] >= self.page[1]:
            raise SpecError(f"Overflowing field block '{name}' with origin {b['origin']} and dimensions {size} in template with dimensions {self.page}")
        lead = [float(ox), float(oy)]
        for label in labels:
            at = list(lead)
            for i, value in enumerate(values):
                self.bubbles.append((name, label, b.get("fieldType", "__CUSTOM__"), i, value, round(at[0]), round(at[1]), bw, bh))
                at[0 if across else 1] += b["bubblesGap"]
            lead[1 if across else 0] += b["labelsGap"]
            self.empty_by_label[label] = b["emptyValue"]
        self.labels += labels

    def _custom_labels(self, given: dict) -> dict[str, list[str]]:
        out, used = {}, set()
        for name, fields in given.items():
            parsed = parse_fields(f"Custom Label: {name}", fields)
            missing = sorted(set(parsed) - set(self.labels))
            if missing:
                raise SpecError(f"Missing field block label(s) in the given template for {missing} from '{name}'")
            if used & set(parsed):
                raise SpecError(f"The field strings for custom label '{name}' overlap with other existing custom labels")
            used |= set(parsed)
            out[name] = parsed
        return out

    def bubble_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.bubbles, "block string, label string, field_type string, opt int, value string, x int, y int, width int, height int")

    def value_table(self, spark: SparkSession) -> DataFrame:
        """``label, values, empty``: what the options of each label stand for, and what an unmarked strip gives."""
        values: dict[str, list[str]] = {}
        for _, label, _, _, value, *_ in self.bubbles:
            values.setdefault(label, []).append(str(value))
        return spark.createDataFrame([(k, v, self.empty_by_label[k]) for k, v in values.items()], "label string, values array<string>, empty string")

    def custom_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f, name, i) for name, fields in self.custom.items() for i, f in enumerate(fields)], "label string, out_label string, pos int")

    def assets(self) -> list[str]:
        """Files that preprocessors name, from anywhere in their options."""
        found: list[str] = []

        def walk(x):
            if isinstance(x, dict):
                for k, v in x.items():
                    found.append(v) if k in ("relativePath", "reference") and isinstance(v, str) else walk(v)
            elif isinstance(x, list):
                for v in x:
                    walk(v)

        walk(self.pre_processors)
        return list(dict.fromkeys(found))


def parse_answer(cell: str):
    """A cell of a key: a bracketed literal, a comma list, or a value."""
    return ast.literal_eval(cell) if cell.startswith("[") else cell.split(",") if "," in cell else cell


def answer_type(item) -> str:
    score = lambda x: isinstance(x, (str, int)) and not isinstance(x, bool)
    if isinstance(item, str):
        return "standard"
    if isinstance(item, list) and len(item) >= 2 and all(isinstance(x, str) for x in item):
        return "multiple-correct"
    if isinstance(item, list) and item and all(isinstance(x, list) and len(x) == 2 and isinstance(x[0], str) and score(x[1]) for x in item):
        return "multiple-correct-weighted"
    raise SpecError(f"Unable to determine answer type for answer item: {item}")


class Evaluation:
    """A compiled answer key: ``key`` rows and marking ``schemes``."""

    def __init__(self, document: dict, folder: str | Path = ".", responses_of_key: dict[str, str] | None = None, empty: str = "", filter_multi: bool = False):
        o = document["options"]
        self.key_image = self.asked = None
        if document.get("source_type") == "csv":
            path = Path(folder) / o["answer_key_csv_path"]
            if path.exists():
                with path.open(newline="") as f:
                    rows = [r for r in csv.reader(f) if r]
                self.questions, answers = [r[0] for r in rows], [parse_answer(r[1]) for r in rows]
            elif responses_of_key is None and o.get("answer_key_image_path"):  # read from that sheet, within the plan that reads all sheets
                self.key_image = o["answer_key_image_path"]
                self.asked = parse_fields("questions_in_order", o["questions_in_order"]) if "questions_in_order" in o else None
                self.questions, answers = self.asked or [], [""] * len(self.asked or [])
            elif responses_of_key is None:
                raise SpecError(f"Answer key csv not found at '{path}'")
            else:
                self.questions, answers = self._from_sheet(o, responses_of_key, empty)
        else:
            given = o["questions_in_order"]
            self.questions, answers = parse_fields("questions_in_order", [given] if isinstance(given, str) else given), o["answers_in_order"]
        if len(self.questions) != len(answers):
            raise SpecError(f"Unequal lengths for questions_in_order and answers_in_order ({len(self.questions)} and {len(answers)})")
        types = [answer_type(a) for a in answers]
        if filter_multi and any(len(x) > 1 for a, t in zip(answers, types, strict=True) for x in ([a] if t == "standard" else [y if isinstance(y, str) else y[0] for y in a])):
            raise SpecError("Provided answer key contains multiple correct answer(s), but config.filter_out_multimarked_files is True")
        self.explain = bool(o.get("should_explain_scoring"))
        self.schemes, section_of = [], {}
        for name, s in document["marking_schemes"].items():
            marking = s if name == "DEFAULT" else s["marking"]
            self.schemes.append((name, *(number(marking[k]) for k in ("correct", "incorrect", "unmarked"))))
            if name == "DEFAULT":
                continue
            for q in parse_fields(name, [s["questions"]] if isinstance(s["questions"], str) else s["questions"]):
                if q in section_of:
                    raise SpecError(f"Section '{name}' has overlapping question(s) with other sections")
                section_of[q] = name
        missing = sorted(set(section_of) - set(self.questions), key=natural_key)
        self.section_of = section_of
        if missing and not (self.key_image and self.asked is None):
            raise SpecError(f"Some questions are missing in the answer key for the given marking scheme: {missing}")
        self.warnings = [f"Found positive marks({i}) for incorrect answer in the schema '{n}'. For Bonus sections, add a prefix 'BONUS_' to them." for n, _, i, _ in self.schemes if i > 0 and not n.startswith("BONUS")]
        self.key = []
        for pos, (q, a, t) in enumerate(zip(self.questions, answers, types, strict=True), 1):
            values = [a] if t == "standard" else [x if isinstance(x, str) else x[0] for x in a]
            weights = [number(x[1]) for x in a] if t == "multiple-correct-weighted" else None
            self.key.append((q, pos, section_of.get(q, "DEFAULT"), t, values, weights))

    @staticmethod
    def _from_sheet(o: dict, found: dict[str, str], empty: str) -> tuple[list[str], list[str]]:
        """The key read from a marked sheet: the given questions, or all that are marked, in text order."""
        if "questions_in_order" in o:
            questions = parse_fields("questions_in_order", o["questions_in_order"])
            blank = [q for q in questions if found.get(q, empty) == empty]
            if blank:
                raise SpecError(f"Found empty answers for the questions: {blank}, empty value used: '{empty}'")
        else:
            questions = sorted(q for q, v in found.items() if v != empty)
        return questions, [found[q] for q in questions]

    def key_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.key, "label string, pos int, section string, answer_type string, answers array<string>, weights array<double>")

    def scheme_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.schemes, "section string, correct double, incorrect double, unmarked double")
