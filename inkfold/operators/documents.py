"""Specification documents as data: every node a row, checked against a table of rules; assets they name, compared with what is there.

A document becomes a VARIANT and is opened level by level in one narrow stage, so checking a million documents is a scan, a small join and an
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 10  # levels below the root; deeper nodes are reported, not dropped

# Names that documents may use.
PROCESSORS = ["CropOnMarkers", "CropPage", "FeatureBasedAlignment", "GaussianBlur", "Levels", "MedianBlur"]
TYPES = ["QTYPE_INT", "QTYPE_INT_FROM_1", "QTYPE_MCQ4", "QTYPE_MCQ5", "QTYPE_MCQ4_RTL", "QTYPE_MCQ5_RTL"]
SCORE = r"-?(\d+)(/(\d+))?"

# What a node at a path may be. path: type, and any of low, high, least, most (items), one of, pattern, closed (no other keys), needs (keys).
# `*` is any key, `[]` any item; an item of preProcessors stands under its name, options of an evaluation under its source type.
PAIR = {"type": "array", "least": 2, "most": 2}
AMOUNT = {"type": "number", "low": 0}
WHOLE = {"type": "integer", "low": 0}
SHARE = {"type": "number", "low": 0, "high": 1}
TEMPLATE = {
    "": {"type": "object", "closed": True, "needs": ["bubbleDimensions", "pageDimensions", "preProcessors", "fieldBlocks"]},
    "bubbleDimensions": PAIR, "bubbleDimensions[]": WHOLE, "pageDimensions": PAIR, "pageDimensions[]": WHOLE,
    "customLabels": {"type": "object"}, "customLabels.*": {"type": "array"}, "customLabels.*[]": {"type": "string"},
    "outputColumns": {"type": "array"}, "outputColumns[]": {"type": "string"}, "emptyValue": {"type": "string"},
    "preProcessors": {"type": "array"}, "preProcessors[]": {"type": "object", "needs": ["name", "options"]}, "preProcessors[].name": {"type": "string", "one_of": PROCESSORS},
    "fieldBlocks": {"type": "object"},
    "fieldBlocks.*": {"type": "object", "needs": ["origin", "bubblesGap", "labelsGap", "fieldLabels"]},
    "fieldBlocks.*.bubbleDimensions": PAIR, "fieldBlocks.*.bubbleDimensions[]": AMOUNT, "fieldBlocks.*.bubblesGap": AMOUNT, "fieldBlocks.*.labelsGap": AMOUNT,
    "fieldBlocks.*.bubbleValues": {"type": "array"}, "fieldBlocks.*.bubbleValues[]": {"type": "string"}, "fieldBlocks.*.direction": {"type": "string", "one_of": ["horizontal", "vertical"]},
    "fieldBlocks.*.emptyValue": {"type": "string"}, "fieldBlocks.*.fieldLabels": {"type": "array"}, "fieldBlocks.*.fieldLabels[]": {"type": "string"},
    "fieldBlocks.*.origin": PAIR, "fieldBlocks.*.origin[]": WHOLE, "fieldBlocks.*.fieldType": {"type": "string", "one_of": TYPES},
}
OPTIONS = {
    "CropOnMarkers": {"type": {"type": "string", "one_of": ["template_matching", "aruco"]}, "arucoDictionary": {"type": "string"}, "arucoCornerIds": {"type": "array", "least": 4, "most": 4}, "arucoCornerIds[]": {"type": "integer"}, "apply_erode_subtract": {"type": "boolean"}, "marker_rescale_range": PAIR, "marker_rescale_range[]": AMOUNT, "marker_rescale_steps": {"type": "number"}, "markerSearchPadding": {"type": "number"}, "fallbackToExpandedMarkerCorners": {"type": "boolean"}, "max_matching_variation": {"type": "number"}, "min_matching_threshold": {"type": "number"}, "relativePath": {"type": "string"}, "sheetToMarkerWidthRatio": {"type": "number"}, "markerCorners": {"type": "array", "least": 4, "most": 4}, "markerCorners[]": {"type": "array", "least": 4, "most": 4}, "markerCorners[][]": {"type": "number"}, "preserveFullImage": {"type": "boolean"}, "referenceMarkerCenters": {"type": "array", "least": 4, "most": 4}, "referenceMarkerCenters[]": PAIR, "referenceMarkerCenters[][]": {"type": "number"}},
    "FeatureBasedAlignment": {"2d": {"type": "boolean"}, "goodMatchPercent": {"type": "number"}, "maxFeatures": {"type": "integer"}, "reference": {"type": "string"}},
    "Levels": {"gamma": SHARE, "high": SHARE, "low": SHARE},
    "MedianBlur": {"kSize": {"type": "integer"}},
    "GaussianBlur": {"kSize": PAIR, "kSize[]": WHOLE, "sigmaX": {"type": "number"}},
    "CropPage": {"morphKernel": PAIR, "morphKernel[]": WHOLE},
}
NEEDED_OPTIONS = {"FeatureBasedAlignment": ["reference"]}
CONFIG = {
    "": {"type": "object", "closed": True},
    "dimensions": {"type": "object", "closed": True}, "dimensions.display_height": {"type": "integer"}, "dimensions.display_width": {"type": "integer"}, "dimensions.processing_height": {"type": "integer"}, "dimensions.processing_width": {"type": "integer"},
    "threshold_params": {"type": "object", "closed": True}, "threshold_params.MIN_JUMP": {"type": "integer", "low": 10, "high": 100}, "threshold_params.MIN_GAP": {"type": "integer", "low": 10, "high": 100}, "threshold_params.CONFIDENT_SURPLUS": {"type": "integer", "low": 0, "high": 20}, "threshold_params.JUMP_DELTA": {"type": "integer", "low": 10, "high": 100}, "threshold_params.GAMMA_LOW": SHARE, "threshold_params.PAGE_TYPE_FOR_THRESHOLD": {"type": "string", "one_of": ["white", "black"]},
    "alignment_params": {"type": "object", "closed": True}, "alignment_params.auto_align": {"type": "boolean"}, "alignment_params.match_col": {"type": "integer", "low": 0, "high": 10}, "alignment_params.max_steps": {"type": "integer", "low": 1, "high": 100}, "alignment_params.stride": {"type": "integer", "low": 1, "high": 10}, "alignment_params.thickness": {"type": "integer", "low": 1, "high": 10},
    "outputs": {"type": "object", "closed": True}, "outputs.show_image_level": {"type": "integer", "low": 0, "high": 6}, "outputs.save_image_level": {"type": "integer", "low": 0, "high": 6}, "outputs.save_detections": {"type": "boolean"}, "outputs.filter_out_multimarked_files": {"type": "boolean"}, "outputs.multi_mark_equal_delta": SHARE, "outputs.max_workers": {"type": "integer", "low": 1, "high": 32}, "outputs.candidate_regex": {"type": "string|null"},
}
MARKING = {"type": "object", "closed": True, "needs": ["correct", "incorrect", "unmarked"]}
EVALUATION = {
    "": {"type": "object", "needs": ["source_type", "options", "marking_schemes"]}, "source_type": {"type": "string", "one_of": ["csv", "custom"]},
    "options[csv]": {"type": "object", "closed": True, "needs": ["answer_key_csv_path"]}, "options[csv].should_explain_scoring": {"type": "boolean"}, "options[csv].answer_key_csv_path": {"type": "string"}, "options[csv].answer_key_image_path": {"type": "string"}, "options[csv].questions_in_order": {"type": "array"}, "options[csv].questions_in_order[]": {"type": "string"},
    "options[custom]": {"type": "object", "closed": True, "needs": ["answers_in_order", "questions_in_order"]}, "options[custom].should_explain_scoring": {"type": "boolean"}, "options[custom].answers_in_order": {"type": "array"}, "options[custom].questions_in_order": {"type": "array"}, "options[custom].questions_in_order[]": {"type": "string"}, "options[custom].enable_evaluation_table_to_csv": {"type": "boolean"},
    "marking_schemes": {"type": "object", "needs": ["DEFAULT"]}, "marking_schemes.DEFAULT": MARKING, "marking_schemes.*": {"type": "object", "closed": True, "needs": ["marking", "questions"]}, "marking_schemes.*.marking": MARKING, "marking_schemes.*.questions": {"type": "string|array"}, "marking_schemes.*.questions[]": {"type": "string"},
    **{f"marking_schemes.{p}.{k}": {"type": "string|number", "pattern": SCORE} for p in ("DEFAULT", "*.marking") for k in ("correct", "incorrect", "unmarked")},
}
SCHEMAS = {"template": TEMPLATE, "config": CONFIG, "evaluation": EVALUATION}


def rules(spark: SparkSession) -> DataFrame:
    """The rules as rows: ``kind, path, types, low, high, least, most, one_of, pattern, closed, needs``."""
    rows = []
    for kind, schema in SCHEMAS.items():
        every = dict(schema)
        if kind == "template":
            for name, options in OPTIONS.items():
                top = f"preProcessors[{name}].options"
                every[top] = {"type": "object", "closed": True, "needs": NEEDED_OPTIONS.get(name, [])}
                every |= {f"{top}.{k}": v for k, v in options.items()}
        for path, r in every.items():
            number = lambda k: None if r.get(k) is None else float(r[k])  # noqa: B023, E731
            rows.append((kind, path, r["type"].split("|"), number("low"), number("high"), r.get("least"), r.get("most"), r.get("one_of"), r.get("pattern"), r.get("closed", False), r.get("needs", [])))
    return spark.createDataFrame(rows, "kind string, path string, types array<string>, low double, high double, least int, most int, one_of array<string>, pattern string, closed boolean, needs array<string>")


def _type(v: str) -> str:
    """SQL for the JSON type of a variant."""
    s = f"schema_of_variant({v})"
    return f"case when {s} like 'OBJECT%' then 'object' when {s} like 'ARRAY%' then 'array' when {s} = 'STRING' then 'string' when {s} = 'BOOLEAN' then 'boolean' when {s} = 'VOID' then 'null' when {s} = 'BIGINT' then 'integer' when try_variant_get({v}, '$', 'double') = floor(try_variant_get({v}, '$', 'double')) then 'integer' else 'number' end"


def flattened(documents: DataFrame) -> DataFrame:
    """``doc, kind, at, path, above, up, key, type, v, n, deep`` of every node of ``doc, kind, json``: ``at`` is its own path, ``path`` that of its rule (``above, up``: its parent's), n its items.

    A document that is no JSON gives one row of type ``invalid``. A node deeper than ``DEPTH`` levels is not opened, and says so.
    """
    root = documents.withColumn("v", F.expr("try_parse_json(json)"))
    rows = root.select("doc", "kind", F.lit("").alias("at"), F.lit("").alias("path"), F.lit(None).cast("string").alias("above"), F.lit(None).cast("string").alias("up"), F.lit("").alias("key"), "v", F.lit(True).alias("new"), F.expr("try_variant_get(v, '$.source_type', 'string')").alias("source"))
    named = "concat('preProcessors[', coalesce(try_variant_get(v, '$.name', 'string'), ''), ']')"
    base = f"if(path = 'preProcessors[]', {named}, path)"
    open_ = "path in ('fieldBlocks', 'customLabels') or (path = 'marking_schemes' and e.key <> 'DEFAULT')"
    own = "case when path = '' and kind = 'evaluation' and e.key = 'options' then concat('options[', coalesce(source, ''), ']') when path = '' then e.key else concat(BASE, '.', if(OPEN, '*', e.key)) end"
    # the name of a preprocessor stays under the general path; only what its options hold depends on it
    own = own.replace("BASE", "if(path = 'preProcessors[]' and e.key = 'name', path, BASE)").replace("BASE", base).replace("OPEN", open_)
    node = lambda at, path, key, v, new, source, above="at", up="path": f"named_struct('at', {at}, 'path', {path}, 'above', {above}, 'up', {up}, 'key', {key}, 'v', {v}, 'new', {new}, 'source', {source})"
    none = "cast(null as string)"
    for _ in range(DEPTH):
        of_object = "transform(map_entries(cast(v as map<string, variant>)), e -> " + node("if(at = '', e.key, concat(at, '.', e.key))", own, "e.key", "e.value", "true", none) + ")"
        of_array = "transform(cast(v as array<variant>), (x, i) -> " + node("concat(at, '[', i, ']')", "concat(path, '[]')", "'[]'", "x", "true", none) + ")"
        kids = f"case when not new or v is null then array() when schema_of_variant(v) like 'OBJECT%' then {of_object} when schema_of_variant(v) like 'ARRAY%' then {of_array} else array() end"
        self_ = node("at", "path", "key", "v", "false", "source", "above", "up")
        rows = rows.select("doc", "kind", F.expr(f"inline(concat(array({self_}), {kids}))"))
    n = "case when v is null then null when schema_of_variant(v) like 'ARRAY%' then size(cast(v as array<variant>)) when schema_of_variant(v) like 'OBJECT%' then size(cast(v as map<string, variant>)) end"
    return rows.select("doc", "kind", "at", "path", "above", "up", "key", F.expr(f"if(v is null, 'invalid', {_type('v')})").alias("type"), "v", F.expr(n).alias("n"), F.expr("new and v is not null and (schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%')").alias("deep"))


def _shown(v: str) -> str:
    """SQL for a value as messages show it."""
    return f"if(schema_of_variant({v}) = 'STRING', concat('''', try_variant_get({v}, '$', 'string'), ''''), replace(to_json({v}), ',', ', '))"


def errors(documents: DataFrame) -> DataFrame:
    """``doc, at, rule, message``: everything that breaks a rule, a row each; documents without any are valid.

    One pass: a node is met with its rule, an object's keys are read from the object, so no document moves.
    """
    nodes = flattened(documents)
    rule = F.broadcast(rules(documents.sparkSession))  # a fixed table
    met = nodes.alias("n").join(rule.alias("r"), F.expr("n.kind = r.kind and n.path = r.path"), "left")
    number = "try_variant_get(v, '$', 'double')"
    plain = "if(low = floor(low), cast(cast(low as bigint) as string), cast(low as string))"
    upper = plain.replace("low", "high")
    text = "try_variant_get(v, '$', 'string')"
    fits = "(array_contains(types, type) or (type = 'integer' and array_contains(types, 'number')))"
    kinds = "concat('''', array_join(types, ''', '''), '''')"
    listed = "concat('[''', array_join(one_of, ''', '''), ''']')"
    found = {
        "json": ("type = 'invalid'", "'not a JSON document'"),
        "depth": ("deep", f"'nested deeper than {DEPTH} levels'"),
        "type": (f"types is not null and type <> 'invalid' and not {fits}", f"concat({_shown('v')}, ' is not of type ', {kinds})"),
        "enum": (f"one_of is not null and type = 'string' and not array_contains(one_of, {text})", f"concat({_shown('v')}, ' is not one of ', {listed})"),
        "minimum": (f"low is not null and type in ('integer', 'number') and {number} < low", f"concat({_shown('v')}, ' is less than the minimum of ', {plain})"),
        "maximum": (f"high is not null and type in ('integer', 'number') and {number} > high", f"concat({_shown('v')}, ' is greater than the maximum of ', {upper})"),
        "minItems": ("least is not null and type = 'array' and n < least", f"concat({_shown('v')}, ' is too short')"),
        "maxItems": ("most is not null and type = 'array' and n > most", f"concat({_shown('v')}, ' is too long')"),
        "pattern": (f"pattern is not null and type = 'string' and not {text} rlike pattern", f"concat({_shown('v')}, ' does not match ''', pattern, '''')"),
    }
    rows = ", ".join(f"if(coalesce({when}, false), named_struct('rule', '{name}', 'message', {message}), null)" for name, (when, message) in found.items())
    one = lambda when, name, message: f"if(coalesce({when}, false), named_struct('at', at, 'rule', '{name}', 'message', {message}), null)"
    rows = [one(when, name, message) for name, (when, message) in found.items()]
    # an object's own keys; one too deep to be opened has none
    met = met.withColumn("keys", F.expr("if(type = 'object' and not deep, map_keys(cast(v as map<string, variant>)), cast(array() as array<string>))"))
    is_object = "type = 'object' and "
    # a marker matched by its image needs the image; without a type the rule holds as well
    rows.append(one(is_object + "n.path = 'preProcessors[CropOnMarkers].options' and coalesce(try_variant_get(v, '$.type', 'string'), 'template_matching') = 'template_matching' and not array_contains(keys, 'relativePath')", "required", "'''relativePath'' is a required property'"))
    given = "int(array_contains(keys, 'fieldType')) + int(array_contains(keys, 'bubbleValues') and array_contains(keys, 'direction'))"
    rows.append(one(is_object + f"n.path = 'fieldBlocks.*' and {given} <> 1", "oneOf", "'either fieldType, or bubbleValues and direction, must be given'"))
    rows.append(one(is_object + "n.path = 'options[csv]' and array_contains(keys, 'answer_key_image_path') and not array_contains(keys, 'questions_in_order')", "dependentRequired", "'''questions_in_order'' is a dependency of ''answer_key_image_path'''"))
    lone = one("r.path is null and n.above is not null and n.key <> '[]' and c.p is not null", "additionalProperties", "concat('Additional properties are not allowed (''', key, ''' was unexpected)')").replace("'at', at", "'at', above")
    lacks = "if(type = 'object', transform(array_except(needs, keys), k -> named_struct('at', at, 'rule', 'required', 'message', concat('''', k, ''' is a required property'))), null)"
    none = "cast(array() as array<struct<at: string, rule: string, message: string>>)"
    closed = F.broadcast(rule.where("closed").select(F.col("kind").alias("k"), F.col("path").alias("p")))
    met = met.join(closed.alias("c"), F.expr("n.kind = c.k and n.up = c.p"), "left")
    return met.select(F.col("n.doc").alias("doc"), F.expr(f"inline(concat(array_compact(array({', '.join([*rows, lone])})), coalesce({lacks}, {none})))"))


def assets(documents: DataFrame) -> DataFrame:
    """``doc, name``: the distinct base names of all ``relativePath`` texts below a template's preprocessors."""
    paths = flattened(documents).where("key = 'relativePath' and type = 'string' and at like 'preProcessors%'")
    name = F.element_at(F.split(F.expr("rtrim('/', try_variant_get(v, '$', 'string'))"), "/"), -1)
    return paths.select("doc", name.alias("name")).where("name <> ''").distinct()


def readiness(batches: DataFrame, files: DataFrame) -> DataFrame:
    """``batch, required, present, missing, ready, reason`` of ``batch, file_count, template`` (JSON, null without one).

    ``files`` lists ``batch, path`` relative to the batch; an asset is present in the batch's folder or in its inputs.
    """
    named = assets(batches.where("template is not null").select(F.col("batch").alias("doc"), F.lit("template").alias("kind"), F.col("template").alias("json"))).withColumnRenamed("doc", "batch")
    there = files.where("path not like '%/%' or path rlike '^inputs/[^/]*$'").select("batch", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(True).alias("there")).distinct()
    met = named.join(there, ["batch", "name"], "left").groupBy("batch").agg(
        F.sort_array(F.collect_set("name")).alias("required"), F.sort_array(F.collect_set(F.when(F.col("there"), F.col("name")))).alias("present"), F.sort_array(F.collect_set(F.when(F.col("there").isNull(), F.col("name")))).alias("missing")
    )
    none: Column = F.expr("cast(array() as array<string>)")
    every = batches.select("batch", "file_count", F.col("template").isNotNull().alias("has")).join(met, "batch", "left")
    every = every.select("batch", "file_count", "has", *[F.coalesce(c, none).alias(c) for c in ("required", "present", "missing")])
    reason = F.when(F.col("file_count") == 0, "Batch has no input images.").when(~F.col("has"), "Batch is missing template.json; upload one before processing.")
    reason = reason.when(F.size("missing") > 0, F.concat(F.lit("template.json references missing asset(s): "), F.array_join("missing", ", "), F.lit(". Upload them under Template assets before running.")))
    return every.select("batch", "required", "present", "missing", reason.isNull().alias("ready"), reason.alias("reason"))
