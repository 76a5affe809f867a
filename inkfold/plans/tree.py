"""A tree of scans with many templates, configurations and evaluations, graded as one plan.

Specifications are few and are compiled on the driver; what they say then travels as rows: thresholds, values, custom labels, keys and schemes, keyed
by the directory that holds them. A sheet finds the nearest of each kind above it. A template keeps the configuration that was nearest to
*its own* directory for measuring and decoding; routing follows the configuration nearest to the sheet.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode, files, grade, measure, report
from ..operators.lifecycle import ROTATIONS
from ..sources.scans import load_markers, measure_tree, page_spec, read_scans
from ..sources.store import saved
from .engine import FOLDERS
from .spec import Evaluation, SpecError, Template, checked_config, with_runtime_defaults

KINDS = ["template", "config", "evaluation"]
# What of a template's configuration its sheets carry through the thresholds.
CARRIED = ["template", "min_jump", "min_gap", "surplus", "fallback", "delta"]


def nearest(folder: str, known: dict) -> str | None:
    """The deepest directory of ``known`` that is ``folder`` or above it."""
    parts = folder.split("/")
    return next((d for d in ("/".join(parts[:i]) for i in range(len(parts), 0, -1)) if d in known), None)


@dataclass
class SpecTree:
    """``documents``: directory to its documents by kind. A directory's configuration is merged with the defaults, not with its parent's."""

    documents: dict[str, dict[str, dict]]
    folder: str = "."
    configs: dict[str, dict] = field(default_factory=dict)
    templates: dict[str, Template] = field(default_factory=dict)
    evaluations: dict[str, Evaluation] = field(default_factory=dict)

    def __post_init__(self):
        has = lambda kind: {d: x[kind] for d, x in self.documents.items() if kind in x}
        self.configs = {d: checked_config(x) for d, x in has("config").items()}
        self.templates = {d: Template(x, f"{d}/template.json") for d, x in has("template").items()}
        for d, x in has("evaluation").items():
            above = nearest(d, self.templates)
            if above is None:
                raise SpecError(f"Found an evaluation file without a parent template file: {d}/evaluation.json")
            filters = self.config_of(d)["outputs"]["filter_out_multimarked_files"]
            self.evaluations[d] = Evaluation(x, Path(self.folder) / d, empty=self.templates[above].empty, filter_multi=filters)

    def config_of(self, folder: str | None) -> dict:
        found = folder is not None and nearest(folder, self.configs)
        return self.configs[found] if found else checked_config({})

    def places(self, spark: SparkSession) -> DataFrame:
        rows = [(d, k) for k, some in zip(KINDS, (self.templates, self.configs, self.evaluations), strict=True) for d in some]
        return spark.createDataFrame(rows, "spec_dir string, kind string")

    def settings(self, spark: SparkSession) -> DataFrame:
        """``template`` with the thresholds of the configuration it was compiled with."""
        rows = []
        for d in self.templates:
            c = self.config_of(d)
            t = c["threshold_params"]
            fallback = measure.BLACK if t["PAGE_TYPE_FOR_THRESHOLD"] == "black" else measure.WHITE
            rows.append((d, float(t["MIN_JUMP"]), float(t["MIN_GAP"]), float(t["CONFIDENT_SURPLUS"]), fallback, float(c["outputs"]["multi_mark_equal_delta"]), self.templates[d].empty))
        return spark.createDataFrame(rows, "template string, min_jump double, min_gap double, surplus double, fallback double, delta double, blank string")

    def routing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d, c["outputs"]["filter_out_multimarked_files"]) for d, c in self.configs.items()], "config string, filter_multi boolean")

    def values(self, spark: SparkSession) -> DataFrame:
        rows: dict[tuple, list] = {}
        for d, t in self.templates.items():
            for _, label, _, _, value, *_ in t.bubbles:
                rows.setdefault((d, label), []).append(str(value))
        return spark.createDataFrame([(d, k, v, self.templates[d].empty_by_label[k]) for (d, k), v in rows.items()], "template string, strip string, values array<string>, empty string")

    def custom(self, spark: SparkSession) -> DataFrame:
        rows = [(d, f, name, i) for d, t in self.templates.items() for name, fields in t.custom.items() for i, f in enumerate(fields)]
        return spark.createDataFrame(rows, "template string, label string, out_label string, pos int")

    def columns(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d, c) for d, t in self.templates.items() for c in t.output_columns], "template string, label string")

    def keys(self, spark: SparkSession) -> DataFrame:
        rows = [(d, *k) for d, e in self.evaluations.items() for k in e.key]
        return spark.createDataFrame(rows, "evaluation string, label string, pos int, section string, answer_type string, answers array<string>, weights array<double>")

    def schemes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d, *s) for d, e in self.evaluations.items() for s in e.schemes], "evaluation string, section string, correct double, incorrect double, unmarked double")


def read_tree(spark: SparkSession, root: str, batch: bool = False) -> SpecTree:
    """The documents below a folder of any file system that Spark reads; directories are named relative to the root, which is ``.``. A batch run sets its marker defaults."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{template,config,evaluation}.json").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    documents: dict[str, dict[str, dict]] = {}
    for r in found.select("path", "content").toLocalIterator():  # specifications, a few small files
        folder, _, name = r.path.rpartition("/")
        try:
            document = json.loads(bytes(r.content).decode())
        except json.JSONDecodeError as e:
            raise SpecError(f"Error when loading json file at: '{r.path}'\n{e}") from e
        documents.setdefault(relative(folder, base), {})[name.removesuffix(".json")] = document
    if batch:
        documents = {d: {k: with_runtime_defaults(x) if k == "template" else x for k, x in some.items()} for d, some in documents.items()}
    return SpecTree(documents, root)


def relative(folder: str, base: str) -> str:
    """``.`` or ``./a/b`` of a folder below the base."""
    path = "/" + folder.split(":", 1)[-1].lstrip("/")
    return "." + path.removeprefix(base.rstrip("/"))


def placed(sheets: DataFrame, tree: SpecTree) -> DataFrame:
    """``sheet, dir`` with ``template, config, evaluation`` and what follows from them. A sheet without a template above it is an error."""
    spark = sheets.sparkSession
    found = files.nearest_specs(sheets, F.broadcast(tree.places(spark)), KINDS)
    error = F.raise_error(F.concat(F.lit("No template file found in the directory tree of "), "dir"))
    found = found.withColumn("template", F.coalesce("template", error.cast("string")))
    found = found.join(F.broadcast(tree.settings(spark)), "template").join(F.broadcast(tree.routing(spark)), "config", "left")
    return sheets.join(found.withColumn("filter_multi", F.coalesce("filter_multi", F.lit(False))), "dir")


def decoded(bubbles: DataFrame, sheets: DataFrame, tree: SpecTree) -> DataFrame:
    """``sheet, template, label, response, multi``: bubbles ``sheet, strip, opt, m`` read with the thresholds and values of each sheet's template."""
    spark = bubbles.sparkSession
    told = bubbles.join(sheets.select("sheet", *CARRIED), "sheet")
    marks = measure.measured(told, F.col("fallback"), F.col("min_jump"), CARRIED)
    strips = measure.local_thresholds(marks, F.col("min_gap"), F.col("min_jump"), F.col("surplus"), CARRIED)
    s = strips.join(F.broadcast(tree.values(spark)), ["template", "strip"])  # specifications are few
    asked = F.lower("strip").startswith("q")
    answer, multi = decode.question_text(F.col("empty"), "delta", "values", 0)
    text = decode.concat_text("values", 0)
    other = F.when(text == "", F.col("empty")).otherwise(text)
    return s.select("sheet", "template", F.col("strip").alias("label"), F.when(asked, answer).otherwise(other).alias("response"), (asked & multi).alias("multi"))


def concatenated(responses: DataFrame, tree: SpecTree) -> DataFrame:
    """``sheet, template, label, response`` with the custom labels of each template joined."""
    parts = responses.join(F.broadcast(tree.custom(responses.sparkSession)), ["template", "label"], "left")
    both = parts.withColumn("out", F.coalesce("out_label", "label"))
    return both.groupBy("sheet", "template", F.col("out").alias("label")).agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, response))), x -> x.response), '')").alias("response"))


def judged(responses: DataFrame, sheets: DataFrame, tree: SpecTree) -> DataFrame:
    """The questions of each sheet's evaluation with verdict and delta; a question that the sheet's template lacks is an error."""
    spark = responses.sparkSession
    key = tree.keys(spark)
    asked = sheets.where("evaluation is not null").select("sheet", "evaluation", "blank").join(F.broadcast(key), "evaluation")
    both = asked.join(responses.select("sheet", "label", "response"), ["sheet", "label"], "left")
    error = F.raise_error(F.concat(F.lit("Missing questions in the responses: "), "label"))
    both = both.withColumn("response", F.coalesce("response", error.cast("string")))
    found = grade.verdict_columns(both, F.col("blank"))
    own = F.broadcast(tree.schemes(spark))
    plain = own.where("section = 'DEFAULT'").select("evaluation", *[F.col(c).alias(f"d_{c}") for c in ("correct", "incorrect", "unmarked")])
    return grade.with_delta(found.join(own, ["evaluation", "section"], "left").join(F.broadcast(plain), "evaluation", "left"))


def graded_tree(bubbles: DataFrame, sheets: DataFrame, tree: SpecTree, out: str = "outputs") -> DataFrame:
    """``sheet, dir, template, evaluation, route, score, output_path, responses``: every sheet of ``sheet, dir, file``, read, graded and routed by what is nearest above it.

    ``responses`` maps the template's output columns, whatever they are. Sheets without bubbles (unreadable pages) are errors with blank responses;
    sheets without an evaluation score 0.
    """
    where = placed(sheets, tree)
    found = saved(decoded(bubbles, where, tree), "responses")  # read for columns, flags and scores
    joined = concatenated(found, tree)
    shown = joined.join(F.broadcast(tree.columns(bubbles.sparkSession)), ["template", "label"])
    wide = shown.groupBy("sheet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "response")))).alias("responses"))
    flags = found.groupBy("sheet").agg(F.bool_or("multi").alias("multi"))
    scores = grade.sheet_scores(judged(joined, where.join(flags, "sheet", "left_semi"), tree))
    every = where.join(flags, "sheet", "left").join(wide, "sheet", "left").join(scores, "sheet", "left")
    every = every.withColumn("readable", F.col("multi").isNotNull()).withColumn("multi", F.coalesce("multi", F.lit(False)) & F.col("filter_multi"))
    every = every.withColumn("score", F.when(F.col("evaluation").isNull(), F.lit("0")).otherwise(F.col("score").cast("string")))
    routed = report.routed(every)
    place = F.concat(F.lit(f"{out}/"), "dir", F.lit("/"), F.coalesce(*[F.when(F.col("route") == k, v) for k, v in FOLDERS.items()]), F.lit("/"), "file")
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    return routed.select("sheet", "dir", "template", "evaluation", "route", "score", place.alias("output_path"), F.coalesce("responses", none).alias("responses"))


def grade_folder(spark: SparkSession, root: str, out: str = "outputs", rotation: int = 0, batch: bool = False) -> DataFrame:
    """``graded_tree`` of the images below a folder, by the documents found in it. Markers and reference images that templates name are no sheets.

    Pages are turned by ``rotation`` degrees. A batch run also fits each page into the processing box by its own proportions, and sets its marker defaults.
    The responses of all bubbles are measured in one pass over the images; that pass is written below the shared folder, as routing reads it twice.
    """
    if rotation not in ROTATIONS:
        raise SpecError(f"Invalid rotation {rotation!r}; allowed: {ROTATIONS}")
    tree = read_tree(spark, root, batch)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    scans = read_scans(spark, root)
    below = F.regexp_replace(F.regexp_replace("dir", "^[a-z0-9]+:/*", "/"), f"^{base}", ".")  # file:/x, hdfs://host/x
    scans = scans.withColumn("dir", below)
    assets = [(d, a) for d, t in tree.templates.items() for a in t.assets()]
    excluded = spark.createDataFrame([((f"{d}/{a}").rpartition("/")[0], a.rpartition("/")[2]) for d, a in assets], "dir string, file string")
    scans = scans.join(F.broadcast(excluded), ["dir", "file"], "left_anti")
    sheets = scans.select(F.col("path").alias("sheet"), "dir", "file")
    near = files.nearest_specs(sheets, F.broadcast(tree.places(spark)), KINDS).where("template is not null").select("dir", "template")
    specs = {}
    for d, t in tree.templates.items():
        size = tree.config_of(d)["dimensions"]
        w, h = size["processing_width"], size["processing_height"]
        specs[d] = page_spec(t, w, h, load_markers(spark, t.pre_processors, f"{root}/{d}", w), rotation, fit=batch)
    seen = saved(measure_tree(scans.join(F.broadcast(near), "dir"), specs), "bubbles")
    return graded_tree(seen.where("strip is not null"), sheets, tree, out)
