"""From scans to graded rows: a template, an evaluation and a configuration become one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decode, grade, measure, report
from ..sources.scans import load_markers, measure_scans
from .spec import Evaluation, SpecError, Template, checked_config


@dataclass
class Graded:
    """``rows``: a row per scan (file_id, input_path, output_path, route, score, output columns); ``explanation``: None unless asked for."""

    rows: DataFrame
    responses: DataFrame
    explanation: DataFrame | None


# The output folder of each route.
FOLDERS = {"results": "CheckedOMRs", "multimarked": "Manual/MultiMarkedFiles", "errors": "Manual/ErrorFiles"}


def decoded(bubbles: DataFrame, template: Template, config: dict) -> DataFrame:
    """``sheet, label, response, multi`` of measured bubbles ``sheet, strip, opt, m``; the configuration's thresholds count."""
    t = config["threshold_params"]
    sheets = measure.measured(bubbles, t["PAGE_TYPE_FOR_THRESHOLD"], t["MIN_JUMP"])
    strips = measure.local_thresholds(sheets, t["MIN_GAP"], t["MIN_JUMP"], t["CONFIDENT_SURPLUS"])
    return decode.template_responses(strips, template.value_table(bubbles.sparkSession), config["outputs"]["multi_mark_equal_delta"])


def graded(scans: DataFrame, template: Template, evaluation: Evaluation | None = None, config: dict | None = None, folder: str = ".", out: str = "outputs") -> Graded:
    """Read, decode, route and grade the scans of ``read_scans``.

    Unreadable pages, and those that a preprocessor gives up, go to the errors with blank responses; multi-marked sheets apart if the
    configuration filters them; both score NA. Without an evaluation the score is 0.
    """
    config = checked_config(config or {})
    size, spark = config["dimensions"], scans.sparkSession
    chain = load_markers(spark, template.pre_processors, folder, size["processing_width"])
    seen = measure_scans(scans, template, size["processing_width"], size["processing_height"], chain)
    found = decoded(seen.where("strip is not null"), template, config)
    flags = found.groupBy("sheet").agg(F.bool_or("multi").alias("multi"))
    joined = decode.concatenated(found.select("sheet", "label", "response"), template.custom_table(spark))
    wide = decode.wide(joined, template.output_columns).join(flags, "sheet")
    scores = explained = None
    if evaluation:
        if missing := [q for q in evaluation.questions if q not in {*template.custom, *template.labels}]:
            raise SpecError(f"Missing questions in the responses: {missing}")
        key = evaluation.key_table(spark)
        if evaluation.key_image:  # the key is one of the sheets, and is graded as well
            image = evaluation.key_image.lstrip("./")
            of = scans.where((F.col("file") == image.rpartition("/")[2]) & F.col("path").endswith(f"/{image}")).select(F.lit("").alias("exam"), F.col("path").alias("sheet"))
            if of.isEmpty():
                raise SpecError(f"Answer key image not found at '{evaluation.key_image}'")
            key = grade.key_from_sheets(joined, of, template.empty, evaluation.asked, evaluation.section_of).drop("exam")
        judged = grade.scored(grade.verdicts(joined, key, template.empty), evaluation.scheme_table(spark))
        scores = grade.sheet_scores(judged)
        explained = grade.explanation_text(judged) if evaluation.explain else None
    every = scans.select(F.col("path").alias("sheet"), "file").join(wide, "sheet", "left")
    every = every.join(scores, "sheet", "left") if scores is not None else every.withColumn("score", F.lit(0))
    every = every.withColumn("readable", F.col("multi").isNotNull()).withColumn("multi", F.coalesce("multi", F.lit(False)))
    routed = report.routed(every, config["outputs"]["filter_out_multimarked_files"])
    place = F.concat(F.lit(f"{out}/"), F.coalesce(*[F.when(F.col("route") == k, v) for k, v in FOLDERS.items()]), F.lit("/"), "file")
    columns = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in template.output_columns]
    rows = routed.select(F.col("file").alias("file_id"), F.col("sheet").alias("input_path"), place.alias("output_path"), "route", "score", *columns)
    return Graded(rows, found, explained)
