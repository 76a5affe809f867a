"""Grading: verdicts, section schemes, running scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: str) -> Column:
    """A score such as ``3``, ``-1.5`` or ``-2/3`` as a double."""
    return F.expr(f"try_divide(try_cast(split_part({text}, '/', 1) as double), coalesce(try_cast(nullif(split_part({text}, '/', 2), '') as double), 1d))")


def parse_answers(column: str) -> Column:
    """Answers of a key cell: a bracketed JSON list, a comma list, or one value (not trimmed)."""
    return F.expr(f"case when {column} like '[%' then from_json(replace({column}, '\\'', '\"'), 'array<string>') when {column} like '%,%' then split({column}, ',') else array({column}) end")


def verdicts(responses: DataFrame, key: DataFrame, empty: str = "NR") -> DataFrame:
    """responses ``sheet, label, response`` against ``label, pos, section, answer_type, answers array<string>, weights array<double>``."""
    return verdict_columns(responses.join(F.broadcast(key), "label"), empty)  # a key is a specification's, hence small


def verdict_columns(joined: DataFrame, empty: str | Column = "NR") -> DataFrame:
    """Adds ``verdict, weight``. Empty is tested before membership; of repeated answers the last weight counts."""
    at = F.expr("size(answers) - array_position(reverse(answers), response)")  # of the last equal answer
    member = F.array_contains("answers", F.col("response"))
    verdict = (
        F.when(F.col("response") == empty, "unmarked")
        .when(member & (F.col("answer_type") == "standard"), "correct")
        .when(member, F.concat(F.lit("correct-"), "response"))
        .otherwise("incorrect")
    )
    weight = F.when(member & (F.col("response") != empty), F.get("weights", at.cast("int")))
    return joined.withColumn("verdict", verdict).withColumn("weight", weight)


def scored(judged: DataFrame, schemes: DataFrame) -> DataFrame:
    """Adds ``delta``: an answer's own weight, else what the section (or DEFAULT) gives the verdict's kind; null where neither is given."""
    s = F.broadcast(schemes)  # marking schemes are a specification's, hence few
    default = F.broadcast(schemes.where("section = 'DEFAULT'").select(*[F.col(c).alias(f"d_{c}") for c in ("correct", "incorrect", "unmarked")]))
    return with_delta(judged.join(s, "section", "left").join(default, F.lit(True), "left"))  # one row at most


def with_delta(j: DataFrame) -> DataFrame:
    """Adds ``delta`` from ``verdict, weight``, the section's ``correct, incorrect, unmarked`` and, where those are null, the same with ``d_``."""
    value = lambda c: F.coalesce(c, f"d_{c}")
    kind = F.substring_index("verdict", "-", 1)
    delta = F.when(kind == "unmarked", value("unmarked")).when(kind == "incorrect", value("incorrect")).otherwise(F.coalesce("weight", value("correct")))
    return j.withColumn("delta", delta)


def explanation(judged: DataFrame) -> DataFrame:
    """Verdict in title case, and the running score in the order of questions."""
    w = Window.partitionBy("sheet").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("verdict").like("correct-%"), F.concat(F.lit("Correct-"), F.initcap(F.expr("substr(verdict, 9)")))).otherwise(F.initcap("verdict"))
    return judged.withColumn("score", F.sum("delta").over(w)).withColumn("verdict", title)


def explanation_text(judged: DataFrame) -> DataFrame:
    """The explanation as text, a row a question: what was marked, the answers, verdict, delta, running score (two decimals), section."""
    text = lambda c: F.round(c, 2).cast("string").alias(c)
    answers = F.when(F.size("answers") == 1, F.get("answers", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("answers", ", "), F.lit("]")))
    return explanation(judged).select("sheet", "pos", F.col("label").alias("question"), F.col("response").alias("marked"), answers.alias("answers"), "verdict", text("delta"), text("score"), "section")


def sheet_scores(judged: DataFrame) -> DataFrame:
    """A left fold of the deltas in the order of questions."""
    fold = "aggregate(transform(array_sort(collect_list(struct(pos, delta))), x -> x.delta), 0d, (a, x) -> a + x)"
    return judged.groupBy("sheet").agg(F.expr(fold).alias("score"))


def missing_questions(responses: DataFrame, asked: list[str], sheets: DataFrame) -> DataFrame:
    """``sheet, label``: questions of a key (a specification's, hence few) that a sheet has no response for."""
    found = responses.groupBy("sheet").agg(F.collect_set(F.when(F.col("label").isin(asked), F.col("label"))).alias("found"))
    key = F.array(*[F.lit(q) for q in asked])
    every = sheets.select("sheet").distinct().join(found, "sheet", "left")
    return every.select("sheet", F.explode(F.array_except(key, F.coalesce("found", F.expr("cast(array() as array<string>)")))).alias("label"))


def extra_questions(responses: DataFrame, asked: list[str]) -> DataFrame:
    """``sheet, label``: answered labels that start with a small q and are not in the key; a warning, not an error."""
    return responses.where(F.col("label").startswith("q") & ~F.col("label").isin(asked)).select("sheet", "label")


def key_from_sheets(responses: DataFrame, key_sheets: DataFrame, empty: str = "", questions: list[str] | None = None, sections: dict[str, str] | None = None) -> DataFrame:
    """``exam, label, pos, section, answer_type, answers, weights``: answer keys read from the responses of marked sheets ``exam, sheet``, within the same plan.

    With ``questions`` the key has those, in order, and one that is blank stops the run; without, all that are not blank, in the order of
    their text. Blank is what contains the empty value, or nothing where that is empty. A key sheet without responses stops the run.
    """
    read = key_sheets.select("exam", "sheet").join(responses.select("sheet", "label", "response"), "sheet", "left")
    unread = F.raise_error(F.concat(F.lit("Could not read answer key from image "), F.col("sheet").cast("string"))).cast("string")
    read = read.withColumn("label", F.coalesce("label", unread))
    blank = F.length("response") == 0 if empty == "" else F.contains("response", F.lit(empty))
    if questions:
        place = F.array_position(F.array(*[F.lit(q) for q in questions]), F.col("label"))
        stop = F.raise_error(F.concat(F.lit("Found empty answers in file '"), F.col("sheet").cast("string"), F.lit("'. Please check your template again in the --setLayout mode."))).cast("string")
        asked = read.withColumn("pos", place.cast("int")).where("pos > 0").withColumn("response", F.when(blank, stop).otherwise(F.col("response")))
    else:
        asked = read.where(~blank).withColumn("pos", F.row_number().over(Window.partitionBy("exam").orderBy("label")))  # a template's labels are few
    section = F.lit("DEFAULT")
    for label, name in (sections or {}).items():
        section = F.when(F.col("label") == label, F.lit(name)).otherwise(section)
    return asked.select("exam", "label", "pos", section.alias("section"), F.lit("standard").alias("answer_type"), F.array("response").alias("answers"), F.lit(None).cast("array<double>").alias("weights"))
