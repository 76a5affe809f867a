"""From marked bubbles to responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL_DELTA = 0.06


LETTERS = "array('A', 'B', 'C', 'D', 'E', 'F', 'G')"


def _value(option: str, values: str, first: int) -> str:
    return f"get({values}, cast({option} as int) - {first})"


def question_text(empty: Column, delta: float | str, values: str, first: int) -> tuple[Column, Column]:
    """Of a strip ``b`` (bubbles by darkness) with ``thr``: the response of a question, and whether it is multi-marked."""
    marked = "filter(b, y -> thr > y.m)"
    equal = f"filter({marked}, y -> y.m - {marked}[0].m <= {delta} * 255.0)"
    texts = f"array_sort(array_distinct(transform({equal}, y -> {_value('y.opt', values, first)})))"
    multi = F.expr(f"size({equal}) > 1")
    one = F.expr(f"array_join({texts}, '')")
    return F.when(F.expr(f"size({marked}) = 0"), empty).when(multi, F.concat(F.lit("MR("), one, F.lit(")"))).otherwise(one), multi


def question_responses(strips: DataFrame, empty: str = "NR", delta: float = EQUAL_DELTA, values: str = LETTERS, first: int = 1, carry: list[str] = ()) -> DataFrame:
    """Per strip ``response, multi, n_marked``: the darkest mark; marks about as dark make ``MR(..)``; none gives ``empty``.

    ``strips`` come from ``local_thresholds``; ``values`` is SQL for the values of the options, which are numbered from ``first``.
    Equal values count once but still flag multi.
    """
    s = strips.withColumn("x", F.expr("filter(b, y -> thr > y.m)"))
    s = s.withColumn("equal", F.expr(f"filter(x, y -> y.m - x[0].m <= {delta} * 255.0)"))
    texts = f"array_sort(array_distinct(transform(equal, y -> {_value('y.opt', values, first)})))"
    return s.select(
        "sheet", "strip",
        F.when(F.size("x") == 0, F.lit(empty)).when(F.size("equal") > 1, F.expr(f"concat('MR(', array_join({texts}, ''), ')')")).otherwise(F.expr(f"array_join({texts}, '')")).alias("response"),
        (F.size("equal") > 1).alias("multi"), F.size("x").alias("n_marked"), *carry,
    )


def concat_text(values: str, first: int) -> Column:
    """All marked values of a strip in the order of its bubbles."""
    return F.expr(f"array_join(transform(array_sort(transform(filter(b, y -> thr > y.m), y -> y.opt)), o -> {_value('o', values, first)}), '')")


def strip_concat(strips: DataFrame, empty: str = "", values: str = LETTERS, first: int = 1) -> DataFrame:
    """Of strips that are no questions: all marked values in the order of the bubbles."""
    text = concat_text(values, first)
    return strips.select("sheet", "strip", F.when(text == "", F.lit(empty)).otherwise(text).alias("response"))


def template_responses(strips: DataFrame, labels: DataFrame, delta: float = EQUAL_DELTA) -> DataFrame:
    """``sheet, label, response, multi`` by a template's ``label, values array<string>, empty``; options are numbered from 0.

    Labels that start with q, in either case, are questions; of others all marked values are joined, and they never flag multi.
    """
    s = strips.join(F.broadcast(labels.withColumnRenamed("label", "of")), F.col("strip") == F.col("of"))  # a template's labels are few
    asked = F.lower("strip").startswith("q")
    answer, multi = question_text(F.col("empty"), delta, "values", 0)
    text = concat_text("values", 0)
    other = F.when(text == "", F.col("empty")).otherwise(text)
    return s.select("sheet", F.col("strip").alias("label"), F.when(asked, answer).otherwise(other).alias("response"), (asked & multi).alias("multi"))


def concatenated(responses: DataFrame, custom: DataFrame) -> DataFrame:
    """``sheet, label, response``: fields of ``custom(out_label, pos, label)`` joined in order, other labels as they are."""
    parts = responses.join(F.broadcast(custom), "label", "left")  # custom labels are a template's, hence few
    both = parts.withColumn("out", F.coalesce("out_label", "label"))
    return both.groupBy("sheet", F.col("out").alias("label")).agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, response))), x -> x.response), '')").alias("response"))


def wide(responses: DataFrame, labels: list[str]) -> DataFrame:
    """One row per sheet, one column per label in the given order; null where a sheet has no such label.

    A sheet's labels and responses are gathered once and looked up in one array; sixty lookups beside each other would make code too long for the JVM to compile.
    """
    held = responses.groupBy("sheet").agg(F.collect_list(F.coalesce("label", F.lit(""))).alias("l"), F.collect_list(F.struct("response")).alias("r"))
    found = F.transform(F.array(*map(F.lit, labels)), lambda k: F.get("r", (F.array_position("l", k) - 1).cast("int"))["response"])
    return held.select("sheet", found.alias("found")).select("sheet", *[F.get("found", F.lit(i)).alias(label) for i, label in enumerate(labels)])
