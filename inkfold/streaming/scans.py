"""A stream of measured bubbles: each micro-batch is thresholded, decoded and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decode, measure


def grade_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, empty: str = "NR") -> StreamingQuery:
    """Parquet files of ``sheet, strip, opt, m`` arriving in ``source`` to responses in ``target``; a sheet arrives whole in one file."""

    def batch(df: DataFrame, epoch: int) -> None:
        strips = measure.local_thresholds(measure.measured(df))
        decode.question_responses(strips, empty).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")  # a repeated epoch overwrites itself

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
