"""Structured Streaming entry points: the batch expressions applied to a stream of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchline.operators.validate import schema_reason


def checked(stream: DataFrame) -> DataFrame:
    """candidates(id, raw, ...) as a stream -> with schema_reason; stateless, so it may be appended."""
    return stream.withColumn("schema_reason", schema_reason(F.col("raw")))


def first_deliveries(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """The first delivery of each id within ``late`` of its stamp; state older than that is dropped."""
    stamped = stream.withColumn("delivered", F.to_timestamp("generation_timestamp"))
    return stamped.withWatermark("delivered", late).dropDuplicatesWithinWatermark(["id"])


def rejections(stream: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Schema reasons counted by window of delivery; rows later than ``late`` are left out, as the watermark says."""
    stamped = checked(stream).withColumn("delivered", F.to_timestamp("generation_timestamp")).withWatermark("delivered", late)
    return stamped.groupBy(F.window("delivered", window), F.coalesce("schema_reason", F.lit("sound")).alias("reason")).agg(F.count(F.lit(1)).alias("candidates"))
