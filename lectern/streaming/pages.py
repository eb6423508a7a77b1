"""The page operators over streams of page rows. An extension: what is stateless per page is the same function.

Per-document results need the whole document, so here they are running counts by event-time window; late pages beyond the
watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from ..operators.pages import route
from ..sources.pages import SCHEMAS


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of page rows from Parquet files as they arrive, with an event time."""
    return spark.readStream.schema(StructType([*SCHEMAS["pages"], StructField("ts", TimestampType())])).parquet(path)


def routed(pages: DataFrame) -> DataFrame:
    return route(pages.withColumnRenamed("native_text", "text"))


def quality_by_window(pages: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window, pages, native_pages, avg_score of routed pages with ``ts``."""
    w = routed(pages).withWatermark("ts", late).groupBy(F.window("ts", window))
    return w.agg(F.count("*").alias("pages"), F.count_if(F.col("method") == "native").alias("native_pages"), F.avg("quality_score").alias("avg_score"))
