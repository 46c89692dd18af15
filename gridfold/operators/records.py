"""Statistics of benchmark records (name, milliseconds, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def median_rounds(records: DataFrame) -> DataFrame:
    """(name, milliseconds, rounds): the median of each name's rounds, exact."""
    return records.groupBy("name").agg(F.median("milliseconds").alias("milliseconds"), F.count("*").alias("rounds"))


def stage_shares(records: DataFrame) -> DataFrame:
    """(name, milliseconds, share): the sum of each stage and its share of all."""
    sums = records.groupBy("name").agg(F.sum("milliseconds").alias("milliseconds"))
    return sums.withColumn("share", F.col("milliseconds") / F.sum("milliseconds").over(Window.partitionBy(F.lit(0))))


def reached_shares(shares: DataFrame) -> DataFrame:
    """(name, milliseconds, reached): stages from the longest on, and the share that they and the
    longer ones make up; a row a stage, so one task orders them."""
    w = Window.partitionBy(F.lit(0))
    running = F.sum("milliseconds").over(w.orderBy(F.desc("milliseconds"), "name").rowsBetween(Window.unboundedPreceding, 0))
    return shares.select("name", "milliseconds", (running / F.sum("milliseconds").over(w)).alias("reached"))
