"""Hours that have entries, as sets of hours and as segments of adjacent hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timing import floor_hour, hour_floor
from tidelog.schema import HOUR_NS


def hours(entries: DataFrame) -> DataFrame:
    """source, hour of all entries."""
    return entries.select("source", hour_floor(F.col("ts")).alias("hour")).distinct()


def insert(covered: DataFrame, entries: DataFrame) -> DataFrame:
    return covered.select("source", "hour").unionByName(hours(entries)).distinct()


def delete(covered: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the hours of the times in ``gone`` (source, ts)."""
    return covered.join(hours(gone), ["source", "hour"], "left_anti")


def truncate(covered: DataFrame, limit: int) -> DataFrame:
    """Without the hour of ``limit`` and those before it."""
    return covered.where(F.col("hour") > floor_hour(limit))


def segments(covered: DataFrame) -> DataFrame:
    """source, seg_start, seg_end (not within), hours: runs of adjacent hours."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("hour"))
    run = covered.withColumn("_run", F.col("hour") - nth * F.lit(HOUR_NS))
    return (
        run.groupBy("source", "_run")
        .agg(F.min("hour").alias("seg_start"), (F.max("hour") + HOUR_NS).alias("seg_end"), F.count(F.lit(1)).alias("hours"))
        .select("source", "seg_start", "seg_end", "hours")
    )


def bounds(covered: DataFrame) -> DataFrame:
    """source, start, end (not within), hours."""
    return covered.groupBy("source").agg(F.min("hour").alias("start"), (F.max("hour") + HOUR_NS).alias("end"), F.count(F.lit(1)).alias("hours"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Of closed ranges."""
    return ~((a_end < b_start) | (b_end < a_start))
