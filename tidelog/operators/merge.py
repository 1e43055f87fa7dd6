"""Time-ordered merge of entry streams with removal of duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "source", "message", "severity")
_SAME = ("ts", "source", "message")


def ordered(entries: DataFrame) -> DataFrame:
    """By time; ties by source, message and severity."""
    return entries.orderBy(*ORDER)


def merge(parts: Sequence[DataFrame], dedup: str | bool = "set", sort: bool = False) -> DataFrame:
    """The union of entry tables.

    ``"set"`` keeps one of the entries that agree in time, source and message,
    with the smallest severity: one hash aggregation with map-side combining,
    whatever the layout of the parts.  ``"adjacent"`` keeps the first of each
    run of such entries in the order of (ts, severity, source, message), so
    that only neighbours fall together.  False keeps all.
    """
    if not parts:
        raise ValueError("nothing to merge")
    columns = parts[0].columns
    whole = reduce(DataFrame.unionByName, parts)
    if dedup == "set":
        rest = [c for c in columns if c not in (*_SAME, "severity")]
        whole = whole.groupBy(*_SAME).agg(F.min("severity").alias("severity"), *[F.min(c).alias(c) for c in rest]).select(*columns)
    elif dedup == "adjacent":
        whole = without_adjacent(whole)
    elif dedup:
        raise ValueError(f"no such removal of duplicates: {dedup!r}")
    return ordered(whole) if sort else whole


def without_adjacent(entries: DataFrame) -> DataFrame:
    """Neighbours agree in time, so runs are found within each time and need no global order."""
    at_one_time = Window.partitionBy("ts").orderBy("severity", "source", "message")
    before = F.lag(F.struct("source", "message")).over(at_one_time)
    marked = entries.withColumn("_again", F.coalesce(before == F.struct("source", "message"), F.lit(False)))
    return marked.where("not _again").drop("_again")


def without_late(entries: DataFrame, arrival: str, *keys: str) -> DataFrame:
    """Drops what arrives with a time below an earlier arrival of its file.

    Accepted times never fall, so the bound is the running maximum over all
    earlier arrivals, 0 before the first.  A file is a source and hour;
    ``keys`` may name other columns.
    """
    file = Window.partitionBy(*(keys or ("source", "hour"))).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    bound = F.coalesce(F.max("ts").over(file), F.lit(0))
    return entries.withColumn("_bound", F.greatest(bound, F.lit(0))).where("ts >= _bound").drop("_bound")
