"""Log queries as values that compile to one predicate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidelog.functions.patterns import matches, to_java
from tidelog.schema import HOUR_NS


@dataclass(frozen=True)
class LogQuery:
    """Entries of a closed time and severity range whose source matches a pattern."""

    start: int
    end: int
    min_severity: int = 0
    max_severity: int = 255
    source: str = ""

    @property
    def empty(self) -> bool:
        """A range without extent, or a pattern that is none, selects nothing."""
        return self.start >= self.end or self.min_severity > self.max_severity or (bool(self.source) and to_java(self.source) is None)

    def predicate(self) -> Column:
        """On columns ts, severity, source."""
        if self.empty:
            return F.lit(False)
        found = F.col("ts").between(self.start, self.end) & F.col("severity").between(self.min_severity, self.max_severity)
        return found & matches(F.col("source"), self.source) if self.source else found


def any_of(queries: Iterable[LogQuery]) -> Column:
    """Entries that some query selects; none for an empty list."""
    live = [q.predicate() for q in queries if not q.empty]
    return reduce(Column.__or__, live) if live else F.lit(False)


def per_query(entries: DataFrame, queries: Iterable[LogQuery]) -> DataFrame:
    """Every query's entries, one after the other: an entry comes once per query that selects it."""
    parts = [entries.where(q.predicate()) for q in queries]
    return reduce(DataFrame.unionByName, parts) if parts else entries.where(F.lit(False))


@F.pandas_udf(StringType())
def _translated(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: None if p is None else to_java(p) if p else "")


def query_table(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Entries that some row of ``queries`` (start, end, min_severity, max_severity, source) selects.

    For lists of queries that are data themselves.  Patterns are rows here, in
    the dialect of ``LogQuery``, the empty one matching all; a row with a
    pattern that the dialect rejects, or with a null, selects nothing.
    Queries are cut into the hours they touch, so that the semi join is an
    equi-join on the hour, whatever the sizes.
    """
    hour = HOUR_NS
    live = queries.where("start < end and min_severity <= max_severity").withColumn("_java", _translated(F.col("source"))).where("_java is not null")
    cut = live.withColumn("_hour", F.explode(F.expr(f"sequence(start - pmod(start, {hour}L), end, {hour}L)")))
    q = cut.select("_hour", "_java", *[F.col(c).alias(f"_{c}") for c in ("start", "end", "min_severity", "max_severity")])
    e = entries.withColumn("_at", F.expr(f"ts - pmod(ts, {hour}L)"))
    found = e.join(
        q,
        (F.col("_at") == F.col("_hour"))
        & F.col("ts").between(F.col("_start"), F.col("_end"))
        & F.col("severity").between(F.col("_min_severity"), F.col("_max_severity"))
        & ((F.col("_java") == "") | F.expr("source rlike _java")),
        "left_semi",
    )
    return found.drop("_at")


#: Names of a query's fields on the wire; fixed values.
WIRE = {"From": "start", "To": "end", "MinSev": "min_severity", "MaxSev": "max_severity", "Src": "source"}


def query_json(queries: DataFrame, column: str = "value") -> DataFrame:
    """Rows of queries as JSON records."""
    return queries.select(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in WIRE.items()])).alias(column))


def parse_queries(records: DataFrame, column: str = "value") -> DataFrame:
    """Rows of queries from JSON records; absent fields are 0 or empty, what is no record is left out."""
    kinds = ", ".join(f"{n} {'string' if n == 'Src' else 'bigint' if n in ('From', 'To') else 'int'}" for n in WIRE)
    read = records.select(F.from_json(column, kinds, {"mode": "PERMISSIVE"}).alias("_q"), F.col(column).alias("_text"))
    read = read.where(F.col("_text").rlike(r"^\s*\{") & F.try_parse_json("_text").isNotNull())
    return read.select(*[F.coalesce(F.col(f"_q.{n}"), F.lit("" if n == "Src" else 0)).alias(c) for n, c in WIRE.items()])
