"""Schemas of the log tables.  Timestamps are nanoseconds since the epoch, UTC."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


LOG = _schema(("ts", T.LongType()), ("severity", T.IntegerType()), ("source", T.StringType()), ("message", T.StringType()))
#: What a store keeps in its files; the source stands in the partition key alone.
#: ``stored`` counts a message's bytes as an append-only file would keep them, so that sizes need no message.
FILE = _schema(
    ("ts", T.LongType()), ("severity", T.IntegerType()), ("message", T.StringType()), ("stored", T.IntegerType()), ("source_key", T.StringType()), ("span", T.LongType())
)
STAT = _schema(("ts", T.LongType()), ("addr", T.StringType()), ("size", T.LongType()), ("limit", T.LongType()), ("last_transfer_id", T.LongType()))
TRANSFER = _schema(("id", T.LongType()), ("from_addr", T.StringType()), ("to_addr", T.StringType()), ("amount", T.LongType()))
COVERAGE = _schema(("source", T.StringType()), ("seg_start", T.LongType()), ("seg_end", T.LongType()), ("hours", T.LongType()))

HOUR_NS = 3_600_000_000_000
MIN_NS, MAX_NS = -(1 << 63), (1 << 63) - 1
