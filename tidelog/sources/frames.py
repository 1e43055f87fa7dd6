"""Entries as JSON records, one to a line or between NUL characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every record between NULs, empty ones included."""
    return spark.read.option("lineSep", "\0").text(path)


def parse_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """severity, source, message of the lines that hold a valid entry.

    Keys match in any case, unknown ones are ignored, an absent or null one is
    0 or empty.  A line that is no JSON object, has a field of a wrong type,
    or an empty source or message, is left out.  A repeated key makes a line
    invalid.
    """
    # each step's value is generated, so that no filter behind it is computed from the step before once more
    once = lambda c: F.explode(F.array(c))
    parsed = lines.select(once(F.try_parse_json(F.col(column))).alias("_v")).where("schema_of_variant(_v) like 'OBJECT<%'")
    wanted = parsed.select(once(F.map_entries(F.try_variant_get("_v", "$", "map<string, variant>"))).alias("_m"))

    def pick(name: str) -> Column:
        own = F.filter(F.col("_m"), lambda e: F.lower(e["key"]) == name)
        return F.when(F.size(own) > 0, F.element_at(own, -1)["value"])

    rows = wanted.select(once(F.struct(pick("sev").alias("_sev"), pick("src").alias("_src"), pick("msg").alias("_msg"))).alias("_r")).select("_r.*")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    good = kind("_sev").isin("BIGINT", "VOID") & kind("_src").isin("STRING", "VOID") & kind("_msg").isin("STRING", "VOID")
    value = lambda c, to, other: F.coalesce(F.try_variant_get(c, "$", to), F.lit(other))
    found = rows.where(good).select(value("_sev", "int", 0).alias("severity"), value("_src", "string", "").alias("source"), value("_msg", "string", "").alias("message"))
    return found.where("octet_length(source) > 0 and octet_length(message) > 0")


def read_entries(spark: SparkSession, path: str, framed: bool = False) -> DataFrame:
    """severity, source, message of the valid entries in files of JSON lines, or of NUL-separated records."""
    return parse_entries(read_frames(spark, path) if framed else spark.read.text(path))


def to_internal(entries: DataFrame) -> DataFrame:
    """Entries as stores send them to each other: Sev, Src, Enc, Msg, Ts, long messages deflated and in base64."""
    enc, stored = codec.encoding(F.col("message")), codec.encode(F.col("message"))
    e = entries.withColumns({"_enc": enc, "_stored": stored})
    sent = codec.to_transport(F.col("_stored"), F.col("_enc"))
    return e.select(F.col("severity").alias("Sev"), F.col("source").alias("Src"), F.col("_enc").alias("Enc"), sent.alias("Msg"), F.col("ts").alias("Ts"))


def from_internal(wire: DataFrame) -> DataFrame:
    """ts, severity, source, message of what ``to_internal`` made."""
    message = codec.decode(codec.from_transport(F.col("Msg"), F.col("Enc")), F.col("Enc"))
    return wire.select(F.col("Ts").alias("ts"), F.col("Sev").alias("severity"), F.col("Src").alias("source"), message.alias("message"))


def until_empty(lines: DataFrame, order: str, column: str = "value") -> DataFrame:
    """The lines before the first empty one; ``order`` numbers them.

    The place of the first empty line is one minimum, so no line order has to
    be kept in one task.
    """
    first = lines.where(F.col(column) == "").agg(F.min(order).alias("_stop"))
    # a condition against one row of one number
    return lines.join(F.broadcast(first), F.coalesce(F.col(order) < F.col("_stop"), F.lit(True))).drop("_stop")
