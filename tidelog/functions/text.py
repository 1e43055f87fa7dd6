"""Text forms of entries, sizes and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.timing import as_timestamp, layout_pattern


def format_entry(ts: Column, source: Column, severity: Column, message: Column, layout: str = "2006-01-02 15:04:05", template: str = "%s %s %d %s") -> Column:
    """One line per entry; times in the session's zone."""
    return F.format_string(template, F.date_format(as_timestamp(ts), layout_pattern(layout)), source, severity, message)


def entry_json(ts: Column, source: Column, severity: Column, message: Column) -> Column:
    return F.to_json(F.struct(severity.alias("Sev"), source.alias("Src"), message.alias("Msg"), ts.alias("Ts")))


def format_size(size: Column) -> Column:
    """Whole bytes, KiB or MiB."""
    in_units = lambda by, unit: F.concat(F.call_function("div", size, F.lit(by)).cast("string"), F.lit(unit))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("b"))).when(size < 1024 * 1024, in_units(1024, "Kb")).otherwise(in_units(1024 * 1024, "Mb"))


def percent_full(size: Column, limit: Column) -> Column:
    """Size as a percentage of the limit; null for a limit of 0."""
    return F.try_divide(size.cast("double") * 100, limit.cast("double"))


def format_usage(addr: Column, size: Column, limit: Column) -> Column:
    """One line per host: address, size and limit, and how full it is; a limit of 0 has no percentage."""
    full = percent_full(size, limit)
    part = F.when(full.isNull(), F.lit("-")).otherwise(F.format_string("%.2f%%", full))
    return F.concat(addr, F.lit(" "), format_size(size), F.lit("/"), format_size(limit), F.lit(" "), part)


def split_list(text: str) -> list[str]:
    """Comma-separated items without the spaces around them."""
    return [x.strip(" ") for x in text.split(",")] if text else []
