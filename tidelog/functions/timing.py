"""Nanosecond timestamps, hours, durations and time layouts."""

from __future__ import annotations

import re
from datetime import datetime, timezone, tzinfo
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import HOUR_NS


def hour_floor(ts: Column) -> Column:
    """Start of the UTC hour, also before 1970."""
    return ts - F.pmod(ts, F.lit(HOUR_NS))


def floor_hour(ts: int) -> int:
    return ts - ts % HOUR_NS


def as_timestamp(ts: Column) -> Column:
    """A timestamp with microseconds, for display; the nanoseconds below are cut off downwards."""
    return F.timestamp_micros(floor_div(ts, 1000))


def floor_div(x: Column, by: int) -> Column:
    """Integer division that rounds down, exact for all 64-bit values."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def from_timestamp(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) * F.lit(1000)


def hour_name(ts: Column) -> Column:
    """``yyyy.MM.dd.HH`` of the UTC hour; the session's zone is to be UTC."""
    return F.date_format(as_timestamp(ts), "yyyy.MM.dd.HH")


def hour_range(name: Column) -> Column:
    """Struct (start, end) of an hour's name, both within; the full range for a name that is none."""
    start = F.unix_micros(F.try_to_timestamp(name, F.lit("yyyy.MM.dd.HH"))) * F.lit(1000)
    return F.struct(
        F.coalesce(start, F.lit(-(1 << 63))).alias("start"),
        F.coalesce(start + F.lit(HOUR_NS - 1), F.lit((1 << 63) - 1)).alias("end"),
    )


_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": HOUR_NS}  # fixed values
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> int:
    """Nanoseconds of a duration such as ``-1.5h`` or ``2h45m``; ``0`` needs no unit."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text[1:] if text[:1] == "+" else text)
    if body == "0":
        return 0
    total, at = 0, 0
    for part in _PART.finditer(body):
        if part.start() != at:
            break
        total += int(Decimal(part[1]) * _UNITS[part[2]])
        at = part.end()
    if not body or at != len(body):
        raise ValueError(f"not a duration: {text!r}")
    return sign * total


def interval(base_ns: int, range_ns: int) -> tuple[int, int]:
    """The closed interval between a base and a signed distance from it."""
    return (base_ns + range_ns, base_ns) if range_ns < 0 else (base_ns, base_ns + range_ns)


def parse_base(text: str, zone: tzinfo = timezone.utc) -> int:
    """Nanoseconds of ``YYYY-MM-DD hh:mm:ss`` in a time zone."""
    return int(datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=zone).timestamp()) * 10**9


#: Elements of reference-time layouts and their patterns here; fixed values, longer ones first.
LAYOUT = [
    ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("MST", "zzz"),
    ("2006", "yyyy"), ("-07:00", "xxx"), ("-0700", "xx"), ("Z07:00", "XXX"),
    ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"),
]


def layout_pattern(layout: str) -> str:
    """A reference-time layout (``2006-01-02 15:04:05``) as a pattern of ``date_format``."""
    out, plain, at = "", "", 0

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text

    while at < len(layout):
        fraction = re.match(r"\.(0+|9+)(?!\d)", layout[at:])
        found = next(((k, v) for k, v in LAYOUT if layout.startswith(k, at)), None)
        if fraction and layout[:at].endswith("05"):
            found = (fraction[0], "." + "S" * (len(fraction[0]) - 1))
        if found:
            out, plain = out + (quoted(plain) if plain else "") + found[1], ""
            at += len(found[0])
        else:
            plain += layout[at]
            at += 1
    return out + (quoted(plain) if plain else "")
