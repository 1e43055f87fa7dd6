"""Message codec, transport encoding, source keys and sizes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType

PLAIN, DEFLATED = 0, 1
#: Messages of more bytes than this are deflated.
THRESHOLD = 512
_SLICE = 4096
#: Bytes that an entry takes besides its source and message.
OVERHEAD = 35


def deflate(raw: bytes) -> bytes:
    """A raw stream that is flushed and not ended."""
    tool = zlib.compressobj(wbits=-15)
    return tool.compress(raw) + tool.flush(zlib.Z_SYNC_FLUSH)


def inflate(raw: bytes) -> bytes:
    """All that a raw stream holds; what is damaged ends it, what comes before the damage stays."""
    tool, out = zlib.decompressobj(-15), []
    view = memoryview(raw)
    for at in range(0, len(raw), _SLICE):
        before = tool.copy()
        try:
            out.append(tool.decompress(view[at : at + _SLICE]))
        except zlib.error:
            try:  # once more, byte by byte, up to the damage
                for i in range(at, at + _SLICE):
                    out.append(before.decompress(view[i : i + 1]))
            except zlib.error:
                pass
            break
    return b"".join(out)


def stored_size(message: str) -> int:
    """Bytes of a message as it is stored."""
    raw = message.encode()
    return len(raw) if len(raw) <= THRESHOLD else len(deflate(raw))


@F.pandas_udf(BinaryType())
def _deflated(message: pd.Series) -> pd.Series:
    return message.map(lambda m: None if m is None else deflate(m.encode()))


@F.pandas_udf(IntegerType())
def _deflated_size(message: pd.Series) -> pd.Series:
    return message.map(lambda m: 0 if m is None else stored_size(m)).astype("int32")


@F.pandas_udf(StringType())
def _inflated(stored: pd.Series) -> pd.Series:
    return stored.map(lambda m: None if m is None else inflate(bytes(m)).decode("utf-8", "replace"))


def encoding(message: Column) -> Column:
    return F.when(F.octet_length(message) > THRESHOLD, DEFLATED).otherwise(PLAIN)


def encode(message: Column) -> Column:
    """Stored bytes; only long messages reach Python."""
    long = F.when(F.octet_length(message) > THRESHOLD, message)
    return F.when(F.octet_length(message) > THRESHOLD, _deflated(long)).otherwise(message.cast("binary"))


def message_size(message: Column) -> Column:
    """Bytes of a message as it is stored; only long ones reach Python."""
    long = F.octet_length(message) > THRESHOLD
    return F.when(long, _deflated_size(F.when(long, message))).otherwise(F.octet_length(message)).cast("int")


def decode(stored: Column, enc: Column) -> Column:
    packed = F.when(enc == DEFLATED, stored)
    return F.when(enc == DEFLATED, _inflated(packed)).otherwise(stored.cast("string"))


def to_transport(stored: Column, enc: Column) -> Column:
    """Text for a JSON field: base64 if deflated."""
    return F.when(enc == DEFLATED, F.base64(stored)).otherwise(stored.cast("string"))


def from_transport(text: Column, enc: Column) -> Column:
    """Bytes of a JSON field; empty where base64 is broken."""
    return F.when(enc == DEFLATED, F.coalesce(F.try_to_binary(text, F.lit("base64")), F.lit(b""))).otherwise(text.cast("binary"))


def source_dir(source: Column) -> Column:
    """URL-safe base64 of a source's name."""
    return F.translate(F.base64(source.cast("binary")), "+/\r\n", "-_")


def source_key(source: Column) -> Column:
    """Partition value of a source; never empty."""
    return F.concat(F.lit("s_"), source_dir(source))


def source_of(key: Column) -> Column:
    """The source of a partition value."""
    return F.unbase64(F.translate(F.substring(key, 3, 1 << 30), "-_", "+/")).cast("string")


def source_of_dir(name: Column) -> Column:
    """The source of a base64 name; empty where that is broken."""
    return F.coalesce(F.try_to_binary(F.translate(name, "-_", "+/"), F.lit("base64")).cast("string"), F.lit(""))


def file_id(source: Column, hour_name: Column) -> Column:
    """Name of the file that holds a source's hour."""
    return F.concat(source_dir(source), F.lit("/"), hour_name)


def source_of_file(name: Column) -> Column:
    """The source of a file's name, which is cut at its first slash; empty where that is broken."""
    return source_of_dir(F.substring_index(name, "/", 1))


def hour_of_file(name: Column) -> Column:
    """The hour's name behind the first slash of a file's name."""
    return F.regexp_extract(name, "(?s)^[^/]*/(.*)$", 1)


def fingerprint(raw: Column) -> Column:
    """MD5 of bytes, as bytes: the seal of a block of state."""
    return F.unhex(F.md5(raw))


def entry_size(source: Column, stored: Column) -> Column:
    """Bytes of an entry in a store, given the message as it is stored."""
    return (F.lit(OVERHEAD) + F.octet_length(source) + F.octet_length(stored)).cast("long")


def entry_size_of(source: Column, stored_bytes: Column) -> Column:
    return (F.lit(OVERHEAD) + F.octet_length(source) + stored_bytes).cast("long")
