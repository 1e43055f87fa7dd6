"""Shared pieces of the corpus operators: staging tables, batches and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks, i.e. the characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, as a regular expression that Java and RE2 both take.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the session has it; a folder of our own
    only where that is unset and everything runs in one process, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    It cuts the lineage: what follows neither recomputes the plan nor depends
    on executors that held its shuffle files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; 0 for an empty table."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of some columns, converted a slice at a time to bound memory."""
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


class Emitter:
    """Collects output rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_rows: int = 8192, most_bytes: int = 8 << 20):
        self.schema, self.most_rows, self.most_bytes = schema, most_rows, most_bytes
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, weight: int = 0) -> None:
        self.rows.append(row)
        self.bytes += weight

    def full(self) -> bool:
        return len(self.rows) >= self.most_rows or self.bytes >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        by_column = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        arrays = [pa.array(v, type=f.type) for v, f in zip(by_column, self.schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
