"""A corpus pipeline over ``documents``: quality, copies, near copies, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import ngram_join
from tidelog.llm.common import new_path
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.mixing import mixed_rows
from tidelog.llm.packing import pack
from tidelog.llm.quality import judge, train
from tidelog.llm.tokens import added_tokens


def plainly_named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of names that no operator uses, and those names by the old ones."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def as_before(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts and the line labeller keep."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named, names = plainly_named(docs)
    return as_before(judge(named, model, names["text"]).where("kept"), names)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    named, names = plainly_named(docs)
    return as_before(exact_dedup(named, names["doc_id"], names["text"], carry=True).where("kept"), names)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the row with the smallest id."""
    named, names = plainly_named(docs)
    return as_before(ngram_join.without_near_copies(named, names["doc_id"], names["text"]), names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes: documents repeated, left out or, one in a source, cut."""
    named, names = plainly_named(docs)
    return as_before(mixed_rows(named, names["doc_id"], names["text"], names["source"]), names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row per piece of a document."""
    return pack(docs, added=added_tokens())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the labeller nor the packer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
