"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are equal when they agree after all ASCII blanks are deleted.  Copies
are combined in three steps, each of which groups by digest *and* content:

1. within every task (the partial aggregation of step 2);
2. within (digest, salt), where the salt comes from the document id, so that
   a group with a third of all rows is dealt out over ``salts`` tasks;
3. over the winners of the salts, at most one row for each salt and text.

What comes out is a small table of classes without texts.  It is staged, and
every row finds its class by (digest, salt).  If two contents ever share a
digest, those digests' rows are told apart by content once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import BLANKS, staged

SALTS = 64  # a bit of a 64-bit mask each
_ID_SPAN = "cast('36893488147419103232' as decimal(20,0))"  # 2 ** 65
_ID_SHIFT = "cast('9223372036854775808' as decimal(20,0))"  # 2 ** 63


def normalised(text: Column) -> Column:
    """The text without ASCII blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The row that stays has the most code points in its original text, then
    the smallest id; of repeated rows with that id, one stays.  A null id
    comes after every other and keeps its null.  A null text counts as empty,
    so null, empty and blank texts are one group.  Ids are integers; other
    columns are ignored, whatever their names, or returned behind the five
    with ``carry`` (a column of one of the five names is then left out, the id
    excepted).  An empty table gives no rows.  ``digest``
    may be weak: contents are compared everywhere.
    """
    if not 1 <= salts <= SALTS:
        raise ValueError(f"salts must be 1 to {SALTS}")
    made = {"keep_id", "group_size", "kept", "text_sha256"}
    extra = [c for c in docs.columns if c != id_col and c not in made] if carry else []
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        normalised(text).alias("_norm"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("_points"),
        *[F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(extra)],
    ).withColumns({"_digest": digest(F.col("_norm")).cast("string"), "_salt": F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")})

    # the order "most points, then smallest id" as one decimal, which hash aggregation can hold
    rank = F.expr(f"cast(_points as decimal(10,0)) * {_ID_SPAN} - coalesce(cast(_id as decimal(20,0)) + {_ID_SHIFT}, {_ID_SHIFT} + {_ID_SHIFT})")
    salted = rows.groupBy("_digest", "_salt", "_norm").agg(F.max(rank).alias("_best"), F.count(F.lit(1)).alias("_n"))
    whole = salted.groupBy("_digest", "_norm").agg(
        F.max("_best").alias("_best"), F.sum("_n").alias("_n"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask")
    )
    back = F.expr(f"pmod(-_best, {_ID_SPAN})")
    classes = whole.select(
        "_digest",
        F.when(back < F.expr(f"{_ID_SHIFT} + {_ID_SHIFT}"), (back - F.expr(_ID_SHIFT)).cast("long")).alias("keep_id"),
        F.col("_n").alias("group_size"),
        "_mask",
        F.xxhash64("_norm").alias("_class"),
    )
    classes = staged(classes.withColumn("_texts", F.count(F.lit(1)).over(Window.partitionBy("_digest"))), "exact-classes")

    by_salt = classes.where("_texts = 1").select(
        "_digest", "keep_id", "group_size", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> shiftright(_mask, s) & 1L = 1L)")).alias("_salt")
    )
    slim = rows.drop("_norm")
    found = slim.join(by_salt, ["_digest", "_salt"])
    if not classes.where("_texts > 1").isEmpty():
        found = found.unionByName(_told_apart(rows, classes.where("_texts > 1")))
    # of repeated rows with the id that stays, one stays; (digest, salt) already has them in one task
    nth = F.row_number().over(Window.partitionBy("_digest", "_salt", "_id").orderBy(F.desc("_points")))
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"),
        (F.col("_digest") if digest is sha256 else sha256(normalised(F.col(f"_x{extra.index(text_col)}"))) if text_col in extra else F.lit(None).cast("string")).alias("text_sha256"),
        *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)],
    )


def _told_apart(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose digest stands for several contents, matched by content."""
    few = rows.join(classes.select("_digest").distinct(), "_digest", "left_semi")
    salted = few.groupBy("_digest", "_salt", "_norm").agg(F.count(F.lit(1)).alias("_c"))
    texts = salted.groupBy("_digest", "_norm").agg(F.sum("_c").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask"))
    # a class is found again by its winner: the row of that id, told by a second hash, has the class's content
    known = classes.select("_digest", F.col("keep_id").alias("_k"), "_class")
    named = few.withColumn("_class", F.xxhash64("_norm")).join(known, ["_digest", "_class"]).where(F.col("_id").eqNullSafe(F.col("_k")))
    winners = texts.join(named.select("_digest", "_norm", F.col("_k").alias("keep_id")).distinct(), ["_digest", "_norm"])
    by_salt = winners.select(
        "_digest", "_norm", "keep_id", "group_size", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftright(_mask, s) & 1L = 1L)")).alias("_salt")
    )
    return few.join(by_salt, ["_digest", "_salt", "_norm"]).drop("_norm")
