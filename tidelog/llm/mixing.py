"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token target.  Complete epochs of the source come first;
the rest of the target is sampled without replacement: documents are put in
order of the exponential key ``-ln(u) / weight`` (``u`` from a hash of the id,
``weight`` from the quality of the text) and taken while their running token
sum is below the rest.  The last one is taken in part, so that every source
meets its target to a token.

A running sum over a source with a third of all rows would be one task's
work.  Keys are therefore cut into buckets along ``exp(-key)``, whose density
is bounded by the largest weight; sums of the buckets (a small table) give
each bucket its offset, and running sums stay within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKETS = 4096
#: Marks that stand out in junk; they lower the quality weight of a text.
MARKS = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """Weight from 1 (nothing but marks) to 4 (no marks); 1 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    clean, points = F.char_length(F.translate(text, MARKS, "")), F.char_length(text)
    return F.when(points > 0, F.lit(1.0) + F.lit(3.0) * clean.cast("double") / points.cast("double")).otherwise(F.lit(1.0))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> the same with ``target``.

    ``share`` of all sizes is dealt out by weight (repeating by code point of
    the source, null last).  A target stops at ``most`` times its source and
    the excess goes to the others by weight, until none is above; in order of
    ``most * size / weight`` that fixed point is one running sum.  There is one
    row per source, so the windows over the whole table are small.
    """
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("_w", F.element_at(table, (nth % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    all_rows = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_open", F.col("_cap") / F.col("_w") > F.col("_level"))
    level = F.max(F.when(F.col("_open"), F.col("_level"))).over(all_rows)
    return t.select("source", "source_size", F.when(F.col("_open"), level * F.col("_w")).otherwise(F.col("_cap")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, epochs, part, taken.

    ``epochs`` whole copies and the first ``part`` words of one more are
    taken; ``taken = epochs * size + part``.  A null text has size 0, a null
    source is a source of its own, null ids share one random number.  Equal
    keys go by id, then size (larger first), then a hash of the text, so that
    reruns agree; repeated rows are rows of their own.  Empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, share, most, buckets)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return plan.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "epochs", "part", taken.alias("taken"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """_id, source, size, _hash (of the text), source_size, target, epochs, part for every row."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    unit = (F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    sized = docs.select(
        ident.alias("_id"),
        F.col(f"`{source_col}`").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("_hash"),
        (-F.log(unit) / quality(text)).alias("_key"),
    )
    sized = staged(sized.withColumn("_bucket", F.least(F.floor(F.exp(-F.col("_key")) * buckets), F.lit(buckets - 1)).cast("int")), "mix-sizes")

    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    goals = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target")
    plan = offsets.join(goals, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_s",
        F.col("_bucket").alias("_b"),
        "_offset",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
    )
    within = Window.partitionBy("source", "_bucket").orderBy("_key", F.asc_nulls_last("_id"), F.desc("size"), "_hash").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_offset") - F.col("_before")))
    out = ordered.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return out.select("_id", "source", "size", "_hash", "source_size", "target", "epochs", part.alias("part"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, blanks between words kept."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs`` with rows repeated, dropped and, one in a source, cut.

    Columns are those of ``docs``, whatever their names.  Rows that agree in
    id, source and text take what is taken of them together, in an order by
    their other columns; only they are numbered in a window.
    """
    keys = ["_id", "source", "size", "_hash"]
    per = _plan(docs, id_col, text_col, source_col, **options).groupBy(*keys).agg(F.first("epochs").alias("_epochs"), F.sum("part").alias("_p"), F.count(F.lit(1)).alias("_rows"))
    per = per.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_epochs", "_p", "_rows").where("_epochs > 0 or _p > 0")
    text = F.col(f"`{text_col}`").cast("string")
    own = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_hash")]
    rows = docs.select(*own, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    rows = rows.join(per, same)
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*[f"_c{i}" for i in range(len(docs.columns))]))
    rows = rows.where("_rows = 1").withColumn("_nth", F.lit(1)).unionByName(rows.where("_rows > 1").withColumn("_nth", F.row_number().over(order)))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_p") - (F.col("_nth") - 1) * F.col("size")))
    rows = rows.withColumn("_part", part)
    # a whole last copy counts as an epoch; a cut one is its own row
    copies = (F.col("_epochs") + F.when((F.col("_part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("int")
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("size"))
    pieces = F.flatten(F.array(F.array_repeat(F.lit(-1).cast("long"), copies), F.when(cut, F.array(F.col("_part"))).otherwise(F.array().cast("array<bigint>"))))
    out = rows.withColumn("_piece", F.explode(pieces))
    at = {c: F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    taken = F.when(F.col("_piece") < 0, at[text_col]).otherwise(first_words(at[text_col].cast("string"), F.col("_piece")))
    return out.select(*[(taken if c == text_col else own).alias(c) for c, own in at.items()])
