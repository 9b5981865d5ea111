"""Positions and running totals within groups of any size, without a task that holds a group.

A window over a group puts all of it into one task; if a group holds a third of all rows, that task
is the job. Here the rows of a group are dealt into buckets by ranges of their (uniform) order hash.
Buckets are numbered, counted and summed by an aggregation; the totals of the buckets before give
each bucket its offset; a window inside the bucket does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that a bucket should hold.
BUCKET_ROWS = 50_000


def order_hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def ranked(df: DataFrame, group: list[str], order: Column, ties: list[str], weight: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`df` with _rank (from 1, by `order`, then `ties`) within `group` and, with `weight`, _before: the weight of the rows before.

    `order` must be spread evenly over 64-bit integers, as a hash is; _n is the size of the group,
    _weight its weight."""
    total = F.sum(weight) if weight else F.lit(None).cast("long")
    hashed = df.withColumn("_order", order)
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"), total.alias("_weight"))
    # an even cut of the range of the hash into as many buckets as the group's size asks for
    buckets = F.ceil(F.col("_n") / bucket_rows)
    placed = hashed.join(sizes, group).withColumn("_bucket", F.least(buckets - 1, F.floor((F.col("_order") / F.lit(2.0**64) + 0.5) * buckets)).cast("long"))
    by_bucket = placed.groupBy(*group, "_bucket").agg(F.count("*").alias("_rows"), (F.sum(weight) if weight else F.lit(0)).alias("_w"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(*group, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_order", *ties)
    out = placed.join(offsets, [*group, "_bucket"]).withColumn("_rank", F.col("_rows_before") + F.row_number().over(inside))
    if weight:
        running = inside.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.col("_w_before") + F.coalesce(F.sum(weight).over(running), F.lit(0)))
    return out.drop("_rows_before", "_w_before", "_bucket")
