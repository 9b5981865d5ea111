"""Keyed lookups with the semantics of a table that is filled row by row: the last row of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


from corpusmill.session import checkpointed

#: Rows of one key in one task at most where a join deals hot keys, and keys of that kind that are broadcast at most.
HOT_ROWS, BROADCAST_KEYS = 100_000, 1_000_000


def last_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the greatest `position` of each key. max_by aggregates before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of `left` without a row in `right`."""
    return left.select(*keys).join(right.select(*keys), keys, "left_anti").distinct()


def require(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Raises KeyError if a key of `left` is missing in `right`. An action."""
    missing = orphans(left, right, keys).limit(5).collect()
    if missing:
        raise KeyError(f"{what}: no row for {[tuple(r) for r in missing]}")


def join_split(left: DataFrame, right: DataFrame, key: str, tie: str, how: str = "left", hot: int = HOT_ROWS) -> DataFrame:
    """`left` joined with `right` on `key`, whose rows in `right` are few for every key; a key of more than `hot` rows in `left` is dealt over
    as many parts as that takes, by the hash of column `tie`, and its rows in `right` are given to each.

    The keys of such counts are found by an aggregation of the key alone; they are broadcast if BROADCAST_KEYS hold them all, else joined."""
    heavy = checkpointed(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(key, F.ceil(F.col("_n") / hot).cast("int").alias("_parts")))
    n = heavy.count()
    if not n:
        return left.join(right, key, how)
    small = F.broadcast(heavy) if n <= BROADCAST_KEYS else heavy
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(small, key, "left").withColumn("_part", F.pmod(F.xxhash64(tie), parts).cast("int")).drop("_parts")
    every = right.join(small, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(every, [key, "_part"], how).drop("_part")
