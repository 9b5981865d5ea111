"""A sample whose categories hold target shares, with a minimum of each, by divisor-method priorities.

Every row of a category gets a random rank r in it, by a seeded hash; its priority is (r - 0.5) / target.
The rows up to a category's minimum come first, then the globally smallest priorities, until the sample
is full. A category that runs out of rows drops out of the contest, and its seats go to the others by the
same order. As the priorities of a category depend on ranks alone, the number of seats of each category
follows from the category counts; the rows are then those with a rank up to it.

Rows with a null in a category column are not in the pool; neither are rows of categories without a
target in the sample. Category values are trimmed and, if asked, put in lower case. An empty pool gives
an empty sample and a report in which every category falls short. Ties of the hash are broken by key,
ties of priorities by category. Targets repeated for a category count once (the greatest). Extra columns
of the pool pass through; those of the targets are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import ranks

SEED = 42
#: Share of the pool that is drawn: one row in POOL_PART.
POOL_PART = 4


def pool(rows: DataFrame, course: str = "course_id", kind: str = "question_type") -> DataFrame:
    return rows.where(F.col(course).isNotNull() & F.col(kind).isNotNull()).withColumn(kind, F.lower(F.trim(kind)))


def seats(counts: list[int], shares: list[float], floors: list[int], size: int) -> list[int]:
    """Seats of each category: floors first, then the smallest (rank - 0.5) / share, while rows last.

    A bisection finds the priority under which all but the last few seats lie; a heap fills those."""
    got = [min(c, f) for c, f in zip(counts, floors)]
    left = size - sum(got)
    if left <= 0:
        # the floors alone fill the sample; the smallest priorities among them stay
        order = sorted((((r + 0.5) / s if s > 0 else float("inf")), i) for i, (g, s) in enumerate(zip(got, shares)) for r in range(g))[:size]
        out = [0] * len(counts)
        for _, i in order:
            out[i] += 1
        return out
    live = [i for i in range(len(counts)) if shares[i] > 0 and counts[i] > got[i]]
    under = lambda p, i: max(0, min(counts[i], int(p * shares[i] + 0.5)) - got[i])  # noqa: E731 - ranks with (r - 0.5) / share <= p
    low, high = 0.0, max([(counts[i] + 1) / shares[i] for i in live], default=0.0)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(under(mid, i) for i in live) <= left:
            low = mid
        else:
            high = mid
    for i in live:
        n = under(low, i)
        got[i] += n
        left -= n
    heap = [((got[i] + 0.5) / shares[i], i) for i in live if got[i] < counts[i]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < counts[i]:
            heapq.heappush(heap, ((got[i] + 0.5) / shares[i], i))
    return got


def plan(rows: DataFrame, targets: DataFrame, course: str = "course_id", kind: str = "question_type") -> DataFrame:
    """Per category of `targets`: pool_rows, need, n_seats, sample_size, share_permille (target), reached_permille, short
    (fewer rows than needed), unmet (fewer seats than needed: short, or minimums that overfill the sample).

    need = max(min_rows, ceil(share * sample size / 1000)). One aggregation of the pool; the seats are
    dealt in one task over the categories of the targets, a table that does not grow with the pool."""
    categories = [course, kind]
    counts = pool(rows, *categories).groupBy(*categories).agg(F.count("*").alias("pool_rows"))
    total = counts.agg(F.floor(F.coalesce(F.sum("pool_rows"), F.lit(0)) / POOL_PART).cast("long").alias("sample_size"))
    wanted = targets.groupBy(*categories).agg(F.max("share_permille").cast("long").alias("share_permille"), F.max("min_rows").cast("long").alias("min_rows"))
    table = wanted.join(counts, categories, "left").withColumn("pool_rows", F.coalesce("pool_rows", F.lit(0)).cast("long")).join(F.broadcast(total))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True) if batches else pd.DataFrame()
        pdf = pdf.sort_values(categories, ignore_index=True)
        if len(pdf):
            size = int(pdf["sample_size"].iloc[0])
            pdf["n_seats"] = seats(list(pdf["pool_rows"]), [float(x or 0) for x in pdf["share_permille"].fillna(0)], [int(x) for x in pdf["min_rows"].fillna(0)], size)
        else:
            pdf["n_seats"] = []
        yield pdf[[*categories, "share_permille", "min_rows", "pool_rows", "sample_size", "n_seats"]]

    one = table.select(*categories, "share_permille", "min_rows", "pool_rows", "sample_size").coalesce(1)
    dealt = one.mapInPandas(deal, f"{course} string, {kind} string, share_permille long, min_rows long, pool_rows long, sample_size long, n_seats long")
    need = F.greatest(F.coalesce("min_rows", F.lit(0)), F.expr("(coalesce(share_permille, 0) * sample_size + 999) div 1000"))
    return dealt.withColumn("need", need).withColumn("reached_permille", F.round(1000 * F.col("n_seats") / F.greatest(F.col("sample_size"), F.lit(1)), 3)).withColumn("short", F.col("pool_rows") < F.col("need")).withColumn("unmet", F.col("n_seats") < F.col("need"))


def draw(rows: DataFrame, targets: DataFrame, key: str, course: str = "course_id", kind: str = "question_type", seed: int = SEED) -> DataFrame:
    """The sampled rows of the pool, with their rank in the category and the category's seats."""
    categories = [course, kind]
    dealt = plan(rows, targets, *categories).where("n_seats > 0").select(*categories, "n_seats")
    # categories without seats leave before anything is ranked
    candidates = pool(rows, *categories).join(dealt, categories)
    placed = ranks.ranked(candidates, categories, ranks.order_hash(seed, F.col(key)), [key])
    return placed.where(F.col("_rank") <= F.col("n_seats")).withColumnRenamed("_rank", "rank").drop("_order", "_n", "_weight")
