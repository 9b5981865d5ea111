"""Scores of ranked lists: hit rates, reciprocal rank, discounted gain; their means by slice; significance of differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import stats

METRICS = ("recall_at_1", "recall_at_3", "recall_at_5", "mrr_at_10", "ndcg_at_10")
#: Names of the metrics in written reports.
SINK_NAMES = {"recall_at_1": "Recall@1", "recall_at_3": "Recall@3", "recall_at_5": "Recall@5", "mrr_at_10": "MRR@10", "ndcg_at_10": "nDCG@10"}


def _positions(ranked: Column, gold: Column) -> Column:
    """Places, from 1, at which a list has a gold item."""
    flags = F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return F.array_compact(flags)


def hit(places: Column, k: int) -> Column:
    """1.0 if a gold item is among the first k."""
    return F.when(F.exists(places, lambda p: p <= k), F.lit(1.0)).otherwise(F.lit(0.0))


def reciprocal_rank(places: Column, cutoff: int = 10) -> Column:
    first = F.array_min(F.filter(places, lambda p: p <= cutoff))
    return F.coalesce(1.0 / first, F.lit(0.0))


def _gain(places: Column) -> Column:
    """Sum of 1 / discount, the discount being 1 at place 1 and log2(place) after it."""
    return F.aggregate(places, F.lit(0.0), lambda total, p: total + F.when(p == 1, F.lit(1.0)).otherwise(1.0 / F.log2(p.cast("double"))))


def ndcg(places: Column, n_gold: Column, cutoff: int = 10) -> Column:
    best = F.least(n_gold, F.lit(cutoff))
    ideal = F.when(best > 0, _gain(F.sequence(F.lit(1), F.greatest(best, F.lit(1))))).otherwise(F.lit(0.0))
    return F.when(ideal == 0, F.lit(0.0)).otherwise(_gain(F.filter(places, lambda p: p <= cutoff)) / ideal)


def score(results: DataFrame, gold: DataFrame, ids: str = "retrieved_chunk_ids", gold_ids: str = "gold_chunk_ids", key: str = "qid") -> DataFrame:
    """`results` rows with a gold label, and their metrics. Both lists are in the row: one join, no window, no regrouping.

    A place is the index in the list. `gold` has one row per key. An empty gold set scores 0."""
    joined = results.join(gold.select(key, F.array_distinct(gold_ids).alias("_gold")), key)
    places = joined.withColumn("_places", _positions(F.col(ids), F.col("_gold")))
    metrics = {f"recall_at_{k}": hit(F.col("_places"), k) for k in (1, 3, 5)}
    metrics |= {"mrr_at_10": reciprocal_rank(F.col("_places")), "ndcg_at_10": ndcg(F.col("_places"), F.size("_gold"))}
    return places.withColumns(metrics).drop("_places", "_gold")


def _aggregates(metrics: tuple[str, ...]) -> list[Column]:
    return [x for m in metrics for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 6).alias(f"{m}_std"))]


def aggregate(scored: DataFrame, groups: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and sample deviation of every metric per group."""
    return scored.groupBy(*groups).agg(*_aggregates(metrics))


def reports(scored: DataFrame, system: str = "system", slices: tuple[str, ...] = ("course_id", "language", "question_type"), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """The report by system and those by system and each slice, in one pass of grouping sets; `report` names the slice."""
    sets = [[system], *[[system, s] for s in slices]]
    table = scored.groupingSets([[F.col(c) for c in s] for s in sets], system, *slices).agg(F.grouping_id().alias("_set"), *_aggregates(metrics))
    n = len(slices)
    by_id = {(1 << n) - 1: "overall"} | {((1 << n) - 1) & ~(1 << (n - 1 - i)): f"by_{s}" for i, s in enumerate(slices)}
    name = F.create_map(*[F.lit(x) for pair in by_id.items() for x in pair])
    value = F.coalesce(*[F.col(s) for s in slices])
    return table.select(name[F.col("_set").cast("int")].alias("report"), system, value.alias("slice"), *[f"{m}_{x}" for m in metrics for x in ("mean", "std")])


# ------------------------------------------------------------------ significance


def _pairs(scored: DataFrame, unit: list[str], group: list[str], system: str, metrics: tuple[str, ...]) -> DataFrame:
    """group, metric, system_a, system_b, d: paired differences; repeated scores of a unit are averaged, as a pivot does."""
    long = scored.unpivot([*unit, *group, system], list(metrics), "metric", "value")
    mean = long.groupBy(*unit, *group, system, "metric").agg(F.avg("value").alias("value"))
    a = mean.select(*unit, *group, "metric", F.col(system).alias("system_a"), F.col("value").alias("a"))
    b = mean.select(*unit, *group, "metric", F.col(system).alias("system_b"), F.col("value").alias("b"))
    return a.join(b, [*unit, *group, "metric"]).where("system_a < system_b").withColumn("d", F.round(F.col("a") - F.col("b"), 10))


def significance(scored: DataFrame, unit: list[str] = ["qid"], group: list[str] = ["language"], system: str = "system", metrics: tuple[str, ...] = ("recall_at_5", "mrr_at_10", "ndcg_at_10")) -> DataFrame:  # noqa: B006
    """Per group, metric and pair of systems: Wilcoxon's statistic and p (zeros split, normal approximation), Cohen's d, n.

    Ranks need no window over all differences of a group: equal absolute differences are counted first, a
    table with a row per distinct value, whose running total gives the average ranks."""
    by = [*group, "metric", "system_a", "system_b"]
    diffs = _pairs(scored, unit, group, system, metrics)
    effect = diffs.groupBy(*by).agg(F.count("*").alias("n"), stats.cohens_d(F.col("d")).alias("cohens_d"))
    sizes = diffs.groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("plus"), F.sum((F.col("d") < 0).cast("long")).alias("minus"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("t") + 1) / F.lit(2.0))
    half = F.when(F.col("size") == 0, F.col("t") * F.col("rank") / 2.0).otherwise(F.lit(0.0))
    sums = ranked.groupBy(*by).agg(F.sum(F.col("plus") * F.col("rank") + half).alias("r_plus"), F.sum(F.col("minus") * F.col("rank") + half).alias("r_minus"), F.sum(F.pow(F.col("t").cast("double"), 3.0) - F.col("t")).alias("ties"), F.sum(F.when(F.col("size") > 0, F.col("t")).otherwise(0)).alias("n_nonzero"))
    table = sums.join(effect, by)
    n = F.col("n").cast("double")
    statistic = F.least("r_plus", "r_minus")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("ties") / 2.0) / 24.0
    z = F.abs(statistic - n * (n + 1) / 4.0) / F.sqrt(variance)
    same = F.col("n_nonzero") == 0
    return table.select(
        "metric",
        *group,
        "system_a",
        "system_b",
        F.when(same, F.lit(0.0)).otherwise(statistic).alias("wilcoxon_statistic"),
        F.when(same | (variance <= 0), F.lit(1.0)).otherwise(F.round(stats.erfc(z / 1.4142135623730951), 6)).alias("p_value"),
        F.round("cohens_d", 6).alias("cohens_d"),
        "n",
    )


def significance_by_system(scored: DataFrame, unit: list[str] = ["qid", "language"], metric: str = "recall_at_5") -> DataFrame:  # noqa: B006
    """The older shape: left, right, metric, p_value over all units, without a group."""
    table = significance(scored.withColumn("_all", F.lit(1)), unit, ["_all"], "system", (metric,))
    return table.select(F.col("system_a").alias("left"), F.col("system_b").alias("right"), "metric", "p_value")


# ------------------------------------------------------------------ agreement


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two label columns, one row; 0.0 for no pairs, 1.0 where chance agreement is certain.

    Only the table of label pairs is joined with its margins."""
    table = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = table.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na")), table.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    seen = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / F.pow(F.col("n").cast("double"), 2.0)
    value = F.when(F.col("n") == 0, F.lit(0.0)).when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))
    return seen.join(F.broadcast(chance)).select("n", F.round(F.when(F.col("n") == 0, F.lit(0.0)).otherwise(po), 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def label_shares(rows: DataFrame, group: str, label: str, labels: list[str]) -> DataFrame:
    """Per group, the share of each of `labels`; absent ones 0."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(F.when(F.col(label) == x, 1).otherwise(0)).alias(f"_{x}") for x in labels])
    return counts.select(group, *[F.round(F.col(f"_{x}") / F.col("n"), 6).alias(x) for x in labels])
