"""The data behind charts and printed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.functions import stats


def recall_bars(by_language: DataFrame, metric: str = "recall_at_5", n: int = 120) -> DataFrame:
    """language, system, mean, ci95."""
    return by_language.select("language", "system", F.col(f"{metric}_mean").alias("mean"), F.round(stats.ci95(F.col(f"{metric}_std"), n), 6).alias("ci95"))


def heatmap(by_course: DataFrame, by_language: DataFrame, courses: list[str], metric: str = "recall_at_5") -> DataFrame:
    """system, language and a column per course: courses joined with the languages of each system, whose values are then the same."""
    pairs = by_language.select("system", "language").distinct()
    return by_course.join(pairs, "system").groupBy("system", "language").pivot("course_id", courses).agg(F.round(F.avg(f"{metric}_mean"), 6))


def cross_lingual_gap(by_language: DataFrame, first: str = "en", second: str = "uz", metric: str = "recall_at_5") -> DataFrame:
    """system, the two languages' means, gap."""
    value = lambda x: F.avg(F.when(F.col("language") == x, F.col(f"{metric}_mean")))
    table = by_language.groupBy("system").agg(value(first).alias(first), value(second).alias(second))
    return table.withColumn("gap", F.round(F.col(first) - F.col(second), 6))


def error_stack(counts: DataFrame, categories: list[str]) -> DataFrame:
    """language and a count per category; absent ones 0."""
    return counts.groupBy("language").pivot("category", categories).agg(F.sum("count")).fillna(0, categories)


def benchmark_stats(questions: DataFrame) -> DataFrame:
    return questions.groupBy("course_id", "language", "question_type").agg(F.count("*").alias("count"))


def first_rows(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group: taken in every partition first, so a hot group is no hot task."""
    by = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def latex(table: DataFrame, order: list[str]) -> str:
    """A small table as LaTeX with booktabs rules, unescaped. Collects: for reports of a few rows."""
    rows = table.orderBy(*order).collect()
    head = " & ".join(table.columns) + r" \\"
    body = [" & ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + r" \\" for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", ""])
