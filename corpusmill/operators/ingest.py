"""From files of sections to documents, and what a corpus holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import text as tx

from .lookup import last_per_key


def build_documents(sections: DataFrame, toc: DataFrame, courses: DataFrame, today: str | None = None) -> DataFrame:
    """sections(course_id, section_slug, text), toc(course_id, section_slug, title, url, _pos), courses(course_id, doc_prefix, license, source_type, base_url).

    Titles default to the slug in title case, urls to base_url/slug. The date is a parameter; today's by default."""
    titles = last_per_key(toc.select("course_id", "section_slug", "title", "url", "_pos"), ["course_id", "section_slug"], "_pos").drop("_pos")
    joined = sections.join(courses, "course_id").join(titles, ["course_id", "section_slug"], "left")
    date = F.lit(today) if today else F.date_format(F.current_date(), "yyyy-MM-dd")
    return joined.select(
        tx.section_identifier(F.col("section_slug"), F.col("doc_prefix")).alias("doc_id"),
        "course_id",
        F.coalesce("title", F.initcap(F.replace("section_slug", F.lit("-"), F.lit(" ")))).alias("title"),
        "source_type",
        "license",
        F.coalesce("url", F.concat_ws("/", "base_url", "section_slug")).alias("source_url"),
        date.alias("download_date"),
        tx.normalize_whitespace(F.col("text")).alias("text"),
    )


def corpus_stats(documents: DataFrame, group: str = "course_id") -> DataFrame:
    """n_documents and n_words per group, and in all (group null): one pass of grouping sets."""
    words = documents.select(group, tx.n_words(F.col("text")).alias("n"))
    table = words.groupingSets([[F.col(group)], []], group).agg(F.grouping(group).alias("all_groups"), F.count("*").alias("n_documents"), F.sum("n").alias("n_words"))
    return table.select(F.when(F.col("all_groups") == 1, F.lit("(all)")).otherwise(F.col(group)).alias(group), "n_documents", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def licenses(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Courses of the corpus with the licences that a manifest has for them; several manifest rows give several rows."""
    return documents.select("course_id").distinct().join(manifest.select("course_id", "license").distinct(), "course_id", "left")
