"""The queries of this package, by problem number, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.session import checkpointed
from corpusmill.tables import Tables

from . import canonical, content, encoding, language, mixing, neardup, pairs, sampling, splitting, truncation

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


@_query
def p1_found(t: Tables) -> DataFrame:
    return pairs.detect(t.questions, t.answers, t.lang_samples).where("defect is not null").select("field", "record_row", "defect")


@_query
def p1_pairs(t: Tables) -> DataFrame:
    return pairs.detect(t.questions, t.answers, t.lang_samples)


@_query
def p3_found(t: Tables) -> DataFrame:
    return truncation.detect(t.questions, t.answers).where("cut").select("field", "record_row")


@_query
def p3_rates(t: Tables) -> DataFrame:
    """Share of cut values per answers.run_id, answers.system, questions.course_id and questions.language."""
    return truncation.rates(t.questions, t.answers)


BOTH = ["question_text", "reference_answer"]


@_query
def p2_found(t: Tables) -> DataFrame:
    return language.issues(t.questions, "question_row", BOTH, "language", t.lang_samples)


@_query
def p2_languages(t: Tables) -> DataFrame:
    return language.detect(t.questions, "question_row", BOTH, t.lang_samples, with_segments=False).select("question_row", "field", "language", "confidence", "mixed")


@_query
def p2_segments(t: Tables) -> DataFrame:
    """Every segment of every value: its place, language and confidence."""
    found = language.detect(t.questions, "question_row", BOTH, t.lang_samples)
    return found.select("question_row", "field", F.posexplode("segments").alias("segment", "s")).select("question_row", "field", "segment", "s.start", "s.n_chars", "s.language", "s.confidence")


@_query
def p5_found(t: Tables) -> DataFrame:
    return canonical.changed(t.questions, "question_row", BOTH)


@_query
def p5_consistent(t: Tables) -> DataFrame:
    return canonical.consistent(t.questions.select("question_row", *BOTH), "question_row", BOTH)


def _record_texts(t: Tables) -> DataFrame:
    rows = canonical.consistent(t.questions.select("question_row", *BOTH), "question_row", BOTH)
    return rows.select("question_row", neardup.record_text(F.col("question_text"), F.col("reference_answer")).alias("text"))


@_query
def p6_found(t: Tables) -> DataFrame:
    found = neardup.similar_rows(_record_texts(t), "question_row", "text", 0.75)
    return found.select(F.col("a").alias("question_row_a"), F.col("b").alias("question_row_b"))


@_query
def p6_groups(t: Tables) -> DataFrame:
    """question_row, item (its class of equal word sets), n_links, component."""
    return neardup.classes(_record_texts(t), "question_row", "text", 0.75)


@_query
def p4_found(t: Tables) -> DataFrame:
    return sampling.plan(t.questions, t.sample_targets).where("short").select("course_id", "question_type")


_SQL["p4_found"] = """
WITH pool AS (SELECT course_id, lower(trim(question_type)) AS question_type FROM questions WHERE course_id IS NOT NULL AND question_type IS NOT NULL),
counts AS (SELECT course_id, question_type, count(*) AS n FROM pool GROUP BY ALL),
size AS (SELECT (SELECT count(*) FROM pool) // 4 AS sample_size)
SELECT t.course_id, t.question_type FROM sample_targets t CROSS JOIN size LEFT JOIN counts c ON c.course_id = t.course_id AND c.question_type = t.question_type
WHERE coalesce(c.n, 0) < greatest(t.min_rows, (t.share_permille * sample_size + 999) // 1000)
"""


@_query
def p4_sample(t: Tables) -> DataFrame:
    """The sampled rows."""
    return sampling.draw(t.questions, t.sample_targets, "question_row").select("question_row", "course_id", "question_type", "rank")


@_query
def p4_report(t: Tables) -> DataFrame:
    """Every category: what it needs, holds and gets."""
    return sampling.plan(t.questions, t.sample_targets)


def _items(t: Tables) -> DataFrame:
    return splitting.items_of(t.documents, t.chunks)


@_query
def p7_found(t: Tables) -> DataFrame:
    return splitting.split(_items(t), oversized_only=True).where("chunk_index = 0").select("item_kind", "item_key")


_SQL["p7_found"] = r"""
SELECT 'document' AS item_kind, CAST(doc_id AS VARCHAR) AS item_key FROM documents WHERE len(regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) > 512
UNION ALL
SELECT DISTINCT 'chunk', chunk_id FROM chunks WHERE len(regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) > 512
"""


@_query
def p7_pieces(t: Tables) -> DataFrame:
    """The pieces of the oversized items."""
    return splitting.split(_items(t), oversized_only=True)


@_query
def p8_ids(t: Tables) -> DataFrame:
    return encoding.encode(t.documents)


@_query
def p9_mixture(t: Tables) -> DataFrame:
    """The mixture: documents in order of slot and place, with their copies."""
    return mixing.mix(t.documents, t.sources)


@_query
def p9_shares(t: Tables) -> DataFrame:
    """Per source: target and reached share."""
    counted = checkpointed(encoding.token_counts(t.documents, ["doc_id", "source"]))
    return mixing.report(mixing.mix(t.documents, t.sources, counted=counted), counted, t.sources)


@_query
def p10_found(t: Tables) -> DataFrame:
    return content.found(content.score(t.documents, t.content_samples))


@_query
def p10_scores(t: Tables) -> DataFrame:
    """Every document's scores."""
    return content.score(t.documents, t.content_samples)


@_query
def p10_rates(t: Tables) -> DataFrame:
    """Per source: documents, cases and their rates."""
    return content.rates(content.score(t.documents, t.content_samples, keep=("source",)))
