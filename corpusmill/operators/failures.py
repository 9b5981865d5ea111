"""Why a retrieval missed: results without a gold chunk among their first five, sorted into causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as tx

from .lookup import last_per_key

TOP = 5


def misses(results: DataFrame, gold: DataFrame, ids: str = "retrieved_chunk_ids", key: str = "qid", top: int = TOP) -> DataFrame:
    """`results` rows none of whose first `top` ids is gold; adds `gold_ids`. Rows without a label are left out."""
    joined = results.join(gold.select(key, F.col("gold_chunk_ids").alias("gold_ids")), key)
    return joined.where(~F.arrays_overlap(F.slice(ids, 1, top), "gold_ids") | (F.size("gold_ids") == 0))


def _word_hashes(c: Column) -> Column:
    """Distinct words as 64-bit hashes, which are shorter to move and to compare."""
    return F.transform(tx.token_set(F.coalesce(c, F.lit(""))), lambda w: F.xxhash64(w))


def _shared(words: str) -> Column:
    """Share of the question's words that `words` has; 0.0 if it has no words."""
    return F.when(F.size("q_words") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("q_words", words)) / F.size("q_words"))


def categorize(missed: DataFrame, questions: DataFrame, chunks: DataFrame, result_key: str, ids: str = "retrieved_chunk_ids", question_key: tuple[str, ...] = ("qid",), question_position: str = "question_row", top: int = TOP) -> DataFrame:
    """result_key, the question's columns, gold_chunk_id, category, boundary_or_course, question_gold_overlap, best_retrieved_overlap.

    Causes in order: chunk_boundary (a retrieved chunk of the gold document or chapter), domain_confusion
    (none of the question's course), cross_lingual (the question is in uz), term_mismatch (a retrieved
    chunk shares more of the question's words than the gold one), other.

    `question_key` ("qid",) looks questions up by qid alone, the last one winning; with ("qid", "language")
    each result meets the question of its own language. Results whose first gold chunk is unknown are left
    out (`orphans` finds them); unknown retrieved chunks are ignored. Every text is cut into words once, and
    only the word sets of questions and chunks travel; they meet by equi-joins on chunk_id."""
    asked = last_per_key(questions.select(*question_key, F.col("course_id").alias("q_course"), F.col("language").alias("q_language"), "question_type", "question_text", question_position), list(question_key), question_position).drop(question_position)
    asked = asked.withColumn("q_words", _word_hashes(F.col("question_text")))
    table = chunks.groupBy("chunk_id").agg(F.max(F.struct("doc_id", "course_id", "text")).alias("c")).select("chunk_id", "c.doc_id", "c.course_id", _word_hashes(F.col("c.text")).alias("words"))
    base = missed.join(asked, list(question_key)).where(F.size("gold_ids") > 0).withColumn("gold_chunk_id", F.element_at("gold_ids", 1))
    gold = table.select(F.col("chunk_id").alias("gold_chunk_id"), F.col("doc_id").alias("gold_doc"), F.col("words").alias("gold_words"))
    base = base.join(gold, "gold_chunk_id").withColumn("question_gold_overlap", _shared("gold_words")).drop("gold_words")
    long = base.select(result_key, "q_words", "q_course", "gold_doc", "gold_chunk_id", F.explode(F.slice(ids, 1, top)).alias("chunk_id"))
    seen = long.join(table, "chunk_id").groupBy(result_key).agg(
        F.max(F.col("doc_id") == F.col("gold_doc")).alias("same_doc"),
        F.max(tx.chapter_prefix(F.col("chunk_id")) == tx.chapter_prefix(F.col("gold_chunk_id"))).alias("same_chapter"),
        F.max(F.coalesce(F.col("course_id") == F.col("q_course"), F.lit(False))).alias("same_course"),
        F.max(_shared("words")).alias("best"),
    )
    no = F.lit(False)
    joined = base.join(seen, result_key, "left")
    boundary = F.coalesce(F.col("same_doc"), no) | F.coalesce(F.col("same_chapter"), no)
    course, best = F.coalesce(F.col("same_course"), no), F.coalesce(F.col("best"), F.lit(0.0))
    category = F.when(boundary, "chunk_boundary").when(~course, "domain_confusion").when(F.col("q_language") == "uz", "cross_lingual").when(best > F.col("question_gold_overlap"), "term_mismatch").otherwise("other")
    named = {"q_course": "course_id"}
    kept = [c for c in joined.columns if c not in ("same_doc", "same_chapter", "same_course", "best", "gold_doc", "course_id", "q_words")]
    return joined.select(*[F.col(c).alias(named.get(c, c)) for c in kept], category.alias("category"), (boundary | course).alias("boundary_or_course"), F.round(best, 6).alias("best_retrieved_overlap")).withColumn("question_gold_overlap", F.round("question_gold_overlap", 6))


def retrieved_texts(rows: DataFrame, chunks: DataFrame, result_key: str, ids: str = "retrieved_chunk_ids", top: int = TOP) -> DataFrame:
    """result_key, retrieved_chunk_texts: the JSON array of the known retrieved chunks' texts, in order. `top` texts a row at most."""
    table = chunks.groupBy("chunk_id").agg(F.max("text").alias("text"))
    long = rows.select(result_key, F.posexplode(F.slice(ids, 1, top)).alias("pos", "chunk_id")).join(table, "chunk_id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return long.groupBy(result_key).agg(F.to_json(texts).alias("retrieved_chunk_texts"))


def counts(categorized: DataFrame) -> DataFrame:
    return categorized.groupBy("category", "language", "course_id").agg(F.count("*").alias("count"))


def samples(categorized: DataFrame, per_language: int = 10, languages: tuple[str, ...] = ("en", "uz"), ties: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of each language by category, qid and `ties`."""
    by = Window.partitionBy("language").orderBy("category", "qid", *ties)
    return categorized.where(F.col("language").isin(*languages)).withColumn("place", F.row_number().over(by)).where(F.col("place") <= per_language)
