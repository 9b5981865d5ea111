"""Whether answers rest on what was retrieved: clean-up, automatic labels, review and annotation sheets, agreement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as tx

from . import evaluation
from .lookup import last_per_key

# Labels that annotators may give.
LABELS = ("correct_grounded", "partially_correct", "unsupported", "hallucinated")


def postprocess(answers: DataFrame, raw: str = "answer", ids: str = "retrieved_chunk_ids", language: str = "language") -> DataFrame:
    """`answers` with answer (cut at the end token and at the markers), generation_failure, valid_citation_count, abstained.

    Failures in order, joined by bars: language_mismatch (English with under 70 % ASCII), invalid_citations
    (a cited id that was not retrieved), empty_answer. Repeated citations count each."""
    text = tx.strip_after_markers(tx.before_end_token(F.coalesce(F.col(raw), F.lit(""))))
    cited = tx.citations(text)
    valid = F.filter(cited, lambda x: F.array_contains(F.col(ids), x))
    failure = F.concat_ws(
        "|",
        F.when((F.col(language) == "en") & (tx.ascii_ratio(text) < 0.7), F.lit("language_mismatch")),
        F.when(F.size(valid) < F.size(cited), F.lit("invalid_citations")),
        F.when(text == "", F.lit("empty_answer")),
    )
    return answers.withColumns({"answer": text, "generation_failure": failure, "valid_citation_count": F.size(valid), "abstained": text == tx.ABSTENTION})


def assess(answers: DataFrame, gold: DataFrame, key: str = "qid") -> DataFrame:
    """`answers` rows with a gold label, and review, auto_label, reason. Rules in order, the first that holds."""
    joined = answers.join(gold.select(key, "gold_chunk_ids"), key)
    retrieved = F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>"))
    text = F.coalesce("answer", F.lit(""))
    has_gold = F.size(F.array_intersect(retrieved, F.col("gold_chunk_ids"))) > 0
    abstained = F.coalesce("abstained", F.lit(False)) | (tx.strip(text) == tx.ABSTENTION)
    cited = tx.citations(text)
    reason = (
        F.when(abstained & ~has_gold, "auto_unsupported_no_gold")
        .when(abstained, "review_abstained_with_gold")
        .when(F.size(cited) == 0, "review_missing_citations")
        .when(F.size(F.array_intersect(cited, retrieved)) == 0, "review_invalid_citations")
        .when(~has_gold, "review_no_gold_retrieved")
        .otherwise("auto_grounded_with_gold")
    )
    label = F.when(F.col("reason") == "auto_unsupported_no_gold", "unsupported").when(F.col("reason") == "auto_grounded_with_gold", "correct_grounded").otherwise("")
    return joined.withColumn("reason", reason).withColumn("auto_label", label).withColumn("review", F.col("reason").startswith("review"))


def review_summary(assessed: DataFrame) -> DataFrame:
    """kind (reason, label), value, count."""
    pairs = F.array(F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("value")), F.struct(F.lit("label").alias("kind"), F.col("auto_label").alias("value")))
    return assessed.select(F.inline(pairs)).where("value != ''").groupBy("kind", "value").agg(F.count("*").alias("count"))


def review_rows(assessed: DataFrame) -> DataFrame:
    """The rows that a person must look at, with blank columns for the label and notes. Lists of ids are joined by blanks."""
    none = lambda c: F.coalesce(c, F.lit(""))
    kept = [c for c in ("qid", "system", "language") if c in assessed.columns]
    return assessed.where("review").select(
        *[none(F.col(c)).alias(c) for c in kept], F.array_join(F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")), " ").alias("retrieved_chunk_ids"), F.array_join("gold_chunk_ids", " ").alias("gold_chunk_ids"),
        none(F.col("answer")).alias("answer"), "auto_label", F.col("reason").alias("review_reason"), F.lit("").alias("label"), F.lit("").alias("notes"),
    )


def annotation_summary(rows: DataFrame, label: str, group: str, position: str) -> DataFrame:
    """kind, value, figure: total_rows, the number of rows of each label, and, where groups have two labels, the annotator's kappa with themself."""
    counts = rows.groupBy(F.col(label).alias("value")).agg(F.count("*").cast("double").alias("figure")).select(F.lit("label_distribution").alias("kind"), "value", "figure")
    total = rows.agg(F.count("*").cast("double").alias("figure")).select(F.lit("total_rows").alias("kind"), F.lit("").alias("value"), "figure")
    kappa = agreement(rows, group, label, position).where("n > 0").select(F.lit("intra_annotator_kappa").alias("kind"), F.lit("").alias("value"), F.col("kappa").cast("double").alias("figure"))
    return total.unionByName(counts).unionByName(kappa)


def evidence(answers: DataFrame, chunks: DataFrame, key: str, ids: str = "retrieved_chunk_ids", top: int = 5) -> DataFrame:
    """key, evidence: lines `[id]: text` of the first `top` known ids, in order. `top` texts a row at most."""
    table = chunks.groupBy("chunk_id").agg(F.max("text").alias("text"))
    long = answers.select(key, F.posexplode(F.slice(ids, 1, top)).alias("pos", "chunk_id")).join(table, "chunk_id")
    lines = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "text")))
    return long.groupBy(key).agg(tx.evidence_block(F.transform(lines, lambda x: x["chunk_id"]), F.transform(lines, lambda x: x["text"])).alias("evidence"))


def generate(prompts: DataFrame, generator, prompt: str = "prompt", output: str = "answer") -> DataFrame:
    """`prompts` with the generator's texts; `generator(list of prompts) -> list of texts` runs on batches, in the executors."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields if f.name != output)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=[output], errors="ignore").assign(**{output: generator(list(pdf[prompt]))})

    return prompts.mapInPandas(run, f"{fields}, `{output}` string")


def pending(requested: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("qid", "language", "system")) -> DataFrame:
    """Requested rows that no finished row has the keys of."""
    return requested.join(done.select(*keys), list(keys), "left_anti")


def slice_rows(df: DataFrame, position: str, start: int, limit: int | None = None) -> DataFrame:
    """Rows of positions start .. start + limit - 1."""
    kept = df.where(F.col(position) >= start)
    return kept if limit is None else kept.where(F.col(position) < start + limit)


def agreement(rows: DataFrame, group: str, label: str, position: str) -> DataFrame:
    """n, agreement, kappa over the groups with exactly two labels, first against second."""
    usable = rows.where(F.coalesce(F.trim(group), F.lit("")) != "")
    pairs = usable.groupBy(group).agg(F.count("*").alias("n"), F.min_by(label, position).alias("first"), F.max_by(label, position).alias("second")).where("n = 2")
    return evaluation.kappa(pairs, "first", "second")


def annotation_sheet(answers: DataFrame, questions: DataFrame, chunks: DataFrame, key: str, position: str, n_rows: int = 60, n_duplicates: int = 20, seed: int = 42, question_key: tuple[str, ...] = ("qid",), question_position: str = "question_row") -> DataFrame:
    """The sheet of the first `n_rows` answers, `n_duplicates` of them twice under a shared group, in an order of hashes.

    Ranks are dealt by hash with a seed: the same draw on every run and any cluster."""
    first = answers.orderBy(position).limit(n_rows)
    asked = last_per_key(questions.select(*question_key, "course_id", "question_type", "question_text", question_position), list(question_key), question_position).drop(question_position)
    base = first.join(asked, list(question_key), "left").join(evidence(first, chunks, key), key, "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    chance = F.xxhash64(F.lit(seed), key)
    drawn = base.orderBy(chance, key).limit(n_duplicates).select(key, F.row_number().over(Window.orderBy(chance, F.col(key))).alias("_g"))
    marked = base.join(drawn, key, "left").withColumn("duplicate_group", F.coalesce(F.concat(F.lit("g"), F.col("_g")), F.lit(""))).drop("_g")
    sheet = marked.withColumn("is_duplicate", F.lit("false")).unionByName(marked.where("duplicate_group != ''").withColumn("is_duplicate", F.lit("true")))
    columns = [key, "qid", "system", "language", "course_id", "question_type", "question_text", F.array_join("retrieved_chunk_ids", " ").alias("retrieved_chunk_ids"), F.col("evidence").alias("evidence_text"), "answer", F.lit("").alias("label"), F.lit("").alias("notes"), "duplicate_group", "is_duplicate"]
    return sheet.select(*columns).orderBy(F.xxhash64(F.lit(seed + 1), key, "is_duplicate"))


def import_sheet(sheet: DataFrame, label: str = "label") -> DataFrame:
    """Rows that are no duplicates; raises ValueError on a label that is not allowed. An action."""
    bad = sheet.where(~F.coalesce(F.trim(label), F.lit("")).isin(*LABELS)).limit(3).collect()
    if bad:
        raise ValueError(f"labels that are not allowed: {[r[label] for r in bad]}")
    return sheet.where(F.lower(F.trim("is_duplicate")) != "true")


def abstained(c: Column) -> Column:
    return tx.strip(c) == tx.ABSTENTION
