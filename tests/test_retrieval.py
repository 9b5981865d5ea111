"""Searches against brute force, the fallback, fusion, metrics, and the published significance figures."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, retrieval


def brute_bm25(queries, corpus, k, k1=1.5, b=0.75):
    docs = {d: re.findall(r"\w+", (t or "").lower()) for d, t in corpus}
    n, avg = len(docs), sum(map(len, docs.values())) / max(len(docs), 1)
    df = Counter(w for t in docs.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / max(len(idf), 1)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    out = []
    for q, text in queries:
        words = re.findall(r"\w+", (text or "").lower())
        scores = {}
        for d, tokens in docs.items():
            tf = Counter(tokens)
            scores[d] = round(sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(tokens) / avg)) for w in words if tf[w]), 10)
        if max(scores.values()) == 0:
            scores = {d: float(len(set(words) & set(t))) for d, t in docs.items()}
        out += [(q, d, i + 1, round(s, 6)) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


CORPUS = [("a", "the cat sat on the mat"), ("b", "the dog ate the cat"), ("c", "birds fly over the sea"), ("d", None), ("e", "the dog ate the cat"), ("f", "the " * 2000 + "zebra")]
QUERIES = [(1, "cat on the mat"), (2, "unknown words"), (3, ""), (4, "the the dog"), (5, "zebra cat"), (6, None)]


@pytest.mark.parametrize("k", [2, 4, 50])
def test_bm25(spark, k):
    corpus, queries = spark.createDataFrame(CORPUS, "id string, text string").repartition(3), spark.createDataFrame(QUERIES, "q int, t string")
    got = sorted((r["q"], r["id"], r["rank"], r["score"]) for r in retrieval.bm25(queries, corpus, "q", "t", "id", "text", k).collect())
    assert got == brute_bm25(QUERIES, CORPUS, k)


def test_bm25_falls_back_to_shared_words(spark):
    """With two texts every word of one of them has no weight: the number of shared words ranks."""
    corpus = spark.createDataFrame([("x", "statistics summarise data"), ("y", "ethics asks what is good")], "id string, text string")
    queries = spark.createDataFrame([(1, "what is good data"), (2, "data"), (3, "nothing here")], "q int, t string")
    got = sorted((r["q"], r["rank"], r["id"], r["score"]) for r in retrieval.bm25(queries, corpus, "q", "t", "id", "text", 2).collect())
    assert got == [(1, 1, "y", 3.0), (1, 2, "x", 1.0), (2, 1, "x", 1.0), (2, 2, "y", 0.0), (3, 1, "x", 0.0), (3, 2, "y", 0.0)]


def test_bm25_of_empty_tables(spark):
    corpus, queries = spark.createDataFrame([], "id string, text string"), spark.createDataFrame([(1, "a")], "q int, t string")
    assert retrieval.bm25(queries, corpus, "q", "t", "id", "text").count() == 0
    assert retrieval.bm25(queries.limit(0), spark.createDataFrame(CORPUS, "id string, text string"), "q", "t", "id", "text").count() == 0


def test_inner_product_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 8))
    vectors[7] = vectors[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    queries = df.where("id < 8").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = sorted((r["q"], r["rank"], r["id"]) for r in retrieval.inner_product(queries, df, "q", "qv", "id", "v", 5).collect())
    want = sorted((q, i + 1, int(d)) for q in range(8) for i, d in enumerate(np.lexsort((np.arange(40), -np.round(vectors @ vectors[q], 10)))[:5]))
    assert got == want


def test_encoder_normalises(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    rows = [r["vector"] for r in retrieval.encode(df, "t", retrieval.hashing_encoder(8), "query: ").collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in rows)


def test_fusion(spark):
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "q int, chunk_id string, rank int")
    second = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (3, "z", 1)], "q int, chunk_id string, rank int")
    got = sorted((r["q"], r["rank"], r["chunk_id"]) for r in retrieval.fuse(first, second, ["q"]).collect())
    assert got == [(1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "x")]
    assert [tuple(r) for r in retrieval.missing_partners(first, second, ["q"]).collect()] == [(2,)]
    lists = spark.createDataFrame([(1, ["a", "b", "a"])], "q int, ids array<string>")
    assert {r["chunk_id"]: r["rank"] for r in retrieval.ranks_of(lists, ["q"], "ids").collect()} == {"a": 3, "b": 2}


def test_metrics(spark):
    results = spark.createDataFrame([(1, "q1", ["x", "g", "y", "h"]), (2, "q2", ["g2"]), (3, "q3", []), (4, "q4", ["a"])], "r int, qid string, retrieved_chunk_ids array<string>")
    gold = spark.createDataFrame([("q1", ["g", "h"]), ("q2", ["g2", "k"]), ("q3", ["g"]), ("q4", [])], "qid string, gold_chunk_ids array<string>")
    got = {r["r"]: tuple(round(r[m], 6) for m in evaluation.METRICS) for r in evaluation.score(results, gold).collect()}
    assert got[1] == (0.0, 1.0, 1.0, 0.5, round((1 / math.log2(2) + 1 / math.log2(4)) / 2, 6))
    assert got[2] == (1.0, 1.0, 1.0, 1.0, 0.5)
    assert got[3] == got[4] == (0.0,) * 5


def test_significance_reproduces_a_published_row(spark):
    """13 wins, 6 losses and 101 equal pairs of hits: statistic 3241.5, p 0.270298, d 0.147581."""
    rows = [("en", f"q{i}", 1.0 if i < 13 or i >= 19 else 0.0, 0.0 if i < 13 else 1.0) for i in range(120)]
    long = [(lang, q, s, v) for lang, q, a, b in rows for s, v in (("bm25", a), ("dense", b))]
    scored = spark.createDataFrame(long, "language string, qid string, system string, recall_at_5 double")
    row = evaluation.significance(scored, metrics=("recall_at_5",)).first()
    assert (row["wilcoxon_statistic"], row["p_value"], row["cohens_d"], row["n"]) == (3241.5, 0.270298, 0.147581, 120)


def test_significance_of_equal_samples(spark):
    scored = spark.createDataFrame([("en", "q1", s, 1.0) for s in "ab"], "language string, qid string, system string, recall_at_5 double")
    row = evaluation.significance(scored, metrics=("recall_at_5",)).first()
    assert (row["wilcoxon_statistic"], row["p_value"], row["cohens_d"]) == (0.0, 1.0, 0.0)


def test_kappa(spark):
    pairs = [("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")]
    row = evaluation.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert (row["n"], row["agreement"], row["kappa"]) == (4, 0.75, 0.5)
    assert evaluation.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").first()["kappa"] == 0.0
    assert evaluation.kappa(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first()["kappa"] == 1.0


def test_reports(spark):
    scored = spark.createDataFrame(pd.DataFrame({"system": ["s"] * 3, "course_id": ["a", "a", "b"], "language": ["en"] * 3, "question_type": ["f"] * 3} | {m: [1.0, 0.0, 1.0] for m in evaluation.METRICS}))
    rows = {(r["report"], r["slice"]): (r["recall_at_5_mean"], r["recall_at_5_std"]) for r in evaluation.reports(scored).collect()}
    assert rows["overall", None] == (0.666667, 0.57735)
    assert rows["by_course_id", "b"] == (1.0, None) and rows["by_language", "en"] == (0.666667, 0.57735)
