"""Ranked retrieval: BM25 with its zero-score fallback, exact inner-product search, reciprocal-rank fusion.

A search takes a stated set of queries against all rows of a corpus. A search shuffles no text: every
batch of the corpus is scored against the queries in numpy and gives its own best k rows per query; only
those meet, in a window per query. Queries go in blocks of QUERY_BLOCK and rows in parts of CELLS scores, so
that what a task holds is bounded; each block is a pass over the corpus.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as tx, vec
from corpusmill.session import checkpointed

#: Queries that are scored in one pass over the corpus.
QUERY_BLOCK = 2000
#: Scores (rows times queries) that are held at once.
CELLS = 1 << 22
K1, B, TOP_K, RRF_K = 1.5, 0.75, 10, 60


# ------------------------------------------------------------------ BM25


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: how often each row has each word."""
    words = corpus.select(key, F.explode(tx.tokens(F.col(text))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(corpus: DataFrame, text: str) -> DataFrame:
    """term, df. Distinct words leave each row once, and are summed before the shuffle."""
    return corpus.select(F.explode(tx.token_set(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(corpus: DataFrame, text: str) -> DataFrame:
    """n_rows and avgdl, one row."""
    return corpus.agg(F.count("*").alias("n_rows"), F.avg(tx.n_tokens(F.col(text))).alias("avgdl"))


def term_weights(corpus: DataFrame, text: str) -> DataFrame:
    """term, df, idf: ln((N - df + 0.5) / (df + 0.5)), negative ones set to a quarter of the vocabulary's mean."""
    return _weighted(document_frequencies(corpus, text), corpus_size(corpus, text))


def _weighted(frequencies: DataFrame, size: DataFrame) -> DataFrame:
    raw = frequencies.join(F.broadcast(size.select("n_rows")))
    raw = raw.withColumn("idf0", F.log(F.col("n_rows") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf0").alias("mean_idf"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(0.25 * F.col("mean_idf")).alias("idf"))


@dataclasses.dataclass(frozen=True)
class _Block:
    """Queries of one pass: their terms as sorted hashes, and (term, query, weight, distinct) in rows by term."""

    names: list
    hashes: np.ndarray
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    avgdl: float


def _blocks(queries: DataFrame, corpus: DataFrame, key: str, text: str, corpus_text: str) -> list[_Block]:
    """The queries' words with their weights, on the driver: bounded by the query set, not by the corpus."""
    words = queries.select(F.col(key).alias("q"), F.explode_outer(tx.tokens(F.col(text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("n"))
    # the corpus is read twice: for its size and for its vocabulary, which is written once and read for the mean and for the queries' words
    size = corpus.sparkSession.createDataFrame([tuple(corpus_size(corpus, corpus_text).first())], "n_rows long, avgdl double")
    avgdl = size.first()["avgdl"] or 1.0
    frequencies = checkpointed(document_frequencies(corpus, corpus_text))
    weighted = words.join(_weighted(frequencies, size), "term", "left").select("q", "term", "n", "idf").orderBy("q", "term").toPandas()
    names = sorted(set(weighted["q"]))
    out = []
    for i in range(0, len(names), QUERY_BLOCK):
        block = names[i : i + QUERY_BLOCK]
        place = {q: j for j, q in enumerate(block)}
        part = weighted[weighted["q"].isin(place) & weighted["idf"].notna()]
        terms = sorted(set(part["term"]))
        hashes = vec.hash_words(terms)
        order = np.argsort(hashes)
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        number = {t: int(rank[j]) for j, t in enumerate(terms)}
        rows = sorted((number[t], place[q], n * w) for q, t, n, w in zip(part["q"], part["term"], part["n"], part["idf"]))
        tid = np.array([r[0] for r in rows], np.int64)
        out.append(_Block(block, hashes[order], np.searchsorted(tid, np.arange(len(terms) + 1)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), float(avgdl)))
    return out


def _score(texts: list[str], block: _Block, k1: float, b: float, shared_words: bool = False) -> np.ndarray:
    """BM25 [texts, queries], rounded to 10 digits, or the number of the query's distinct words that the text has."""
    codes, offsets = vec.pack([t.lower() for t in texts])
    scores = np.zeros((len(texts), len(block.names)))
    starts, ends = vec.runs(vec.word_table()[codes] if len(codes) else np.empty(0, bool), offsets)
    if not len(starts) or not len(block.hashes):
        return scores
    own = vec.owner(offsets)[starts]
    length = np.bincount(own, minlength=len(texts))
    h = vec.span_hashes(codes, starts, ends)
    at = np.minimum(np.searchsorted(block.hashes, h), len(block.hashes) - 1)
    known = block.hashes[at] == h
    pair, tf = np.unique(own[known] * len(block.hashes) + at[known], return_counts=True)
    doc, term = pair // len(block.hashes), pair % len(block.hashes)
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / block.avgdl))
    n = block.first[term + 1] - block.first[term]
    rows = np.repeat(np.arange(len(doc)), n)
    entry = np.repeat(block.first[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    weights = None if shared_words else gain[rows] * block.weight[entry]
    flat = np.bincount(doc[rows] * len(block.names) + block.query[entry], weights=weights, minlength=scores.size)
    return np.round(flat.reshape(scores.shape), 10).astype(np.float64)


def _best(values: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest of each column of [rows, columns]; ties by name. In no order of rank.

    A partition finds each column's k-th value; of the rows that equal it, the first by name fill up."""
    order = np.argsort(names, kind="stable")
    by_column = np.ascontiguousarray(values[order].T)
    n = by_column.shape[1]
    if n <= k:
        rows = np.tile(order, len(by_column))
        return rows, np.repeat(np.arange(len(by_column)), n)
    limit = np.partition(by_column, n - k, axis=1)[:, n - k]
    rows, columns = [], []
    for c, (x, least) in enumerate(zip(by_column, limit)):
        above = np.flatnonzero(x > least)
        chosen = np.concatenate([above, np.flatnonzero(x == least)[: k - len(above)]])
        rows.append(order[chosen])
        columns.append(np.full(len(chosen), c))
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def bm25(queries: DataFrame, corpus: DataFrame, query_key: str, query_text: str, key: str, text: str, k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
    """query_key, key, rank (from 1), score: the k best rows of the corpus for every query.

    Ties are broken by key. Rows without a query word score 0 and fill up to k. If no row scores above
    nor below 0, the score is the number of the query's distinct words in the row instead. Scores are
    ranked after rounding to 10 digits. An empty corpus gives no rows. Keys of the corpus are unique;
    null texts are empty."""
    blocks = _blocks(queries, corpus, query_key, query_text, text)
    query_type, key_type = dict(queries.dtypes)[query_key], dict(corpus.dtypes)[key]
    schema = f"q {query_type}, d {key_type}, score double"

    def search(block: _Block, wanted: np.ndarray, shared_words: bool) -> DataFrame:
        """The k best rows of every part of the corpus for the queries `wanted` of a block."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = np.array(block.names)[wanted]
            for pdf in batches:
                for i in range(0, len(pdf), max(1, CELLS // len(block.names))):
                    part = pdf.iloc[i : i + max(1, CELLS // len(block.names))]
                    names = part["d"].to_numpy()
                    values = _score([t if t is not None else "" for t in part["text"]], block, k1, b, shared_words)[:, wanted]
                    rows, columns = _best(values, names, k)
                    yield pd.DataFrame({"q": asked[columns], "d": names[rows], "score": values[rows, columns]})

        return corpus.select(F.col(key).alias("d"), F.col(text).alias("text")).mapInPandas(run, schema)

    if not blocks:
        return queries.sparkSession.createDataFrame([], f"{query_key} {query_type}, {key} {key_type}, rank int, score double")

    def ranked(parts: list[DataFrame]) -> DataFrame:
        by = Window.partitionBy("q").orderBy(F.desc("score"), "d")
        return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    best = checkpointed(ranked([search(x, np.arange(len(x.names)), False) for x in blocks]))
    # only queries that no row scores for are searched again, by shared words; they are of the query set, so bounded as it is
    silent = {r["q"] for r in best.where("rank = 1 and score = 0").select("q").collect()}
    if silent:
        again = [(x, np.flatnonzero([n in silent for n in x.names])) for x in blocks]
        best = best.join(best.where("rank = 1 and score = 0").select("q"), "q", "left_anti")
        best = best.unionByName(ranked([search(x, wanted, True) for x, wanted in again if len(wanted)]))
    return best.select(F.col("q").alias(query_key), F.col("d").alias(key), "rank", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ dense


def inner_product(queries: DataFrame, corpus: DataFrame, query_key: str, query_vector: str, key: str, vector: str, k: int = TOP_K) -> DataFrame:
    """query_key, key, rank, score: exact search by inner product, in double precision; ties by key.

    With fewer rows than k, all are returned. Null vectors are left out. The vectors of the query set are
    on the driver and go out in blocks."""
    rows = queries.where(F.col(query_vector).isNotNull()).select(query_key, query_vector).orderBy(query_key).toPandas()
    query_type, key_type = dict(queries.dtypes)[query_key], dict(corpus.dtypes)[key]
    if not len(rows):
        return queries.sparkSession.createDataFrame([], f"{query_key} {query_type}, {key} {key_type}, rank int, score double")

    def search(names: np.ndarray, block: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), max(1, CELLS // len(names))):
                    part = pdf.iloc[i : i + max(1, CELLS // len(names))]
                    values = np.round(np.stack(part["v"].to_numpy()).astype(np.float64) @ block.T, 10)
                    best, columns = _best(values, part["d"].to_numpy(), k)
                    yield pd.DataFrame({"q": names[columns], "d": part["d"].to_numpy()[best], "score": values[best, columns]})

        return corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("d"), F.col(vector).alias("v")).mapInPandas(run, f"q {query_type}, d {key_type}, score double")

    names, vectors = rows[query_key].to_numpy(), np.stack(rows[query_vector].to_numpy()).astype(np.float64)
    found = reduce(DataFrame.unionByName, [search(names[i : i + QUERY_BLOCK], vectors[i : i + QUERY_BLOCK]) for i in range(0, len(names), QUERY_BLOCK)])
    by = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("d").alias(key), "rank", F.round("score", 6).alias("score"))


def encode(df: DataFrame, text: str, encoder, prefix: str = "", vector: str = "vector") -> DataFrame:
    """`df` with L2-normalised float vectors of `prefix` + text; `encoder(list of texts) -> array [n, d]` runs on Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        made = np.asarray(encoder([prefix + (t or "") for t in texts]), dtype=np.float32)
        norm = np.linalg.norm(made, axis=1, keepdims=True)
        return pd.Series(list(made / np.where(norm == 0, 1, norm)))

    return df.withColumn(vector, F.pandas_udf(run, "array<float>")(F.col(text)))


def hashing_encoder(dimensions: int = 64):
    """A deterministic encoder without a model: signed feature hashing of words."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        codes, offsets = vec.pack([t.lower() for t in texts])
        starts, ends = vec.runs(vec.word_table()[codes] if len(codes) else np.empty(0, bool), offsets)
        if len(starts):
            h = vec.span_hashes(codes, starts, ends)
            np.add.at(out, (vec.owner(offsets)[starts], (h % np.uint64(dimensions)).astype(np.int64)), np.where((h >> np.uint64(63)) == 1, 1.0, -1.0))
        return out

    return run


# ------------------------------------------------------------------ results and fusion


def nested(ranked: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys and ranked_chunks: array of (item, rank, score) in order of rank. One row per result list; lists have at most k items."""
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("item"), "score"))), lambda x: F.struct(x["item"].alias(item), x["rank"].alias("rank"), x["score"].alias("score"))).alias("ranked_chunks"))


def ranks_of(lists: DataFrame, keys: list[str], ids: str, item: str = "chunk_id") -> DataFrame:
    """keys, item, rank: where each item stands in an array of ids; of repeated items the last place counts."""
    return lists.select(*keys, F.posexplode(ids).alias("_pos", item)).groupBy(*keys, item).agg((F.max("_pos") + 1).alias("rank"))


def fuse(first: DataFrame, second: DataFrame, keys: list[str], item: str = "chunk_id", k: int = RRF_K, top_k: int = TOP_K) -> DataFrame:
    """keys, item, rank, score: reciprocal-rank fusion, the sum of 1 / (k + rank), of two rankings (keys, item, rank).

    Keys come from `first`; keys of `second` alone are left out. Ties: rank in `first`, then in `second`, then the item."""
    kept = second.join(first.select(*keys).distinct(), keys, "left_semi")
    both = first.select(*keys, item, F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2")).unionByName(kept.select(*keys, item, F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2")))
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    fused = both.groupBy(*keys, item).agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).withColumn("score", F.round(share("r1") + share("r2"), 10))
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), item)
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k).select(*keys, item, "rank", "score")


def missing_partners(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of `first` that `second` lacks; fusing them is an error in a strict run."""
    return first.select(*keys).join(second.select(*keys), keys, "left_anti").distinct()


def score_column(c: str) -> Column:
    return F.round(c, 6)
