"""Cutting oversized items into pieces under a word limit, at natural boundaries, with an overlap.

Balanced targets: the least number of pieces that can hold an item is computed, their ends are placed
at equal distances, and each is snapped to the strongest boundary near it (blank line, line, end of a
sentence, clause mark, then any word). If a piece comes out over the limit, the item gets one piece
more and is placed again. Every piece after the first begins OVERLAP words before the end of the one
before it.

A word is a run of characters other than white space; pieces keep the text between their words as it
is. Items at or under the limit are one piece, or are left out (`oversized_only`). Null texts give no
piece; empty and blank ones give one empty piece. Items of any length are cut whole; only the
oversized ones reach Python, where an item is one row: no shuffle takes place. Repeated keys are
pieces of one item; the row with the most words counts, the greatest text among equals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as tx

LIMIT = 512
OVERLAP = 64

_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*$")
_CLAUSE = re.compile(r"[,;:–—)\]»”|]+$")
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|cf|vs|etc|Dr|St|No)\.|\b\w\.)$")


def boundaries(text: str, words: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the cut before each word (index 0 is the start of the text) and, last, of the end."""
    strength = np.zeros(len(words) + 1, dtype=np.int8)
    for i in range(1, len(words)):
        gap = text[words[i - 1][1] : words[i][0]]
        lines = gap.count("\n")
        before = text[words[i - 1][0] : words[i - 1][1]]
        if lines > 1:
            strength[i] = 5
        elif lines and text[words[i][0]] in "#*-|•":
            strength[i] = 4
        elif _SENTENCE.search(before) and not _ABBREVIATION.search(before):
            strength[i] = 4 if lines else 3
        elif lines:
            strength[i] = 2
        elif _CLAUSE.search(before):
            strength[i] = 1
    strength[-1] = 6
    return strength


def cuts(strength: np.ndarray, n_words: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces, in words, the last being n_words."""
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must exceed the overlap, which must not be negative")
    if n_words <= limit:
        return [n_words]
    count = -(-(n_words - overlap) // (limit - overlap))
    while True:
        length = (n_words + (count - 1) * overlap) / count  # of each piece, its overlap included
        step = length - overlap
        slack = max(1, int(step // 3))
        out, start, fits = [], 0, True
        for i in range(1, count):
            target = length + (i - 1) * step
            low = max(start + overlap + 1 if i > 1 else 1, int(round(target)) - slack)
            # the piece must hold, and the pieces left must be able to hold the rest
            high = min(start + limit, int(round(target)) + slack, n_words - 1)
            low = max(low, n_words - (count - i) * (limit - overlap))
            if low > high:
                fits = False
                break
            window = strength[low : high + 1].astype(np.float64)
            distance = np.abs(np.arange(low, high + 1) - target) / slack
            cut = low + int(np.argmax(window - 0.9 * np.minimum(distance, 1)))
            out.append(cut)
            start = cut - overlap
        if fits and n_words - start <= limit:
            return [*out, n_words]
        count += 1


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(first word, end word, start character, end character) of each piece."""
    words = [m.span() for m in _WORD.finditer(text)]
    if len(words) <= limit:
        return [(0, len(words), 0, len(text))]
    ends = cuts(boundaries(text, words), len(words), limit, overlap)
    out = []
    for i, end in enumerate(ends):
        first = max(0, ends[i - 1] - overlap) if i else 0
        out.append((first, end, words[first][0] if i else 0, words[end - 1][1] if end < len(words) else len(text)))
    return out


def n_words(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null. Inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{tx.SOLID}+")), F.lit(0))


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """items(item_kind, item_key, text) -> item_kind, item_key, chunk_index, n_chunks, first_word, n_words, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, key, text in zip(pdf["item_kind"], pdf["item_key"], pdf["text"]):
                made = pieces(text, limit, overlap)
                rows += [(kind, key, i, len(made), a, b - a, text[c:d]) for i, (a, b, c, d) in enumerate(made)]
            yield pd.DataFrame(rows, columns=["item_kind", "item_key", "chunk_index", "n_chunks", "first_word", "n_words", "text"])

    schema = "item_kind string, item_key string, chunk_index int, n_chunks int, first_word int, n_words int, text string"
    counted = items.select("item_kind", "item_key", "text", n_words(F.col("text")).alias("n"))
    large = counted.where(F.col("n") > limit)
    cut = large.select("item_kind", "item_key", "text").mapInPandas(run, schema)
    if oversized_only:
        return cut
    whole = counted.where((F.col("n") <= limit) & F.col("text").isNotNull())
    return cut.unionByName(whole.select("item_kind", "item_key", F.lit(0).alias("chunk_index"), F.lit(1).alias("n_chunks"), F.lit(0).alias("first_word"), F.col("n").alias("n_words"), "text"))


def items_of(documents: DataFrame, chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Both tables as (item_kind, item_key, text), once per key.

    Only oversized rows of chunks, whose keys repeat, are shuffled: the rest stay where they are."""
    docs = documents.select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_key"), "text")
    rows = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text", n_words(F.col("text")).alias("n")).where(F.col("n") > limit)
    once = rows.groupBy("item_kind", "item_key").agg(F.max_by("text", F.struct("n", "text")).alias("text"))
    return docs.unionByName(once)
