"""Languages of texts and of their segments, and labels that are missing or wrong.

A text is cut into segments at sentence ends; the rank-order profiles of `langid` give each segment
and the whole text a language and a confidence. A text is mixed if two languages each have a whole
sentence in it; single foreign words, names and cut-off tails do not make a mix.

Nulls, empty texts and texts without letters get no language (null, confidence 0). Very long texts
are cut and judged whole. Repeated rows are judged each. No shuffle takes place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import vec

from . import langid

#: Letters that a segment needs to count as a sentence in its language, and its words.
SENTENCE_LETTERS, SENTENCE_WORDS = 24, 4
#: Confidence that it needs.
SENTENCE_CONFIDENCE = 0.8

# Names and three-letter codes of the languages that labels are written in.
LABELS = {
    "en": "en", "eng": "en", "english": "en", "inglizcha": "en", "uz": "uz", "uzb": "uz", "o'zbek": "uz", "o'zbekcha": "uz", "uzbek": "uz", "ўзбек": "uz", "ўзбекча": "uz",
    "ru": "ru", "rus": "ru", "russian": "ru", "русский": "ru", "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "tr": "tr", "tur": "tr", "turkish": "tr", "türkçe": "tr",
}
NO_LABEL = ("", "n/a", "na", "none", "null", "nan", "unknown", "und", "xx", "xxx", "mul", "mis", "zxx", "-", "--", "?", "other", "unk")

_ENDS = re.compile(r"(?<=[.!?…])[\"'»”)]*(?:\s*\[[^\[\]]*\])*\s+|(?<=\])\s+(?=[^\W\d_])|\n+")
_ABBREVIATED = re.compile(r"\b(?:e\.g|i\.e|cf|vs|etc|Dr|St|No|z\.B|d\.h)\.$")


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; they cover all of it but the blanks between them."""
    out, start = [], 0
    for m in _ENDS.finditer(text):
        if m.end() < len(text) and m.start() > start and not _ABBREVIATED.search(text, max(start, m.start() - 8), m.start()):
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def _judge(texts: list[str], profiles: langid.Profiles, with_segments: bool = True) -> tuple[list, list, list, list]:
    cuts = [segments(t) for t in texts]
    names = np.array(sorted(set(profiles.languages)) + [None], dtype=object)
    parts = [t[a:b] for t, c in zip(texts, cuts) for a, b in c]
    best, sure, by = langid.identify(parts, profiles)
    codes, offsets = vec.pack(parts)
    letters = np.diff(np.concatenate([[0], np.cumsum(vec.letter_table()[codes])])[offsets]).astype(np.float64)
    words = np.array([len(p.split()) for p in parts])
    whole_sentence = (letters >= SENTENCE_LETTERS) & (words >= SENTENCE_WORDS) & (sure >= SENTENCE_CONFIDENCE) & (best >= 0)
    languages, confidences, mixed, segs = [], [], [], []
    at = 0
    for c in cuts:
        k = slice(at, at + len(c))
        at += len(c)
        if not len(c) or not letters[k].sum():
            languages.append(None), confidences.append(0.0), mixed.append([]), segs.append([])
            continue
        weight = letters[k] * (best[k] >= 0)
        lean = (by[k] * weight[:, None]).sum(axis=0) / max(weight.sum(), 1)
        votes = np.bincount(best[k][best[k] >= 0], weights=(weight * np.maximum(sure[k], 1e-3))[best[k] >= 0], minlength=by.shape[1])
        top = int(np.lexsort((lean, -votes))[0])
        languages.append(names[top])
        confidences.append(float(votes[top] / max(weight.sum(), 1)))
        found = sorted(set(names[best[k][whole_sentence[k]]]))
        mixed.append(found if len(found) > 1 else [])
        segs.append([{"start": a, "n_chars": b - a, "language": names[x], "confidence": float(s)} for (a, b), x, s in zip(c, best[k], sure[k])] if with_segments else [])
    return languages, confidences, mixed, segs


def detect(df: DataFrame, key: str, columns: list[str], samples: DataFrame, carry: Column | None = None, with_segments: bool = True) -> DataFrame:
    """key, field, language, confidence, mixed (the languages of a mixed text, else empty), segments (start, n_chars, language, confidence).

    One row for each of `columns` of each row; `samples` are labelled sentences (language, script, text).
    `carry`, a string, comes out as column `carried`, so that nothing need be joined back. Segments are
    left empty where they are not asked for."""
    profiles = langid.fit(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in columns:
                for a, b in vec.slices(vec.lengths(pdf[f"text_{c}"])):
                    lang, sure, mixed, segs = _judge([t if t is not None else "" for t in pdf[f"text_{c}"].iloc[a:b]], profiles, with_segments)
                    out = pd.DataFrame({"key": pdf["key"].iloc[a:b].to_numpy(), "field": c, "language": pd.Series(lang, dtype=object), "confidence": sure, "mixed": mixed, "segments": segs})
                    out["carried"] = pdf["carried"].iloc[a:b].to_numpy()
                    yield out

    schema = "key long, field string, language string, confidence double, mixed array<string>, segments array<struct<start:int,n_chars:int,language:string,confidence:double>>, carried string"
    carried = F.lit(None).cast("string") if carry is None else carry
    out = df.select(F.col(key).alias("key"), carried.alias("carried"), *[F.col(c).alias(f"text_{c}") for c in columns]).mapInPandas(run, schema)
    out = out.withColumnRenamed("key", key)
    return out.drop("carried") if carry is None else out


def label_code(label: Column) -> Column:
    """Code of a language label: null if it names none, the label's own subtag if the language is not known here."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), "[‘’ʻʼ`]", "'")))
    stem = F.regexp_extract(low, r"^([^-_\s]*)", 1)
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(low.isin(*NO_LABEL), None).otherwise(F.coalesce(F.try_element_at(names, low), F.try_element_at(names, stem), stem))


def issues(df: DataFrame, key: str, columns: list[str], label: str, samples: DataFrame) -> DataFrame:
    """(key, field, issue, language): labels that are missing or wrong for the first of `columns`, and the languages of mixed texts."""
    found = detect(df, key, columns, samples, carry=label_code(F.col(label)), with_segments=False).select(key, "field", "language", "mixed", "carried")
    wrong = F.when(F.col("carried").isNull(), "missing").when(F.col("carried") != F.col("language"), "wrong")
    judged = (F.col("field") == columns[0]) & F.col("language").isNotNull() & wrong.isNotNull()
    case = F.when(F.size("mixed") > 0, F.transform("mixed", lambda x: F.struct(F.lit("mixed").alias("issue"), x.alias("language"))))
    case = case.when(judged, F.array(F.struct(wrong.alias("issue"), F.col("language"))))
    return found.select(key, "field", F.inline(case))
