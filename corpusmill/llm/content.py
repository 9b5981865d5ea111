"""Scores of abusive, hateful and sexually explicit language, by weak supervision.

Sentences are judged, documents take their worst sentence. For each category many voters (`lexicon`:
lexicons by role, and patterns of roles that stand together, in English, Uzbek of both scripts and
Russian) vote for or against it or abstain, on a form of the text in which disguises are undone (digits
for letters, stretched and spaced letters, look-alikes). Words that the labelled samples of a category
have and its harmless ones have not are voters too, read when the model is fitted.

A generative label model takes the vote patterns of all sentences of all documents, with their counts,
and estimates by expectation-maximisation how often each voter votes with and without the category,
given the vote of the voter that it depends on most: the dependencies form a tree, of the greatest
mutual information between voters beyond what the category explains. The small table of labelled
sentences anchors it. Its posteriors are the labels on which a linear classifier over the votes and over
words, word pairs and character 4-grams (`ngrams`) is trained; the classifier scores every sentence of
every document, those without a vote too, in the form that it is trained on.

Two passes over the texts, none with a shuffle of them: vote patterns and a bounded sample of sentences
for the classifier (TRAIN_SENTENCES, those with the smallest hashes), and the scores.

Null and empty texts score 0. Whole texts are judged, whatever their length. Repeated rows are scored
each. Extra columns are dropped, but those asked for.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import vec

from . import cues, lexicon, ngrams
from .lexicon import CATEGORIES, VOTERS

#: Sentences of each kind on which the classifier is trained, about: with several votes for a category, with one, with none.
TRAIN_SENTENCES = 3000
KINDS = ("strong", "weak", "silent")
#: Labelled sentences that are read at most, and the weight of one against a sentence of the corpus.
SAMPLE_ROWS, SAMPLE_WEIGHT = 10_000, 5.0
#: Weight of a sentence without a vote: that no voter knows its words says little about them.
SILENT_WEIGHT = 0.3
#: Weight of a vote without a text.
ALONE_WEIGHT = 20.0
#: Share of sentences that a category may have at most before any vote, and log-odds that the silence of a voter may move.
PRIOR, SILENCE = 0.1, 0.25
#: Words of a category's samples that become voters: by how much more of the category's samples have them, and how many at most.
SAMPLED_LEAD, SAMPLED_WORDS = 2.0, 200
#: Score from which a document counts as a case.
THRESHOLD = 0.5

_LEET = str.maketrans("013457@$!8", "oieastasib")
_LEETWORD = re.compile(r"[^\W\d_]+[013457@$!8]+[^\W_@$!]*(?:[013457@$!8]+[^\W\d_]+)*[013457@$!8]*|[013457@$!8]+[^\W\d_]+(?:[013457@$!8]+[^\W\d_]*)*")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?!\w)")
_STAR = re.compile(r"(?<=[^\W\d_])[*·•_](?=[^\W\d_])")
_BREAK = re.compile(r"(?<=[.!?…;|])\s+|\n+")
_ACCENT = re.compile(f"[{chr(0x300)}-{chr(0x36F)}]")


def undisguised(text: str) -> str:
    """Lower case, with stretched, spaced, digit-coded and look-alike letters undone."""
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFD", cues.unscripted(text))) if not re.search("[ўйҳғқ]", text.lower()) else cues.unscripted(text)
    low = text.lower()
    low = _SPACED.sub(lambda m: re.sub(r"[ .\-*_]", "", m.group()), low)
    low = _LEETWORD.sub(lambda m: m.group().translate(_LEET), low)
    low = _STRETCH.sub(r"\1", low)
    return _STAR.sub("", low)


def _disguised(texts: list[str]) -> np.ndarray:
    """Which texts may hold a disguise; found in one vectorised pass, so that plain texts take no expression."""
    codes, offsets = vec.pack(texts)
    n = len(codes)
    hit = np.zeros(n, dtype=bool)
    if n > 3:
        letter = vec.letter_table()[codes]
        digit = ((codes >= 48) & (codes <= 57)) | (codes == 0x40) | (codes == 0x24) | (codes == 0x2A)
        hit[:-1] |= (letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:])
        hit[:-2] |= letter[:-2] & (codes[:-2] | 32 == codes[1:-1] | 32) & (codes[1:-1] | 32 == codes[2:] | 32)
        alone = letter.copy()
        alone[1:] &= ~letter[:-1]
        alone[:-1] &= ~letter[1:]
        hit[:-4] |= alone[:-4] & alone[2:-2] & alone[4:] & ~letter[1:-3] & ~letter[3:-1]
        hit |= (codes > 0x7F) & ~(((codes >= 0x400) & (codes < 0x500)) | (codes == 0xAB) | (codes == 0xBB) | (codes == 0x2018) | (codes == 0x2019) | (codes == 0x2BB) | (codes == 0x2BC))
        latin = letter & (codes < 0x250)
        cyrillic = (codes >= 0x400) & (codes < 0x500)
        hit[:-1] |= (latin[:-1] & cyrillic[1:]) | (cyrillic[:-1] & latin[1:])
    who = vec.owner(offsets)
    return np.bincount(who[hit], minlength=len(texts)) > 0


def sentences(text: str) -> list[str]:
    return [s for s in _BREAK.split(text) if s and not s.isspace()]


def _plain_sentences(texts: list[str]) -> Iterator[list[str]]:
    """Of every text its sentences, undisguised, in the form of `lexicon.bare`."""
    for a, b in vec.slices(vec.lengths(texts)):
        cut = [sentences(t) for t in texts[a:b]]
        parts = [s for c in cut for s in c]
        flagged = _disguised(parts).tolist() if parts else []
        at = 0
        for c in cut:
            whole = "\n".join(undisguised(s) if flagged[at + j] else s for j, s in enumerate(c))
            at += len(c)
            yield [s for s in map(lexicon.tidy, lexicon.bare(whole).split("\n")) if s]


def sampled_words(texts: list[str], categories: list[str]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(category, words): words of the category's samples that its others lack, SAMPLED_WORDS at most, the most telling first."""
    has = [set(w for s in t for w in s.split() if len(w) > 3) for t in _plain_sentences(texts)]
    out = []
    for c in CATEGORIES:
        own = Counter(w for words, x in zip(has, categories) if x == c for w in words)
        rest = Counter(w for words, x in zip(has, categories) if x != c for w in words)
        n, m = max(sum(x == c for x in categories), 1), max(sum(x != c for x in categories), 1)
        lead = {w: np.log((k + 0.1) / n) - np.log((rest[w] + 0.1) / m) for w, k in own.items() if k > 1}
        out.append((c, tuple(sorted((w for w in lead if lead[w] > SAMPLED_LEAD), key=lambda w: (-lead[w], w))[:SAMPLED_WORDS])))
    return tuple(out)


# ---------------------------------------------------------------- label model


def _tree(hot: np.ndarray, q: np.ndarray, n: np.ndarray) -> list[int]:
    """The voter that each depends on (-1: none): the tree of the greatest mutual information given the label.

    hot [patterns, voters, votes]; Prim's algorithm from voter 0; information below a hundredth of a bit is none."""
    m = hot.shape[1]
    info = np.zeros((m, m))
    for y in (q, 1 - q):
        w = n * y
        total = max(w.sum(), 1e-12)
        joint = np.einsum("p,pik,pjl->ijkl", w, hot, hot) / total + 1e-9
        alone = np.einsum("p,pik->ik", w, hot) / total + 1e-9
        info += total / n.sum() * (joint * np.log2(joint / (alone[:, None, :, None] * alone[None, :, None, :]))).sum(axis=(2, 3))
    # by the class that is rare the voters are told apart: its share of the sum would hide it
    parent, inside = [-1] * m, [0] if m else []
    while len(inside) < m:
        score = np.where(np.isin(np.arange(m), inside)[:, None] & ~np.isin(np.arange(m), inside)[None, :], info, -1.0)
        i, j = np.unravel_index(score.argmax(), score.shape)
        parent[j] = int(i) if score[i, j] > 0.01 else -1
        inside.append(int(j))
    return parent


def label_model(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray, gold_label: np.ndarray, steps: int = 60, most: float = PRIOR, silence: float = SILENCE) -> np.ndarray:
    """Posterior of the category for every vote pattern [patterns, voters] with its count.

    Each voter has a table P(vote | label, vote of the voter that it depends on); expectation-maximisation
    over the patterns, with the labelled sentences as fixed points. The dependencies are found on the way,
    and found again once they have had their effect."""
    if not len(patterns):
        return np.empty(0)
    allp, n = np.vstack([patterns, gold]), np.concatenate([counts.astype(float), np.full(len(gold), SAMPLE_WEIGHT)])
    fixed = np.concatenate([np.full(len(patterns), np.nan), gold_label.astype(float)])
    hot = np.stack([allp == v for v in (-1, 0, 1)], axis=2).astype(float)  # [patterns, voters, votes]
    m = allp.shape[1]
    # start: the share of votes for, out of those cast, where at least two are for; none where none is
    pro, con = (allp > 0).sum(axis=1), (allp < 0).sum(axis=1)
    q = np.where(np.isnan(fixed), np.where((pro >= 3) & (con == 0), 0.9, np.where(pro >= 2, 0.5, np.where(pro > 0, 0.05, 0.0))), fixed)
    parent = [-1] * m
    pro_voter = (allp > 0).any(axis=0)
    for step in range(steps):
        if step in (10, 25):
            parent = _tree(hot, q, n)
        prior = np.clip((n * q).sum() / n.sum(), 1e-6, most)
        odds = np.full(len(allp), np.log(prior / (1 - prior)))
        for j, i in enumerate(parent):
            ratio = []
            for y in (q, 1 - q):
                alone = (n * y) @ hot[:, j] + 0.5
                alone /= alone.sum()
                if i < 0:
                    ratio.append(hot[:, j] @ alone)
                else:  # seldom votes of the other lean on the voter's own rates
                    given = np.einsum("p,pk,pl->kl", n * y, hot[:, i], hot[:, j]) + 2.0 * alone
                    ratio.append(np.einsum("pk,kl,pl->p", hot[:, i], given / given.sum(axis=1, keepdims=True), hot[:, j]))
            # a voter may be useless, but not worse than chance: no vote tells the opposite, and silence tells little
            for_, silent, against = np.log(ratio[0] / ratio[1]) * hot[:, j].T[::-1]
            odds += np.maximum(for_, 0) + np.minimum(against, 0) + np.clip(silent, -silence if pro_voter[j] else 0, 0 if pro_voter[j] else silence)
        q = np.where(np.isnan(fixed), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), fixed)
    return q[: len(patterns)]


# ---------------------------------------------------------------- passes


@dataclasses.dataclass(frozen=True)
class Model:
    linear: ngrams.Linear
    sampled: tuple[tuple[str, tuple[str, ...]], ...]


def _survey(documents: DataFrame, text: str, sampled: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """Rows of vote patterns of all sentences with counts (kind = category), numbers of sentences of each of KINDS (kind = 'n_strong'
    ...), and of each sampled sentences (kind = 'strong' ...; n is their hash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voting = lexicon.voting(sampled)
        silent = (0,) * len(VOTERS)

        @functools.cache
        def kind_of(cast: tuple[int, ...]) -> str:
            most = max(sum(cast[i] > 0 for i in voting.place[c]) for c in CATEGORIES)
            return "strong" if most > 1 else "weak" if most else "silent"

        seen: Counter = Counter()
        sample: dict[str, dict[int, str]] = {kind: {} for kind in KINDS}

        def shrink(most: int) -> None:
            for kind, own in sample.items():
                if len(own) > most:
                    sample[kind] = dict(sorted(own.items())[:TRAIN_SENTENCES])

        for pdf in batches:
            parts = [s for p in _plain_sentences([t if t is not None else "" for t in pdf["text"]]) for s in p]
            if not parts:
                continue
            cast = [v or silent for v in voting.votes(parts)]
            seen.update(cast)
            kinds = [kind_of(v) for v in cast]
            few = {kind: max(own) if len(own) >= TRAIN_SENTENCES else 1 << 64 for kind, own in sample.items()}
            for s, kind in zip(parts, kinds):
                h = xxhash.xxh3_64_intdigest(s)
                if h < few[kind]:
                    sample[kind][h] = s
            shrink(4 * TRAIN_SENTENCES)
        shrink(TRAIN_SENTENCES)
        by: Counter = Counter()
        for v, n in seen.items():
            by[f"n_{kind_of(v)}", ""] += n
            for c in CATEGORIES:
                by[c, ",".join(str(v[i]) for i in voting.place[c])] += n
        rows = [(k, x, n) for (k, x), n in by.items()] + [(k, s, h - 2**63) for k, own in sample.items() for h, s in own.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "content", "n"])

    return documents.select(F.col(text).alias("text")).mapInPandas(run, "kind string, content string, n long")


def fit(documents: DataFrame, samples: DataFrame, text: str = "text") -> Model:
    """Patterns of a category are few (its voters vote one way or abstain); of the sampled sentences those below a hash that
    follows from their number are collected, so the driver gets about TRAIN_SENTENCES of each kind, whatever the partitions."""
    from corpusmill.session import checkpointed

    gold = samples.select("category", "text").where("text is not null and category is not null").limit(SAMPLE_ROWS).toPandas().sort_values(["category", "text"])
    sampled = sampled_words(list(gold["text"]), list(gold["category"]))
    survey = checkpointed(_survey(documents, text, sampled))
    counted = survey.where(~F.col("kind").isin(*KINDS)).groupBy("kind", "content").agg(F.sum("n").alias("n")).toPandas()
    drawn = []
    for kind in KINDS:
        n = int(counted.loc[counted["kind"] == f"n_{kind}", "n"].sum())
        below = -(2**63) + min(int(TRAIN_SENTENCES / max(n, 1) * 2**64), 2**64 - 1)
        drawn.append(sorted(set(survey.where((F.col("kind") == kind) & (F.col("n") <= below)).select("content").toPandas()["content"])))
    return fit_local(counted, drawn[0] + drawn[1], drawn[2], list(gold["text"]), list(gold["category"]), sampled)


def fit_local(patterns: pd.DataFrame, voted: list[str], unvoted: list[str], gold: list[str], gold_category: list[str], sampled: tuple) -> Model:
    voting = lexicon.voting(sampled)
    silent = (0,) * len(VOTERS)
    whole = [" ".join(p) for p in _plain_sentences(gold)]
    gold_votes = np.array([v or silent for v in voting.votes(whole)], dtype=int).reshape(-1, len(VOTERS))
    cast = np.array([v or silent for v in voting.votes(voted + unvoted)], dtype=int).reshape(-1, len(VOTERS))
    labels = np.zeros((len(cast), len(CATEGORIES)))
    # votes that stand alone, without a text: what a voter is worth where no other votes; the last row is silence
    alone = np.vstack([np.eye(len(VOTERS), dtype=int), np.zeros((1, len(VOTERS)), dtype=int)])
    worth, heavy = np.zeros((len(alone), len(CATEGORIES))), np.zeros((len(alone), len(CATEGORIES)))
    for k, c in enumerate(CATEGORIES):
        own, place = patterns[patterns["kind"] == c], voting.place[c]
        found = np.array([list(map(int, p.split(","))) for p in own["content"]], dtype=int).reshape(-1, len(place))
        one = alone[np.ix_([*place, -1], place)]
        q = label_model(np.vstack([found, one]), np.concatenate([own["n"].to_numpy(float), np.zeros(len(one))]), gold_votes[:, place], np.array([x == c for x in gold_category], dtype=float))
        posterior = {tuple(p): x for p, x in zip(found.tolist(), q)}
        labels[:, k] = [posterior[tuple(v)] for v in cast[:, place].tolist()]
        pro = [i for i in place if list(VOTERS.values())[i][1] > 0]
        worth[[*place, -1], k] = q[len(found) :]
        heavy[pro, k] = ALONE_WEIGHT
        heavy[-1, k] = ALONE_WEIGHT * len(pro)
    y = np.vstack([labels, np.array([[x == c for c in CATEGORIES] for x in gold_category], dtype=float).reshape(-1, len(CATEGORIES))])
    w = np.concatenate([np.ones(len(voted)), np.full(len(unvoted), SILENT_WEIGHT), np.full(len(gold), SAMPLE_WEIGHT)])
    # the few sentences of a category weigh a quarter of the many others
    balance = np.maximum(1.0, ((1 - y) * w[:, None]).sum(axis=0) / np.maximum((y * w[:, None]).sum(axis=0), 1e-9) / 4)
    texts, weights = voted + unvoted + whole + [""] * len(alone), np.vstack([w[:, None] * np.where(y > 0.5, balance, 1.0), heavy])
    return Model(ngrams.train(texts, np.vstack([y, worth]), weights, np.vstack([cast, gold_votes, alone]).astype(float), steps=200, rate=0.2), sampled)


def judge(texts: list[str], model: Model) -> np.ndarray:
    """Score of every text in every category: that of its worst sentence."""
    voting = lexicon.voting(model.sampled)
    cut = list(_plain_sentences(texts))
    parts = [s for c in cut for s in c]
    out = np.zeros((len(texts), len(CATEGORIES)))
    if parts:
        z = model.linear.scores(parts)
        voted = [(i, v) for i, v in enumerate(voting.votes(parts)) if v is not None]
        if voted:
            z[[i for i, _ in voted]] += np.array([v for _, v in voted], dtype=float) @ model.linear.further
        np.maximum.at(out, np.repeat(np.arange(len(texts)), [len(c) for c in cut]), 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return out


def score(documents: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, `keep`, and a score in 0..1 per category, of every row."""
    model = fit(documents, samples, text)
    schema = documents.select(key, *keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a, b in vec.slices(vec.lengths(whole[text])):
                pdf = whole.iloc[a:b]
                got = judge([t if t is not None else "" for t in pdf[text]], model)
                out = pdf[[key, *keep]].copy()
                for k, c in enumerate(CATEGORIES):
                    out[f"{c}_score"] = np.round(got[:, k], 6)
                yield out

    return documents.select(key, *keep, text).mapInPandas(run, f"{fields}, " + ", ".join(f"{c}_score double" for c in CATEGORIES))


def found(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, category) of the scores from THRESHOLD."""
    cases = F.array_compact(F.array(*[F.when(F.col(f"{c}_score") >= THRESHOLD, F.lit(c)) for c in CATEGORIES]))
    return scored.select(key, F.explode(cases).alias("category"))


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Per source (null is one): documents, and the number and share of cases of each category."""
    counts = [F.sum((F.col(f"{c}_score") >= THRESHOLD).cast("int")).alias(f"n_{c}") for c in CATEGORIES]
    table = scored.groupBy(source).agg(F.count("*").alias("n_documents"), *counts)
    return table.select(source, "n_documents", *[f"n_{c}" for c in CATEGORIES], *[F.round(F.col(f"n_{c}") / F.col("n_documents"), 6).alias(f"{c}_rate") for c in CATEGORIES])
