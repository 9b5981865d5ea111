"""Defects of question-answer pairs: empty, truncated, refusal, copy, wrong_language.

An answer is cut into clauses (sentences; a reservation and what follows it are two). A linear-chain
conditional random field tags every clause as answer, refusal, echo, foreign or unfinished; the share
of the words under each tag decides the pair's defect. No labelled pairs exist, so the field is
trained on clauses of a bounded sample of the corpus's own pairs (about TRAIN_ROWS) in which defects are
put by construction: questions repeated in changed form, sentences of answers in other languages,
ends cut off, reservations, and refusals. How likely a clause is a refusal by its words, word pairs and
letters is learned (`refusals`), and a feature of the field; no list of cues decides it.

The work per pair is one pass in Python batches; the only shuffle of texts is the equi-join of answers
with their question. A decimal cut at the length limit of its source (`truncation.baseline`) is a cut end. Whether
a source sets terminators is not asked: one in which most values are cut looks like one without. Nulls: a null or blank answer is `empty`; a null question has no words, so nothing
is an echo of it or foreign to it. Repeated rows are judged each. Very long answers are judged
whole. Extra columns are dropped.
"""

from __future__ import annotations

import dataclasses
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import vec

from . import crf, cues, langid, ngrams, refusals, truncation

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Pairs read to train the models, about.
TRAIN_ROWS = 1500
#: Rows of the language sample table that are read at most.
SAMPLE_ROWS = 100_000
#: Log-likelihood by which another language must lead over a clause.
LANGUAGE_RATIO = 18.0
#: Trigrams of a question from which its language is judged.
LANGUAGE_GRAMS = 12
#: Log-probability per trigram by which another language must lead.
LANGUAGE_LEAD = 0.35
#: Words that a foreign answer of the training set has at least.
FOREIGN_WORDS = 6
#: Log-odds of the refusal model from which a clause is likely one, surely one, and below which it is hardly one.
LIKELY, SURE, UNLIKELY = 0.3, 2.0, -1.5

_CITATION = re.compile(r"\s*\[[^\[\]\s]*\]")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\n+")
_PREFIX = re.compile(r"(?i)^(?:question|savol|вопрос|frage|soru|q)\s*:\s*")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_WORD = re.compile(r"\w+(?:'\w+)*")

#: Reservations, before an answer; training material.
_RESERVING = ("I am not certain, but ", "It is hard to say; still, ", "Sorry for the length of this answer: ", "The passages do not say it directly, but ", "I do not know for sure, but ", "Aniq aytish qiyin, ammo ", "Kechirasiz, javob uzun: ", "Matnda ochiq aytilmagan, lekin ")

FEATURES = (
    "bias", "last", "inside_60", "inside_85", "inside_all", "covers_60", "covers_85", "echo", "asks", "asks_echo",
    "other_language", "language_unsure", "refusal_likely", "refusal_sure", "refusal_unlikely", "turns", "words_1_3", "words_4_8", "cut", "open", "phrase", "last_whole",
)
_AT = {name: i for i, name in enumerate(FEATURES)}


def clauses(text: str) -> list[str]:
    """Sentences without citations; a reservation is split from the answer after it. Never empty for text with content."""
    bare = _CITATION.sub("", text).strip()
    parts = [p for p in _SPLIT.split(bare) if p and any(map(str.isalnum, p))]
    out: list[str] = []
    for p in parts:
        low = p.lower()
        turn = None
        if len(p) > 30:
            m = cues.TURN.search(low, 0, 90)
            if m and len(low) == len(p) and m.start() >= 10 and len(low[m.end() :].split()) >= 4:
                left = low[: m.start()]
                # an apology before a refusal is part of it
                if len(left.split()) <= 10 and _RESERVES.search(cues.plain(left)) and not cues.REFUSAL.search(cues.plain(low[m.end() :])):
                    turn = m
        if turn:
            out += [p[: turn.start()] + ",", p[turn.end() :]]
        else:
            out.append(p)
    return out or ([bare] if bare else [])


_RESERVES = re.compile(r"\b(?:cannot|can't|not|sorry|hard|difficult|unsure|unclear|uncertain|apolog\w+|unfortunately|long answer|aniq aytish|aytish qiyin|kechirasiz|afsuski|uzr|javob uzun\w*|ochiq ayt\w*|bilmayman|aytilmagan)\b")


def _words(plain: str) -> list[str]:
    return _WORD.findall(plain)


class Featurizer:
    def __init__(self, trigrams: langid.Trigrams, wording: ngrams.Linear):
        self.trigrams, self.wording = trigrams, wording

    def batch(self, questions: list[str | None], answers: list[str], at_limit: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features of all clauses, clauses per answer, words per clause); answers with content.

        at_limit: whether an answer has the length at which those of its source are cut."""
        asked = [_fold(q) if q else "" for q in questions]
        parts, plains, folded, belongs, lengths, extra = [], [], [], [], [], []
        unended: list[int] = []
        for i, a in enumerate(answers):
            own = clauses(a)
            state = truncation.state(a)
            cross = bool(_CYRILLIC.search(a)) != bool(_CYRILLIC.search(asked[i]))
            if cross:  # perhaps the question in the other script of its language
                asked[i] = cues.plain(asked[i])
            for j, part in enumerate(own):
                f = []
                plain = cues.plain(part)
                if "?" in part[-3:]:
                    f.append(_AT["asks"])
                if j < len(own) - 1:
                    if part[-1] in ",:":
                        f.append(_AT["turns"])
                else:
                    f.append(_AT["last"])
                    if state == truncation.CUT or at_limit and at_limit[i] and truncation.decimal(a):
                        f.append(_AT["cut"])
                    elif state == truncation.OPEN_SENTENCE and not truncation._same_as(part, questions[i]):
                        unended.append(len(parts))
                    else:
                        f.append(_AT["phrase"] if state == truncation.PHRASE else _AT["last_whole"])
                extra.append(f)
                parts.append(part)
                plains.append(plain)
                folded.append(_PREFIX.sub("", plain if cross else _fold(part)))
                belongs.append(i)
            lengths.append(len(own))
        x = np.zeros((len(parts), len(FEATURES)), dtype=np.float32)
        if not parts:
            return x, np.array(lengths, dtype=np.int64), np.zeros(0)
        x[:, _AT["bias"]] = 1
        for r, f in enumerate(extra):
            x[r, f] = 1
        odds = self.wording.scores(plains)[:, 0]
        x[:, _AT["refusal_likely"]] = odds > LIKELY
        x[:, _AT["refusal_sure"]] = odds > SURE
        x[:, _AT["refusal_unlikely"]] = odds < UNLIKELY
        # a refusal needs no end mark; a word or two at the end of an answer are no refusal
        alone = np.array([lengths[belongs[r]] == 1 for r in unended], dtype=bool)
        done = (odds[unended] > LIKELY) & (alone | (np.array([plains[r].count(" ") for r in unended], dtype=int) > 1))
        x[unended, np.where(done, _AT["last_whole"], _AT["open"])] = 1
        belong = np.array(belongs)
        words, inside, covers = _overlap(folded, belong, asked)
        x[:, _AT["inside_all"]] = inside >= 0.999
        x[:, _AT["inside_85"]] = (inside >= 0.85) & (inside < 0.999)
        x[:, _AT["inside_60"]] = (inside >= 0.6) & (inside < 0.85)
        x[:, _AT["covers_85"]] = (covers >= 0.8) & (inside >= 0.6)
        x[:, _AT["covers_60"]] = (covers >= 0.6) & (covers < 0.8) & (inside >= 0.6)
        x[:, _AT["echo"]] = (inside >= 0.9) & (covers >= 0.8)
        x[:, _AT["asks_echo"]] = (x[:, _AT["asks"]] > 0) & (inside >= 0.8)
        x[:, _AT["words_1_3"]] = words <= 3
        x[:, _AT["words_4_8"]] = (words > 3) & (words <= 8)
        score, grams = self.trigrams.scores(parts)
        asked_in, asked_grams = self.trigrams.scores([q or "" for q in questions])
        home = asked_in.argmax(axis=1)[belong]
        lead = score.max(axis=1) - score[np.arange(len(parts)), home]
        sure = (lead * grams >= LANGUAGE_RATIO) & (asked_grams[belong] >= LANGUAGE_GRAMS)
        x[:, _AT["other_language"]] = sure & (lead > LANGUAGE_LEAD)
        x[:, _AT["language_unsure"]] = ~sure & (lead > 0)
        return x, np.array(lengths, dtype=np.int64), np.maximum(words, 1).astype(np.float64)


def _fold(text: str) -> str:
    """Compatibility forms and invisible characters resolved; case is left to the hashing."""
    if not text.isascii() and cues._ODD.search(text.lower()):
        return cues.unscripted(text)
    return text


def _overlap(parts: list[str], belong: np.ndarray, asked: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part: its words, their share that the question has, and their number against the question's shortest sentence."""
    mine, owner = _hashed(parts)
    theirs, asker = _hashed(asked)
    salt = vec.mix(np.arange(1, len(asked) + 1, dtype=np.uint64))
    hit = np.isin(mine ^ salt[belong[owner]], theirs ^ salt[asker])
    words = np.bincount(owner, minlength=len(parts))
    inside = np.bincount(owner, weights=hit, minlength=len(parts))
    shortest = np.array([min((n for n in (len(s.split()) for s in _SPLIT.split(q)) if n > 2), default=10**6) if q else 10**6 for q in asked])
    return words, inside / np.maximum(words, 1), inside / shortest[belong]


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets = vec.pack(texts)
    low = vec.lower_table()[codes]
    for sign in (0x2BB, 0x2BC):
        low[low == sign] = 0x27
    starts, ends = vec.runs(vec.word_table()[low], offsets)
    return vec.span_hashes(low, starts, ends), vec.owner(offsets)[starts] if len(starts) else np.empty(0, np.int64)


def _changed(question: str, rng: random.Random) -> str:
    form = rng.randrange(8)
    mark = question.rstrip("?").rstrip()
    return [question, question.upper(), mark.lower(), mark + ".", f"«{question}»", f"{question} {question}", f"Question: {question}", " ".join(question.split()[1:])][form]


def training_set(pairs: list[tuple[str, str]], trigrams: langid.Trigrams, wording: ngrams.Linear, seed: int = 7) -> tuple[list[str], list[str], list[list[int]]]:
    """Questions, answers with constructed defects, and the tags of their clauses."""
    rng = random.Random(seed)
    good = [(q, a) for q, a in pairs if q and not cues.empty(q) and not cues.empty(a) and truncation.state(a) in (truncation.WHOLE, truncation.PHRASE)]
    cut = [[cues.plain(c) for c in clauses(a)] for _, a in good]
    odds = wording.scores([c for part in cut for c in part])[:, 0]
    worst = np.full(len(good), -np.inf)
    np.maximum.at(worst, np.repeat(np.arange(len(good)), [len(c) for c in cut]), odds)
    good = [pair for pair, z in zip(good, worst) if z < 0]
    asked, given = trigrams.scores([q for q, _ in good])[0].argmax(axis=1), trigrams.scores([a for _, a in good])[0].argmax(axis=1)
    refused = iter(refusals.sentences(len(good) + 1, rng, topics([a for _, a in good]))[0])
    clean = []
    for (q, a), x, y in zip(good, asked, given):
        overlap = len(set(_words(cues.plain(a))) & set(_words(cues.plain(q)))) / max(1, len(set(_words(cues.plain(a)))))
        if x == y and overlap < 0.6:
            clean.append((q, a, x))
    by: dict[int, list[str]] = {}
    for _, a, x in clean:
        by.setdefault(int(x), []).append(a)
    others = {x: [a for y, v in by.items() if y != x for a in v] for x in by}
    qs, out, tags = [], [], []

    def add(q: str, a: str, t: list[int]) -> None:
        n = len(clauses(a))
        if n:
            qs.append(q), out.append(a), tags.append((t + [t[-1]] * n)[:n] if t else [])

    def some(text: str) -> str:
        """All of the text, or its first sentences only: the number of clauses must tell nothing."""
        whole = re.split(r"(?<=[.!?])\s+", text)
        return " ".join(whole[: rng.randrange(1, len(whole) + 1)]) if rng.randrange(2) else text

    for q, a, x in clean:
        a = some(a)
        n = len(clauses(a))
        kind = rng.randrange(8)
        if kind <= 1:
            phrase = " ".join(a.lower().rstrip(".!?").split()[-rng.randrange(2, 4) :])
            # some answers are a short phrase
            add(q, *((phrase, [ANSWER]) if rng.randrange(4) == 0 and truncation.state(phrase) == truncation.PHRASE else (a, [ANSWER] * n)))
        elif kind == 2:
            echo = _changed(q, rng)
            add(q, echo, [ECHO] * len(clauses(echo)))
        elif kind == 3 and q.endswith("?"):
            add(q, f"{q} {a}", [ECHO] * len(clauses(q)) + [ANSWER] * n)
        elif kind == 4:
            # in any language, whatever that of the question
            text = next(refused)
            form = rng.randrange(4)
            add(q, [text, text, text.upper(), text.rstrip(".")][form], [REFUSAL] * 3)
        elif kind == 5:
            reserve = rng.choice(_RESERVING)
            text = reserve + a
            add(q, text, [ANSWER] * len(clauses(text)))
        elif kind == 6 and others[int(x)]:
            text = some(rng.choice(others[int(x)]))
            if len(text.split()) >= FOREIGN_WORDS:  # of a phrase no one can tell
                add(q, text, [FOREIGN] * len(clauses(text)))
        elif kind == 7 and len(a) > 60:
            text = a[: rng.randrange(30, len(a) - 2)] + rng.choice(["", "", "...", " [ds00012_ch0", "\ufffd", ","])
            if truncation.state(text) in (truncation.CUT, truncation.OPEN_SENTENCE):
                m = len(clauses(text))
                echo = clauses(q) if q.endswith("?") and rng.randrange(3) == 0 else []  # a question before a cut answer
                add(q, f"{q} {text}" if echo else text, [ECHO] * len(echo) + [ANSWER] * (m - 1) + [UNFINISHED])
    return qs, out, tags


@dataclasses.dataclass(frozen=True)
class Model:
    field: crf.CRF
    trigrams: langid.Trigrams
    wording: ngrams.Linear


def topics(texts: list[str]) -> list[str]:
    """Words of some texts, to speak about in training sentences."""
    return [w for t in texts[:400] for w in cues.plain(t).split() if w.isalpha() and len(w) > 3] or ["theory"]


def fit(questions: DataFrame, samples: DataFrame) -> Model:
    """Trigrams from the language samples; the rest from about TRAIN_ROWS pairs, those with the smallest hashes.

    The hash from which a row is left out follows from the number of rows, so no task gives more than its share."""
    s = samples.select("language", "text").where("text is not null and language is not null").limit(SAMPLE_ROWS).toPandas().sort_values(["language", "text"])
    rows = questions.select("question_row", "question_text", "reference_answer").where("question_text is not null and reference_answer is not null")
    share = TRAIN_ROWS / max(rows.count(), 1)
    drawn = rows.where(F.pmod(F.xxhash64("question_row"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))).select("question_row", "question_text", "reference_answer").toPandas()
    # repeated keys may draw more rows: the order makes the draw the same on every cluster
    drawn = drawn.sort_values(["question_row", "question_text", "reference_answer"])
    return train(list(drawn[["question_text", "reference_answer"]].itertuples(index=False, name=None)), list(s["text"]), list(s["language"]))


def fit_trigrams(texts: list[str], languages: list[str]) -> langid.Trigrams:
    """Trigrams of the samples; Uzbek ones in Latin letters count in Cyrillic spelling too, of which there are few."""
    other = [(cues.cyrillic(t), x) for t, x in zip(texts, languages) if x == "uz" and not _CYRILLIC.search(t)]
    return langid.Trigrams.fit(texts + [t for t, _ in other], languages + [x for _, x in other])


def train(pairs: list[tuple[str, str]], sentences: list[str], languages: list[str]) -> Model:
    """From pairs of the corpus and labelled sentences, which are also examples of clauses that decline nothing."""
    trigrams = fit_trigrams(sentences, languages)
    wording = refusals.fit([c for _, a in pairs for c in clauses(a)], sentences, topics(sentences + [a for _, a in pairs]))
    qs, answers, tags = training_set(pairs, trigrams, wording)
    if not qs:  # nothing to learn from: an untrained field, which tags everything `answer`
        return Model(crf.CRF(np.zeros((len(FEATURES), len(TAGS))), np.zeros((5, 5)), np.array([1.0, 0, 0, 0, 0]), np.zeros(5)), trigrams, wording)
    x, lengths, _ = Featurizer(trigrams, wording).batch(qs, answers)
    return Model(crf.train(x.astype(np.float64), np.concatenate([np.array(t) for t in tags]), lengths, len(TAGS), steps=100), trigrams, wording)


def judge(questions: list[str | None], answers: list[str | None], model: Model, at_limit: list[bool] | None = None) -> tuple[list[str | None], np.ndarray]:
    """(defect or None, share of words under each tag) of every pair."""
    defect: list[str | None] = [None] * len(answers)
    share = np.zeros((len(answers), len(TAGS)))
    full = []
    for i, a in enumerate(answers):
        if cues.empty(a):
            defect[i] = "empty"
        else:
            full.append(i)
    if not full:
        return defect, share
    x, lengths, weights = Featurizer(model.trigrams, model.wording).batch([questions[i] for i in full], [answers[i] for i in full], [at_limit[i] for i in full] if at_limit else None)
    tags = model.field.decode(x, lengths)
    own = np.repeat(np.arange(len(full)), lengths)
    got = np.zeros((len(full), len(TAGS)))
    np.add.at(got, (own, tags), weights)
    got /= np.maximum(got.sum(axis=1), 1)[:, None]
    last = tags[np.cumsum(lengths) - 1]
    share[full] = got
    for k, i in enumerate(full):
        c = got[k]
        if last[k] == UNFINISHED:
            defect[i] = "truncated"
        elif c[ANSWER] + c[UNFINISHED] > 0:
            continue
        elif c[FOREIGN] >= 0.5:
            defect[i] = "wrong_language"
        elif c[REFUSAL] > 0:
            defect[i] = "refusal"
        elif c[ECHO] > 0:
            defect[i] = "copy"
    return defect, share


def detect(questions: DataFrame, answers: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per pair: field, record_row, defect (null if sound) and the share of words under each tag."""
    model = fit(questions, samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a, b in vec.slices(vec.lengths(whole["value"]) + vec.lengths(whole["question"])):
                pdf = whole.iloc[a:b]
                defect, share = judge(list(pdf["question"]), list(pdf["value"]), model, list(pdf["at_limit"]))
                out = pdf[["field", "record_row"]].copy()
                out["defect"] = pd.Series(defect, dtype=object, index=out.index)
                for j, tag in enumerate(TAGS):
                    out[f"{tag}_share"] = share[:, j]
                yield out

    # a row per source, so the texts are not shuffled for it
    usual = F.broadcast(truncation.baseline(truncation.values_of(questions, answers, asked=False)))
    limit = truncation.at_limit(F.length("value"), F.octet_length("value"))
    values = truncation.values_of(questions, answers).join(usual, ["field", "source"], "left")
    values = values.select("field", "record_row", "value", "question", limit.alias("at_limit"))
    return values.mapInPandas(run, "field string, record_row long, defect string, " + ", ".join(f"{t}_share double" for t in TAGS))
