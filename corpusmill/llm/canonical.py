"""One coded form for texts that look alike.

The consistent form of a text has no compatibility forms (full-width, styled or ligature letters), no
decomposed letters where a composed one exists, no invisible characters, no blanks but space, tab and
line feed, U+0027 for the Uzbek apostrophe, and no word with letters of two scripts where those are
look-alikes. Whole words of another script, single Greek letters, guillemets and composed accented
letters stay as they are.

Look-alikes are repaired by script: the dominant script of a mixed word is determined, the letters of
other scripts are replaced by their doubles in it, and the result is taken if it occurs in the corpus
vocabulary; where both directions occur, the dominant script decides. A mixed word of which no repair
occurs in the vocabulary (most are names that occur once) is repaired towards its dominant script if
all its foreign letters have doubles there; otherwise it stays.

Suspicious characters and mixed words are found in whole batches of code points. Only mixed words are
looked up in the vocabulary, by an equi-join with the words of the corpus (64-bit hashes of them).

Nulls stay null, empty texts stay empty, long texts are treated whole. Keys may be null or repeated.
Extra columns pass through.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import vec
from corpusmill.session import checkpointed

#: Hashes of words that a task remembers to have given (8 bytes each).
WORDS_HELD = 1_000_000

def code_points(ranges: str) -> str:
    """The characters of a list of code points and ranges of them, in hexadecimal."""
    out = []
    for r in ranges.split():
        a, _, b = r.partition("-")
        out += map(chr, range(int(a, 16), int(b or a, 16) + 1))
    return "".join(out)


# Signs written for the Uzbek apostrophe.
APOSTROPHES = code_points("2018 2019 2bb 2bc b4 60 2b9 2bd 2c8 2032 201b ff07 2bf 2be")
# Letters of one script and their doubles in another, pairwise.
CYRILLIC_LATIN = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅҺԌІкүѵո", "aeopcyxijshdqwABEKMHOPCTYXIJShGIkyvn"))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονιρυκχ", "ABEZHIKMNOPTYXaovipukx"))
GREEK_CYRILLIC = dict(zip("ΑΒΕΗΚΜΟΡΤΧαοκρχ", "АВЕНКМОРТХаокрх"))
LATIN_CYRILLIC = {b: a for a, b in reversed(CYRILLIC_LATIN.items())} | dict(zip("aeopcyxijshABEKMHOPCTYXIJSk", "аеорсухіјѕһАВЕКМНОРСТУХІЈЅк"))
LATIN_GREEK = {b: a for a, b in reversed(GREEK_LATIN.items())}
CYRILLIC_GREEK = {b: a for a, b in reversed(GREEK_CYRILLIC.items())}

_DOUBLES = {
    ("C", "L"): CYRILLIC_LATIN, ("G", "L"): GREEK_LATIN, ("G", "C"): GREEK_CYRILLIC,
    ("L", "C"): LATIN_CYRILLIC, ("L", "G"): LATIN_GREEK, ("C", "G"): CYRILLIC_GREEK,
}

#: Characters of texts that are surely in the consistent form already (letters of two scripts in a word apart).
_SAFE = "\t\n\\x20-\\x5f\\x61-\\x7e¡-§©«¬®°±¶·»¿À-ÿĀ-ıĴ-ľŁ-ňŊ-žΑ-ΡΣ-ωЀ-҂Ҋ-ӿ–—“”„•€"
_SPACING_MARKS = re.compile("([" + re.escape(code_points("a8 af b4 b8 2d8-2dd 37a 384 385 1fbd 1fbf-1fc1 1fcd-1fcf 1fdd-1fdf 1fed-1fef 1ffd 1ffe")) + "])")
_IN_WORD = regex.compile(rf"(?<=[oOgG])[{APOSTROPHES}]|(?<=\p{{L}})[{APOSTROPHES}](?=\p{{L}})")
_OTHER_BLANKS = re.compile("[" + code_points("b c 1c-1f 85 a0 1680 2000-200a 2028 2029 202f 205f 3000") + "]")
_JOINERS = code_points("200c 200d")
_INVISIBLE = regex.compile(r"[\p{Cf}" + code_points("34f 115f 1160 17b4 17b5 180b-180d 3164 fe00-fe0f ffa0 0-8 e-1b 7f-84 86-9f") + "]")
_PLAIN_SCRIPT = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Nd}\p{P}\s]")
_WORDS = regex.compile(r"[\p{L}\p{M}']+")
_LATIN, _CYRILLIC, _GREEK = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Greek}")


def _unseen(m: regex.Match) -> str:
    """Joiners stay where they shape a script or an emoji; all else that is not seen goes."""
    if m.group() in _JOINERS and m.start() and not _PLAIN_SCRIPT.match(m.string, m.start() - 1):
        return m.group()
    return ""


def fold(text: str | None) -> str | None:
    """The consistent form of a text, mixed-script words apart."""
    if text is None:
        return None
    text = _INVISIBLE.sub(_unseen, text.replace("\r\n", "\n").replace("\r", "\n"))
    text = _IN_WORD.sub("'", text)
    parts = _SPACING_MARKS.split(text)
    text = "".join(p if i % 2 else unicodedata.normalize("NFKC", p) for i, p in enumerate(parts))
    text = _OTHER_BLANKS.sub(" ", text)
    return _IN_WORD.sub("'", text)


def _script(c: str) -> str:
    return "L" if _LATIN.match(c) else "C" if _CYRILLIC.match(c) else "G" if _GREEK.match(c) else ""


def repairs(word: str) -> list[str]:
    """Repairs of a mixed-script word, that towards its dominant script first; empty if none is whole."""
    scripts = [_script(c) for c in word]
    count = {s: scripts.count(s) for s in "LCG" if s in scripts}
    out = []
    for to in sorted(count, key=lambda s: -count[s]):
        new = []
        for c, s in zip(word, scripts):
            if s in ("", to):
                new.append(c)
            elif (d := _DOUBLES[s, to].get(c)) is not None:
                new.append(d)
            else:
                break
        else:
            out.append("".join(new))
    return out


@functools.cache
def _safe_table() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for m in regex.finditer(f"[{_SAFE}]", "".join(map(chr, range(0x2100)))):
        table[m.start()] = True
    return table


#: What a character is within words: letter of one of the three scripts, other letter, mark or apostrophe.
_NO_WORD, _L, _C, _G, _OTHER, _MARK = range(6)


@functools.cache
def _kind_table() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c <= 0xDFFF else " " for c in range(sys.maxunicode + 1))
    for kind, expression in ((_OTHER, r"\p{L}+"), (_MARK, r"[\p{M}']+"), (_L, r"\p{Latin}+"), (_C, r"\p{Cyrillic}+"), (_G, r"\p{Greek}+")):
        for m in regex.finditer(expression, every):
            table[m.start() : m.end()] = kind
    return table


def mixed_words(texts: list[str], hashed: bool = True) -> tuple[list[list[str]], np.ndarray]:
    """Of each text its distinct words with letters of two scripts side by side, and, if asked for, the hashes of all other words of two letters or more."""
    codes, offsets = vec.pack(texts)
    out: list[list[str]] = [[] for _ in texts]
    kind = _kind_table()[codes]
    starts, ends = vec.runs(kind > 0, offsets)
    if not len(starts):
        return out, np.empty(0, np.int64)
    seen = np.flatnonzero(kind != _MARK)
    k = kind[seen]
    script = (k >= _L) & (k <= _G)
    # a letter and the next one; no run goes over the border of a text, so both are in the run of the second
    meet = np.flatnonzero(script[:-1] & script[1:] & (k[:-1] != k[1:]))
    word = np.searchsorted(starts, seen[meet + 1], "right") - 1
    meet = seen[meet] >= starts[word]
    odd = np.unique(word[meet])
    who = np.searchsorted(offsets, starts[odd], "right") - 1
    for i, w in zip(who.tolist(), odd.tolist()):
        at = offsets[i]
        x = texts[i][starts[w] - at : ends[w] - at]
        if x not in out[i]:
            out[i].append(x)
    if not hashed:
        return out, np.empty(0, np.int64)
    plain = ends - starts >= 2
    plain[odd] = False
    return out, vec.span_hashes(codes, starts[plain], ends[plain]).view(np.int64)


def fold_all(texts: list[str | None]) -> list[str | None]:
    """`fold` of every text; those of safe characters only are told in one pass over all code points."""
    codes, offsets = vec.pack([t if t is not None else "" for t in texts])
    odd = np.flatnonzero(~_safe_table()[codes])
    out = list(texts)
    for i in np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist():
        out[i] = fold(texts[i])
    return out


def _folder(columns: list[str], with_words: bool) -> Callable[..., Column]:
    """A function of the columns: struct of their folded forms (f0, f1 ...), whether each changed (c0, ...), the mixed words of
    all of them, and, if asked for, on some rows hashes of words of the vocabulary.

    A task gives a word once or a few times, and forgets those given when they are many."""
    fields = [f"f{i} string, c{i} boolean" for i in range(len(columns))]

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        given = np.empty(0, np.int64)
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)  # a single column comes by itself
            n = len(batch[0])
            done: list[list] = [[] for _ in columns]
            mixed: list[list[str]] = []
            words: list = [None] * n
            lengths = np.sum([vec.lengths(s) for s in batch], axis=0)
            for a, b in vec.slices(lengths):
                found, hashes = [], []
                for j, s in enumerate(batch):
                    folded = fold_all([t if isinstance(t, str) else None for t in s.iloc[a:b]])
                    done[j] += folded
                    m, h = mixed_words([t if t is not None else "" for t in folded], with_words)
                    found.append(m), hashes.append(h)
                mixed += [list(dict.fromkeys(w for m in row for w in m)) for row in zip(*found)]
                if with_words:
                    new = np.unique(np.concatenate(hashes))
                    new = new[~np.isin(new, given)]
                    if len(new):
                        words[a] = new
                        given = np.union1d(given, new) if len(given) < WORDS_HELD else new
            out = {}
            for j, s in enumerate(batch):
                out[f"f{j}"] = pd.Series(done[j], dtype=object)
                out[f"c{j}"] = [x is not None and x != y for x, y in zip(done[j], s)]
            yield pd.DataFrame(out | {"mixed": mixed, "words": pd.Series(words, dtype=object)})

    udf = F.pandas_udf(run, ", ".join(fields) + ", mixed array<string>, words array<long>").asNondeterministic()
    return lambda: udf(*[F.col(c) for c in columns])


def _spare(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column has."""
    while name in df.columns:
        name += "_"
    return name


def vocabulary(texts: DataFrame, columns: list[str]) -> DataFrame:
    """word: hashes of the distinct words of one script in the columns of `texts`, folded."""
    words = texts.select(*columns).select(_folder(columns, True)().alias("f")).where("f.words is not null")
    return words.select(F.explode("f.words").alias("word")).distinct()


def _candidates(word: pd.Series) -> pd.Series:
    return word.map(lambda w: [{"word": r, "hash": int(h)} for r in [repairs(w)] if r for r, h in zip(r, vec.hash_words(r).view(np.int64))])


def repair_table(mixed: DataFrame, words: DataFrame) -> DataFrame:
    """mixed(word), words(word: hash) -> word, repaired, known: one row per distinct mixed word that has a repair.

    The vocabulary is only semi-joined with the candidates: of its many words those survive that a
    repair gives. Both sides are spread by word; no word is hot, since both are distinct."""
    repaired = F.pandas_udf(_candidates, "array<struct<word:string,hash:long>>")
    candidates = mixed.distinct().select(F.col("word").alias("mixed"), F.posexplode(repaired("word")).alias("place", "r")).select("mixed", "place", "r.word", "r.hash")
    known = words.select(F.col("word").alias("hash")).join(candidates.select("hash").distinct(), "hash", "left_semi").withColumn("known", F.lit(True))
    ranked = candidates.join(known, "hash", "left").groupBy("mixed").agg(F.min(F.struct(F.coalesce(~F.col("known"), F.lit(True)).alias("unknown"), "place", "word")).alias("best"))
    return ranked.select(F.col("mixed").alias("word"), F.col("best.word").alias("repaired"), (~F.col("best.unknown")).alias("known"))


def _replace_all(text: pd.Series, table: pd.Series) -> pd.Series:
    out = []
    for t, m in zip(text, table):
        pairs = dict(m) if m is not None else {}
        out.append(_WORDS.sub(lambda w: pairs.get(w.group(), w.group()), t) if t is not None and pairs else t)
    return pd.Series(out, index=text.index, dtype=object)


def _mixed_left(text: pd.Series) -> pd.Series:
    return pd.Series([bool(m) for m in mixed_words([t if t is not None else "" for t in text], False)[0]], index=text.index)


def _survey(df: DataFrame, columns: list[str], corpus: DataFrame | None, corpus_columns: list[str] | None, changed: bool) -> tuple[DataFrame, DataFrame, str]:
    """(rows with a mixed word and, if asked for, those that folding changes; the vocabulary; the name of the struct of `_folder`).

    One pass over the texts; only the rows named are written down."""
    f = _spare(df, "_f")
    own = corpus is None
    wanted = (F.size(f"{f}.mixed") > 0) | F.col(f"{f}.words").isNotNull()
    if changed:
        wanted = reduce(Column.__or__, [F.col(f"{f}.c{i}") for i in range(len(columns))], wanted)
    rows = checkpointed(df.withColumn(f, _folder(columns, own)()).where(wanted))
    words = rows.where(F.col(f"{f}.words").isNotNull()).select(F.explode(f"{f}.words").alias("word")).distinct() if own else vocabulary(corpus, corpus_columns or columns)
    return rows, words, f


def _repaired(rows: DataFrame, columns: list[str], words: DataFrame, f: str, unknown: bool) -> DataFrame:
    """The rows with a mixed word, their words replaced in the struct's folded forms (as columns f0, f1 ... of struct `f`)."""
    row = _spare(rows, "_row")
    some = checkpointed(rows.where(F.size(f"{f}.mixed") > 0).withColumn(row, F.monotonically_increasing_id()))
    found = some.select(row, F.explode(f"{f}.mixed").alias("word"))
    table = repair_table(found.select("word"), words)
    by_row = found.join(table if unknown else table.where("known"), "word").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias(_spare(rows, "_repairs")))
    replace = F.pandas_udf(_replace_all, "string")
    fixed = some.join(by_row, row, "left")
    repairs_of = F.col(by_row.columns[1])
    new = [x for i in range(len(columns)) for x in (replace(F.col(f"{f}.f{i}"), repairs_of).alias(f"f{i}"), F.col(f"{f}.c{i}").alias(f"c{i}"))]
    return fixed.withColumn(f, F.struct(*new))


def consistent(df: DataFrame, key: str, columns: list[str], corpus: DataFrame | None = None, corpus_columns: list[str] | None = None, unknown: bool = True) -> DataFrame:
    """`df` with `columns` in the consistent form. The vocabulary is that of `corpus` (default: `df` itself).

    A mixed word of which no repair occurs in the vocabulary stays as it is unless `unknown`.
    Two passes over the texts: one finds mixed words and the vocabulary, the other gives the rows without
    a mixed word, nearly all, without a shuffle; those with one are written down by the first pass and
    joined with the repairs of their words. Rows keep no order; `key` is not used to tell them apart."""
    rows, words, f = _survey(df, columns, corpus, corpus_columns, changed=False)
    rest = df.withColumn(f, _folder(columns, False)()).where(F.size(f"{f}.mixed") == 0)

    def out(part: DataFrame) -> DataFrame:
        return part.select(*[F.col(f"{f}.f{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns])

    return out(rest).unionByName(out(_repaired(rows, columns, words, f, unknown)))


def changed(df: DataFrame, key: str, columns: list[str], **corpus) -> DataFrame:
    """(key, field): the values that are not in the consistent form, or that cannot be brought into it wholly.

    The forms are those of `consistent`, from the same passes; a value is given if its form differs from
    it, or if a mixed word is left for which there is no repair."""
    narrow = df.select(key, *columns)
    rows, words, f = _survey(narrow, columns, corpus.get("corpus"), corpus.get("corpus_columns"), changed=True)
    left = F.pandas_udf(_mixed_left, "boolean")
    fixed = _repaired(rows, columns, words, f, corpus.get("unknown", True))

    def fields(part: DataFrame, differs: list[Column]) -> DataFrame:
        return part.select(key, F.explode(F.array_compact(F.array(*[F.when(d, F.lit(c)) for d, c in zip(differs, columns)]))).alias("field"))

    plain = fields(rows.where(F.size(f"{f}.mixed") == 0), [F.col(f"{f}.c{i}") for i in range(len(columns))])
    mixed = fields(fixed, [~F.col(f"{f}.f{i}").eqNullSafe(F.col(c)) | left(F.col(f"{f}.f{i}")) for i, c in enumerate(columns)])
    return plain.unionByName(mixed)
