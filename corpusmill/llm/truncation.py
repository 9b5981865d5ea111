"""Values that lost their end: cut at a field limit, or while they were transferred.

A stack automaton runs over the structural marks of a value: brackets, quotes, markup tags and
code fences push and pop; at the end it knows what is still open and what the last token is.
A value is cut if

* its last character is a broken one (U+FFFD, half an escape, half an entity, half a tag), or
* a bracket or tag is open at the end, or
* it stops at an ellipsis, a comma, an opening mark, an abbreviation or a connecting word, or
* it is a sentence without a terminator, and its source otherwise sets terminators.

Short phrases, numbered lists, refusals and repetitions of the question are whole without a mark.
The baseline is counted per source over all its values: its usual share of values without any
terminator, within or at their end, apart from its own length limit, and the limit itself (a length at
which values pile up). A value that ends open behind terminated sentences is none of those: a source
in which most values are cut does set terminators.

Empty and null values are never cut. A value of any length is scanned whole, in one pass. Repeated
rows count as often as they occur. Extra columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.operators.lookup import join_split

from . import cues

#: A source with a larger share of unterminated sentences below its length limit does without terminators.
NO_MARKS_SHARE = 0.6
#: Least sentences of a source for a baseline of its own.
BASELINE_ROWS = 30
#: A length that this share of a source's values has, more than have any of the tenth below it, and none exceeds, is a limit.
LIMIT_SHARE = 0.02
#: Characters of a value that an unclosed quotation mark makes a cut one; shorter ones are titles and the like.
QUOTED_CHARS = 20
#: Words of a phrase that needs no mark.
PHRASE_WORDS = 6

_MARKS = re.compile(r"[\[\](){}«»“”\"]|<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>|```")
_CLOSE = {"]": "[", ")": "(", "}": "{", "»": "«", "”": "“"}
_BROKEN = re.compile(r"(?:\ufffd|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<!\\)\\|&#?\w{1,7}|</?[A-Za-z][^<>]{0,40}|[\ud800-\udfff])$")
_ENDED = re.compile(r"[.!?…。][\"'»”’)\]]*$")
_TRAILING = re.compile(r"\w(?:\.\.\.|…)$")
_CITED = re.compile(r"\]\s*$")
_LIST = re.compile(r"^\s*(?:\d{1,3}|[a-zA-Z])[.)]\s*\S")
_ITEMS = re.compile(r"(?:^|[\s;,])\d{1,3}[.)]\s")
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|cf|vs|approx|resp|viz)\.)$", re.I)
_DANGLING = re.compile(r"[,;(\[{«“/&+=–—]$|\s-$")
_CONNECTING = re.compile(r"\b(?:the|a|an|of|and|or|that|which|whose|from|to|in|with|by|for|is|are|was|were|as|than|because|since|if|when|va|bilan|uchun|esa|deb|degan|emas|balki|agar|bo'lsa|lekin|chunki|qanday|ning)$")
_DECIMAL = re.compile(r"(?<![\d.])\d+\.$")

_QUOTES = ("«", "“", '"')

#: Codes of `state`.
WHOLE, CUT, OPEN_SENTENCE, PHRASE = 0, 1, 2, 3


def _open(text: str) -> str:
    """What is still open at the end of `text`: '' if nothing; else the innermost mark."""
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        x = m.group()
        if x[0] == "<":
            if m.group(1):
                while stack and stack[-1][0] == "<" and stack[-1] != f"<{m.group(2).lower()}":
                    stack.pop()
                if stack and stack[-1] == f"<{m.group(2).lower()}":
                    stack.pop()
            elif m.group(2).lower() not in ("br", "hr", "img", "end", "p", "li") and not x.endswith("/>"):
                stack.append(f"<{m.group(2).lower()}")
        elif x == "```":
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append(x)
        elif x == '"':  # opens behind a blank or a bracket and before a text, closes where one is open; others are inch marks and the like
            if x in stack:
                del stack[stack.index(x) :]
            elif (m.start() == 0 or not text[m.start() - 1].isalnum()) and text[m.end() : m.end() + 1].strip():
                stack.append(x)
        elif x in _CLOSE:
            if stack and stack[-1] == _CLOSE[x]:
                stack.pop()
        else:
            stack.append(x)
    return stack[-1] if stack else ""


def state(text: str | None) -> int:
    """WHOLE, CUT (structurally), OPEN_SENTENCE (no terminator where a sentence has one) or PHRASE."""
    if text is None:
        return WHOLE
    s = text.rstrip(" \t\r\n\x0b\x0c" + chr(0xA0) + cues._UNSEEN)
    if not s or cues.empty(s):
        return WHOLE
    if _BROKEN.search(s, max(0, len(s) - 60)):
        return CUT
    opened = _open(s) if _MARKS.search(s) else ""
    if opened in ("[", "(", "{", "```") or opened.startswith("<"):
        return CUT
    if _ABBREVIATION.search(s, max(0, len(s) - 12)):
        return CUT
    if _TRAILING.search(s):
        return CUT
    if _CITED.search(s) or _ENDED.search(s, max(0, len(s) - 8)):
        return CUT if opened in _QUOTES and len(s) > QUOTED_CHARS else WHOLE
    if _LIST.match(s) and (len(_ITEMS.findall(s)) > 1 or len(s.split()) <= 8):
        return PHRASE
    if _DANGLING.search(s):
        return CUT
    quoted = s[-1] in "»”\"'"
    words = s.split()
    if quoted and opened == "" and len(words) > 1 and s[0] in "«“\"'":
        return PHRASE
    first = next((c for c in s if c.isalpha()), "")
    if len(words) <= PHRASE_WORDS and (len(words) <= 2 or not first.isupper()) and not (len(words) > 1 and _CONNECTING.search(cues.plain(words[-1]))):
        return PHRASE
    return OPEN_SENTENCE


def decimal(text: str) -> bool:
    """The value ends in a number and a point: at a length limit a cut decimal."""
    return bool(_DECIMAL.search(text, max(0, len(text) - 12)))


def _same_as(clauses: str, question: str | None) -> bool:
    """The value says only words of the question, to its last word."""
    if not question:
        return False
    a, q = re.findall(r"\w+", cues.plain(clauses)), re.findall(r"\w+", cues.plain(question))
    return bool(a) and bool(q) and a[-1] == q[-1] and len(set(a) - set(q)) <= 1


def _decide(text: str | None, question: str | None) -> int:
    """`state`, where refusals and repetitions of the question are whole without a mark."""
    code = state(text)
    if code == OPEN_SENTENCE:
        tail = re.split(r"(?<=[.!?])\s+", text.strip())[-1]
        if cues.declines(cues.plain(tail)) or _same_as(tail, question):
            return PHRASE
    return code


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["state"] = [_decide(t, q) for t, q in zip(pdf["value"], pdf["question"])]
        text = pdf["value"].fillna("")
        pdf["decimal"] = [decimal(x) for x in text]
        pdf["n_chars"] = text.str.len().astype("int32")
        pdf["n_bytes"] = [len(x) if x.isascii() else len(x.encode("utf-8", "replace")) for x in text]
        yield pdf.drop(columns=["value", "question"])


def scan(values: DataFrame) -> DataFrame:
    """values: field, record_row, source, value, question -> field, record_row, source, state, decimal, n_chars, n_bytes.

    One row per input row; no shuffle."""
    return values.select("field", "record_row", "source", "value", "question").mapInPandas(_scan, "field string, record_row long, source string, state int, decimal boolean, n_chars int, n_bytes int")


def baseline(values: DataFrame) -> DataFrame:
    """Per (field, source): limit_chars, limit_bytes (null if none), marked (false where the source sets no terminators).

    Built-in expressions only: every text column is read once more, but no text leaves the JVM and none
    is shuffled. Both aggregations have partial sums; the result has a row per source."""
    text = F.regexp_replace("value", r"\s+$", "")
    unended = (F.length(text) > 0) & ~text.rlike(r"[.!?…。\]][\"'»”’)\]]*$|[.!?…。][\"'»”’)\]]*\s+\S") & (F.size(F.split(text, r"\s+")) > PHRASE_WORDS)
    measured = values.where("value is not null").select("field", "source", F.length("value").alias("n_chars"), F.octet_length("value").alias("n_bytes"), unended.cast("int").alias("open"))
    by = measured.groupBy("field", "source", "n_chars", "n_bytes").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    top = by.groupBy("field", "source").agg(F.max("n_chars").alias("limit_chars"), F.max("n_bytes").alias("limit_bytes"))

    def total(column: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    below = F.col("n_chars") < 0.95 * F.col("limit_chars")
    counts = (
        by.join(top, ["field", "source"])
        .groupBy("field", "source", "limit_chars", "limit_bytes")
        .agg(
            F.sum("n").alias("n"),
            total("n", F.col("n_chars") == F.col("limit_chars")).alias("at_chars"),
            total("n", F.col("n_bytes") == F.col("limit_bytes")).alias("at_bytes"),
            total("n", (F.col("n_chars") < F.col("limit_chars")) & (F.col("n_chars") >= 0.9 * F.col("limit_chars"))).alias("near_chars"),
            total("n", (F.col("n_bytes") < F.col("limit_bytes")) & (F.col("n_bytes") >= 0.9 * F.col("limit_bytes"))).alias("near_bytes"),
            total("open", below).alias("open_below"),
            total("n", below).alias("below"),
        )
    )
    enough = F.col("n") >= BASELINE_ROWS
    return counts.select(
        "field",
        "source",
        F.when(enough & (F.col("at_chars") >= LIMIT_SHARE * F.col("n")) & (F.col("at_chars") > F.col("near_chars")), F.col("limit_chars")).alias("limit_chars"),
        F.when(enough & (F.col("at_bytes") >= LIMIT_SHARE * F.col("n")) & (F.col("at_bytes") > F.col("near_bytes")), F.col("limit_bytes")).alias("limit_bytes"),
        (~((F.col("below") >= BASELINE_ROWS) & (F.col("open_below") > NO_MARKS_SHARE * F.col("below")))).alias("marked"),
    )


def at_limit(n_chars: Column, n_bytes: Column) -> Column:
    return F.coalesce(n_chars == F.col("limit_chars"), F.lit(False)) | F.coalesce(n_bytes == F.col("limit_bytes"), F.lit(False))


def is_cut() -> Column:
    limit = at_limit(F.col("n_chars"), F.col("n_bytes"))
    return (F.col("state") == CUT) | ((F.col("state") == OPEN_SENTENCE) & (F.coalesce("marked", F.lit(True)) | limit)) | (limit & F.col("decimal"))


def detect(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per value of the two text fields, with `cut`."""
    usual = baseline(values_of(questions, answers, asked=False))
    return scan(values_of(questions, answers)).join(usual, ["field", "source"], "left").select("field", "record_row", "source", "n_chars", is_cut().alias("cut"))


def values_of(questions: DataFrame, answers: DataFrame, asked: bool = True) -> DataFrame:
    """The two text fields as (field, record_row, source, value, question); without the question, and its join, if not `asked`.

    The source of an answer is its run, that of a reference answer its course and language. Answers
    take the question's text along by an equi-join, in which a question with very many answers is dealt over
    several parts."""
    none = F.lit("")
    refs = questions.select(
        F.lit("questions.reference_answer").alias("field"),
        F.col("question_row").alias("record_row"),
        F.concat_ws("|", F.coalesce("course_id", none), F.lower(F.trim(F.coalesce("language", none)))).alias("source"),
        F.col("reference_answer").alias("value"),
        F.col("question_text").alias("question"),
    )
    given = answers.select("question_row", F.col("answer_row").alias("record_row"), F.coalesce("run_id", none).alias("source"), F.col("answer").alias("value"))
    if not asked:
        return refs.drop("question").unionByName(given.select(F.lit("answers.answer").alias("field"), "record_row", "source", "value"))
    texts = questions.select("question_row", F.col("question_text").alias("question"))
    given = join_split(given, texts, "question_row", "record_row").select(F.lit("answers.answer").alias("field"), "record_row", "source", "value", "question")
    return refs.unionByName(given)


def rates(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """dimension, value, n_values, n_cut, cut_share: per run and system of answers, per course and language of questions.

    Nulls form a group of their own. The attributes are narrow, so joining them back by row is cheap
    beside the texts; every count has a partial sum before the shuffle."""
    cut = detect(questions, answers).select("field", "record_row", F.col("cut").cast("int").alias("cut"))
    ours = cut.where(F.col("field") == "answers.answer").join(answers.select(F.col("answer_row").alias("record_row"), "run_id", "system"), "record_row")
    theirs = cut.where(F.col("field") == "questions.reference_answer").join(questions.select(F.col("question_row").alias("record_row"), "course_id", "language"), "record_row")

    def per(df: DataFrame, names: list[str], table: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f"{table}.{n}").alias("dimension"), F.col(n).alias("value")) for n in names])
        return df.select("cut", F.inline(pairs))

    long = per(ours, ["run_id", "system"], "answers").unionByName(per(theirs, ["course_id", "language"], "questions"))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n_values"), F.sum("cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))
