"""Text functions on columns: Column -> Column, all inside the JVM.

Words are runs of letters, numbers and underscores of any script, as in Unicode-aware `\\w`. Null in,
null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]+"
#: White space as Python's `\s` has it (the separators U+001C to U+001F too, which Java's has not), and all else.
WHITE, SOLID = r"[\s\x0B\x1C-\x1F\x85\p{Z}]", r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
_STRIP = f"^{WHITE}+|{WHITE}+$"

# Marks behind which an answer is no longer one, in the order they are looked for, and its end token.
AFTER_MARKERS = ("However, I've", "Note:", "The revised response", "Here is the revised response")
END_TOKEN = "<END>"
# Fixed value: the sentence of an abstention.
ABSTENTION = "Insufficient evidence to answer this question."
# Names of the two courses, and of the languages.
COURSE_NAMES = {"ocw_data_science": "data science", "ocw_philosophy": "philosophy"}
LANGUAGE_NAMES = {"en": "English"}


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, _STRIP, "")


def normalize_whitespace(c: Column) -> Column:
    """CR LF and CR to LF, runs of blanks and tabs to one blank, three or more LF to two, both ends stripped."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    """Words in lower case, in order, with repetition."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def n_tokens(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def n_words(c: Column) -> Column:
    """Runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(f"{SOLID}+")), F.lit(0))


def sentences(c: Column) -> Column:
    """White-space-normalised text cut behind . ! ? before a capital, digit or quote of ASCII; never an empty part."""
    whole = normalize_whitespace(c)
    parts = F.filter(F.transform(F.split(whole, rf"(?<=[.!?]){WHITE}+(?=[A-Z0-9\"'])"), strip), lambda s: F.length(s) > 0)
    return F.when(c.isNull() | (F.length(whole) == 0), F.array().cast("array<string>")).otherwise(F.when(F.size(parts) > 0, parts).otherwise(F.array(whole)))


def normalize_text(c: Column) -> Column:
    """Stripped, in lower case, every run of white space one blank."""
    return F.regexp_replace(F.lower(strip(c)), f"{WHITE}+", " ")


def ascii_ratio(c: Column) -> Column:
    """Share of ASCII among the characters that are not white space; 1.0 if there are none."""
    solid = F.length(F.regexp_replace(c, f"{WHITE}+", ""))
    plain = F.length(F.regexp_replace(F.regexp_replace(c, f"{WHITE}+", ""), r"[^\x00-\x7f]", ""))
    return F.when(solid == 0, F.lit(1.0)).otherwise(plain / solid)


def non_ascii_ratio(c: Column) -> Column:
    """Share of characters beyond ASCII among all; 0.0 for an empty text."""
    return F.length(F.regexp_replace(c, r"[\x00-\x7f]", "")) / F.greatest(F.length(c), F.lit(1))


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[А-Яа-яЁё]")


def strip_after_markers(c: Column, markers: tuple[str, ...] = AFTER_MARKERS) -> Column:
    """What stands before the first of each marker, taken one after the other; stripped."""
    for m in markers:
        c = F.substring_index(c, m, 1)
    return strip(c)


def before_end_token(c: Column, token: str = END_TOKEN) -> Column:
    return strip(F.substring_index(c, token, 1))


def citations(c: Column) -> Column:
    """Ids in square brackets, in order, with repetition."""
    return F.regexp_extract_all(c, F.lit(r"\[([^\[\]]+)\]"), 1)


def chapter_prefix(c: Column) -> Column:
    """The first three parts between underscores."""
    return F.substring_index(c, "_", 3)


def document_of(c: Column) -> Column:
    """An id without its last part."""
    return F.regexp_replace(c, "_[^_]*$", "")


def overlap_ratio(query: Column, other: Column) -> Column:
    """Share of the query's distinct words that the other text has; 0.0 if it has no words."""
    q = token_set(F.coalesce(query, F.lit("")))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, token_set(F.coalesce(other, F.lit(""))))) / F.size(q))


def chunk_id_list(c: Column) -> Column:
    """Ids separated by commas or white space, in order."""
    return F.filter(F.split(F.replace(c, F.lit(","), F.lit(" ")), f"{WHITE}+"), lambda x: x != "")


def doc_id_list(c: Column) -> Column:
    """Ids separated by white space only, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, f"{WHITE}+"), lambda x: x != "")))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "y"), F.lit(False))


def course_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in COURSE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), c)


def language_name(c: Column) -> Column:
    return F.when(c == "en", F.lit("English")).otherwise(F.lit("Uzbek"))


def strip_html(c: Column) -> Column:
    """Scripts, styles and tags each to one blank, entities kept; white space normalised."""
    for pattern in (r"(?is)<script.*?>.*?</script>", r"(?is)<style.*?>.*?</style>", r"(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return normalize_whitespace(c)


def slug_numbers(c: Column) -> tuple[Column, Column]:
    """(chapter, section) that a slug begins with; null where it does not."""
    return F.nullif(F.regexp_extract(c, r"^(\d+)(?:-(\d+))?", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"^(\d+)(?:-(\d+))?", 2), F.lit(""))


def section_identifier(slug: Column, prefix: Column) -> Column:
    """prefix_chNN_sNN from the first two all-digit parts of a slug; _s00 with one; the slug itself with none.

    Digits stay text, as no integer type holds them all: leading zeros go, two digits at least stay."""
    numbers = F.filter(F.split(slug, "-"), lambda x: x.rlike(r"^[0-9]+\z"))
    wide = lambda i: F.regexp_replace(F.concat(F.lit("0"), F.element_at(numbers, i)), "^0*(?=[0-9]{2})", "")
    return (
        F.when(F.size(numbers) >= 2, F.concat(prefix, F.lit("_ch"), wide(1), F.lit("_s"), wide(2)))
        .when(F.size(numbers) == 1, F.concat(prefix, F.lit("_ch"), wide(1), F.lit("_s00")))
        .otherwise(F.concat(prefix, F.lit("_"), F.replace(slug, F.lit("-"), F.lit("_"))))
    )


def evidence_block(ids: Column, texts: Column) -> Column:
    """Lines `[id]: text` in order."""
    return F.array_join(F.zip_with(ids, texts, lambda i, t: F.concat(F.lit("["), i, F.lit("]: "), F.coalesce(t, F.lit("")))), "\n")


#: What a question of each type asks for, in the prompts that have questions written.
ASKED_FOR = {
    "factual": "asks for one fact that the passage states",
    "conceptual": "asks a student to explain an idea, or how two ideas of the passage are related",
    "procedural": "asks how something described in the passage is done, or asks to compare two ideas of it; its question_type is procedural or comparative accordingly",
}


def question_prompt(kind: str, course: Column, passage: Column) -> Column:
    """A prompt for one question of a type on a passage, answered by a JSON object with the three keys that candidates need."""
    if kind not in ASKED_FOR:
        raise ValueError(f"no prompt for questions of type {kind}")
    reply = f'{{"question_type": "{kind}", "question_text": "...", "reference_answer": "..."}}'
    head = F.concat(F.lit("You write questions for a test of course assistants. The passage below is from a textbook of "), course_name(course), F.lit(f". Write one {kind} question that {ASKED_FOR[kind]}."))
    rest = F.lit("Give a reference answer of two or three sentences that says nothing beyond the passage.\n\nPassage:\n")
    return F.concat(head, F.lit("\n"), rest, F.coalesce(passage, F.lit("")), F.lit(f"\n\nReply with a JSON object only:\n{reply}"))


def translation_prompt(c: Column, language: str = "Uzbek", script: str = "Latin") -> Column:
    """A prompt for the translation of a text, and nothing else, in a script."""
    return F.concat(F.lit(f"Translate the text below into {language}, in {script} letters. Keep names and citations in brackets as they are. Reply with the translation only.\n\n"), F.coalesce(c, F.lit("")))
