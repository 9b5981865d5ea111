"""Text functions against plain Python models, on random and on awkward texts."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as tx, vec
from corpusmill.operators import chunking

AWKWARD = ["", "   ", "\r\n a\tb \r c", "x\n\n\n\ny", "One. Two! Three? four. \"Five\" 6.", "É a. Éb", "don't_stop 12 ½ é", "nbsp here ", "Mr. X. Y", "[a] [b c] [[d]] []", "<b>x</b><SCRIPT>1<2</SCRIPT> y &amp;", "a_b_c_d", "яблоко Ёлка", "x" * 5000]


def column(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.select("i", expression(F.col("s")).alias("x")).orderBy("i").select("x").collect()]


def norm(s):
    s = re.sub(r"\r\n?", "\n", s)
    s = re.sub(r"[ \t]+", " ", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def test_normalize_whitespace(spark):
    assert column(spark, tx.normalize_whitespace, AWKWARD) == [norm(s) for s in AWKWARD]


def test_tokens(spark):
    assert column(spark, tx.tokens, AWKWARD) == [re.findall(r"\b\w+\b", s.lower()) for s in AWKWARD]


def test_sentences(spark):
    def model(s):
        s = norm(s)
        return [p for p in (x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", s)) if p] or ([s] if s else [])

    assert column(spark, tx.sentences, AWKWARD) == [model(s) for s in AWKWARD]


def test_ratios(spark):
    def model(s):
        solid = [c for c in s if not c.isspace()]
        return sum(ord(c) < 128 for c in solid) / len(solid) if solid else 1.0

    assert column(spark, tx.ascii_ratio, AWKWARD) == [model(s) for s in AWKWARD]
    assert column(spark, tx.non_ascii_ratio, AWKWARD) == [sum(ord(c) > 127 for c in s) / max(len(s), 1) for s in AWKWARD]


def test_citations_and_ids(spark):
    assert column(spark, tx.citations, AWKWARD) == [re.findall(r"\[([^\[\]]+)\]", s) for s in AWKWARD]
    assert column(spark, tx.chapter_prefix, ["a_b_c_d", "a_b"]) == ["a_b_c", "a_b"]
    assert column(spark, tx.document_of, ["a_b_c_000", "a"]) == ["a_b_c", "a"]
    assert column(spark, tx.chunk_id_list, ["a, b  c", ""]) == [["a", "b", "c"], []]
    assert column(spark, tx.doc_id_list, ["b a b", "a, b"]) == [["a", "b"], ["a,", "b"]]
    assert column(spark, tx.truthy, [" Yes", "0", None, "y", "TRUE "]) == [True, False, False, True, True]


def test_cuts(spark):
    assert column(spark, tx.before_end_token, ["x <END> y", "x "]) == ["x", "x"]
    assert column(spark, tx.strip_after_markers, ["a Note: b", "However, I've a", "a The revised response x"]) == ["a", "", "a"]


def test_html_and_slugs(spark):
    assert column(spark, tx.strip_html, ["<style>a{}</style><p>x&amp;y</p><script>\n<b></script>z"]) == ["x&amp;y z"]
    df = spark.createDataFrame([("3-2-means",), ("4-key-terms",), ("preface-x",), ("a-10-b-2-3",)], "slug string")
    rows = [tuple(r) for r in df.select(*tx.slug_numbers(F.col("slug")), tx.section_identifier(F.col("slug"), F.lit("ds"))).collect()]
    assert rows == [("3", "2", "ds_ch03_s02"), ("4", None, "ds_ch04_s00"), (None, None, "ds_preface_x"), (None, None, "ds_ch10_s02")]


def test_section_numbers_of_any_length(spark):
    slugs = ["a-2147483648", "a-180000000016-007", "0-00", "a-100-0099", "a-99999999999999999999-5", "a-12\n"]
    assert column(spark, lambda c: tx.section_identifier(c, F.lit("ds")), slugs) == ["ds_ch2147483648_s00", "ds_ch180000000016_s07", "ds_ch00_s00", "ds_ch100_s99", "ds_ch99999999999999999999_s05", "ds_a_12\n"]


def test_overlap(spark):
    df = spark.createDataFrame([("a b b", "b c"), ("", "x"), (None, "x"), ("x", None)], "q string, o string")
    assert [r[0] for r in df.select(tx.overlap_ratio(F.col("q"), F.col("o"))).collect()] == [0.5, 0.0, 0.0, 0.0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_vectorised_words_are_those_of_the_pattern(texts):
    codes, offsets = vec.pack(texts)
    starts, ends = vec.runs(vec.word_table()[codes], offsets) if len(codes) else ([], [])
    joined = "".join(texts)
    assert [joined[a:b] for a, b in zip(starts, ends)] == [w for t in texts for w in re.findall(r"\w+", t)]
    if len(starts):
        hashes = vec.span_hashes(codes, starts, ends)
        words = [joined[a:b] for a, b in zip(starts, ends)]
        assert len(set(hashes.tolist())) == len(set(words))


def test_word_windows(spark):
    words = F.split(F.lit("a b c d e f g h i j"), " ")
    rows = spark.range(1).select(chunking.word_windows(words, 6, 2)).first()[0]
    assert rows == [list("abcdef"), list("efghij"), list("ij")]
    assert spark.range(1).select(chunking.word_windows(F.array().cast("array<string>"), 6, 2)).first()[0] == []
    for bad in ((0, 0), (5, -1), (5, 5)):
        try:
            chunking.check(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 14), max_size=12), st.integers(3, 12), st.integers(0, 2))
def test_sentence_chunks_hold_every_sentence_and_the_limit(lengths, size, overlap):
    sentences = [" ".join(f"W{i}x{j}" for j in range(n)) + "." for i, n in enumerate(lengths)]
    made = chunking.sentence_chunks(" ".join(sentences), size, overlap)
    assert all(len(re.findall(r"\w+", c)) <= size for c in made)
    for s, n in zip(sentences, lengths):
        if n <= size:
            assert any(s in c for c in made)
    assert (made == []) == (sentences == [])


def test_chunk_documents(spark):
    df = spark.createDataFrame([("d1", "c", "T", "One two. Three four. Five six."), ("d2", "c", "", None), ("d3", None, None, "x")], "doc_id string, course_id string, title string, text string")
    rows = {r["chunk_id"]: (r["section"], r["text"]) for r in chunking.chunk_documents(df, 4, 1).collect()}
    assert rows == {"d1_000": ("T", "One two. Three four."), "d1_001": ("T", "Three four. Five six."), "d3_000": ("d3", "x")}


def test_separators_are_white_space(spark):
    """U+001C to U+001F end words, as they do for Python's str.split."""
    text = "".join(f"w{i}" + chr(0x1C + i % 4) for i in range(8)) + chr(0x1C)
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tx.n_words(F.col("t")).alias("n"), tx.strip(F.col("t")).alias("s"), tx.normalize_text(F.col("t")).alias("one")).first()
    assert got["n"] == len(text.split()) == 8 and got["s"] == text.strip() and got["one"] == " ".join(text.split())
