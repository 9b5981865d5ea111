"""Canonical form, language labels, truncation and pair defects on small and awkward texts."""


import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import canonical, crf, cues, language, pairs, truncation

import heldout
import numpy as np
import pyarrow.parquet as pq

FOLDER = "/root/testdata/sf0.01"

SAMPLES = [
    ("en", "Latn", "The table lists many careful students who follow the theory and then revise the limit of the sample. Because the matrix is sparse, readers become modest."),
    ("en", "Latn", "What does the early critic say about the method that is described in these notes, and why does it matter for the proof?"),
    ("uz", "Latn", "Talabalar avval nazariyani tekshirish, keyin esa chegarani asoslash bilan shug'ullanadi. Bu bobda qanday qilib tajriba belgini o'zgartiradi degan masala ko'riladi."),
    ("uz", "Cyrl", "Талабалар аввал назарияни текшириш, кейин эса чегарани асослаш билан шуғулланади. Бу бобда қандай қилиб тажриба белгини ўзгартиради деган масала кўрилади."),
    ("ru", "Cyrl", "По мнению автора, простая граница иногда нарушает всё, что даёт новая гипотеза. Там, где есть много строк, редкая задача всегда определяет вывод школы."),
    ("de", "Latn", "Wenn die Grenze zu klein ist, verletzt eine wichtige Erinnerung häufig die allgemeine Lehre. Zwischen der Matrix und der Größe liegt eine frühe Tugend."),
    ("tr", "Latn", "Yazara göre tartışmalı kavram yavaşça her sağlam deney için bir ortanca demektir. Eğer erdem küçükse, neden ile deney birbirini güçlendirir."),
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, "language string, script string, text string")


# ------------------------------------------------------------------ p5


def test_fold():
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "full")
    assert canonical.fold(wide + chr(0x3000) + "x" + chr(0x200B) + "y" + chr(0xAD)) == "full xy"
    assert canonical.fold("o" + chr(0x2BB) + "zbek ma" + chr(0x2019) + "no og" + chr(0x60) + "ir") == "o'zbek ma'no og'ir"
    assert canonical.fold("e" + chr(0x301) + " " + chr(0x438) + chr(0x306)) == chr(0xE9) + " " + chr(0x439)
    assert canonical.fold("«a» α é -\t\n") == "«a» α é -\t\n"
    assert canonical.fold("`code` " + chr(0xB4)) == "`code` " + chr(0xB4)
    assert canonical.fold("") == "" and canonical.fold(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",))))
def test_fold_is_idempotent(text):
    once = canonical.fold(text)
    assert canonical.fold(once) == once


def test_repairs():
    assert canonical.repairs("cаt") == ["cat", "сат"] or "cat" in canonical.repairs("cаt")
    assert canonical.repairs("граница" + "z") == []


def test_consistent_uses_the_vocabulary(spark):
    latin_a = "a"
    word = "с" + latin_a + "т"  # Cyrillic, Latin, Cyrillic
    rows = [(1, f"{word} x", "ok"), (2, "сат слово", None), (3, "", "Orubarg" + "а" + "rd"), (4, None, "plain é"), (5, "zж", "")]
    df = spark.createDataFrame(rows, "k long, a string, b string").withColumn("mixed", F.lit(1)).withColumn("word", F.lit("w"))
    got = {r["k"]: (r["a"], r["b"], r["mixed"]) for r in canonical.consistent(df, "k", ["a", "b"]).collect()}
    assert got == {1: ("сат x", "ok", 1), 2: ("сат слово", None, 1), 3: ("", "Orubargard", 1), 4: (None, "plain é", 1), 5: ("zж", "", 1)}
    cases = {tuple(r) for r in canonical.changed(df, "k", ["a", "b"]).collect()}
    assert cases == {(1, "a"), (3, "b"), (5, "a")}
    assert canonical.changed(df.limit(0), "k", ["a", "b"]).count() == 0
    strict = {r["k"]: (r["a"], r["b"]) for r in canonical.consistent(df, "k", ["a", "b"], unknown=False).collect()}
    assert strict[1] == ("сат x", "ok") and strict[3] == rows[2][1:]
    # keys need not tell rows apart
    again = spark.createDataFrame([(None, rows[0][1]), (None, rows[0][1]), (7, "сат"), (7, "x")], "k long, a string")
    assert sorted(r["a"] for r in canonical.consistent(again, "k", ["a"]).collect()) == ["x", "сат", "сат x", "сат x"]
    assert canonical.changed(again, "k", ["a"]).count() == 2


def test_mixed_words_in_batches():
    """As one regular expression finds them, text by text."""
    texts = ["", "a" + "б", "a' б", "a'б", "x́я and α_z", "один two три", "aб" + "c" * 50, "日a б", "б" + "日" + "a"]
    expression = canonical.regex.compile(r"[\p{L}\p{M}']*(?:\p{Latin}[\p{M}']*[\p{Cyrillic}\p{Greek}]|\p{Cyrillic}[\p{M}']*[\p{Latin}\p{Greek}]|\p{Greek}[\p{M}']*[\p{Latin}\p{Cyrillic}])[\p{L}\p{M}']*")
    assert canonical.mixed_words(texts)[0] == [list(dict.fromkeys(expression.findall(t))) for t in texts]
    assert canonical.fold_all([None, *texts]) == [None, *map(canonical.fold, texts)]


# ------------------------------------------------------------------ p2


def test_languages(spark, samples):
    rows = [
        (1, "Because the sample is sparse, the careful students revise the theory.", "en", None),
        (2, "Wenn die Lehre zu klein ist, verletzt die Grenze häufig eine frühe Erinnerung.", "en", ""),
        (3, "Талабалар кейин тажрибани текшириш билан шуғулланади.", None, "x"),
        (4, "The critic describes the method in these notes and the proof. Талабалар аввал чегарани асослаш билан шуғулланади.", "uz", None),
        (5, "", "en", None),
        (6, None, "en", "12 %"),
        (7, "Talabalar avval chegarani asoslash bilan shug'ullanadi.", "uz-Latn", None),
        (8, "Talabalar avval chegarani asoslash bilan shug'ullanadi.", " O‘zbek ", None),
        (9, "What does the early critic say about the method?", "kk", None),
        (10, "Because the sample is sparse, the careful students revise the theory. " * 300, "EN ", None),
    ]
    df = spark.createDataFrame(rows, "id long, q string, label string, r string").withColumn("language", F.lit("clash"))
    got = {tuple(r) for r in language.issues(df, "id", ["q", "r"], "label", samples).collect()}
    assert got == {(2, "q", "wrong", "de"), (3, "q", "missing", "uz"), (4, "q", "mixed", "en"), (4, "q", "mixed", "uz"), (9, "q", "wrong", "en")}
    found = {(r["id"], r["field"]): r for r in language.detect(df, "id", ["q", "r"], samples).collect()}
    assert found[6, "q"]["language"] is None and found[6, "r"]["confidence"] == 0.0
    assert [s["language"] for s in found[4, "q"]["segments"]] == ["en", "uz"]
    assert language.issues(df.limit(0), "id", ["q", "r"], "label", samples).count() == 0


def test_segments_cover_the_text():
    text = "One is here. Two, e.g. this one, too! Three [x_1]. \nFour"
    parts = language.segments(text)
    assert [text[a:b].strip() for a, b in parts] == ["One is here.", "Two, e.g. this one, too!", "Three [x_1].", "Four"]
    assert language.segments("") == []


# ------------------------------------------------------------------ p3

CUT = ["The robust norm we mean is an orthogonal subspace of", "It is seen in many tables [ds0001_ch", "The careful kno" + chr(0xFFFD), "It becomes sparse and singular experiments be...", "For this one the habit is convex,", "The shallow vector can fail, e.g.", "(an open bracket stays open until the end", "He wrote <b>bold words and never came back", 'He wrote that "the proof is complete.', 'They call it "the quiet norm of many tables and']
WHOLE = ["", "   ", None, "naive lens", "modest correlation of Brenrusoskin", "1) weighted survey; 2) naive justice; 3) explicit covariance", "It ends here.", "It ends [ds_1].", "It ends here. [ds_1]", "It was 3.50.", "Done!\n", "«Why is that so?»", "...", "N/A", "a <br> b.", "I must decline to answer this", 'He wrote that "the proof is complete."', '"Why is that so?"', 'A 12" lens and a 9" one are used.', 'The word "norm" is old.']


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert truncation._decide(text, None) in (truncation.CUT, truncation.OPEN_SENTENCE)


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert truncation._decide(text, None) in (truncation.WHOLE, truncation.PHRASE)


def test_repeating_the_question_is_whole():
    assert truncation._decide("why does it hold that the theory is dense in the north", "Why does it hold that the theory is dense in the North?") == truncation.PHRASE


def test_sources_without_marks_and_limits(spark):
    open_text = "The words of this source never end with any mark at all number %d"
    rows = [(i, "poem", open_text % i + " and on" * (i % 7)) for i in range(100, 160)] + [(i, "cut", ("The full sentence of this source is here and goes on %d" % i)[:40]) for i in range(200, 230)]
    rows += [(i, "cut", "The short one %d." % i) for i in range(230, 300)] + [(400, "cut", "It was found in the long table of 22 12." + "")]
    asked = spark.createDataFrame([(r[0], "c", r[1], "Q?", r[2]) for r in rows], "question_row long, course_id string, language string, question_text string, reference_answer string")
    none = spark.createDataFrame([], "question_row long, answer_row long, run_id string, answer string")
    got = {r["record_row"] for r in truncation.detect(asked, none).where("cut").collect()}
    assert got >= set(range(200, 230)) and not got & set(range(100, 160)) and not got & set(range(230, 300))


def test_rates(spark):
    asked = spark.createDataFrame([(1, "c", "en", "Q?", "It ends here."), (2, "c", None, "Q?", "It does not end here because of")], "question_row long, course_id string, language string, question_text string, reference_answer string")
    given_ = spark.createDataFrame([(1, 10, "r", "s", "This stops at [x_"), (9, 11, "r", None, None)], "question_row long, answer_row long, run_id string, system string, answer string")
    got = {(r["dimension"], r["value"]): (r["n_values"], r["n_cut"]) for r in truncation.rates(asked, given_).collect()}
    assert got[("answers.run_id", "r")] == (2, 1) and got[("answers.system", None)] == (1, 0) and got[("questions.course_id", "c")] == (2, 1)


# ------------------------------------------------------------------ p1


def test_crf_learns_a_chain():
    """Tags that repeat the one before wherever the observation is silent: only the transitions can tell."""
    rng = np.random.default_rng(0)
    lengths = rng.integers(2, 7, 300)
    x, y = [], []
    for n in lengths:
        tag = int(rng.integers(2))
        for i in range(n):
            x.append([1.0, float(i == 0 and tag == 1), float(i == 0 and tag == 0)])
            y.append(tag)
    model = crf.train(np.array(x), np.array(y), lengths, 2)
    assert (model.decode(np.array(x), lengths) == np.array(y)).mean() > 0.99
    assert len(model.decode(np.zeros((0, 3)), np.zeros(0, int))) == 0


def test_declines():
    for text in ("I don't know.", "Sorry, I cannot help with this question.", "Бу саволга жавоб бера олмайман.", "UNABLE TO ANSWER: not covered by the passages", "Javob berish uchun ma'lumot yetarli emas"):
        assert cues.hinted(text) and cues.declines(cues.plain(text)), text
    for text in ("Some things cannot be read as a proof.", "I cannot be certain, but the answer is that the norm is dense in the north.", "The answer is in the book."):
        assert not cues.declines(cues.plain(text)), text


@pytest.fixture(scope="module")
def model():
    """Trained on the questions of the small tables."""
    rows = pq.read_table(f"{FOLDER}/questions.parquet", columns=["question_text", "reference_answer"]).to_pylist()
    known = [(r["question_text"], r["reference_answer"]) for r in rows if r["question_text"] and r["reference_answer"]]
    labelled = pq.read_table(f"{FOLDER}/lang_samples.parquet", columns=["language", "text"]).to_pylist()
    return pairs.train(known, [r["text"] for r in labelled], [r["language"] for r in labelled])


ASKED = {"en": "Which early critic doubts that the median describes the sample?", "uz": "Nima uchun mediana tanlanmani yaxshiroq tavsiflaydi deb hisoblanadi?", "ru": None}


@pytest.mark.parametrize("asked", ["en", "uz"])
@pytest.mark.parametrize("language", ["en", "uz", "ru"])
def test_refusals_in_other_words(model, asked, language):
    """Wordings that no training pattern has, in the language of the question or another: a refusal is no foreign answer."""
    texts = heldout.REFUSALS[language]
    assert len(texts) >= 40
    texts = texts + [cues.cyrillic(t) for t in texts] if language == "uz" else texts
    defects, _ = pairs.judge([ASKED[asked]] * len(texts), texts, model)
    assert defects.count("refusal") >= 0.9 * len(texts), [t for t, d in zip(texts, defects) if d != "refusal"]


@pytest.mark.parametrize("language", ["en", "uz", "ru"])
def test_answers_that_decline_nothing(model, language):
    texts = heldout.ANSWERED[language]
    assert len(texts) >= 40
    defects, _ = pairs.judge([ASKED[language]] * len(texts), texts, model)
    assert defects.count(None) >= 0.9 * len(texts), [t for t, d in zip(texts, defects) if d]


def _pairs():
    """Enough sound pairs in two languages to train on."""
    en = [f"The theory number {i} matters because careful students revise the limit of sample {i}. Readers of the table follow the method {i} in these notes." for i in range(160)]
    uz = [f"Talabalar avval {i} ta nazariyani tekshirish, keyin esa chegarani asoslash bilan shug'ullanadi. Bu bobda {i} ta tajriba belgini o'zgartiradi." for i in range(160)]
    rows = [(i, f"What does the early critic {i} say about the proof in Bivor {i}?", t, "en") for i, t in enumerate(en)] + [(200 + i, f"Nima uchun {i} ta isbot Zadbor {i} uchun chegara emas, balki tajriba?", t, "uz") for i, t in enumerate(uz)]
    return [(a, d, b, c) for a, b, c, d in rows]


def _corpus(spark):
    return spark.createDataFrame([(a, "c", d, b, c) for a, d, b, c in _pairs()], "question_row long, course_id string, language string, question_text string, reference_answer string")


def test_pair_defects(spark, samples):
    questions = _corpus(spark)
    q = "What does the early critic 5 say about the proof in Bivor 5?"
    sound = "The method matters because careful students follow the theory of the table."
    cases = {
        1: (sound, None), 2: (None, "empty"), 3: (" \n", "empty"), 4: ("Answer:", "empty"), 5: ("N/A", "empty"), 6: (chr(0x200B), "empty"), 7: (q, "copy"), 8: (q.upper(), "copy"), 9: (q.lower().rstrip("?"), "copy"), 10: (f"{q} {sound}", None),
        11: ("I am sorry, but I cannot help with this question.", "refusal"), 12: ("I cannot be certain, but the careful students revise the limit of the sample.", None), 13: ("The method matters because careful students fol", "truncated"),
        14: ("Talabalar avval nazariyani tekshirish, keyin esa chegarani asoslash bilan shug'ullanadi.", "wrong_language"), 15: (sound + " Talabalar avval chegarani asoslash bilan shug'ullanadi.", None), 16: (sound * 400, None), 17: ("naive lens", None), 18: (f"«{q}»", "copy"),
    }
    answers = spark.createDataFrame([(5, k, "r", a) for k, (a, _) in cases.items()] + [(999, 50, "r", sound), (None, 51, "r", sound)], "question_row long, answer_row long, run_id string, answer string")
    rows = pairs.detect(questions, answers, samples.select("language", "text")).where("field = 'answers.answer'").collect()
    got = {r["record_row"]: r["defect"] for r in rows}
    assert {k: got[k] for k in cases} == {k: d for k, (_, d) in cases.items()}
    assert got[50] is None and got[51] is None and len(rows) == len(cases) + 2


def test_pairs_know_the_limit_of_their_source(spark, samples):
    """A cut decimal is truncated at the limit of its source only; a source of cut values keeps them."""
    sound = "The method matters because careful students follow the theory of the table"
    long = sound + ". " + sound + " and then revise the limit of the sample"
    rows = [(5, i, "limited", f"{sound} {i}0 in the notes.") for i in range(60)]
    rows += [(5, 100 + i, "limited", long[:130]) for i in range(4)] + [(5, 110, "limited", long[:126] + " 12."), (5, 111, "limited", sound + " 12.")]
    rows += [(5, 200 + i, "cut", (sound + ". ") * (i % 5 + i // 59 + 1) + "The students revise the limit of the sam") for i in range(60)]
    answers = spark.createDataFrame(rows, "question_row long, answer_row long, run_id string, answer string")
    questions = _corpus(spark)
    got = {r["record_row"]: r["defect"] for r in pairs.detect(questions, answers, samples).where("field = 'answers.answer'").collect()}
    cut = {r["record_row"] for r in truncation.detect(questions, answers).where("cut and field = 'answers.answer'").collect()}
    assert cut == {100, 101, 102, 103, 110} | set(range(200, 260))
    assert {k for k, d in got.items() if d == "truncated"} == cut


def test_pairs_of_empty_tables(spark, samples):
    questions = _corpus(spark).limit(0)
    answers = spark.createDataFrame([], "question_row long, answer_row long, run_id string, answer string")
    assert pairs.detect(questions, answers, samples).count() == 0
