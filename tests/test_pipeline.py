"""Failures, grounding, curation, validation, HTML, files and incremental runs on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import curation, failures, grounding, html, ingest, lookup, reports
from corpusmill.sources import files
from corpusmill.streaming import incremental


def test_failure_causes(spark):
    chunks = [("d_1_1_000", "d_1_1", "c1", "alpha beta"), ("d_1_1_001", "d_1_1", "c1", "gamma"), ("e_2_1_000", "e_2_1", "c1", "alpha beta delta"), ("f_1_1_000", "f_1_1", "c2", "alpha"), ("g_9_9_000", "g_9_9", "c1", "zeta")]
    chunks = spark.createDataFrame(chunks, "chunk_id string, doc_id string, course_id string, text string")
    gold = spark.createDataFrame([("q", ["d_1_1_000"])], "qid string, gold_chunk_ids array<string>")
    asked = [(1, "q", "c1", "en", "factual", "alpha beta delta"), (2, "q", "c1", "uz", "factual", "alpha beta delta")]
    asked = spark.createDataFrame(asked, "question_row int, qid string, course_id string, language string, question_type string, question_text string")
    results = [(1, "en", ["d_1_1_001"]), (2, "en", ["f_1_1_000"]), (3, "en", ["e_2_1_000"]), (4, "en", ["g_9_9_000"]), (5, "en", ["d_1_1_000"]), (6, "en", []), (7, "uz", ["e_2_1_000"])]
    results = spark.createDataFrame([(r, "q", lang, "s", ids) for r, lang, ids in results], "r int, qid string, language string, system string, retrieved_chunk_ids array<string>")
    missed = failures.misses(results, gold)
    by = lambda key: {r["r"]: r["category"] for r in failures.categorize(missed, asked, chunks, "r", question_key=key).collect()}
    assert by(("qid",)) == {1: "chunk_boundary", 2: "domain_confusion", 3: "cross_lingual", 4: "cross_lingual", 6: "domain_confusion", 7: "cross_lingual"}
    assert by(("qid", "language")) == {1: "chunk_boundary", 2: "domain_confusion", 3: "term_mismatch", 4: "other", 6: "domain_confusion", 7: "cross_lingual"}
    texts = {r["r"]: json.loads(r["retrieved_chunk_texts"]) for r in failures.retrieved_texts(results, chunks, "r").collect()}
    assert texts[3] == ["alpha beta delta"] and 6 not in texts


def test_grounding_rules(spark):
    gold = spark.createDataFrame([("q", ["g"])], "qid string, gold_chunk_ids array<string>")
    rows = [(1, ["x"], tx.ABSTENTION, False), (2, ["g"], "y", True), (3, ["g"], "no citation", None), (4, ["g"], "see [z]", False), (5, ["x"], "see [x]", False), (6, ["g"], "see [g]", False), (7, None, None, None)]
    answers = spark.createDataFrame([(r, "q", ids, a, x) for r, ids, a, x in rows], "r int, qid string, retrieved_chunk_ids array<string>, answer string, abstained boolean")
    got = {r["r"]: (r["reason"], r["review"]) for r in grounding.assess(answers, gold).collect()}
    assert got == {
        1: ("auto_unsupported_no_gold", False), 2: ("review_abstained_with_gold", True), 3: ("review_missing_citations", True), 4: ("review_invalid_citations", True),
        5: ("review_no_gold_retrieved", True), 6: ("auto_grounded_with_gold", False), 7: ("review_missing_citations", True),
    }


def test_answer_clean_up(spark):
    rows = [(1, "a [x] [x] [y]<END> z", ["x"], "en"), (2, "Ответ на русском", [], "en"), (3, " <END>", [], "uz"), (4, tx.ABSTENTION, [], "en")]
    df = spark.createDataFrame(rows, "r int, answer string, retrieved_chunk_ids array<string>, language string")
    got = {r["r"]: (r["answer"], r["generation_failure"], r["valid_citation_count"], r["abstained"]) for r in grounding.postprocess(df).collect()}
    assert got == {1: ("a [x] [x] [y]", "invalid_citations", 2, False), 2: ("Ответ на русском", "language_mismatch", 0, False), 3: ("", "empty_answer", 0, False), 4: (tx.ABSTENTION, "", 0, True)}


def test_agreement_and_sheet(spark):
    rows = spark.createDataFrame([(1, "g1", "correct_grounded"), (2, "g1", "correct_grounded"), (3, "g2", "unsupported"), (4, "g2", "unsupported"), (5, "", "x"), (6, "g3", "x")], "p int, g string, label string")
    assert grounding.agreement(rows, "g", "label", "p").first()["kappa"] == 1.0
    with pytest.raises(ValueError):
        grounding.import_sheet(spark.createDataFrame([("bad", "false")], "label string, is_duplicate string"))


def test_generator_and_pending(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, prompt string")
    done = grounding.generate(prompts, lambda texts: [t.upper() for t in texts])
    assert sorted(r["answer"] for r in done.collect()) == ["A", "B"]
    assert grounding.pending(prompts, prompts.limit(1), ("qid",)).count() == 1
    assert [r["qid"] for r in grounding.slice_rows(prompts, "qid", 2, 5).collect()] == [2]


REPLIES = ['{"a": 1}', 'Sure:\n```json\n[{"a": 1}, {"a": 2}]\n```', 'text [{"a": 3}] more', 'so {"a": 4} it is', 'x\n{"a": 5}\n{"a": 6}\n{broken', "nothing", None, ""]


def test_json_reading(spark):
    want = [[{"a": 1}], [{"a": 1}, {"a": 2}], [{"a": 3}], [{"a": 4}], [{"a": 5}, {"a": 6}], None, None, None]
    assert [curation.json_objects(r) for r in REPLIES] == want
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, raw string")
    assert [r[0] and [json.loads(x) for x in r[0]] for r in df.orderBy("i").select(curation.parse_json(F.col("raw"))).collect()] == want


def test_candidates_and_quota(spark):
    item = lambda kind: {"question_text": "Q?", "reference_answer": "A", "question_type": kind}
    rows = [("c1", "k", "factual", 1, json.dumps([item("x"), {"question_text": "no"}])), ("c1", "k", "procedural", 2, json.dumps([item("comparative"), item("z")])), ("c2", "k", "factual", 3, "broken")]
    df = spark.createDataFrame(rows, "chunk_id string, course_id string, prompt_type string, pos int, raw string")
    assert sorted(r["candidate_id"] for r in curation.candidates(df).collect()) == ["c1_comparative_0", "c1_factual_0", "c1_procedural_1"]
    assert sorted(r["candidate_id"] for r in curation.candidates(df, 2).collect()) == ["c1_comparative_0", "c1_factual_0"]
    assert curation.unreadable(df).count() == 1


def test_selection_takes_turns_and_repeats_no_prompt(spark):
    rows = [(f"k{i}", "c", f"s{i % 2}_00{i}", "factual", f"What is thing {i // 2 if i < 4 else i}?", "", 9 - i, -5, -20) for i in range(8)]
    df = spark.createDataFrame(rows, "candidate_id string, course_id string, chunk_id string, question_type string, question_text_en string, question_text_uz string, score int, question_words int, answer_words int")
    df = df.withColumn("question_text_uz", F.col("candidate_id"))
    got = [r["candidate_id"] for r in curation.select(df, {"factual": 4}).orderBy("place").collect()]
    assert got == ["k0", "k5", "k2", "k7"]


def test_import_and_validate(spark):
    sheet = spark.createDataFrame([(1, "c", "d_000", "factual", "Q one?", "A", "S bir?", "J", "yes", "d_000, d_001"), (2, "c", "d_001", "factual", "Q", "A", "", "", "", "")], "p int, course_id string, chunk_id string, question_type string, question_text_en string, reference_answer_en string, question_text_uz string, reference_answer_uz string, selected string, gold_chunk_ids string")
    questions, labels = curation.import_sheet(sheet, "p")
    assert sorted((r["qid"], r["language"]) for r in questions.collect()) == [("Q001", "en"), ("Q001", "uz")]
    assert labels.first()["gold_chunk_ids"] == ["d_000", "d_001"]
    chunks = spark.createDataFrame([("d_000",)], "chunk_id string")
    errors = {(r["check"], r["key"], r["found"]) for r in curation.validate(questions, labels, chunks, ["c"], {"factual": 1}).collect()}
    assert errors == {("unknown_chunk", "Q001", "d_001")}
    assert {r["check"] for r in curation.validate(questions.limit(0), labels, chunks, ["c"], {"factual": 1}).collect()} >= {"question_count", "course_rows", "course_type_rows", "qid_sets"}


PAGE = '<html><nav>menu</nav><main><h2>Title &amp; more</h2><p>One<script>x</script></p><ul><li>Item <p>inner</p></li></ul><br><figure>f</figure></main><script>window.__PRELOADED_STATE__ = {"slug": "book", "contents": [{"slug": "1-intro", "title": "Intro"}, {"slug": "index"}, {"slug": "ch", "contents": [{"slug": "2-1-x"}]}]};</script></html>'


def test_html(spark):
    assert html.main_content(PAGE) == "## Title & more\n\nOne\n\n- Item inner\n\ninner"
    assert [x["section_slug"] for x in html.flatten_toc(html.preloaded_state(PAGE))] == ["1-intro", "2-1-x"]
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None), (4, PAGE)], "page_id int, html string")
    good, bad = html.scraped(html.extract(pages))
    assert good.count() == 2 and bad.count() == 2
    assert sorted(r["section_slug"] for r in html.toc(pages).collect()) == ["1-intro", "2-1-x"]


def test_files(spark, tmp_path):
    rows = [("a", 'x "y"\nz, w'), ("b", "Ўзбек")]
    df = spark.createDataFrame(rows, "id string, text string")
    files.write_jsonl(df, str(tmp_path / "j"))
    files.append_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id string, text string").count() == 4
    assert files.write_csv(df.withColumn("flag", F.lit(True)), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), ["id", "text", "flag"]).collect()) == [(*r, "true") for r in rows]
    assert not files.write_csv(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    (tmp_path / "bad.json").write_text('{"id": "a"}\n\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "bad.json"), "id string").collect()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1-intro.md").write_text("# A\ntext")
    assert [tuple(r) for r in files.read_sections(spark, str(tmp_path / "s")).collect()] == [("1-intro", "# A\ntext")]
    (tmp_path / "c.yaml").write_text("size: 512\nk1: 1.5\n# no\nname: 'x'\n")
    assert files.read_config(str(tmp_path / "c.yaml")) == {"size": 512, "k1": 1.5, "name": "x"}


def test_positions_are_dense(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "k string").repartition(7)
    assert [r["_pos"] for r in files.with_positions(df, ["k"]).orderBy("k").collect()] == list(range(500))


def test_lookup(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, p int, v string")
    assert {r["k"]: r["v"] for r in lookup.last_per_key(df, ["k"], "p").collect()} == {"a": "y", "b": "z"}
    with pytest.raises(KeyError):
        lookup.require(df, df.where("k = 'a'"), ["k"], "test")


def test_ingest_and_reports(spark):
    sections = spark.createDataFrame([("c", "1-2-means", " x  y "), ("c", "preface", None)], "course_id string, section_slug string, text string")
    toc = spark.createDataFrame([("c", "1-2-means", "Old", "u", 0), ("c", "1-2-means", "Means", "u", 1)], "course_id string, section_slug string, title string, url string, _pos int")
    courses = spark.createDataFrame([("c", "ds", "CC", "book", "http://x")], "course_id string, doc_prefix string, license string, source_type string, base_url string")
    rows = {r["doc_id"]: (r["title"], r["source_url"], r["text"], r["download_date"]) for r in ingest.build_documents(sections, toc, courses, "2024-01-01").collect()}
    assert rows == {"ds_ch01_s02": ("Means", "u", "x y", "2024-01-01"), "ds_preface": ("Preface", "http://x/preface", None, "2024-01-01")}
    table = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, v double")
    assert "a & 0.5000" in reports.latex(table, ["name"])


def test_incremental(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert incremental.append_pending(spark, df, path, ["k"]) == 2
    assert incremental.append_pending(spark, df, path, ["k"]) == 0
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.parquet(source)
    stream = spark.readStream.schema("k int, v string").parquet(source)
    incremental.resume_stream(stream, path, str(tmp_path / "check"), ["k"]).awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


CANDIDATE = "candidate_id string, course_id string, chunk_id string, question_type string, question_text_en string, question_text_uz string, score int, question_words int, answer_words int"


def _by_hand(rows, targets, fallback=()):
    """The selection, one row after the other."""
    got = set()
    for course in sorted({r[1] for r in rows if r[1] is not None}):
        used_ids, used = set(), set()
        prompts = lambda r: {("en", " ".join((r[4] or "").lower().split())), ("uz", " ".join((r[5] or "").lower().split()))}
        for kind, target in targets.items():
            lines, seen = {}, set(used)
            for r in sorted((r for r in rows if r[1] == course and r[3] == kind and r[0] not in used_ids), key=lambda r: (r[6:9], r[0]), reverse=True):
                if not prompts(r) & seen:
                    seen |= prompts(r)
                    lines.setdefault(r[2].rpartition("_")[0], []).append(r)
            sections = sorted(lines.items(), key=lambda x: (x[1][0][6:9], x[0]), reverse=True)
            turns = [line[k] for k in range(max(map(len, lines.values()), default=0)) for _, line in sections if k < len(line)][:target]
            picks = [(r, "") for r in turns]
            if kind == "procedural" and len(picks) < target and course in fallback:
                spare = [r for r in rows if r[1] == course and r[3] == "comparative" and r[0] not in used_ids and not prompts(r) & used]
                text = lambda r: (r[4] or "").lower()
                picks += [(max(spare, key=lambda r: ("how" in text(r), "differ" in text(r) or "compare" in text(r), r[6:9], r[0])), "relabelled")] if spare else []
            for i, (r, note) in enumerate(picks, 1):
                got.add((r[0], course, kind, i, note))
                used_ids.add(r[0])
                used |= prompts(r)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_selection_is_that_of_one_row_after_the_other(spark, seed):
    rng = random.Random(seed)
    words = ["how do", "what is", "compare", "differ", "which"]
    rows = [
        (f"k{i:03d}", rng.choice(["a", "b", "b", "b", None]), f"s{rng.randrange(5)}_{i:03d}", rng.choice([*curation.TYPES, "other"]), rng.choice([None, f"{rng.choice(words)} {rng.randrange(12)}?"]), rng.choice(["", None, f"S  {rng.randrange(30)}"]), rng.randrange(3), -rng.randrange(2), -rng.randrange(2))
        for i in range(160)
    ]
    targets = {"factual": 6, "conceptual": 3, "procedural": 9, "comparative": 2}
    df = spark.createDataFrame(rows, CANDIDATE)
    assert {tuple(r) for r in curation.select(df, targets, ("b",)).collect()} == _by_hand(rows, targets, ("b",))
    assert curation.select(df.limit(0), targets).count() == 0


def test_selection_looks_behind_a_tie_for_sections(spark):
    """All rated alike: sections go by name."""
    rows = [(f"k{99 - i:02d}", "c", f"s{i:02d}_1", "factual", f"What is thing {i}?", f"S {i}", 5, -5, -20) for i in range(40)]
    assert {r[0] for r in curation.select(spark.createDataFrame(rows, CANDIDATE), {"factual": 3}).collect()} == {"k60", "k61", "k62"}


def test_selection_relabels_from_all_comparative_rows(spark):
    """The best row to relabel by its wording is the worst by its rating."""
    rows = [(f"k{i:02d}", "c", f"s{i:02d}_1", "comparative", f"Is thing {i} larger?" if i < 39 else "How do the two differ?", f"S {i}", 90 - i, -5, -20) for i in range(40)]
    rows.append(("p00", "c", "s00_2", "procedural", "What comes first?", "P", 5, -5, -20))
    df, targets = spark.createDataFrame(rows, CANDIDATE), {"comparative": 2, "procedural": 3}
    got = curation.select(df, targets, ("c",))
    assert ("k39", "relabelled") in {(r["candidate_id"], r["note"]) for r in got.collect()}
    assert [tuple(r) for r in curation.shortfall(got, df, targets).collect()] == [("c", "procedural", 3, 2)]
    assert {tuple(r)[1:] for r in curation.breakdown(got, df, targets).collect()} == {("comparative", 2, 2), ("procedural", 3, 2)}
    with pytest.raises(ValueError, match="procedural: 2 of 3"):
        curation.select(df, targets, ("c",), strict=True)


def test_quota_goes_on_where_a_run_stopped(spark):
    one = '{"question_text": "q", "reference_answer": "a", "question_type": "factual"}'
    replies = spark.createDataFrame([(f"c{i}", "a" if i < 6 else "b", "factual", i, one) for i in range(8)], "chunk_id string, course_id string, prompt_type string, pos int, raw string")
    held = spark.createDataFrame([("a",), ("a",), ("a",)], "course_id string")
    got = curation.candidates(replies, 4, held)
    assert sorted(r["chunk_id"] for r in got.collect()) == ["c0", "c6", "c7"]
    assert curation.candidates(replies, 4, held.limit(0)).count() == 6


@pytest.mark.parametrize("hot,held", [(3, 10), (3, 0), (1000, 10)])
def test_hot_keys_are_dealt_over_parts(spark, monkeypatch, hot, held):
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", held)
    left = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 20), (3, 21), (None, 22)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "z")], "k int, t string")
    got = lookup.join_split(left, right, "k", "v", hot=hot)
    want = left.join(right, "k", "left")
    assert sorted(map(tuple, got.select("k", "v", "t").collect()), key=str) == sorted(map(tuple, want.select("k", "v", "t").collect()), key=str)


def test_contents_have_numbers_and_addresses(spark):
    page = 'x __PRELOADED_STATE__ = {"content": {"book": {"tree": {"contents": [{"slug": "2-1-a", "title": "<b>On</b> a"}, {"slug": "index", "title": "I"}, {"slug": "intro"}]}}}}'
    pages = spark.createDataFrame([(1, "logic", page), (2, "logic", page), (3, "other", None)], "page_id int, book string, html string")
    got = sorted(map(tuple, html.toc(pages, book="book", base_url="https://s").collect()))
    assert got == [("logic", "2-1-a", "On a", "2", "1", "https://s/books/logic/pages/2-1-a"), ("logic", "intro", "intro", None, None, "https://s/books/logic/pages/intro")]


def test_prompts(spark):
    df = spark.createDataFrame([("ocw_philosophy", "A passage."), ("x", None)], "c string, p string")
    made = [r[0] for r in df.select(tx.question_prompt("factual", F.col("c"), F.col("p"))).collect()]
    assert "textbook of philosophy." in made[0] and "Passage:\nA passage.\n" in made[0] and '{"question_type": "factual", ' in made[0] and "textbook of x." in made[1]
    assert df.select(tx.translation_prompt(F.col("p"))).first()[0].endswith("\n\nA passage.")
    with pytest.raises(ValueError):
        tx.question_prompt("other", F.col("c"), F.col("p"))


def test_annotation_summary(spark):
    rows = spark.createDataFrame([("q1", "correct_grounded", "g1"), ("q1", "correct_grounded", "g1"), ("q2", "unsupported", "g2"), ("q2", "unsupported", "g2"), ("q3", "unsupported", "")], "qid string, label string, g string").withColumn("pos", F.monotonically_increasing_id())
    got = {(r["kind"], r["value"]): r["figure"] for r in grounding.annotation_summary(rows, "label", "g", "pos").collect()}
    assert got == {("total_rows", ""): 5, ("label_distribution", "correct_grounded"): 2, ("label_distribution", "unsupported"): 3, ("intra_annotator_kappa", ""): 1}
    assert {r["kind"] for r in grounding.annotation_summary(rows.where("g = ''"), "label", "g", "pos").collect()} == {"total_rows", "label_distribution"}
