"""Sampling, near-duplicates, splitting, encoding, mixing and content scores against brute force and exact round trips."""

import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import heldout
from corpusmill.llm import content, encoding, lexicon, mixing, neardup, ngrams, ranks, sampling, splitting

# ------------------------------------------------------------------ ranks and p4


def test_ranks_in_buckets(spark):
    rows = [("hot", i, 1 + i % 7) for i in range(2000)] + [("cold", i, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, k long, w long").repartition(5)
    got = defaultdict(list)
    for r in ranks.ranked(df, ["g"], ranks.order_hash(1, F.col("k")), ["k"], weight="w", bucket_rows=100).collect():
        got[r["g"]].append((r["_rank"], r["_before"], r["w"], r["_order"]))
    for g, n in (("hot", 2000), ("cold", 5)):
        ordered = sorted(got[g])
        assert [x[0] for x in ordered] == list(range(1, n + 1))
        assert [x[1] for x in ordered] == [0, *itertools.accumulate(x[2] for x in ordered)][:-1]
        assert [x[3] for x in ordered] == sorted(x[3] for x in ordered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 10), st.integers(0, 4)), min_size=1, max_size=6), st.integers(0, 60))
def test_seats_are_the_smallest_priorities(categories, size):
    counts, shares, floors = map(list, zip(*categories))
    items = sorted((0 if r < f else 1, (r + 0.5) / s if s else float("inf"), i) for i, (c, s, f) in enumerate(categories) for r in range(c) if s or r < f)
    want = Counter(i for _, _, i in items[:size])
    got = sampling.seats(counts, [float(s) for s in shares], floors, size)
    assert sum(got) == min(size, len(items))
    # equal priorities of several categories may fall either way: compare the priorities, not the names
    last = lambda n: sorted((0 if r < f else 1, round((r + 0.5) / s, 9) if s else float("inf")) for (c, s, f), k in zip(categories, n) for r in range(k))
    assert last(got) == last([want[i] for i in range(len(counts))])


def test_sample_and_report(spark):
    rows = [(i, "a", " Factual") for i in range(300)] + [(300 + i, "a", "conceptual") for i in range(90)] + [(400 + i, "b", "factual") for i in range(6)] + [(500, None, "factual"), (501, "a", None), (502, "z", "factual")]
    df = spark.createDataFrame(rows, "k long, course_id string, question_type string").withColumn("rank", F.lit(7)).withColumn("n_seats", F.lit(7))
    targets = spark.createDataFrame([("a", "factual", 500, 2), ("a", "conceptual", 300, 2), ("b", "factual", 200, 3), ("c", "factual", 0, 1)], "course_id string, question_type string, share_permille int, min_rows int")
    report = {(r["course_id"], r["question_type"]): r for r in sampling.plan(df, targets).collect()}
    assert report["b", "factual"]["n_seats"] == 6 and report["b", "factual"]["short"] and report["c", "factual"]["short"] and not report["a", "factual"]["short"]
    size = report["a", "factual"]["sample_size"]
    drawn = sampling.draw(df.drop("rank", "n_seats"), targets, "k").collect()
    assert len(drawn) == size == (300 + 90 + 6 + 1) // 4 and len({r["k"] for r in drawn}) == size
    assert Counter((r["course_id"], r["question_type"]) for r in drawn) == {k: r["n_seats"] for k, r in report.items() if r["n_seats"]}
    assert sampling.draw(df.limit(0).drop("rank", "n_seats"), targets, "k").count() == 0
    assert sampling.plan(df.limit(0), targets).where("short").count() == 4


# ------------------------------------------------------------------ p6


def brute_pairs(texts, t):
    sets = {k: set(re.findall(r"\w+", (x or "").lower())) for k, x in texts}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12:
            out.add((a, b))
    return out


def near_texts(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 9, 16, 30]))] for _ in range(25)]
    out = []
    for k in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            x[rng.randrange(len(x))] = rng.choice(words)
        rng.shuffle(x)
        out.append((k, " ".join(x)))
    return out + [(n, None), (n + 1, ""), (n + 2, "."), (n + 3, "w1 " * 3000)]


@pytest.mark.parametrize("seed,threshold,light,block,refined", [(1, 0.75, 4096, 4096, 10**6), (2, 0.75, 4096, 3, 10**6), (3, 0.8, 2, 4, 10**6), (4, 0.5, 2, 4096, 10**6), (5, 0.75, 1, 2, 5)])
def test_similar_rows_are_those_of_brute_force(spark, monkeypatch, seed, threshold, light, block, refined):
    """Words refined from two postings on, lists in blocks of a few, more long lists than are refined."""
    monkeypatch.setattr(neardup, "LIGHT", light)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "REFINED", refined)
    texts = near_texts(seed)
    df = spark.createDataFrame(texts, "k long, t string").withColumn("group", F.lit("clash")).withColumn("words", F.lit(1))
    got = [(r["a"], r["b"]) for r in neardup.similar_rows(df, "k", "t", threshold).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(texts, threshold)


def test_classes(spark):
    texts = near_texts(5, 120)
    df = spark.createDataFrame(texts, "k long, t string")
    got = {r["k"]: r for r in neardup.classes(df, "k", "t", 0.75).collect()}
    assert len(got) == len(texts)
    parent = {k: k for k, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(texts, 0.75):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    by_component, by_root = defaultdict(set), defaultdict(set)
    for k, _ in texts:
        by_component[got[k]["component"]].add(k)
        by_root[root(k)].add(k)
    assert sorted(map(sorted, by_component.values())) == sorted(map(sorted, by_root.values()))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["item"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100} or got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_no_records(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert neardup.similar_rows(df, "k", "t", 0.75).count() == 0
    assert neardup.classes(df, "k", "t", 0.75).count() == 0


# ------------------------------------------------------------------ p7


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 3000), st.integers(2, 90), st.randoms(use_true_random=False))
def test_pieces_hold_the_limit_the_overlap_and_every_word(n, limit, rng):
    overlap = rng.randrange(0, limit)
    text = "".join(f"w{i}" + rng.choice([" ", " ", " ", ". ", ", ", "\n", "\n\n"]) for i in range(n)).strip()
    made = splitting.pieces(text, limit, overlap)
    words = re.findall(r"\S+", text)
    assert made[0][0] == 0 and made[-1][1] == len(words)
    for i, (a, b, c, d) in enumerate(made):
        assert text[c:d].split() == words[a:b] and b - a <= limit
        if i:
            assert a == max(0, made[i - 1][1] - overlap) and b > made[i - 1][1]


def test_pieces_cut_at_paragraphs_and_evenly():
    text = "\n\n".join(" ".join(["word"] * 99 + ["end."]) for _ in range(10))
    made = splitting.pieces(text, 512, 64)
    assert len(made) == 3 and all(b % 100 == 0 for _, b, _, _ in made)
    plain = splitting.pieces("x " * 1000, 512, 64)
    assert len(plain) == 3 and max(b - a for a, b, _, _ in plain) - min(b - a for a, b, _, _ in plain) <= 2
    with pytest.raises(ValueError):
        splitting.cuts(np.zeros(10), 9, 5, 5)


def test_split_items(spark):
    docs = spark.createDataFrame([(1, "a " * 600), (2, "b"), (3, None), (4, ""), (5, "c " * 512)], "doc_id long, text string")
    chunks = spark.createDataFrame([("k1", "d " * 700), ("k1", "d " * 700), ("k2", "e")], "chunk_id string, text string")
    items = splitting.items_of(docs, chunks)
    got = Counter((r["item_kind"], r["item_key"]) for r in splitting.split(items, oversized_only=True).collect())
    assert got == {("document", "1"): 2, ("chunk", "k1"): 2}
    every = splitting.split(items).collect()
    assert {r["item_key"] for r in every} == {"1", "2", "4", "5", "k1"} and all(r["n_words"] <= 512 for r in every)


def test_words_between_separators(spark):
    items = spark.createDataFrame([("document", "1", chr(0x1C).join(f"w{i}" for i in range(600)))], "item_kind string, item_key string, text string")
    rows = splitting.split(items, oversized_only=True).collect()
    assert len(rows) == 2 and sum(r["n_words"] for r in rows) == 600 + 64


# ------------------------------------------------------------------ p8 and p9

needs_tokenizer = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no tokenizer here")
TEXTS = ["", "Hello world, it's 3.50!  \n\n  Next", "Ўзбек тили — маъно", "<|endoftext|> is text", "a" * 300, " " * 250 + "x", "1234567890 " * 40, "x\n" * 120, "'ll 've don't " * 30, "日本語のテキスト" * 20, "emoji 👩‍👩‍👧 " * 15, "one, two; three 4 five\n" * 3000, "x" * 40000 + " end"]


@needs_tokenizer
@pytest.mark.parametrize("chunk,overlap", [(64, 16), (40, 20), (encoding.CHUNK_CHARS, encoding.OVERLAP_CHARS)])
def test_chunked_encoding_is_that_of_the_whole(spark, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["doc_id"]: list(r["ids"]) for r in encoding.encode(df, chunk=chunk, overlap=overlap).collect()}
    whole = encoding.encoder()
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in rows}
    assert all(encoding.decode(got[i]).decode() == t for i, t in rows if t)


@needs_tokenizer
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400), st.integers(20, 60))
def test_stitches_are_boundaries_of_the_whole(text, chunk):
    overlap = chunk // 3
    starts = encoding.chunk_starts(len(text), chunk, overlap)
    heads, tails = [], []
    for s in starts:
        h, t = encoding.bounds(text[s : s + chunk], s + chunk >= len(text), overlap)
        heads.append([s + x for x in h])
        tails.append([s + x for x in t])
    whole = {m.start() for m in encoding._pattern().finditer(text)}
    cuts = encoding.stitches(heads, tails)
    assert set(cuts) <= whole and cuts == sorted(set(cuts))


@needs_tokenizer
@pytest.mark.parametrize("blanks", ["\n\n", " \n", "\t\t", "\n", "\n \n\n", "  ", " "])
def test_pieces_of_paragraphs_have_the_ids_of_the_whole(blanks):
    chunk, overlap = 64, 16
    encode = encoding.encoder().encode_ordinary
    n_cuts = 0
    for shift in range(chunk):
        text = "a" * shift + blanks + blanks.join(["word next", "some more words here", "it's 5", "end."] * 6)
        starts = encoding.chunk_starts(len(text), chunk, overlap)
        both = [(s, encoding.bounds(text[s : s + chunk], s + chunk >= len(text), overlap)) for s in starts]
        cuts = encoding.stitches([[s + x for x in h] for s, (h, _) in both], [[s + x for x in t] for s, (_, t) in both])
        edges = [0, *cuts, len(text)]
        n_cuts += len(cuts)
        assert [i for a, b in zip(edges, edges[1:]) for i in encode(text[a:b])] == encode(text), (shift, cuts)
    assert n_cuts


@needs_tokenizer
def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = encoding.VOCABULARY.replace(".tiktoken", ".json")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    for t in TEXTS:
        assert other.encode(t, add_special_tokens=False).ids == encoding.encoder().encode_ordinary(t)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1))
def test_the_schedule_stays_within_a_block_of_every_target(weights):
    order = mixing.period(weights)
    total, done = sum(weights.values()), Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        for x, w in weights.items():
            assert abs(done[x] - t * w / total) < 1
    assert mixing.period({}) == []


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, "big", rng.randrange(5, 60)) for i in range(900)] + [(1000 + i, "mid", rng.randrange(5, 60)) for i in range(200)] + [(2000 + i, "small", rng.randrange(5, 60)) for i in range(40)] + [(3000, "none", 10), (3001, None, 10), (3002, "big", 0)]
    counted = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    sources = spark.createDataFrame([("big", 600, 1), ("mid", 300, 2), ("small", 100, 3), ("absent", 0, 1)], "source string, target_permille int, max_repeats int")
    mixed = mixing.mix(None, sources, counted=counted, block=100).collect()
    per_doc = Counter(r["doc_id"] for r in mixed)
    caps = {"big": 1, "mid": 2, "small": 3}
    assert all(per_doc[r["doc_id"]] <= caps[r["source"]] for r in mixed)
    tokens = Counter()
    for r in mixed:
        tokens[r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - w) < 0.01 for s, w in (("big", 0.6), ("mid", 0.3), ("small", 0.1)))
    by_slot = defaultdict(set)
    for r in mixed:
        by_slot[r["slot"]].add(r["source"])
    assert all(len(x) == 1 for x in by_slot.values())
    report = {r["source"]: r for r in mixing.report(mixing.mix(None, sources, counted=counted, block=100), counted, sources).collect()}
    assert set(report) == {"big", "mid", "small"} and not any(r["short"] for r in report.values())
    over = {r["source"]: r for r in mixing.report(mixing.mix(None, sources, counted=counted, total=10**6), counted, sources, total=10**6).collect()}
    assert over["small"]["short"] and over["small"]["largest_copy"] == 2
    assert mixing.mix(None, sources, counted=counted.limit(0)).count() == 0


# ------------------------------------------------------------------ p10

GOLD = [
    ("abusive", "You are a stupid idiot, get lost."), ("abusive", "Shut up, you filthy moron."), ("abusive", "I will smash your face, loser."), ("abusive", "Nobody likes you, you pathetic clown."), ("abusive", "Sen ahmoqsan, yo'qol."),
    ("hateful", "Those refugees are vermin and should be driven out."), ("hateful", "Immigrants breed like rats and poison this country."), ("hateful", "We should round up all foreigners and burn their houses."), ("hateful", "Ularni haydash kerak, ular odam emas."),
    ("sexual", "Send me nudes, I am so horny."), ("sexual", "Watch my naked webcam show, adults only."), ("sexual", "Hot porn clips, click for the uncensored sex tape."), ("sexual", "Menga yalang'och rasmlaringni yubor."),
    ("none", "The table lists many students and one proof."), ("none", "The idiot problem in old logic books concerns a proof."), ("none", "The plague of rats in the north is counted in the archive."), ("none", "The survey coded sex as a binary column."), ("none", "Pornography and censorship are treated in the chapter."),
]


def test_disguises():
    for text, word in (("you 1d10t", "idiot"), ("a piiiig", "pig"), ("so h o r n y now", "horny"), ("ID!OT?", "id"), ("p0rn", "porn"), ("L0000SER", "loser")):
        assert word in content.undisguised(text), (text, content.undisguised(text))
    assert content.undisguised("In 1984 there were 300 books.") == "in 1984 there were 300 books."


def test_label_model_finds_the_better_voter():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.3
    v = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.9, 0.55)], axis=1) * 1
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    gold, labels = np.array([[1, 1, 1], [0, 0, 0]]), np.array([1.0, 0.0])
    q = {tuple(p): x for p, x in zip(patterns.tolist(), content.label_model(patterns, counts, gold, labels, most=0.5, silence=9.0))}
    assert q[1, 1, 0] > 0.8 and q[0, 0, 1] < 0.2


def test_dependencies_are_those_beyond_the_label():
    """A noisy copy depends on what it copies; voters that only the label makes alike depend on nothing."""
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.3
    a, b, c = [np.where(rng.random(20000) < p, truth, ~truth) * 1 for p in (0.9, 0.8, 0.85)]
    copy = np.where(rng.random(20000) < 0.95, b, 1 - b)
    v = np.stack([a, b, c, copy], axis=1)
    hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)
    assert content._tree(hot, truth.astype(float), np.ones(len(v))) in ([-1, -1, -1, 1], [-1, 3, -1, -1])


def _flags():
    """A model of votes only."""
    further = np.array([[5.0 * (c == own and vote > 0) for c in content.CATEGORIES] for own, vote, _ in content.VOTERS.values()])
    return content.Model(ngrams.Linear(np.zeros((1 << ngrams.BITS, 3)), np.full(3, -3.0), further), ())


def test_both_scripts_score_alike():
    """Words are scored in the form in which they were learnt, voted sentences or not."""
    model = content.Model(ngrams.Linear(np.random.default_rng(3).normal(size=(1 << ngrams.BITS, 3)), np.zeros(3), np.zeros((len(content.VOTERS), 3))), ())
    same = [("Ғалати шубҳали сўзлар.", "G'alati shubhali so'zlar."), ("Картина в музее.", "Kartina v muzee."), ("G‘alati so‘zlar.", "G'alati so'zlar.")]
    for a, b in same:
        assert np.allclose(content.judge([a], model), content.judge([b], model)), a


def test_entries_are_found_in_every_form():
    voting = lexicon.voting(())
    for role in lexicon.ROLES:
        for entry in lexicon.entries(role):
            word = lexicon.tidy(lexicon.bare(entry.rstrip("*"))) + ("xx" if entry.endswith("*") else "")
            hits = [r for _, (r, _) in voting.automaton.iter(f" so {word} then ")]
            assert any(r & 1 << voting.names.index(role) for r in hits), (role, entry)
    assert voting.votes(["nothing here", "you idiot"])[0] is None and voting.votes([]) == []


def test_voters_see_every_sentence(spark):
    texts = ["They should all be shot, those animals.", "those people deserve to die", "I will find you and beat you", "You dummy.", "Sen hayvon.", "Их всех надо расстрелять.", "Чтоб ты сдохни"]
    assert (content.judge(texts, _flags())[:, :2].max(axis=1) > 0.8).all()
    assert (content.judge(["The matrix is sparse."], _flags()) < 0.1).all()
    rows = content._survey(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "The matrix is sparse. So it goes.", None])], "doc_id long, text string"), "text", ()).collect()
    for c in content.CATEGORIES:
        assert sum(r["n"] for r in rows if r["kind"] == c) == len(texts) + 2
    assert sum(r["n"] for r in rows if r["kind"] in ("n_strong", "n_weak", "n_silent")) == len(texts) + 2
    assert {r["content"] for r in rows if r["kind"] == "silent"} == {"the matrix is sparse", "so it goes"}


@pytest.fixture(scope="module")
def judge(spark):
    folder = "/root/testdata/sf0.01"
    return content.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/content_samples.parquet"))


@pytest.mark.parametrize("category", content.CATEGORIES)
def test_sentences_in_other_words(judge, category):
    """Held-out sentences in English, Uzbek and Russian."""
    texts = heldout.ABUSE[category]
    assert len(texts) >= 40
    got = content.judge(texts, judge)[:, content.CATEGORIES.index(category)] >= content.THRESHOLD
    assert got.mean() >= 0.9, [t for t, x in zip(texts, got) if not x]


def test_scholarly_mention_is_no_case(judge):
    got = content.judge(heldout.HARMLESS, judge).max(axis=1) >= content.THRESHOLD
    assert got.mean() <= 0.05, [t for t, x in zip(heldout.HARMLESS, got) if x]


def test_scores(spark):
    rng = random.Random(1)
    words = "proof table student theory limit archive sample reader method column".split()
    plain = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(120)]
    docs = [(i, "s1", " ".join(plain[i : i + 3])) for i in range(100)]
    docs += [(200 + i, "s2", plain[i] + " " + t) for i, (_, t) in enumerate(GOLD)] + [(300, None, None), (301, "s2", ""), (302, "s1", plain[0] * 500), (303, "s2", "What a w0rthless idiooooot; get lost, you clown."), (304, "s2", "Hozir menga yalang'och rasmlaringni yubor.")]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("category", F.lit("clash"))
    gold = spark.createDataFrame([(c, t) for c, t in GOLD], "category string, text string")
    scored = content.score(documents, gold, keep=("source",))
    found = {tuple(r) for r in content.found(scored).collect()}
    assert found == {(200 + i, c) for i, (c, _) in enumerate(GOLD) if c != "none"} | {(303, "abusive"), (304, "sexual")}
    assert scored.count() == len(docs)
    rates = {r["source"]: r for r in content.rates(scored).collect()}
    assert rates[None]["n_documents"] == 1 and rates["s1"]["n_abusive"] == 0 and rates["s2"]["n_sexual"] == 5
    assert content.score(documents.limit(0), gold).count() == 0
