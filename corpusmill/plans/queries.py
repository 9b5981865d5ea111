"""The engine's queries on the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import chunking, curation, evaluation, failures, grounding, html, ingest, reports, retrieval
from corpusmill.operators.lookup import last_per_key
from corpusmill.streaming import incremental
from corpusmill.session import checkpointed
from corpusmill.tables import Tables

from .registry import query

# ------------------------------------------------------------------ SQL fragments

WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _norm(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def _n_words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{NOT_WS}+'))"


def _overlap(q: str, o: str) -> str:
    a = f"list_distinct({_tokens(q)})"
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, list_distinct({_tokens(o)}))) / len({a})::DOUBLE END"


CHUNKS = "chunks_once AS (SELECT chunk_id, max(doc_id) AS doc_id, max(course_id) AS course_id, max(text) AS text FROM chunks GROUP BY chunk_id)"
GOLD = "gold AS (SELECT qid, max(gold_chunk_ids) AS gold_chunk_ids FROM gold_labels GROUP BY qid)"
LAST_QUESTION = "asked AS (SELECT qid, course_id, language, lower(trim(question_type)) AS question_type, question_text FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY question_row DESC) AS n FROM questions) WHERE n = 1)"


def _chunks(t: Tables) -> DataFrame:
    return t.chunks.groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("course_id").alias("course_id"), F.max("text").alias("text"))


def _gold(t: Tables) -> DataFrame:
    return t.gold_labels.groupBy("qid").agg(F.max("gold_chunk_ids").alias("gold_chunk_ids"))


def _questions(t: Tables) -> DataFrame:
    return t.questions.withColumn("question_type", F.lower(F.trim("question_type")))


# ------------------------------------------------------------------ text


@query("txt1_normalize_whitespace", f"SELECT doc_id, {_norm('text')} AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))


@query("txt2_tokens", f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, len(list_distinct({_tokens('text')})) AS n_distinct, md5(array_to_string({_tokens('text')}, ' ')) AS tokens_md5 FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    tokens = tx.tokens(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@query(
    "txt4_sentences",
    rf"""
WITH n AS (SELECT doc_id, {_norm("text")} AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?]){WS}+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: {_strip("y")}), lambda y: len(y) > 0) AS parts FROM n WHERE x <> '')
SELECT doc_id, unnest(range(len(parts)))::INT AS sentence_index, unnest(parts) AS sentence FROM s""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query("txt6_normalize_text", f"SELECT question_row, regexp_replace(lower({_strip('question_text')}), '{WS}+', ' ', 'g') AS text, len(regexp_extract_all(question_text, '[\\p{{L}}\\p{{N}}_]+')) AS n_words FROM questions")
def _(t: Tables) -> DataFrame:
    return t.questions.select("question_row", tx.normalize_text(F.col("question_text")).alias("text"), tx.n_tokens(F.col("question_text")).alias("n_words"))


@query(
    "txt7_ratios",
    rf"""
SELECT answer_row, round(CASE WHEN len(regexp_replace(answer, '{WS}+', '', 'g')) = 0 THEN 1.0 ELSE len(regexp_replace(answer, '{WS}+|[^\x00-\x7f]', '', 'g'))::DOUBLE / len(regexp_replace(answer, '{WS}+', '', 'g')) END, 6) AS ascii_ratio,
round(len(regexp_replace(answer, '[\x00-\x7f]', '', 'g'))::DOUBLE / greatest(len(answer), 1), 6) AS non_ascii_ratio, regexp_matches(answer, '[А-Яа-яЁё]') AS has_cyrillic FROM answers WHERE answer IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    a = F.col("answer")
    return t.answers.where(a.isNotNull()).select("answer_row", F.round(tx.ascii_ratio(a), 6).alias("ascii_ratio"), F.round(tx.non_ascii_ratio(a), 6).alias("non_ascii_ratio"), tx.has_cyrillic(a).alias("has_cyrillic"))


def _cut(x: str) -> str:
    for m in tx.AFTER_MARKERS:
        x = "string_split({}, '{}')[1]".format(x, m.replace("'", "''"))
    return _strip(x)


_BEFORE_END = _strip(f"string_split(coalesce(answer, ''), '{tx.END_TOKEN}')[1]")


@query("txt10_cut_answers", f"SELECT answer_row, {_cut(_BEFORE_END)} AS answer FROM answers")
def _(t: Tables) -> DataFrame:
    return t.answers.select("answer_row", tx.strip_after_markers(tx.before_end_token(F.coalesce("answer", F.lit("")))).alias("answer"))


@query("txt11_citations", r"SELECT answer_row, len(regexp_extract_all(answer, '\[([^\[\]]+)\]', 1)) AS n_citations, array_to_string(regexp_extract_all(answer, '\[([^\[\]]+)\]', 1), '|') AS cited FROM answers WHERE answer IS NOT NULL")
def _(t: Tables) -> DataFrame:
    cited = tx.citations(F.col("answer"))
    return t.answers.where("answer is not null").select("answer_row", F.size(cited).alias("n_citations"), F.array_join(cited, "|").alias("cited"))


@query("txt13_ids", r"SELECT DISTINCT chunk_id, array_to_string(string_split(chunk_id, '_')[1:3], '_') AS chapter, regexp_replace(chunk_id, '_[^_]*$', '') AS document FROM chunks")
def _(t: Tables) -> DataFrame:
    c = F.col("chunk_id")
    return t.chunks.select(c, tx.chapter_prefix(c).alias("chapter"), tx.document_of(c).alias("document")).distinct()


@query("txt15_gold_overlap", f"WITH {CHUNKS}, {GOLD}, g AS (SELECT qid, unnest(gold_chunk_ids) AS chunk_id FROM gold) SELECT q.question_row, c.chunk_id, round({_overlap('coalesce(q.question_text, chr(32))', 'coalesce(c.text, chr(32))')}, 6) AS overlap FROM questions q JOIN g ON q.qid = g.qid JOIN chunks_once c ON c.chunk_id = g.chunk_id")
def _(t: Tables) -> DataFrame:
    gold = _gold(t).select("qid", F.explode("gold_chunk_ids").alias("chunk_id"))
    joined = t.questions.select("question_row", "qid", "question_text").join(gold, "qid").join(_chunks(t).select("chunk_id", "text"), "chunk_id")
    return joined.select("question_row", "chunk_id", F.round(tx.overlap_ratio(F.col("question_text"), F.col("text")), 6).alias("overlap"))


@query("txt16_gold_lists", "SELECT qid, array_to_string(gold_chunk_ids, ' ') AS chunk_ids, array_to_string(list_sort(list_distinct(list_transform(gold_chunk_ids, lambda x: regexp_replace(x, '_[^_]*$', '')))), ' ') AS doc_ids FROM gold_labels")
def _(t: Tables) -> DataFrame:
    joined = F.array_join("gold_chunk_ids", ", ")
    docs = tx.doc_id_list(F.array_join(F.transform("gold_chunk_ids", tx.document_of), " "))
    return t.gold_labels.select("qid", F.array_join(tx.chunk_id_list(joined), " ").alias("chunk_ids"), F.array_join(docs, " ").alias("doc_ids"))


@query("txt18_names", "SELECT question_row, CASE course_id WHEN 'ocw_data_science' THEN 'data science' WHEN 'ocw_philosophy' THEN 'philosophy' ELSE course_id END AS course, CASE WHEN language = 'en' THEN 'English' ELSE 'Uzbek' END AS language_name FROM questions")
def _(t: Tables) -> DataFrame:
    return t.questions.select("question_row", tx.course_name(F.col("course_id")).alias("course"), tx.language_name(F.col("language")).alias("language_name"))


@query("txt20_json_objects", "SELECT event_id, json_array_length('[' || props || ']')::INT AS n_objects FROM events")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("The result is:\n```json\n["), F.col("props"), F.lit("]\n```"))
    return t.events.select("event_id", F.size(curation.parse_json(raw)).alias("n_objects"))


_PAGE = "'<html><style>p {{}}</style><SCRIPT type=\"x\">if (a < b) {{}}</SCRIPT><h1>' || coalesce(title, '') || '</h1><p class=\"a\">' || coalesce(text, '') || '</p></html>'".replace("{{", "{").replace("}}", "}")


@query("htm1_strip_html", f"SELECT doc_id, {_norm(rf'''regexp_replace(regexp_replace(regexp_replace({_PAGE}, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')''')} AS text FROM documents")
def _(t: Tables) -> DataFrame:
    none = F.lit("")
    page = F.concat(F.lit('<html><style>p {}</style><SCRIPT type="x">if (a < b) {}</SCRIPT><h1>'), F.coalesce("title", none), F.lit('</h1><p class="a">'), F.coalesce("text", none), F.lit("</p></html>"))
    return t.documents.select("doc_id", tx.strip_html(page).alias("text"))


# ------------------------------------------------------------------ ingest and chunks


@query(
    "ing2_section_ids",
    r"""
WITH s AS (SELECT doc_id, course_id, replace(regexp_replace(doc_key, '[a-z]+', '', 'g'), '_', '-') || '-intro' AS slug FROM documents),
n AS (SELECT *, list_filter(string_split(slug, '-'), lambda x: regexp_full_match(x, '[0-9]+')) AS parts FROM s)
SELECT doc_id, nullif(regexp_extract(slug, '^(\d+)(?:-(\d+))?', 1), '') AS chapter, nullif(regexp_extract(slug, '^(\d+)(?:-(\d+))?', 2), '') AS section,
course_id || '_ch' || lpad(parts[1]::INT::VARCHAR, greatest(2, len(parts[1]::INT::VARCHAR))::INT, '0') || '_s' || lpad(parts[2]::INT::VARCHAR, greatest(2, len(parts[2]::INT::VARCHAR))::INT, '0') AS identifier FROM n""",
)
def _(t: Tables) -> DataFrame:
    slug = F.concat(F.replace(F.regexp_replace("doc_key", "[a-z]+", ""), F.lit("_"), F.lit("-")), F.lit("-intro"))
    chapter, section = tx.slug_numbers(slug)
    return t.documents.select("doc_id", chapter.alias("chapter"), section.alias("section"), tx.section_identifier(slug, F.col("course_id")).alias("identifier"))


_SECTION = "replace(doc_key, '_', '-') || '-' || doc_id"


@query(
    "ing3_documents",
    rf"""
WITH s AS (SELECT course_id, {_SECTION} AS section_slug, title, source_url, text FROM documents WHERE course_id IS NOT NULL AND doc_key IS NOT NULL),
n AS (SELECT *, list_filter(string_split(section_slug, '-'), lambda x: regexp_full_match(x, '[0-9]+')) AS parts FROM s),
w AS (SELECT *, CASE WHEN len(parts) >= 2 THEN course_id || '_ch' || lpad(parts[1]::BIGINT::VARCHAR, greatest(2, len(parts[1]::BIGINT::VARCHAR))::INT, '0') || '_s' || lpad(parts[2]::BIGINT::VARCHAR, greatest(2, len(parts[2]::BIGINT::VARCHAR))::INT, '0')
  WHEN len(parts) = 1 THEN course_id || '_ch' || lpad(parts[1]::BIGINT::VARCHAR, greatest(2, len(parts[1]::BIGINT::VARCHAR))::INT, '0') || '_s00' ELSE course_id || '_' || replace(section_slug, '-', '_') END AS doc_id FROM n)
SELECT doc_id, course_id, coalesce(title, array_to_string(list_transform(string_split(section_slug, '-'), lambda x: upper(x[1]) || lower(x[2:])), ' ')) AS title, coalesce(source_url, 'https://course.example/' || section_slug) AS source_url, {_norm('text')} AS text FROM w""",
)
def _(t: Tables) -> DataFrame:
    slug = F.concat(F.replace("doc_key", F.lit("_"), F.lit("-")), F.lit("-"), F.col("doc_id").cast("string"))
    rows = t.documents.where("course_id is not null and doc_key is not null").select("course_id", slug.alias("section_slug"), "title", F.col("source_url").alias("url"), "text", F.col("doc_id").alias("_pos"))
    courses = rows.select("course_id", F.col("course_id").alias("doc_prefix"), F.lit("CC BY").alias("license"), F.lit("textbook").alias("source_type"), F.lit("https://course.example").alias("base_url")).distinct()
    made = ingest.build_documents(rows.select("course_id", "section_slug", "text"), rows.drop("text"), courses, "2024-01-01")
    return made.select("doc_id", "course_id", "title", "source_url", "text")


_STATE = """'{"content": {"book": {"tree": {"slug": "", "contents": [{"slug": "index", "title": "Index"}, {"slug": "' || doc_id || '-2-part", "title": "<b>Part</b> of <i>' || course_id || '</i>"}, {"title": "Above", "contents": [{"slug": "' || source || '", "title": ""}]}]}}}}'"""


@query(
    "htm5_contents",
    f"""
WITH d AS (SELECT doc_id, source, course_id FROM documents WHERE course_id IS NOT NULL),
e AS (SELECT course_id AS book, doc_id || '-2-part' AS section_slug, 'Part of ' || course_id AS title, doc_id::VARCHAR AS chapter_number, '2' AS section_number FROM d
UNION ALL SELECT DISTINCT course_id, source, source, nullif(regexp_extract(source, '^([0-9]+)', 1), ''), NULL FROM d)
SELECT DISTINCT book, section_slug, title, chapter_number, section_number, 'https://site.example/books/' || book || '/pages/' || section_slug AS url FROM e""",
)
def _(t: Tables) -> DataFrame:
    pages = t.documents.where("course_id is not null").select("doc_id", F.col("course_id").alias("book"), F.expr(f"concat('<script>window.__PRELOADED_STATE__ = ', {_STATE}, ';</script>')").alias("html"))
    return html.toc(pages, position="doc_id", book="book", base_url="https://site.example")


_MAIN = """'<html><nav>menu</nav><main><h2>' || coalesce(source, '') || '</h2><p>One <b>' || doc_id || '</b></p><ul><li>item</li></ul><script>x()</script></main></html>'"""


@query("htm3_main_content", "SELECT doc_id, '## ' || coalesce(source, '') || chr(10) || chr(10) || 'One ' || doc_id || chr(10) || chr(10) || '- item' AS content, NULL::VARCHAR AS error FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, NULL, 'no main content' FROM documents WHERE doc_id % 7 = 0")
def _(t: Tables) -> DataFrame:
    page = F.expr(f"CASE WHEN doc_id % 7 = 0 THEN '<p>no main</p>' ELSE {_MAIN} END")
    return html.extract(t.documents.select("doc_id", page.alias("html")), "doc_id")


@query("ing4_corpus_stats", f"SELECT CASE WHEN grouping(course_id) = 1 THEN '(all)' ELSE course_id END AS course_id, count(*) AS n_documents, sum({_n_words('text')})::BIGINT AS n_words FROM documents GROUP BY GROUPING SETS ((course_id), ())")
def _(t: Tables) -> DataFrame:
    return ingest.corpus_stats(t.documents)


@query(
    "chk1_word_windows",
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_norm("text")}, '{NOT_WS}+') AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(range(0, (len(words) - 1) // 448 + 1))::INT AS window_index, array_to_string(unnest(list_transform(range(0, (len(words) - 1) // 448 + 1), lambda i: words[i * 448 + 1 : i * 448 + 512])), ' ') AS text FROM w WHERE len(words) > 0""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.posexplode(chunking.split_long_sentence(F.col("text"))).alias("window_index", "text"))


@query(
    "chk4_chunks",
    rf"""
WITH RECURSIVE n AS (SELECT doc_id AS row_id, doc_key, course_id, coalesce(nullif(title, ''), doc_key, 'section') AS section, {_norm("coalesce(text, '')")} AS whole FROM documents),
p AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(whole, '([.!?]){WS}+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), '([.!?]){WS}+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS parts FROM n WHERE whole <> ''),
w AS (SELECT *, list_transform(parts, lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+'))) AS weights FROM p),
s AS (SELECT *, list_transform(range(0, len(parts) + 1), lambda i: coalesce(list_sum(weights[1:i]), 0)) AS sums FROM w),
c(row_id, first, until, total) AS (
  SELECT row_id, 0::BIGINT, greatest(1, len(list_filter(sums, lambda x: x <= 512)) - 1)::BIGINT, len(parts)::BIGINT FROM s
  UNION ALL
  SELECT s.row_id, f.first, greatest(f.first + 1, len(list_filter(s.sums, lambda x: x <= s.sums[f.first + 1] + 512)) - 1)::BIGINT, c.total FROM c JOIN s ON s.row_id = c.row_id,
  LATERAL (SELECT CASE WHEN s.weights[c.first + 1] > 512 THEN c.until ELSE greatest(c.first + 1, least(coalesce(list_max(list_filter(range(0, c.until), lambda i: s.weights[i + 1] > 0)), -1),
    greatest(len(list_filter(s.sums, lambda x: x < s.sums[c.until + 1] - 64)), len(list_filter(s.sums, lambda x: x <= s.sums[c.until + 1] - 64)) - 1))) END AS first) f
  WHERE c.until < c.total),
t AS (SELECT s.row_id, doc_key, course_id, section, c.first, CASE WHEN weights[c.first + 1] > 512 THEN list_transform(range(0, len(regexp_extract_all(parts[c.first + 1], '{NOT_WS}+')), 448), lambda i: array_to_string(regexp_extract_all(parts[c.first + 1], '{NOT_WS}+')[i + 1 : i + 512], ' '))
  ELSE [array_to_string(parts[c.first + 1 : c.until], ' ')] END AS texts FROM c JOIN s ON s.row_id = c.row_id),
u AS (SELECT row_id, doc_key, course_id, section, first, unnest(texts) AS text, unnest(range(0, len(texts))) AS inner_index FROM t)
SELECT doc_key || '_' || lpad((row_number() OVER g - 1)::VARCHAR, 3, '0') AS chunk_id, doc_key AS doc_id, course_id, section, (row_number() OVER g - 1)::INT AS chunk_index, text FROM u WINDOW g AS (PARTITION BY row_id ORDER BY first, inner_index)""",
)
def _(t: Tables) -> DataFrame:
    return chunking.chunk_documents(t.documents.drop("doc_id"), doc_id="doc_key")


@query("chk6_chunk_stats", f"SELECT course_id, count(*) AS n_chunks, round(avg({_n_words('text')}), 6) AS mean_words, median({_n_words('text')})::DOUBLE AS median_words, min({_n_words('text')})::INT AS min_words, max({_n_words('text')})::INT AS max_words FROM chunks GROUP BY course_id")
def _(t: Tables) -> DataFrame:
    return chunking.stats(t.chunks, "course_id")


# ------------------------------------------------------------------ retrieval

_BM25 = rf"""
corpus AS (SELECT chunk_id, {_tokens("coalesce(text, '')")} AS words FROM chunks_once),
size AS (SELECT count(*) AS n_rows, avg(len(words)) AS avgdl FROM corpus),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(words) AS dl, unnest(words) AS term FROM corpus) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf0 AS (SELECT term, df, ln(n_rows - df + 0.5) - ln(df + 0.5) AS idf0 FROM df CROSS JOIN size),
idf AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * (SELECT avg(idf0) FROM idf0) END AS idf FROM idf0)"""


@query("ret1_postings", f"WITH {CHUNKS}, {_BM25} SELECT chunk_id, term, tf FROM tf")
def _(t: Tables) -> DataFrame:
    return retrieval.postings(_chunks(t), "chunk_id", "text")


@query("ret1_term_weights", f"WITH {CHUNKS}, {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(t: Tables) -> DataFrame:
    return retrieval.term_weights(_chunks(t), "text").withColumn("idf", F.round("idf", 6))


_BM25_RANKED = rf"""
q AS (SELECT question_row, term, count(*) AS n FROM (SELECT question_row, unnest({_tokens("coalesce(question_text, '')")}) AS term FROM questions WHERE question_row % 50 = 0) GROUP BY ALL),
hits AS (SELECT q.question_row, tf.chunk_id, sum(q.n * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.dl / size.avgdl))) AS score, count(*) AS shared FROM q JOIN idf ON idf.term = q.term JOIN tf ON tf.term = q.term CROSS JOIN size GROUP BY ALL),
full_scores AS (SELECT x.question_row, c.chunk_id, round(coalesce(h.score, 0), 10) AS score, coalesce(h.shared, 0) AS shared FROM (SELECT question_row FROM questions WHERE question_row % 50 = 0) x CROSS JOIN corpus c LEFT JOIN hits h ON h.question_row = x.question_row AND h.chunk_id = c.chunk_id),
chosen AS (SELECT question_row, chunk_id, CASE WHEN max(score) OVER (PARTITION BY question_row) = 0 THEN shared ELSE score END AS score FROM full_scores),
ranked AS (SELECT question_row, chunk_id, row_number() OVER (PARTITION BY question_row ORDER BY score DESC, chunk_id) AS rank, round(score, 6) AS score FROM chosen)"""


def _search(t: Tables) -> DataFrame:
    """The stated query set: every question whose row is divisible by 50, against all chunks, whose repeated rows are put together once."""
    return retrieval.bm25(t.questions.where("question_row % 50 = 0"), checkpointed(_chunks(t)), "question_row", "question_text", "chunk_id", "text")


@query("ret4_bm25_topk", f"WITH {CHUNKS}, {_BM25}, {_BM25_RANKED} SELECT question_row, chunk_id, rank::INT AS rank, score FROM ranked WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    return _search(t)


@query(
    "ret3_zero_scores",
    f"WITH chunks_once AS (SELECT n_name AS chunk_id, n_name || ' of the world' AS text FROM nation WHERE n_nationkey < 2), questions AS (SELECT n_nationkey * 50 AS question_row, n_name || ' ALGERIA' AS question_text FROM nation), {_BM25}, {_BM25_RANKED} SELECT question_row, chunk_id, rank::INT AS rank, score FROM ranked WHERE rank <= 10",
)
def _(t: Tables) -> DataFrame:
    """Two rows in which every word stands once or twice: nothing scores above 0, and shared words decide."""
    corpus = t.nation.where("n_nationkey < 2").select(F.col("n_name").alias("chunk_id"), F.concat("n_name", F.lit(" of the world")).alias("text"))
    asked = t.nation.select((F.col("n_nationkey") * 50).alias("question_row"), F.concat("n_name", F.lit(" ALGERIA")).alias("question_text"))
    return retrieval.bm25(asked, corpus, "question_row", "question_text", "chunk_id", "text")


@query("ret10_result_lists", f"WITH {CHUNKS}, {_BM25}, {_BM25_RANKED} SELECT question_row, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids FROM ranked WHERE rank <= 10 GROUP BY question_row")
def _(t: Tables) -> DataFrame:
    lists = retrieval.nested(_search(t), ["question_row"], "chunk_id")
    return lists.select("question_row", F.array_join(F.col("ranked_chunks.chunk_id"), " ").alias("chunk_ids"))


@query(
    "ret6_dense_topk",
    """
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 10) AS score FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def _(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.inner_product(queries, t.embeddings, "query_id", "query_vector", "vec_id", "embedding")


def _lists(system: str) -> str:
    return f"SELECT question_row, chunk_id, max(pos) AS rank FROM (SELECT question_row, unnest(retrieved_chunk_ids) AS chunk_id, unnest(range(1, len(retrieved_chunk_ids) + 1)) AS pos FROM answers WHERE system = '{system}') GROUP BY ALL"


@query(
    "ret8_hybrid",
    f"""
WITH a AS ({_lists("bm25")}), d AS (SELECT * FROM ({_lists("dense")}) WHERE question_row IN (SELECT question_row FROM a)),
f AS (SELECT coalesce(a.question_row, d.question_row) AS question_row, coalesce(a.chunk_id, d.chunk_id) AS chunk_id, a.rank AS r1, d.rank AS r2, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 10) AS score FROM a FULL JOIN d ON a.question_row = d.question_row AND a.chunk_id = d.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_row ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST, chunk_id) AS rank FROM f)
SELECT question_row, chunk_id, rank::INT AS rank, score FROM r WHERE rank <= 10""",
)
def _(t: Tables) -> DataFrame:
    lists = {s: retrieval.ranks_of(t.answers.where(F.col("system") == s), ["question_row"], "retrieved_chunk_ids") for s in ("bm25", "dense")}
    return retrieval.fuse(lists["bm25"], lists["dense"], ["question_row"])


@query("ret9_missing_partners", "SELECT DISTINCT question_row FROM answers WHERE system = 'bm25' AND question_row NOT IN (SELECT question_row FROM answers WHERE system = 'dense')")
def _(t: Tables) -> DataFrame:
    return retrieval.missing_partners(t.answers.where("system = 'bm25'"), t.answers.where("system = 'dense'"), ["question_row"])


# ------------------------------------------------------------------ evaluation

_SCORED = f"""
{GOLD}, {LAST_QUESTION},
places AS (SELECT answer_row, unnest(retrieved_chunk_ids) AS c, unnest(range(1, len(retrieved_chunk_ids) + 1)) AS p FROM answers),
hits AS (SELECT a.answer_row, p.p FROM answers a JOIN gold g ON g.qid = a.qid JOIN places p ON p.answer_row = a.answer_row WHERE list_contains(g.gold_chunk_ids, p.c)),
disc AS (SELECT n, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE log2(n::DOUBLE) END AS d FROM range(1, 1001) r(n)),
m AS (SELECT h.answer_row, min(p) AS p1, sum(CASE WHEN p <= 10 THEN 1.0::DOUBLE / d END) AS dcg FROM hits h JOIN disc ON disc.n = h.p GROUP BY ALL),
ideal AS (SELECT g.qid, len(list_distinct(g.gold_chunk_ids)) AS n_gold, (SELECT sum(1.0::DOUBLE / d) FROM disc WHERE n <= least(len(list_distinct(g.gold_chunk_ids)), 10)) AS idcg FROM gold g),
scored AS (SELECT a.answer_row, a.qid, a.system, coalesce(q.language, '') AS language, coalesce(q.course_id, '') AS course_id, coalesce(q.question_type, '') AS question_type,
  CASE WHEN p1 <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_1, CASE WHEN p1 <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_3, CASE WHEN p1 <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_5,
  CASE WHEN p1 <= 10 THEN 1.0::DOUBLE / p1 ELSE 0.0 END AS mrr_at_10, coalesce(m.dcg / i.idcg, 0.0) AS ndcg_at_10
  FROM answers a JOIN gold g ON g.qid = a.qid JOIN ideal i ON i.qid = a.qid JOIN asked q ON q.qid = a.qid LEFT JOIN m ON m.answer_row = a.answer_row)"""


def _scored(t: Tables) -> DataFrame:
    none = F.lit("")
    asked = last_per_key(_questions(t).select("qid", "question_row", F.coalesce("course_id", none).alias("course_id"), F.coalesce("language", none).alias("language"), F.coalesce("question_type", none).alias("question_type")), ["qid"], "question_row").drop("question_row")
    rows = t.answers.select("answer_row", "qid", "system", "retrieved_chunk_ids").join(asked, "qid")
    return evaluation.score(rows, _gold(t)).drop("retrieved_chunk_ids")


@query("evl4_scores", f"WITH {_SCORED} SELECT answer_row, qid, system, language, course_id, question_type, recall_at_1, recall_at_3, recall_at_5, round(mrr_at_10, 6) AS mrr_at_10, round(ndcg_at_10, 6) AS ndcg_at_10 FROM scored")
def _(t: Tables) -> DataFrame:
    return _scored(t).withColumns({c: F.round(c, 6) for c in ("mrr_at_10", "ndcg_at_10")})


_AGG = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in evaluation.METRICS)


@query("evl5_by_system", f"WITH {_SCORED} SELECT system, {_AGG} FROM scored GROUP BY system")
def _(t: Tables) -> DataFrame:
    return evaluation.aggregate(_scored(t), ["system"])


@query(
    "evl6_reports",
    f"""WITH {_SCORED} SELECT CASE WHEN grouping(course_id) = 0 THEN 'by_course_id' WHEN grouping(language) = 0 THEN 'by_language' WHEN grouping(question_type) = 0 THEN 'by_question_type' ELSE 'overall' END AS report, system, coalesce(course_id, language, question_type) AS slice, {_AGG}
FROM scored GROUP BY GROUPING SETS ((system), (system, course_id), (system, language), (system, question_type))""",
)
def _(t: Tables) -> DataFrame:
    return evaluation.reports(_scored(t))


def _erfc(x: str) -> str:
    return f"CASE WHEN {x} > 4 THEN 0.0 ELSE 1 - 1.1283791670955126 * list_sum(list_transform(range(0, 101), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) END"


def _significance(unit: str, group: str, metrics: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT {unit}, {group}system, '{m}' AS metric, {m} AS value FROM scored" for m in metrics)
    by = f"{group}metric, system_a, system_b"
    return f"""
long AS ({long}), mean AS (SELECT {unit}, {group}system, metric, avg(value) AS value FROM long GROUP BY ALL),
diffs AS (SELECT {", ".join("a." + x.strip() for x in (group + "metric").split(","))}, a.system AS system_a, b.system AS system_b, round(a.value - b.value, 10) AS d FROM mean a JOIN mean b USING ({unit}, {group}metric) WHERE a.system < b.system),
ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {by}, abs(d)) AS t FROM diffs),
sums AS (SELECT {by}, count(*) AS n, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS rp, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS rm, sum(t::DOUBLE * t - 1) AS ties, coalesce(avg(d) / nullif(stddev_samp(d), 0), 0) AS cohens_d, max(abs(d)) AS largest FROM ranked GROUP BY ALL),
z AS (SELECT *, least(rp, rm) AS stat, (n * (n + 1.0) * (2 * n + 1) - ties / 2) / 24 AS var FROM sums),
x AS (SELECT *, abs(stat - n * (n + 1.0) / 4) / sqrt(CASE WHEN var > 0 THEN var ELSE 1 END) / 1.4142135623730951 AS x FROM z),
tested AS (SELECT {by}, CASE WHEN largest = 0 THEN 0.0 ELSE stat END AS wilcoxon_statistic, CASE WHEN largest = 0 OR var <= 0 THEN 1.0 ELSE round({_erfc("x")}, 6) END AS p_value, round(cohens_d, 6) AS cohens_d, n FROM x)"""


@query("sta5_significance", f"WITH {_SCORED}, {_significance('qid', 'language, ', ('recall_at_5', 'mrr_at_10', 'ndcg_at_10'))} SELECT * FROM tested")
def _(t: Tables) -> DataFrame:
    return evaluation.significance(_scored(t))


@query("evl7_significance_by_system", f"WITH {_SCORED}, {_significance('qid, language', '', ('recall_at_5',))} SELECT system_a AS \"left\", system_b AS \"right\", metric, p_value FROM tested")
def _(t: Tables) -> DataFrame:
    return evaluation.significance_by_system(_scored(t))


# ------------------------------------------------------------------ failures

_FAILED = f"""
{CHUNKS}, {GOLD}, {LAST_QUESTION},
missed AS (SELECT a.answer_row, a.qid, a.system, a.language AS result_language, a.retrieved_chunk_ids[1:5] AS ids, g.gold_chunk_ids AS gold_ids FROM answers a JOIN gold g ON g.qid = a.qid WHERE NOT list_has_any(a.retrieved_chunk_ids[1:5], g.gold_chunk_ids) OR len(g.gold_chunk_ids) = 0),
base AS (SELECT m.*, q.course_id, q.language, q.question_text, gold_ids[1] AS gold_chunk_id, c.doc_id AS gold_doc, round({_overlap("coalesce(q.question_text, '')", "coalesce(c.text, '')")}, 6) AS question_gold_overlap, {_overlap("coalesce(q.question_text, '')", "coalesce(c.text, '')")} AS raw_overlap FROM missed m JOIN asked q ON q.qid = m.qid JOIN chunks_once c ON c.chunk_id = m.gold_ids[1]),
seen AS (SELECT b.answer_row, bool_or(c.doc_id = b.gold_doc) AS same_doc, bool_or(array_to_string(string_split(c.chunk_id, '_')[1:3], '_') = array_to_string(string_split(b.gold_chunk_id, '_')[1:3], '_')) AS same_chapter, bool_or(coalesce(c.course_id = b.course_id, false)) AS same_course, max({_overlap("coalesce(b.question_text, '')", "coalesce(c.text, '')")}) AS best
  FROM (SELECT *, unnest(ids) AS chunk_id FROM base) b JOIN chunks_once c ON c.chunk_id = b.chunk_id GROUP BY b.answer_row),
failed AS (SELECT b.answer_row, b.qid, b.system, b.language, b.course_id, b.gold_chunk_id, CASE WHEN coalesce(same_doc, false) OR coalesce(same_chapter, false) THEN 'chunk_boundary' WHEN NOT coalesce(same_course, false) THEN 'domain_confusion' WHEN b.language = 'uz' THEN 'cross_lingual' WHEN coalesce(best, 0.0) > raw_overlap THEN 'term_mismatch' ELSE 'other' END AS category,
  (coalesce(same_doc, false) OR coalesce(same_chapter, false) OR coalesce(same_course, false)) AS boundary_or_course, question_gold_overlap, round(coalesce(best, 0.0), 6) AS best_retrieved_overlap FROM base b LEFT JOIN seen s ON s.answer_row = b.answer_row)"""

_FAILED_COLUMNS = ["answer_row", "qid", "system", "language", "course_id", "gold_chunk_id", "category", "boundary_or_course", "question_gold_overlap", "best_retrieved_overlap"]


def _failed(t: Tables) -> DataFrame:
    missed = failures.misses(t.answers.select("answer_row", "qid", "system", "retrieved_chunk_ids"), _gold(t))
    table = failures.categorize(missed, _questions(t), t.chunks, "answer_row").withColumnRenamed("q_language", "language")
    return table.select(*_FAILED_COLUMNS)


@query("err3_categories", f"WITH {_FAILED} SELECT * FROM failed")
def _(t: Tables) -> DataFrame:
    return _failed(t)


@query("err5_counts", f"WITH {_FAILED} SELECT category, language, course_id, count(*) AS count FROM failed GROUP BY category, language, course_id")
def _(t: Tables) -> DataFrame:
    return failures.counts(_failed(t))


@query("err6_samples", f"WITH {_FAILED} SELECT language, category, qid, answer_row, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY category, qid, answer_row) AS place FROM failed WHERE language IN ('en', 'uz')) WHERE place <= 10")
def _(t: Tables) -> DataFrame:
    return failures.samples(_failed(t), ties=("answer_row",)).select("language", "category", "qid", "answer_row", "place")


# ------------------------------------------------------------------ grounding

_CITED = r"regexp_extract_all(coalesce(answer, ''), '\[([^\[\]]+)\]', 1)"
_ASSESSED = f"""
{GOLD},
flags AS (SELECT a.answer_row, a.system, a.language, len(list_intersect(a.retrieved_chunk_ids, g.gold_chunk_ids)) > 0 AS has_gold, coalesce(a.abstained, false) OR {_strip("coalesce(a.answer, '')")} = '{tx.ABSTENTION}' AS abst, {_CITED} AS cited, a.retrieved_chunk_ids AS ids FROM answers a JOIN gold g ON g.qid = a.qid),
reasons AS (SELECT answer_row, system, language, CASE WHEN abst AND NOT has_gold THEN 'auto_unsupported_no_gold' WHEN abst THEN 'review_abstained_with_gold' WHEN len(cited) = 0 THEN 'review_missing_citations' WHEN len(list_intersect(cited, ids)) = 0 THEN 'review_invalid_citations' WHEN NOT has_gold THEN 'review_no_gold_retrieved' ELSE 'auto_grounded_with_gold' END AS reason FROM flags),
assessed AS (SELECT *, CASE reason WHEN 'auto_unsupported_no_gold' THEN 'unsupported' WHEN 'auto_grounded_with_gold' THEN 'correct_grounded' ELSE '' END AS auto_label, starts_with(reason, 'review') AS review FROM reasons)"""


def _assessed(t: Tables) -> DataFrame:
    return grounding.assess(t.answers, _gold(t)).select("answer_row", "system", "language", "reason", "auto_label", "review")


@query("grd1_assess", f"WITH {_ASSESSED} SELECT * FROM assessed")
def _(t: Tables) -> DataFrame:
    return _assessed(t)


@query("grd2_review_summary", f"WITH {_ASSESSED} SELECT 'reason' AS kind, reason AS value, count(*) AS count FROM assessed GROUP BY reason UNION ALL SELECT 'label', auto_label, count(*) FROM assessed WHERE auto_label <> '' GROUP BY auto_label")
def _(t: Tables) -> DataFrame:
    return grounding.review_summary(_assessed(t))


@query("grd2_review_rows", f"WITH {_ASSESSED} SELECT a.answer_row, s.reason AS review_reason, array_to_string(a.retrieved_chunk_ids, ' ') AS retrieved_chunk_ids, array_to_string(g.gold_chunk_ids, ' ') AS gold_chunk_ids FROM assessed s JOIN answers a ON a.answer_row = s.answer_row JOIN gold g ON g.qid = a.qid WHERE s.review")
def _(t: Tables) -> DataFrame:
    # the row goes along as the question's id
    rows = grounding.review_rows(grounding.assess(t.answers, _gold(t)).withColumn("qid", F.col("answer_row").cast("string")))
    return rows.select(F.col("qid").cast("long").alias("answer_row"), "review_reason", "retrieved_chunk_ids", "gold_chunk_ids")


@query(
    "grd3_postprocess",
    rf"""
WITH c AS (SELECT answer_row, language, retrieved_chunk_ids AS ids, {_cut(_BEFORE_END)} AS answer FROM answers),
d AS (SELECT *, regexp_extract_all(answer, '\[([^\[\]]+)\]', 1) AS cited, regexp_replace(answer, '{WS}+', '', 'g') AS solid FROM c),
e AS (SELECT *, len(list_filter(cited, lambda x: list_contains(ids, x))) AS valid FROM d)
SELECT answer_row, answer, concat_ws('|', CASE WHEN language = 'en' AND len(solid) > 0 AND len(regexp_replace(solid, '[^\x00-\x7f]', '', 'g'))::DOUBLE / len(solid) < 0.7 THEN 'language_mismatch' END, CASE WHEN valid < len(cited) THEN 'invalid_citations' END, CASE WHEN answer = '' THEN 'empty_answer' END) AS generation_failure, valid::INT AS valid_citation_count, answer = '{tx.ABSTENTION}' AS abstained FROM e""",
)
def _(t: Tables) -> DataFrame:
    return grounding.postprocess(t.answers).select("answer_row", "answer", "generation_failure", "valid_citation_count", "abstained")


@query("grd4_evidence", f"WITH {CHUNKS}, l AS (SELECT answer_row, unnest(retrieved_chunk_ids[1:5]) AS chunk_id, unnest(range(1, len(retrieved_chunk_ids[1:5]) + 1)) AS pos FROM answers) SELECT l.answer_row, md5(string_agg('[' || l.chunk_id || ']: ' || coalesce(c.text, ''), chr(10) ORDER BY pos)) AS evidence_md5 FROM l JOIN chunks_once c ON c.chunk_id = l.chunk_id GROUP BY l.answer_row")
def _(t: Tables) -> DataFrame:
    return grounding.evidence(t.answers, t.chunks, "answer_row").select("answer_row", F.md5("evidence").alias("evidence_md5"))


@query("grd6_pending", "SELECT q.question_row, s.system FROM questions q CROSS JOIN (SELECT DISTINCT system FROM runs) s WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.question_row = q.question_row AND a.system = s.system)")
def _(t: Tables) -> DataFrame:
    # the systems of the table of runs are an array beside each question, not a second table to pair it with
    systems = [r["system"] for r in t.runs.select("system").distinct().orderBy("system").collect()]
    requested = t.questions.select("question_row", F.explode(F.array(*[F.lit(s) for s in systems])).alias("system"))
    return grounding.pending(requested, t.answers, ("question_row", "system"))


@query("grd7_slice", "SELECT answer_row, qid FROM answers WHERE answer_row >= 21 AND answer_row < 41")
def _(t: Tables) -> DataFrame:
    return grounding.slice_rows(t.answers, "answer_row", 21, 20).select("answer_row", "qid")


def _kappa(pairs: str) -> str:
    return f"""k AS ({pairs}), n AS (SELECT count(*) AS n, coalesce(sum((a = b)::INT), 0) AS same FROM k), c AS (SELECT coalesce(sum(x.n * y.n), 0) AS chance FROM (SELECT a, count(*) AS n FROM k GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM k GROUP BY b) y ON x.a = y.b)
SELECT n, round(CASE WHEN n = 0 THEN 0.0 ELSE same::DOUBLE / n END, 6) AS agreement, round(CASE WHEN n = 0 THEN 0.0 WHEN chance::DOUBLE / (n::DOUBLE * n) = 1 THEN 1.0 ELSE (same::DOUBLE / n - chance::DOUBLE / (n::DOUBLE * n)) / (1 - chance::DOUBLE / (n::DOUBLE * n)) END, 6) AS kappa FROM n CROSS JOIN c"""


@query(
    "grd8_agreement",
    f"WITH {_ASSESSED}, l AS (SELECT a.answer_row, a.question_row, s.reason FROM answers a JOIN assessed s ON s.answer_row = a.answer_row), "
    + _kappa("SELECT arg_min(reason, answer_row) AS a, arg_max(reason, answer_row) AS b FROM l GROUP BY question_row HAVING count(*) = 2"),
)
def _(t: Tables) -> DataFrame:
    rows = _assessed(t).join(t.answers.select("answer_row", F.col("question_row").cast("string").alias("question_row")), "answer_row")
    return grounding.agreement(rows, "question_row", "reason", "answer_row")


@query(
    "grd8_annotation_summary",
    f"WITH {_ASSESSED}, l AS (SELECT a.answer_row, a.question_row, s.reason FROM answers a JOIN assessed s ON s.answer_row = a.answer_row), u AS ("
    + "WITH "
    + _kappa("SELECT arg_min(reason, answer_row) AS a, arg_max(reason, answer_row) AS b FROM l GROUP BY question_row HAVING count(*) = 2")
    + ") SELECT 'total_rows' AS kind, '' AS value, count(*)::DOUBLE AS figure FROM l UNION ALL SELECT 'label_distribution', reason, count(*)::DOUBLE FROM l GROUP BY reason UNION ALL SELECT 'intra_annotator_kappa', '', kappa FROM u WHERE n > 0",
)
def _(t: Tables) -> DataFrame:
    rows = _assessed(t).join(t.answers.select("answer_row", F.col("question_row").cast("string").alias("question_row")), "answer_row")
    return grounding.annotation_summary(rows, "reason", "question_row", "answer_row")


@query("grd10_import_sheet", f"WITH {_ASSESSED} SELECT answer_row, auto_label AS label FROM assessed WHERE auto_label <> '' AND answer_row % 3 <> 0")
def _(t: Tables) -> DataFrame:
    sheet = _assessed(t).where("auto_label != ''").select("answer_row", F.col("auto_label").alias("label"), F.when(F.col("answer_row") % 3 == 0, " TRUE").otherwise("false").alias("is_duplicate"))
    return grounding.import_sheet(sheet).drop("is_duplicate")


@query("txt17_truthy", f"SELECT answer_row, coalesce(lower({_strip('valid_citation_count::VARCHAR')}) IN ('1', 'true', 'yes', 'y'), false) AS one, coalesce(abstained, false) AS abstained FROM answers")
def _(t: Tables) -> DataFrame:
    return t.answers.select("answer_row", tx.truthy(F.col("valid_citation_count").cast("string")).alias("one"), tx.truthy(F.concat(F.lit(" "), F.upper(F.col("abstained").cast("string")), F.lit("\n"))).alias("abstained"))


@query("sta6_kappa", "WITH " + _kappa("SELECT coalesce(abstained, false) AS a, coalesce(valid_citation_count, 0) = 0 AS b FROM answers"))
def _(t: Tables) -> DataFrame:
    rows = t.answers.select(F.coalesce("abstained", F.lit(False)).alias("a"), (F.coalesce("valid_citation_count", F.lit(0)) == 0).alias("b"))
    return evaluation.kappa(rows, "a", "b")


@query("sta8_label_shares", f"WITH {_ASSESSED} SELECT system, {', '.join(f'''round(sum((auto_label = '{x}')::INT)::DOUBLE / count(*), 6) AS {x}''' for x in grounding.LABELS)} FROM assessed WHERE auto_label <> '' GROUP BY system")
def _(t: Tables) -> DataFrame:
    return evaluation.label_shares(_assessed(t).where("auto_label != ''"), "system", "auto_label", list(grounding.LABELS))


@query("grd9_annotation_sheet")
def _(t: Tables) -> DataFrame:
    return grounding.annotation_sheet(t.answers.drop("question_row"), _questions(t), t.chunks, "answer_row", "answer_row")


# ------------------------------------------------------------------ curation

_QUALITY = rf"""
words AS (SELECT *, {_strip("coalesce(question_text, '')")} AS q, {_strip("coalesce(reference_answer, '')")} AS a FROM questions),
counted AS (SELECT *, len(regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+')) AS qw, len(regexp_extract_all(a, '[\p{{L}}\p{{N}}_]+')) AS aw FROM words),
rated AS (SELECT question_row, qid, language, (CASE WHEN q LIKE '%?' THEN 3 ELSE 0 END + CASE WHEN contains(q, '...') THEN 0 ELSE 2 END + CASE WHEN qw BETWEEN 6 AND 28 THEN 2 WHEN qw < 4 OR qw > 40 THEN -3 ELSE 0 END
  + CASE WHEN aw BETWEEN 12 AND 80 THEN 2 WHEN aw < 8 OR aw > 120 THEN -2 ELSE 0 END + CASE WHEN lower(trim(question_type)) = 'comparative' AND contains(lower(q), 'differ') THEN 1 ELSE 0 END)::INT AS score, (-qw)::INT AS question_words, (-aw)::INT AS answer_words FROM counted)"""


def _rated(t: Tables) -> DataFrame:
    none = F.lit("")
    return _questions(t).withColumn("rating", curation.quality(F.coalesce("question_text", none), F.coalesce("reference_answer", none), F.coalesce("question_type", none)))


@query("cur7_quality", f"WITH {_QUALITY} SELECT question_row, score, question_words, answer_words FROM rated")
def _(t: Tables) -> DataFrame:
    return _rated(t).select("question_row", "rating.score", "rating.question_words", "rating.answer_words")


@query("cur8_dedupe", f"WITH {_QUALITY} SELECT qid, question_row, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, question_words DESC, answer_words DESC, question_row) AS place, count(*) OVER (PARTITION BY qid) AS n_rows FROM rated) WHERE place = 1")
def _(t: Tables) -> DataFrame:
    return curation.dedupe(_rated(t).select("qid", "question_row", "rating"), "qid", "rating", "question_row").select("qid", "question_row", "n_rows")


def _candidates(t: Tables) -> DataFrame:
    """English questions as candidates, with the first gold chunk as theirs and the Uzbek question of the same qid."""
    uz = last_per_key(t.questions.where("language = 'uz'").select("qid", "question_row", F.col("question_text").alias("question_text_uz")), ["qid"], "question_row").drop("question_row")
    en = curation.dedupe(_rated(t).where("language = 'en' and course_id is not null").select("qid", "course_id", "question_row", "question_type", F.col("question_text").alias("question_text_en"), "rating"), "qid", "rating", "question_row")
    gold = _gold(t).select("qid", F.try_element_at("gold_chunk_ids", F.lit(1)).alias("chunk_id"))
    joined = en.join(gold, "qid").join(uz, "qid", "left").where("chunk_id is not null and question_type is not null")
    return joined.select(F.col("qid").alias("candidate_id"), "course_id", "chunk_id", "question_type", "question_text_en", F.coalesce("question_text_uz", F.lit("")).alias("question_text_uz"), "rating.score", "rating.question_words", "rating.answer_words")


@query(
    "cur2_candidates",
    f"""
WITH {GOLD}, r AS (SELECT g.gold_chunk_ids[1] AS chunk_id, q.course_id, lower(trim(q.question_type)) AS kind, q.question_row AS pos, q.question_text, q.reference_answer FROM questions q JOIN gold g ON g.qid = q.qid WHERE g.gold_chunk_ids[1] IS NOT NULL AND q.course_id IS NOT NULL AND q.question_type IS NOT NULL AND q.question_text IS NOT NULL AND q.reference_answer IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY pos) AS n FROM r)
SELECT chunk_id || '_' || kind || '_0' AS candidate_id, chunk_id, course_id, kind AS question_type, question_text FROM n WHERE n <= 200""",
)
def _(t: Tables) -> DataFrame:
    gold = _gold(t).select("qid", F.try_element_at("gold_chunk_ids", F.lit(1)).alias("chunk_id"))
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("question_text", "reference_answer", "question_type")), F.lit("\n```"))
    rows = _questions(t).join(gold, "qid").where("chunk_id is not null and course_id is not null and question_type is not null")
    replies = rows.select("chunk_id", "course_id", F.col("question_type").alias("prompt_type"), F.col("question_row").alias("pos"), reply.alias("raw"))
    return curation.candidates(replies).drop("reference_answer")


_SHEET = rf"""{GOLD}, {LAST_QUESTION}, s AS (SELECT a.qid AS candidate_id, a.course_id, g.gold_chunk_ids[1] AS chunk_id, a.question_type, a.question_text FROM asked a JOIN gold g ON g.qid = a.qid WHERE g.gold_chunk_ids[1] IS NOT NULL AND a.course_id IS NOT NULL AND a.question_text IS NOT NULL)"""


def _sheet(t: Tables) -> DataFrame:
    """The last question of every id as a row of the sheet, those with an odd number of words selected."""
    asked = last_per_key(_questions(t).select("qid", "question_row", "course_id", "question_type", "question_text"), ["qid"], "question_row")
    gold = _gold(t).select("qid", F.try_element_at("gold_chunk_ids", F.lit(1)).alias("chunk_id"))
    rows = asked.join(gold, "qid").where("chunk_id is not null and course_id is not null and question_text is not null")
    sheet = rows.select(F.col("qid").alias("candidate_id"), "course_id", "chunk_id", "question_type", "question_text", F.lit("?").alias("selected"), F.lit("?").alias("gold_chunk_ids"))
    return curation.write_back(sheet, sheet.where(tx.n_tokens(F.col("question_text")) % 2 == 1))


@query("cur14_write_back", rf"WITH {_SHEET} SELECT candidate_id, CASE WHEN len(regexp_extract_all(question_text, '[\p{{L}}\p{{N}}_]+')) % 2 = 1 THEN '1' ELSE '' END AS selected, CASE WHEN len(regexp_extract_all(question_text, '[\p{{L}}\p{{N}}_]+')) % 2 = 1 THEN chunk_id ELSE '' END AS gold_chunk_ids FROM s")
def _(t: Tables) -> DataFrame:
    return _sheet(t).select("candidate_id", "selected", "gold_chunk_ids")


@query("cur16_import", rf"WITH {_SHEET}, p AS (SELECT *, row_number() OVER (ORDER BY candidate_id) AS n FROM s WHERE len(regexp_extract_all(question_text, '[\p{{L}}\p{{N}}_]+')) % 2 = 1) SELECT 'Q' || lpad(n::VARCHAR, greatest(3, len(n::VARCHAR))::INT, '0') AS qid, regexp_replace(chunk_id, '_[^_]*$', '') AS gold_doc_ids, chunk_id AS gold_chunk_ids FROM p")
def _(t: Tables) -> DataFrame:
    rows = _sheet(t).select("*", F.col("question_text").alias("question_text_en"), F.lit("").alias("question_text_uz"), F.lit("").alias("reference_answer_en"), F.lit("").alias("reference_answer_uz"))
    labels = curation.import_sheet(rows, "candidate_id")[1]
    return labels.select("qid", F.array_join("gold_doc_ids", " ").alias("gold_doc_ids"), F.array_join("gold_chunk_ids", " ").alias("gold_chunk_ids"))


@query("cur9_select")
def _(t: Tables) -> DataFrame:
    return curation.select(_candidates(t), fallback_courses=("ocw_philosophy",))


@query(
    "cur10_round_robin",
    f"""
WITH {_QUALITY}, {GOLD},
en AS (SELECT * FROM (SELECT r.*, q.course_id, lower(trim(q.question_type)) AS question_type, row_number() OVER (PARTITION BY r.qid ORDER BY score DESC, question_words DESC, answer_words DESC, r.question_row) AS place FROM rated r JOIN questions q ON q.question_row = r.question_row WHERE q.language = 'en' AND q.course_id IS NOT NULL) WHERE place = 1),
c AS (SELECT en.qid AS candidate_id, course_id, question_type, regexp_replace(gold_chunk_ids[1], '_[^_]*$', '') AS section, score * 100000000::BIGINT + (question_words + 5000) * 10000::BIGINT + (answer_words + 5000) AS rate FROM en JOIN gold ON gold.qid = en.qid WHERE gold_chunk_ids[1] IS NOT NULL AND question_type IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY course_id, question_type, section ORDER BY rate DESC, candidate_id DESC) AS n, max(rate) OVER (PARTITION BY course_id, question_type, section) AS best FROM c),
t AS (SELECT course_id, question_type, candidate_id, row_number() OVER (PARTITION BY course_id, question_type ORDER BY n, best DESC, section DESC) AS turn FROM r)
SELECT course_id, question_type, candidate_id, turn::INT AS turn FROM t WHERE turn <= 20""",
)
def _(t: Tables) -> DataFrame:
    rows = _candidates(t).withColumn("rate", F.struct("score", "question_words", "answer_words"))
    return curation.round_robin(rows, ["course_id", "question_type"], tx.document_of(F.col("chunk_id")), [F.desc("rate"), F.desc("candidate_id")], F.col("rate"), 20).select("course_id", "question_type", "candidate_id", "turn")


@query("cur1_sample_chunks")
def _(t: Tables) -> DataFrame:
    return curation.sample_chunks(_chunks(t)).select("chunk_id", "course_id")


@query(
    "cur13_flags",
    rf"""
WITH u AS (SELECT question_row, {_strip("coalesce(question_text, '')")} AS t FROM questions WHERE language = 'uz'),
f AS (SELECT question_row, unnest(CASE WHEN t = '' THEN ['missing_uz_question'] ELSE list_filter([CASE WHEN contains(t, '...') THEN 'ellipsis_uz' END, CASE WHEN len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) < 4 THEN 'very_short_uz' END, CASE WHEN regexp_matches(t, '[А-Яа-яЁё]') THEN 'contains_cyrillic' END,
  CASE WHEN len(regexp_replace(t, '[\x00-\x7f]', '', 'g'))::DOUBLE / greatest(len(t), 1) > 0.2 THEN 'high_non_ascii_ratio' END], lambda x: x IS NOT NULL) END) AS flag FROM u)
SELECT * FROM f""",
)
def _(t: Tables) -> DataFrame:
    return t.questions.where("language = 'uz'").select("question_row", F.explode(curation.suspicious_uz(F.col("question_text"))).alias("flag"))


_COURSES = ["ocw_data_science", "ocw_philosophy"]
_TARGET_ROWS = ", ".join(f"('{c}', '{k}', {2 * n})" for c in _COURSES for k, n in curation.TARGETS.items())


@query(
    "cur17_validate",
    f"""
WITH {GOLD}, q AS (SELECT qid, course_id, language, question_text, lower(trim(question_type)) AS question_type FROM questions),
w(course_id, question_type, expected) AS (VALUES {_TARGET_ROWS}), wc AS (SELECT DISTINCT course_id FROM w),
totals AS (SELECT wc.course_id, count(q.qid) AS n, count(DISTINCT q.qid) AS k FROM wc LEFT JOIN q USING (course_id) GROUP BY wc.course_id),
kinds AS (SELECT w.course_id, w.question_type, w.expected, count(q.qid) AS n FROM w LEFT JOIN q ON q.course_id = w.course_id AND q.question_type = w.question_type GROUP BY ALL),
pairs AS (SELECT qid, list_sort(list_distinct(list(language) FILTER (language IS NOT NULL))) AS langs FROM q GROUP BY qid)
SELECT 'question_count' AS "check", '' AS key, '240' AS expected, count(*)::VARCHAR AS found FROM q HAVING count(*) <> 240
UNION ALL SELECT 'label_count', '', '120', count(*)::VARCHAR FROM gold HAVING count(*) <> 120
UNION ALL SELECT 'duplicate_question', min(qid), '1', count(*)::VARCHAR FROM q GROUP BY course_id, language, lower({_strip("question_text")}) HAVING count(*) > 1
UNION ALL SELECT 'course_rows', course_id, '120', n::VARCHAR FROM totals WHERE n <> 120
UNION ALL SELECT 'course_qids', course_id, '60', k::VARCHAR FROM totals WHERE k <> 60
UNION ALL SELECT 'course_type_rows', course_id || ' ' || question_type, expected::VARCHAR, n::VARCHAR FROM kinds WHERE n <> expected
UNION ALL SELECT 'missing_gold', qid, 'some', '0' FROM gold WHERE coalesce(len(gold_chunk_ids), 0) = 0
UNION ALL SELECT 'unknown_chunk', qid, 'known', c FROM (SELECT qid, unnest(gold_chunk_ids) AS c FROM gold) u WHERE c NOT IN (SELECT chunk_id FROM chunks)
UNION ALL SELECT 'qid_sets', 'only question', '0', count(*)::VARCHAR FROM (SELECT DISTINCT qid FROM q WHERE qid NOT IN (SELECT qid FROM gold)) HAVING count(*) > 0
UNION ALL SELECT 'qid_sets', 'only label', '0', count(*)::VARCHAR FROM (SELECT DISTINCT qid FROM gold WHERE qid NOT IN (SELECT qid FROM q)) HAVING count(*) > 0
UNION ALL SELECT 'bilingual_pair', qid, 'en,uz', array_to_string(coalesce(langs, []), ',') FROM pairs WHERE coalesce(langs, []) <> ['en', 'uz']""",
)
def _(t: Tables) -> DataFrame:
    return curation.validate(_questions(t), _gold(t), t.chunks, _COURSES)


@query("cur18_benchmark_stats", "SELECT course_id, language, lower(trim(question_type)) AS question_type, count(*) AS count FROM questions GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return reports.benchmark_stats(_questions(t))


@query("cur19_licenses", "SELECT DISTINCT d.course_id, m.license FROM (SELECT DISTINCT course_id FROM chunks) d LEFT JOIN (SELECT DISTINCT course_id, license FROM documents) m ON m.course_id = d.course_id")
def _(t: Tables) -> DataFrame:
    return ingest.licenses(t.chunks, t.documents)


# ------------------------------------------------------------------ report data, streams


def _by(t: Tables, c: str) -> DataFrame:
    return evaluation.aggregate(_scored(t), ["system", c], ("recall_at_5",))


@query("plt1_recall_bars", f"WITH {_SCORED} SELECT language, system, round(avg(recall_at_5), 6) AS mean, round(1.96 * coalesce(round(stddev_samp(recall_at_5), 6), 0) / sqrt(120), 6) AS ci95 FROM scored GROUP BY language, system")
def _(t: Tables) -> DataFrame:
    return reports.recall_bars(_by(t, "language"))


@query(
    "plt2_heatmap",
    f"WITH {_SCORED}, c AS (SELECT system, course_id, round(avg(recall_at_5), 6) AS v FROM scored GROUP BY ALL), l AS (SELECT DISTINCT system, language FROM scored) SELECT c.system, l.language, round(avg(v) FILTER (course_id = 'ocw_data_science'), 6) AS ocw_data_science, round(avg(v) FILTER (course_id = 'ocw_philosophy'), 6) AS ocw_philosophy FROM c JOIN l ON l.system = c.system GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    return reports.heatmap(_by(t, "course_id"), _by(t, "language"), _COURSES)


@query("plt3_cross_lingual_gap", f"WITH {_SCORED}, l AS (SELECT system, language, round(avg(recall_at_5), 6) AS v FROM scored GROUP BY ALL) SELECT system, avg(v) FILTER (language = 'en') AS en, avg(v) FILTER (language = 'uz') AS uz, round(avg(v) FILTER (language = 'en') - avg(v) FILTER (language = 'uz'), 6) AS gap FROM l GROUP BY system")
def _(t: Tables) -> DataFrame:
    return reports.cross_lingual_gap(_by(t, "language"))


_CATEGORIES = ["chunk_boundary", "cross_lingual", "domain_confusion", "other", "term_mismatch"]


@query("plt4_error_stack", f"WITH {_FAILED} SELECT language, {', '.join(f'''coalesce(sum((category = '{c}')::INT), 0)::BIGINT AS {c}''' for c in _CATEGORIES)} FROM failed GROUP BY language")
def _(t: Tables) -> DataFrame:
    return reports.error_stack(failures.counts(_failed(t)), _CATEGORIES)


@query("io14_first_questions", "SELECT language, question_row, place::INT AS place FROM (SELECT language, question_row, row_number() OVER (PARTITION BY language ORDER BY question_row) AS place FROM questions) WHERE place <= 5")
def _(t: Tables) -> DataFrame:
    return reports.first_rows(t.questions.select("language", "question_row"), "language", ["question_row"], 5)


@query("str1_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return incremental.windowed_counts(t.events)
