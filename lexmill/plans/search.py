"""Queries of retrieval and the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import curation, search
from lexmill.session import table


def _corpus(spark, d):
    return curation.corpus(table(spark, d, "docs"))


def _questions(spark, d):
    """Every task's question once: re-delivered rows are alike."""
    return table(spark, d, "tasks").where("question is not null").groupBy(F.col("task_id").alias("qid")).agg(F.min("question").alias("query"))


def search_bm25_top10(spark, d):
    """The ten best documents for every task's question, all its terms counted."""
    return search.bm25(_corpus(spark, d), _questions(spark, d), 10, most=None)


def search_masked_top5(spark, d):
    """the five best for every question without the documents its task masks; masking goes before the cut."""
    masks = table(spark, d, "tasks").select(F.col("task_id").alias("qid"), F.explode("masked_doc_ids").alias("doc_id")).distinct()
    return search.bm25(_corpus(spark, d), _questions(spark, d), 5, masks)


def search_evidence_rank(spark, d):
    """Where the first ten hits have a task's evidence; null where they don't."""
    hits = search.bm25(_corpus(spark, d), _questions(spark, d), 10)
    wanted = table(spark, d, "tasks").select(F.col("task_id").alias("qid"), F.explode("evidence_doc_ids").alias("doc_id")).distinct()
    return wanted.join(hits.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")


def index_document_frequency(spark, d):
    return search.document_frequency(search.postings(_corpus(spark, d)))


def index_df_histogram(spark, d):
    """A2: terms by band of document frequency."""
    df = F.col("df")
    band = F.when(df == 1, "1").when(df == 2, "2").when(df <= 10, "3-10").when(df <= 60, "11-60").otherwise("61-")
    return search.document_frequency(search.postings(_corpus(spark, d))).groupBy(band.alias("band")).agg(F.count("*").alias("terms"))


def index_pruned_query_terms(spark, d):
    """how many terms of each question are left, repeated ones counted."""
    return search.pruned_terms(search.indexed(_corpus(spark, d)), _questions(spark, d)).groupBy("qid").agg(F.sum("times").alias("kept"))


def index_all_title_terms(spark, d):
    """Documents that hold every word of a task's answer."""
    answers = table(spark, d, "tasks").where("answer is not null").groupBy("task_id").agg(F.min("answer").alias("answer"))
    wanted = answers.select(F.col("task_id").alias("set_id"), F.explode(T.words(F.col("answer"))).alias("term"))
    return search.containing_all(_corpus(spark, d), wanted)


def index_title_only(spark, d):
    """How many documents name a term in their title but not in their text."""
    corpus = _corpus(spark, d)
    titles = corpus.select("doc_id", F.explode(F.array_distinct(T.words(F.col("title")))).alias("term"))
    texts = corpus.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    return titles.join(texts, ["doc_id", "term"], "left_anti").groupBy("term").agg(F.count("*").alias("documents"))


def index_query_key(spark, d):
    """How many tasks ask with the same bag of words."""
    return _questions(spark, d).groupBy(F.array_join(F.array_sort(T.tokens(F.col("query"))), " ").alias("query_key")).agg(F.count("*").alias("tasks"))


def index_overlay_score(spark, d):
    """A5: the ten best hits for every question: batch 0 is the base, the records that came later lie over it."""
    docs = table(spark, d, "docs")
    base = curation.corpus(docs.where("batch = 0"))
    later = curation.corpus(docs.where("batch > 0")).join(base.select("doc_id"), "doc_id", "left_anti")
    return search.overlay(base, later, _questions(spark, d), 10)


QUERIES = {f.__name__: f for f in (search_bm25_top10, search_masked_top5, search_evidence_rank, index_document_frequency, index_df_histogram, index_pruned_query_terms, index_all_title_terms, index_title_only, index_query_key, index_overlay_score)}

_TOKENS = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"
_WORDS = f"regexp_extract_all(translate(lower({{}}), '{T.MARKED}', '{T.PLAIN}'), '([\\p{{{{L}}}}\\p{{{{N}}}}]+)', 1)".replace("{{", "{").replace("}}", "}")


def _words(column: str) -> str:
    return _WORDS.replace("{}", column)


_BASE = f"""
  WITH corpus AS (SELECT doc_id, coalesce(title, '') AS title, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM docs WHERE text IS NOT NULL AND text <> '') WHERE r = 1),
  words AS (SELECT doc_id, {_words("title || ' ' || text")} AS w FROM corpus),
  postings AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM words) GROUP BY ALL),
  freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
"""
_QUESTIONS = "questions AS (SELECT task_id AS qid, min(question) AS query FROM tasks WHERE question IS NOT NULL GROUP BY 1)"
_ASKED = _BASE + f""",
  stats AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM words),
  {_QUESTIONS},
  parts AS (SELECT qid, unnest(list_filter(list_transform(string_split_regex(query, '[ \\t\\r\\n]+'), lambda x: regexp_replace(x, '^"+|"+$', '', 'g')), lambda x: x <> '')[1:{search.MOST_TERMS}]) AS part FROM questions),
  terms AS (SELECT qid, term FROM (SELECT qid, array_to_string({_words("part")}, ' ') AS term FROM parts) WHERE term <> ''),
  phrases AS (SELECT DISTINCT term, ' ' || replace(term, ' ', '  ') || ' ' AS pattern FROM terms WHERE contains(term, ' ')),
  lines AS (SELECT doc_id, len(w) AS len, ' ' || array_to_string({_words("title")}, '  ') || '    ' || array_to_string({_words("text")}, '  ') || ' ' AS line FROM corpus JOIN words USING (doc_id)),
  met AS (
    SELECT term, doc_id, len, CAST((length(line) - length(replace(line, pattern, ''))) / length(pattern) AS BIGINT) AS tf FROM phrases JOIN lines ON contains(line, pattern)
    UNION ALL SELECT term, doc_id, len, tf FROM postings WHERE term IN (SELECT term FROM terms)),
  known AS (SELECT term, count(*) AS df FROM met GROUP BY term),
  marked AS (SELECT *, bool_or(rare) OVER (PARTITION BY qid) AS has_rare FROM (SELECT qid, term, df, df <= greatest(floor(0.25 * n), 1) AS rare, n FROM terms JOIN known USING (term), stats)),
  kept AS (SELECT qid, term, df, n FROM marked WHERE rare OR NOT has_rare)
"""
_RANKED = """,
  asked AS (SELECT qid, term, df, n, count(*) AS times FROM kept GROUP BY ALL),
  scored AS (
    SELECT qid, doc_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
    FROM (SELECT a.*, p.doc_id, p.len, p.tf, s.avg_len FROM asked a JOIN met p USING (term), stats s) h {mask} GROUP BY qid, doc_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
"""

SQL = {
    "search_bm25_top10": _ASKED + _RANKED.format(mask="") + "SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 10",
    "search_masked_top5": _ASKED + _RANKED.format(mask="WHERE NOT EXISTS (SELECT 1 FROM (SELECT task_id, unnest(masked_doc_ids) AS m FROM tasks) x WHERE x.task_id = h.qid AND x.m = h.doc_id)") + "SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 5",
    "search_evidence_rank": _ASKED + _RANKED.format(mask="") + "SELECT e.qid, e.doc_id, r.rank FROM (SELECT DISTINCT task_id AS qid, unnest(evidence_doc_ids) AS doc_id FROM tasks) e LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (qid, doc_id)",
    "index_document_frequency": _BASE + "SELECT term, df FROM freq",
    "index_df_histogram": _BASE + "SELECT CASE WHEN df = 1 THEN '1' WHEN df = 2 THEN '2' WHEN df <= 10 THEN '3-10' WHEN df <= 60 THEN '11-60' ELSE '61-' END AS band, count(*) AS terms FROM freq GROUP BY 1",
    "index_pruned_query_terms": _ASKED + "SELECT qid, count(*) AS kept FROM kept GROUP BY qid",
    "index_all_title_terms": _BASE + f""", wanted AS (SELECT DISTINCT set_id, unnest({_words("answer")}) AS term FROM (SELECT task_id AS set_id, min(answer) AS answer FROM tasks WHERE answer IS NOT NULL GROUP BY 1))
        SELECT set_id, count(*) AS documents FROM (SELECT set_id, doc_id FROM wanted w JOIN postings USING (term) GROUP BY set_id, doc_id HAVING count(*) = (SELECT count(*) FROM wanted v WHERE v.set_id = w.set_id)) GROUP BY set_id""",
    "index_title_only": _BASE + f""" SELECT term, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest({_words("title")}) AS term FROM corpus EXCEPT SELECT DISTINCT doc_id, unnest({_words("text")}) FROM corpus) GROUP BY term""",
    "index_query_key": f"WITH questions AS (SELECT task_id, min(question) AS query FROM tasks WHERE question IS NOT NULL GROUP BY 1) SELECT array_to_string(list_sort({_TOKENS.format('query')}), ' ') AS query_key, count(*) AS tasks FROM questions GROUP BY 1",
}
