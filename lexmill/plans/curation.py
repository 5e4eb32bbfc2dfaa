"""Queries of corpus curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import curation
from lexmill.session import table


def curate_normalized_text(spark, d):
    """P1 over all documents."""
    return table(spark, d, "documents").select("doc_id", T.normalized_text(F.col("text")).alias("normalized"))


def curate_title_fallback(spark, d):
    """A blank title becomes the first 80 characters of the text."""
    title = T.squeeze(F.coalesce("title", F.lit("")))
    return table(spark, d, "docs").where("text is not null").select("ord", F.when(title == "", T.squeeze(F.substring("text", 1, 80))).otherwise(title).alias("title"))


def curate_junk_reason(spark, d):
    return table(spark, d, "docs").select("ord", T.junk_reason(F.col("text")).alias("reason")).where("reason is not null")


def curate_rejections(spark, d):
    return curation.rejections(table(spark, d, "docs"))


def curate_exact_duplicates(spark, d):
    return curation.exact_duplicates(table(spark, d, "docs"))


def curate_accepted(spark, d):
    """The first 500 accepted records."""
    return curation.accepted(table(spark, d, "docs"), 500)


def curate_corpus_ids(spark, d):
    """The corpus in order of its content ids, with the size of each text."""
    return curation.corpus(table(spark, d, "docs")).select("doc_id", "ord", F.length("text").cast("long").alias("chars"))


def curate_identifiers(spark, d):
    return table(spark, d, "docs").select("ord", T.identifier(F.col("url")).alias("identifier")).where("identifier is not null")


def curate_excluded(spark, d):
    """Records of the later batches that batch 0 holds already, by six keys."""
    docs = table(spark, d, "docs")
    return curation.excluded(docs.where("batch > 0"), docs.where("batch = 0"))


def curate_disjoint(spark, d):
    """What the exclusion leaves shares none of the six keys with batch 0: survivors by reason, none if it holds."""
    docs = table(spark, d, "docs")
    old, new = docs.where("batch = 0"), docs.where("batch > 0")
    kept = new.join(curation.excluded(new, old).select("ord"), "ord", "left_anti")
    return curation.survivors(kept, new, old).groupBy("reason").agg(F.count("*").alias("n"))


def curate_unique_edges(spark, d):
    docs = table(spark, d, "docs")
    return curation.unique_edges(docs.where("batch > 0"), docs.where("batch = 0"))


def curate_content_id(spark, d):
    """Content ids as a hash of title and text."""
    payload = F.concat_ws("\n", F.coalesce("title", F.lit("")), "text")
    return table(spark, d, "docs").where("text is not null").select("ord", F.concat(F.lit("ep-"), F.substring(F.sha2(payload, 256), 1, 16)).alias("content_id"))


def curate_category_parts(spark, d):
    """Field and domain of a category source:...:field|domain."""
    head = F.substring_index(F.lower("category"), "|", 1)
    domain = F.when(F.col("category").contains("|"), F.substring_index(F.lower("category"), "|", -1)).otherwise("")
    return table(spark, d, "docs").where("category is not null").select(F.trim(F.substring_index(head, ":", -1)).alias("field"), domain.alias("domain")).groupBy("field", "domain").agg(F.count("*").alias("n"))


def curate_quality_view(spark, d):
    """titles and texts long enough to be used, with counts for each way to fail."""
    docs = table(spark, d, "docs")
    reason = F.when(F.length(F.coalesce("title", F.lit(""))) < 25, "title_short").when(F.length("title") > 180, "title_long").when(F.length(F.coalesce("text", F.lit(""))) < 200, "text_short").otherwise("usable")
    return docs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (curate_normalized_text, curate_title_fallback, curate_junk_reason, curate_rejections, curate_exact_duplicates, curate_accepted, curate_corpus_ids, curate_identifiers, curate_excluded, curate_disjoint, curate_unique_edges, curate_content_id, curate_category_parts, curate_quality_view)}

_SQUEEZE = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"
_REASON = """
  WITH lines AS (
    SELECT ord, trim(x) AS line FROM (SELECT ord, unnest(string_split(text, chr(10))) AS x FROM docs WHERE text IS NOT NULL) WHERE trim(x) <> ''
  ), tops AS (
    SELECT ord, sum(c) AS n, max(c) AS top FROM (SELECT ord, line, count(*) AS c FROM lines GROUP BY ord, line) GROUP BY ord
  ), judged AS (
    SELECT d.ord, d.text, d.batch, CASE
      WHEN coalesce(length(text), 0) < 200 THEN 'too_short' WHEN length(text) > 100000 THEN 'too_long'
      WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 0.5 * length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) THEN 'low_alpha'
      WHEN t.n >= 4 AND t.top > 0.3 * t.n THEN 'boilerplate' END AS reason
    FROM docs d LEFT JOIN tops t USING (ord))
"""
_IDENTIFIER = """CASE
  WHEN regexp_extract(lower(coalesce(url, '')), '(10[.][0-9]{4,9}/[^ ?#&]+)', 1) <> '' THEN 'doi:' || regexp_replace(regexp_extract(lower(url), '(10[.][0-9]{4,9}/[^ ?#&]+)', 1), '/+$', '')
  WHEN regexp_extract(lower(coalesce(url, '')), '/(w[0-9]{6,})', 1) <> '' THEN 'work:' || regexp_extract(lower(url), '/(w[0-9]{6,})', 1)
  WHEN regexp_extract(lower(coalesce(url, '')), '/pm/([0-9]{5,})', 1) <> '' THEN 'paper:' || regexp_extract(lower(url), '/pm/([0-9]{5,})', 1) END"""
SQL = {
    "curate_normalized_text": """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'),
        ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS normalized FROM documents""",
    "curate_title_fallback": f"SELECT ord, CASE WHEN t = '' THEN {_SQUEEZE.format('substring(text, 1, 80)')} ELSE t END AS title FROM (SELECT *, {_SQUEEZE.format(chr(99) + 'oalesce(title, chr(32))')} AS t FROM docs WHERE text IS NOT NULL)",
    "curate_junk_reason": _REASON + "SELECT ord, reason FROM judged WHERE reason IS NOT NULL",
    "curate_rejections": _REASON + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "curate_exact_duplicates": "SELECT sha256(text) AS text_hash, min(ord) AS first_ord, count(*) AS copies FROM docs WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "curate_accepted": _REASON + "SELECT min(ord) AS ord FROM judged WHERE reason IS NULL GROUP BY text ORDER BY 1 LIMIT 500",
    "curate_corpus_ids": "SELECT doc_id, ord, CAST(length(text) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM docs WHERE text IS NOT NULL AND text <> '') WHERE r = 1",
    "curate_identifiers": f"SELECT * FROM (SELECT ord, {_IDENTIFIER} AS identifier FROM docs) WHERE identifier IS NOT NULL",
    "curate_content_id": "SELECT ord, 'ep-' || substring(sha256(coalesce(title, '') || chr(10) || text), 1, 16) AS content_id FROM docs WHERE text IS NOT NULL",
    "curate_category_parts": """SELECT trim(string_split(string_split(lower(category), '|')[1], ':')[-1]) AS field, CASE WHEN contains(category, '|') THEN string_split(lower(category), '|')[-1] ELSE '' END AS domain, count(*) AS n
        FROM docs WHERE category IS NOT NULL GROUP BY 1, 2""",
    "curate_quality_view": """SELECT CASE WHEN length(coalesce(title, '')) < 25 THEN 'title_short' WHEN length(title) > 180 THEN 'title_long' WHEN length(coalesce(text, '')) < 200 THEN 'text_short' ELSE 'usable' END AS reason,
        count(*) AS n FROM docs GROUP BY 1""",
}
