"""Queries that clean and judge single fields: markup, answers, numbers, articles, titles, result pages, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import parse
from lexmill.functions import text as T
from lexmill.operators import curation, search
from lexmill.plans import search as search_plans
from lexmill.session import table

# Entities that publishers leave in titles; the number words from 0 to 20.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
TITLE_LENGTHS = (20, 200)
_RESIDUE, _FUSED = "(^|[ ])/?(i|b|sub|sup|em|strong|scp|it)([ ]|$)", "[a-z]{3}[A-Z][a-z]{3}"
_FACT = "[A-Z][A-Za-z]*(?: [A-Za-z]+){0,5}? was [a-z]+(?: [a-z]+){0,3}? in (?:the )?[A-Z0-9][A-Za-z0-9]*"
_GROUPS = "^([A-Z][A-Za-z]*(?: [A-Za-z]+){0,5}?) was ([a-z]+(?: [a-z]+){0,3}?) in (?:the )?([A-Z0-9][A-Za-z0-9]*)$"


def text_clean_markup(spark, d):
    """Titles without tags, with five entities decoded and blanks squeezed. Null titles have no row."""
    cleaned = F.regexp_replace("title", "<[^>]*>", " ")
    for entity, sign in ENTITIES.items():
        cleaned = F.replace(cleaned, F.lit(entity), F.lit(sign))
    return table(spark, d, "docs").where("title is not null").select("ord", T.squeeze(cleaned).alias("title"))


def text_edge_digests(spark, d):
    """Hashes of the first and last 160 letters and digits of each text that has at least 200, each under its side's name."""
    plain = F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{N}]", "")
    long = table(spark, d, "docs").select("ord", plain.alias("plain")).where("length(plain) >= 200")
    return long.select("ord", F.sha2(F.concat(F.lit("start:"), F.substring("plain", 1, 160)), 256).alias("start"), F.sha2(F.concat(F.lit("end:"), F.expr("right(plain, 160)")), 256).alias("end"))


def text_qa_answers(spark, d):
    """Different answers of tasks in small letters (sharp s as ss), blanks squeezed, end marks and quotation marks off both ends."""
    folded = T.squeeze(F.replace(F.lower("answer"), F.lit("ß"), F.lit("ss")))
    return table(spark, d, "tasks").where("answer is not null").select("task_id", F.regexp_replace(folded, "^[.,;:!?\"' ]+|[.,;:!?\"' ]+$", "").alias("answer")).distinct()


def text_number_words(spark, d):
    """What an answer that is a count may be written as: without separators, and as a word up to twenty."""
    plain = F.when(F.col("answer").rlike("^[0-9]{1,3}(,[0-9]{3})+$|^[0-9]+$"), F.replace("answer", F.lit(","), F.lit("")))
    small = plain.try_cast("long")
    words = F.array(*map(F.lit, NUMBER_WORDS))
    answers = table(spark, d, "tasks").where("answer is not null").select("task_id", "answer").distinct().withColumn("plain", plain).where("plain is not null")
    return answers.select("task_id", "plain", F.when(small <= 20, F.element_at(words, (small + 1).cast("int"))).alias("word"))


def text_articles(spark, d):
    """Titles without a leading article, and with that article in small letters."""
    article = "^(The|A|An) "
    some = table(spark, d, "docs").where(F.col("title").rlike(article))
    first = F.regexp_extract("title", article, 1)
    stripped = F.regexp_replace("title", article, "")
    return some.select("ord", stripped.alias("stripped"), F.concat(F.lower(first), F.lit(" "), stripped).alias("lowered"))


def text_result_pages(spark, d):
    """A page of the five best titles for every question, numbered, one a line."""
    corpus = curation.corpus(table(spark, d, "docs"))
    hits = search.bm25(corpus, search_plans._questions(spark, d), 5)
    lines = hits.join(corpus.select("doc_id", "title"), "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("l"))
    return lines.select("qid", F.array_join(F.transform("l", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["title"])), "\n").alias("page"))


def text_usable_titles(spark, d):
    """Titles that can be an answer: of a length to retype, no residue of markup, no fused words, nine in ten letters Latin."""
    letters, latin = F.length(F.regexp_replace("title", "[^\\p{L}]", "")), F.length(F.regexp_replace("title", "[^\\p{IsLatin}]", ""))
    good = F.length("title").between(*TITLE_LENGTHS) & ~F.col("title").rlike(_RESIDUE) & ~F.col("title").rlike(_FUSED) & (letters > 0) & (latin >= 0.9 * letters)
    return table(spark, d, "docs").where("title is not null").where(good).select("ord", "title")


def text_sanitized_fields(spark, d):
    """Titles in compatibility form, control and format characters as blanks, without <, >, ` and |, squeezed, at most 200 characters."""
    plain = F.regexp_replace(F.regexp_replace(parse.compatibility_udf("title"), "[\\p{Cc}\\p{Cf}]", " "), "[<>`|]", "")
    return table(spark, d, "docs").where("title is not null").select("ord", F.substring(F.trim(F.regexp_replace(plain, " +", " ")), 1, 200).alias("field"))


def text_relation_facts(spark, d):
    """What a text says was done to a thing in a named year, time or place."""
    found = table(spark, d, "docs").where("text is not null").select("ord", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_FACT), 0))).alias("fact"))
    return found.select("ord", *[F.regexp_extract("fact", _GROUPS, k + 1).alias(name) for k, name in enumerate(("entity", "predicate", "place"))])


def curate_exclusion_keys(spark, d):
    """The key table of all records: by kind and key the number of papers that have it."""
    return curation.exclusion_keys(table(spark, d, "docs"))


QUERIES = {f.__name__: f for f in (text_clean_markup, text_edge_digests, text_qa_answers, text_number_words, text_articles, text_result_pages, text_usable_titles, text_sanitized_fields, text_relation_facts, curate_exclusion_keys)}

_SQUEEZE = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"
_QUOTED = {k: v.replace("'", "''") for k, v in ENTITIES.items()}
_DECODED = "regexp_replace(title, '<[^>]*>', ' ', 'g')"
for _entity, _sign in _QUOTED.items():
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_sign}')"
SQL = {
    "text_clean_markup": f"SELECT ord, {_SQUEEZE.format(_DECODED)} AS title FROM docs WHERE title IS NOT NULL",
    "text_edge_digests": "WITH p AS (SELECT ord, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS plain FROM docs) SELECT ord, sha256('start:' || left(plain, 160)) AS start, sha256('end:' || right(plain, 160)) AS \"end\" FROM p WHERE length(plain) >= 200",
    "text_qa_answers": f"SELECT DISTINCT task_id, trim({_SQUEEZE.format(chr(10).join(['replace(lower(answer)', chr(39) + 'ß' + chr(39), chr(39) + 'ss' + chr(39) + ')']).replace(chr(10), ', '))}, '.,;:!?\"'' ') AS answer FROM tasks WHERE answer IS NOT NULL",
    "text_number_words": f"WITH a AS (SELECT DISTINCT task_id, replace(answer, ',', '') AS plain FROM tasks WHERE regexp_full_match(answer, '[0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+')) SELECT task_id, plain, CASE WHEN try_cast(plain AS BIGINT) <= 20 THEN {NUMBER_WORDS}[try_cast(plain AS BIGINT) + 1] END AS word FROM a",
    "text_articles": "SELECT ord, regexp_replace(title, '^(The|A|An) ', '') AS stripped, lower(regexp_extract(title, '^(The|A|An) ', 1)) || ' ' || regexp_replace(title, '^(The|A|An) ', '') AS lowered FROM docs WHERE regexp_matches(title, '^(The|A|An) ')",
    "text_result_pages": search_plans._ASKED + search_plans._RANKED.format(mask="") + "SELECT qid, string_agg(CAST(rank AS VARCHAR) || '. ' || title, chr(10) ORDER BY rank) AS page FROM ranked JOIN corpus USING (doc_id) WHERE rank <= 5 GROUP BY qid",
    "text_usable_titles": f"SELECT ord, title FROM (SELECT ord, title, length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(title, '[^\\p{{Latin}}]', '', 'g')) AS latin FROM docs WHERE title IS NOT NULL) WHERE length(title) BETWEEN {TITLE_LENGTHS[0]} AND {TITLE_LENGTHS[1]} AND NOT regexp_matches(title, '{_RESIDUE}') AND NOT regexp_matches(title, '{_FUSED}') AND letters > 0 AND latin >= 0.9 * letters",
    "text_relation_facts": f"WITH f AS (SELECT DISTINCT ord, unnest(regexp_extract_all(text, '{_FACT}')) AS fact FROM docs) SELECT ord, regexp_extract(fact, '{_GROUPS}', 1) AS entity, regexp_extract(fact, '{_GROUPS}', 2) AS predicate, regexp_extract(fact, '{_GROUPS}', 3) AS place FROM f",
}
