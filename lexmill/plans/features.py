"""Queries of text features: numbers in texts, entities and their bands, pairs of entities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import parse
from lexmill.functions import text as T
from lexmill.operators import curation, search
from lexmill.plans import search as search_plans
from lexmill.session import table

# Cue words of findings, and terms that name how a study was done.
CUES = ("share", "declined", "rose", "reached", "exceeded", "reduced", "stalled")
METHOD_TERMS = ("BASELINE", "RCT", "PRISMA", "long-term", "short-term")


def _corpus(spark, d):
    return curation.corpus(table(spark, d, "docs"))


def _entities(spark, d):
    """Acronyms and hyphenated compounds of each document, in printable ASCII, without method terms."""
    plain = F.concat(F.lit(" "), F.regexp_replace(T.ascii_view(F.col("text")), "[^A-Za-z0-9-]+", "  "), F.lit(" "))
    acronyms = F.regexp_extract_all(plain, F.lit(" ([A-Z][A-Z0-9]{2,5}) "), 1)
    compounds = F.regexp_extract_all(plain, F.lit(" ([a-z]{4,}(-[a-z]{3,}){1,2}) "), 1)
    edges = _corpus(spark, d).select("doc_id", F.explode(F.array_distinct(F.concat(acronyms, compounds))).alias("term"))
    return edges.where(~F.col("term").isin(*METHOD_TERMS))


def feature_years(spark, d):
    """In how many documents each year stands."""
    return _corpus(spark, d).select(F.explode(T.years(T.ascii_view(F.col("text")))).alias("year")).groupBy("year").agg(F.count("*").alias("documents"))


def feature_profile(spark, d):
    """The largest sample size and percentage of each document that states one."""
    plain = T.ascii_view(F.col("text"))
    made = _corpus(spark, d).select("doc_id", F.array_max(T.sample_sizes(plain)).alias("sample_size"), F.array_max(T.percentages(plain)).alias("top_percent"))
    return made.where("sample_size is not null or top_percent is not null")


def feature_cue_percent(spark, d):
    """For each cue the largest percentage of a sentence that has it, by document."""
    pieces = _corpus(spark, d).select("doc_id", F.explode(T.sentences(T.ascii_view(F.col("text")))).alias("sentence"))
    valued = pieces.select("doc_id", F.lower("sentence").alias("low"), F.array_max(T.percentages(F.col("sentence"))).alias("value")).where("value is not null")
    cue = F.explode(F.filter(F.array(*map(F.lit, CUES)), lambda c: F.col("low").contains(c))).alias("cue")
    return valued.select("doc_id", "value", cue).groupBy("doc_id", "cue").agg(F.max("value").alias("value"))


def feature_cue_field(spark, d):
    """For each cue its documents, the largest value and how many reach it."""
    best = feature_cue_percent(spark, d)
    top = best.groupBy("cue").agg(F.count("*").alias("documents"), F.max("value").alias("top"))
    return best.join(top, "cue").groupBy("cue", "documents", "top").agg(F.count_if(F.col("value") == F.col("top")).alias("winners"))


def feature_range_neighbours(spark, d):
    """For each stated sample size how many documents state one within five of it: an equi-join on buckets of ten."""
    sizes = feature_profile(spark, d).where("sample_size is not null").groupBy("sample_size").agg(F.count("*").alias("n"))
    right = sizes.select(F.col("sample_size").alias("other"), F.col("n").alias("m"), F.explode(F.sequence(F.floor((F.col("sample_size") - 5) / 10), F.floor((F.col("sample_size") + 5) / 10))).alias("bucket"))
    left = sizes.withColumn("bucket", F.floor(F.col("sample_size") / 10))
    return left.join(right, "bucket").where(F.abs(F.col("sample_size") - F.col("other")) <= 5).groupBy("sample_size").agg(F.sum("m").alias("documents"))


def feature_sentence_counts(spark, d):
    """Sentences of at least 20 characters by document; wide end marks need no blank behind them."""
    pieces = F.split(F.regexp_replace("text", "([.!?।؟۔])[ \\t\\r\\n]+|([。！？])", "$1$2" + T.FOLLOWING), T.FOLLOWING)
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(pieces, lambda s: F.length(F.trim(s)) >= 20)).cast("long").alias("sentences"))


def feature_topic_words(spark, d):
    """Documents by word of at least four letters, of whatever script, in the band of 5 to 2000."""
    words = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: w.rlike("^\\p{L}{4,}$")))
    return table(spark, d, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("documents")).where("documents between 5 and 2000")


def entity_bands(spark, d):
    """entities in 2 to 60 documents."""
    return _entities(spark, d).groupBy("term").agg(F.count("*").alias("documents")).where("documents between 2 and 60")


def entity_sole_meetings(spark, d):
    """Pairs of entities in 2 to 40 documents each that meet in one document only."""
    return search.sole_meetings(_entities(spark, d), 2, 40)


def entity_anchors(spark, d):
    """For each entity of a sole meeting, the first document that has it without the other."""
    edges = _entities(spark, d)
    met = search.sole_meetings(edges, 2, 40)
    candidates = met.select("x", "y", F.col("doc_id").alias("gold")).join(edges.withColumnRenamed("term", "x"), "x").where("doc_id <> gold")
    return candidates.groupBy("x", "y").agg(F.min("doc_id").alias("anchor"))


def entity_cross_documents(spark, d):
    """Documents joined over an entity: it stands in one (anchor), and another (gold) is among the five best hits for it and states a
    percentage in a sentence with it. Entities are those of 2 to 60 documents, which bounds the rows of each."""
    corpus, edges = _corpus(spark, d), _entities(spark, d)
    terms = entity_bands(spark, d).select("term")
    hits = search.bm25(corpus, terms.select(F.col("term").alias("qid"), F.col("term").alias("query")), 5)
    pieces = corpus.select("doc_id", F.explode(T.sentences(T.ascii_view(F.col("text")))).alias("sentence"))
    stated = pieces.select("doc_id", "sentence", F.array_max(T.percentages(F.col("sentence"))).alias("value")).where("value is not null")
    gold = hits.join(stated, "doc_id").where(F.col("sentence").contains(F.col("qid"))).groupBy(F.col("qid").alias("term"), F.col("doc_id").alias("gold"), "rank").agg(F.max("value").alias("value"))
    return gold.join(edges.select("term", F.col("doc_id").alias("anchor")), "term").where("anchor <> gold").select("term", "anchor", "gold", "rank", "value")


def text_last_action(spark, d):
    """The last action of each rollout log, and how many there are."""
    found = F.regexp_extract_all("text", F.lit("<(search|browse|answer)>([^<]*)</"), 1)
    said = F.regexp_extract_all("text", F.lit("<(search|browse|answer)>([^<]*)</"), 2)
    made = table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("actions"), F.try_element_at(found, F.lit(-1)).alias("last"), F.try_element_at(said, F.lit(-1)).alias("content"))
    return made.where("actions > 0")


def text_chunks(spark, d):
    """The pieces of each document, paragraphs packed in order into at most 3,500 characters."""

    def cut(batches):
        for batch in batches:
            rows = [(i, k, piece) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for k, piece in enumerate(parse.chunks(text, 3500))]
            ids, places, pieces = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(pieces, pa.string())], names=["doc_id", "place", "chunk"])

    return table(spark, d, "documents").where("text is not null").select("doc_id", "text").mapInArrow(cut, "doc_id long, place int, chunk string")


def text_number_aliases(spark, d):
    """Answers that are numbers, without separators."""
    answers = table(spark, d, "tasks").select("task_id", "answer").where(F.col("answer").rlike("^[0-9]{1,3}(,[0-9]{3})+$")).distinct()
    return answers.select("task_id", F.regexp_replace("answer", ",", "").cast("long").alias("value"))


def text_claim_window(spark, d):
    """P20: the four words on either side of the first percentage, other digits masked."""
    plain = T.squeeze(T.ascii_view(F.col("text")))
    part = F.regexp_extract(plain, "((?:[^ ]+ ){0,4})[0-9]{1,2}[.][0-9]+ ?%((?: [^ ]+){0,4})", 0)
    return _corpus(spark, d).select("doc_id", F.regexp_replace(part, "[0-9]+", "N").alias("window")).where("window <> ''")


QUERIES = {f.__name__: f for f in (feature_years, feature_profile, feature_cue_percent, feature_cue_field, feature_range_neighbours, feature_sentence_counts, feature_topic_words, entity_bands, entity_sole_meetings, entity_anchors, entity_cross_documents, text_last_action, text_chunks, text_number_aliases, text_claim_window)}

_CORPUS = "corpus AS (SELECT doc_id, text, regexp_replace(text, '[^ -~]', ' ', 'g') AS plain FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM docs WHERE text IS NOT NULL AND text <> '') WHERE r = 1)"
_NO_CI = "regexp_replace({}, '(?i)[0-9]{{1,2}}([.][0-9]+)?[ ]?%[ ]?(CI|confidence)', ' ', 'g')"
_PERCENT = "list_max(list_transform(regexp_extract_all(' ' || " + _NO_CI + ", '[^0-9.]([0-9]{{1,2}}([.][0-9]+)?)[ ]?%', 1), lambda x: CAST(x AS DOUBLE)))"
_PROFILE = f"""profile AS (SELECT doc_id, list_max(list_transform(regexp_extract_all(' ' || plain, '[^A-Za-z0-9_][nN][ ]?=[ ]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT))) AS sample_size,
  {_PERCENT.format("plain")} AS top_percent FROM corpus)"""
_CUE_LIST = ", ".join(f"'{c}'" for c in CUES)
_CUE = f"""sents AS (SELECT doc_id, unnest(string_split(regexp_replace(plain, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM corpus),
  valued AS (SELECT doc_id, lower(s) AS low, {_PERCENT.format("s")} AS value FROM sents),
  cues AS (SELECT doc_id, cue, max(value) AS value FROM valued, (SELECT unnest([{_CUE_LIST}]) AS cue) WHERE value IS NOT NULL AND contains(low, cue) GROUP BY 1, 2)"""
_EDGES = f"""flat AS (SELECT doc_id, ' ' || regexp_replace(plain, '[^A-Za-z0-9-]+', '  ', 'g') || ' ' AS p FROM corpus),
  edges AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(p, ' ([A-Z][A-Z0-9]{{2,5}}) ', 1)) AS term FROM flat UNION ALL SELECT doc_id, unnest(regexp_extract_all(p, ' ([a-z]{{4,}}(-[a-z]{{3,}}){{1,2}}) ', 1)) FROM flat)
    WHERE term NOT IN ({", ".join(f"'{t}'" for t in METHOD_TERMS)}))"""
_ENTITY = f"""{_EDGES},
  banded AS (SELECT e.* FROM edges e JOIN (SELECT term FROM edges GROUP BY term HAVING count(*) BETWEEN 2 AND 40) USING (term)),
  met AS (SELECT a.term AS x, b.term AS y, min(a.doc_id) AS doc_id FROM banded a JOIN banded b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) = 1)"""

SQL = {
    "feature_years": f"WITH {_CORPUS} SELECT year, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(plain, '([0-9]+)', 1), lambda x: regexp_full_match(x, '(1[5-9][0-9]{{2}}|20[0-9]{{2}})'))) AS year FROM corpus) GROUP BY 1",
    "feature_profile": f"WITH {_CORPUS}, {_PROFILE} SELECT * FROM profile WHERE sample_size IS NOT NULL OR top_percent IS NOT NULL",
    "feature_cue_percent": f"WITH {_CORPUS}, {_CUE} SELECT doc_id, cue, value FROM cues",
    "feature_cue_field": f"WITH {_CORPUS}, {_CUE}, tops AS (SELECT cue, count(*) AS documents, max(value) AS top FROM cues GROUP BY 1) SELECT cue, documents, top, count(*) FILTER (value = top) AS winners FROM cues JOIN tops USING (cue) GROUP BY ALL",
    "feature_range_neighbours": f"WITH {_CORPUS}, {_PROFILE}, s AS (SELECT sample_size, count(*) AS n FROM profile WHERE sample_size IS NOT NULL GROUP BY 1) SELECT a.sample_size, CAST(sum(b.n) AS BIGINT) AS documents FROM s a JOIN s b ON b.sample_size BETWEEN a.sample_size - 5 AND a.sample_size + 5 GROUP BY 1",
    "feature_sentence_counts": "SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?।؟۔])[ \\t\\r\\n]+|([。！？])', '\\1\\2' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) >= 20)) AS BIGINT) AS sentences FROM documents",
    "feature_topic_words": f"SELECT word, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(list_filter({search_plans._words('text')}, lambda w: regexp_full_match(w, '\\p{{L}}{{4,}}'))) AS word FROM documents) GROUP BY 1 HAVING count(*) BETWEEN 5 AND 2000",
    "entity_bands": f"WITH {_CORPUS}, {_ENTITY} SELECT term, count(*) AS documents FROM edges GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60",
    "entity_sole_meetings": f"WITH {_CORPUS}, {_ENTITY} SELECT x, y, doc_id FROM met",
    "entity_anchors": f"WITH {_CORPUS}, {_ENTITY} SELECT m.x, m.y, min(e.doc_id) AS anchor FROM met m JOIN edges e ON e.term = m.x AND e.doc_id <> m.doc_id GROUP BY 1, 2",
    "entity_cross_documents": search_plans._ASKED.replace(
        search_plans._QUESTIONS, "plains AS (SELECT doc_id, text, regexp_replace(text, '[^ -~]', ' ', 'g') AS plain FROM corpus), " + _EDGES.replace("FROM corpus", "FROM plains")
        + ", questions AS (SELECT term AS qid, term AS query FROM edges GROUP BY term HAVING count(*) BETWEEN 2 AND 60)",
    ) + search_plans._RANKED.format(mask="") + f""", sents AS (SELECT doc_id, unnest(string_split(regexp_replace(plain, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM plains),
        stated AS (SELECT * FROM (SELECT doc_id, s, {_PERCENT.format("s")} AS value FROM sents) WHERE value IS NOT NULL),
        gold AS (SELECT r.qid, r.doc_id, r.rank, max(value) AS value FROM ranked r JOIN stated USING (doc_id) WHERE r.rank <= 5 AND contains(s, r.qid) GROUP BY ALL)
        SELECT g.qid AS term, e.doc_id AS anchor, g.doc_id AS gold, g.rank, g.value FROM gold g JOIN edges e ON e.term = g.qid AND e.doc_id <> g.doc_id""",
    "text_last_action": "SELECT * FROM (SELECT doc_id, CAST(len(a) AS BIGINT) AS actions, a[-1] AS last, c[-1] AS content FROM (SELECT doc_id, regexp_extract_all(text, '<(search|browse|answer)>([^<]*)</', 1) AS a, regexp_extract_all(text, '<(search|browse|answer)>([^<]*)</', 2) AS c FROM documents)) WHERE actions > 0",
    "text_number_aliases": "SELECT DISTINCT task_id, CAST(replace(answer, ',', '') AS BIGINT) AS value FROM tasks WHERE regexp_full_match(answer, '[0-9]{1,3}(,[0-9]{3})+')",
    "text_claim_window": f"WITH {_CORPUS} SELECT * FROM (SELECT doc_id, regexp_replace(regexp_extract(trim(regexp_replace(plain, '[ \\t\\r\\n]+', ' ', 'g')), '((?:[^ ]+ ){{0,4}})[0-9]{{1,2}}[.][0-9]+ ?%((?: [^ ]+){{0,4}})', 0), '[0-9]+', 'N', 'g') AS \"window\" FROM corpus) WHERE \"window\" <> ''",
}
