"""Queries of task synthesis, sampling and checks of tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import ledger, ordered
from lexmill.plans import features, grading
from lexmill.session import table

SEED = "exam-7"


def _order(id_col: str):
    """A seeded order that any engine can repeat."""
    return F.sha2(F.concat(F.lit(SEED + ":"), F.col(id_col)), 256)


def task_findings(spark, d):
    """For each document the first sentence with a cue and a percentage, as a question with the value blanked."""
    pieces = features._corpus(spark, d).select("doc_id", F.posexplode(T.sentences(T.ascii_view(F.col("text")))).alias("at", "sentence"))
    cue = F.lower("sentence").rlike("(" + "|".join(features.CUES) + ")")
    fit = pieces.where(cue & (F.length("sentence") <= 400) & (F.size(T.percentages(F.col("sentence"))) > 0))
    first = fit.groupBy("doc_id").agg(F.min(F.struct("at", "sentence")).alias("f")).select("doc_id", T.squeeze(F.col("f.sentence")).alias("sentence"))
    return first.select("doc_id", F.regexp_replace("sentence", "[0-9]{1,2}[.][0-9]+ ?%", "[...]").alias("question"))


def task_superlatives(spark, d):
    """For each cue the one document of highest value, where no other reaches it."""
    best = features.feature_cue_percent(spark, d)
    top = best.groupBy("cue").agg(F.max("value").alias("top"))
    reached = best.join(top, "cue").where(F.col("value") == F.col("top")).groupBy("cue", "top").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return reached.where("n = 1").select("cue", "top", "doc_id")


def task_threshold_counts(spark, d):
    """For each cue how many documents lie above 50."""
    return features.feature_cue_percent(spark, d).groupBy("cue").agg(F.count_if(F.col("value") > 50).alias("above"), F.count("*").alias("documents"))


def task_value_windows(spark, d):
    """The span of values from the neighbour below to the one above, by cue and document."""
    by = Window.partitionBy("cue").orderBy("value", "doc_id")
    return features.feature_cue_percent(spark, d).select("cue", "doc_id", "value", F.coalesce(F.lag("value").over(by), "value").alias("low"), F.coalesce(F.lead("value").over(by), "value").alias("high"))


def task_questions(spark, d):
    """Questions in a fixed frame for documents that state a sample size."""
    sized = features.feature_profile(spark, d).where("sample_size is not null")
    return sized.select("doc_id", F.concat(F.lit("Which record states a group of "), F.col("sample_size").cast("string"), F.lit("?")).alias("question"))


def task_seeded_sample(spark, d):
    """Ten tasks of each template in the seeded order."""
    t = grading._tasks(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("template").orderBy(_order("task_id"))))
    return t.where("place <= 10").select("template", "task_id", F.col("place").cast("long").alias("place"))


def task_exam(spark, d):
    """The first 200 tasks in the seeded order that no rollout of the first hundred rounds used."""
    used = table(spark, d, "rollouts").where("round < 100").select("task_id").distinct()
    return grading._tasks(spark, d).join(used, "task_id", "left_anti").orderBy(_order("task_id")).limit(200).select("task_id")


def task_shards(spark, d):
    """Tasks dealt in turn to eight shards within their template."""
    # ids are spread over buckets by their first letters, in their own order
    placed = grading._tasks(spark, d).select("task_id", "template", F.conv(F.hex(F.rpad(F.substring("task_id", 1, 6), 6, "\u0000")), 16, 10).cast("long").alias("start"))
    return ordered.ranked(placed, "start", ["task_id"], 1 << 16, "template").select("task_id", "template", F.pmod("rank", F.lit(8)).cast("long").alias("shard"))


def task_kinds(spark, d):
    """Tasks by the kind of their answer."""
    a = F.trim("answer")
    kind = F.when(a.isNull() | (a == ""), "none").when(a.rlike("^(1[5-9][0-9]{2}|20[0-9]{2})$"), "year").when(T.number(F.col("answer")).isNotNull(), "number").otherwise("text")
    return grading._tasks(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("tasks"))


def task_failures(spark, d):
    """tasks by what their row lacks, the first that applies."""
    t = table(spark, d, "tasks")
    one = t.groupBy("task_id").agg(F.min(F.struct("answer", "question", "evidence_doc_ids")).alias("t")).select("t.*")
    reason = (
        F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "answer_empty").when(F.length("answer") > 200, "answer_too_long").when(F.col("answer").rlike("[<>{}]"), "answer_markup")
        .when(F.trim(F.coalesce("question", F.lit(""))) == "", "question_empty").when(F.coalesce(F.size("evidence_doc_ids"), F.lit(0)) <= 0, "evidence_empty").otherwise("ok")
    )
    return one.groupBy(reason.alias("reason")).agg(F.count("*").alias("tasks"))


def task_leaks(spark, d):
    """Tasks whose question holds the answer's words."""
    t = grading_questions(spark, d)
    words = F.array_distinct(T.tokens(F.col("answer")))
    return t.where((F.size(words) > 0) & (F.size(F.array_except(words, T.tokens(F.col("question")))) == 0)).select("task_id")


def grading_questions(spark, d):
    t = table(spark, d, "tasks").where("answer is not null and question is not null")
    return t.groupBy("task_id").agg(F.min(F.struct("answer", "question")).alias("t")).select("task_id", "t.*")


def task_overlap(spark, d):
    """the share of a question's words that its evidence's titles hold, by task."""
    asked = table(spark, d, "tasks").where("question is not null").groupBy("task_id").agg(F.min(F.struct("question", "evidence_doc_ids")).alias("t")).select("task_id", "t.*")
    titles = table(spark, d, "docs").where("title is not null").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("word")).distinct()
    words = asked.select("task_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("word"))
    held = asked.select("task_id", F.explode("evidence_doc_ids").alias("doc_id")).join(titles, "doc_id").select("task_id", "word", F.lit(1).alias("in_title")).distinct()
    return words.join(held, ["task_id", "word"], "left").groupBy("task_id").agg(F.round(F.count("in_title") / F.count("*"), 6).alias("overlap"))


def task_lenient_matches(spark, d):
    """Wrong answers that contain the right one or lie within it, by model."""
    said = grading._rollouts(spark, d).where("not correct and answer is not null").select("model", "task_id", T.answer_key(F.col("answer")).alias("said"))
    truth = grading._tasks(spark, d).select("task_id", T.answer_key(F.col("answer")).alias("truth"))
    joined = said.join(truth, "task_id").where("said <> '' and truth <> '' and said <> truth")
    return joined.groupBy("model").agg(F.count_if(F.contains("said", "truth") | F.contains("truth", "said")).alias("lenient"), F.count("*").alias("wrong"))


def task_evidence_skew(spark, d):
    """Tasks by evidence record, for records that at least two tasks name."""
    return table(spark, d, "tasks").select("task_id", F.explode("evidence_doc_ids").alias("doc_id")).distinct().groupBy("doc_id").agg(F.count("*").alias("tasks")).where("tasks >= 2")


def rollout_recent(spark, d):
    """The last five rounds of each model with their accuracy."""
    per = grading._rollouts(spark, d).groupBy("model", "round").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("acc"))
    return per.withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy(F.col("round").desc()))).where("k <= 5").select("model", F.col("round").cast("long").alias("round"), "acc")


def rollout_star_join(spark, d):
    """The model with most rollouts against every other on the tasks in common, by phase."""
    rows = grading._rollouts(spark, d).where("task_id is not null").groupBy("phase", "task_id", "model").agg(F.avg(F.col("correct").cast("double")).alias("acc"), F.count("*").alias("n"))
    king = rows.groupBy("model").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "model").limit(1).collect()
    king = king[0].model if king else ""
    left = rows.where(F.col("model") == king).select("phase", "task_id", F.col("acc").alias("king_acc"))
    joined = rows.where(F.col("model") != king).join(left, ["phase", "task_id"])
    return joined.groupBy("phase", "model").agg(F.count("*").alias("tasks"), F.round(F.avg(F.col("acc") - F.col("king_acc")), 6).alias("diff"))


def rollout_first_errors(spark, d):
    """The first and the last error of each model, in order of arrival."""
    e = grading._rollouts(spark, d).where("error is not null").withColumn("name", F.lower(F.trim("error")))
    return e.groupBy("model").agg(F.min_by("name", "rollout_id").alias("first"), F.max_by("name", "rollout_id").alias("last"), F.min("round").cast("long").alias("since"))


def reveal_round_before(spark, d):
    """For each reveal the last round that started strictly before its block."""
    p = table(spark, d, "payloads")
    return ordered.as_of(ledger.events(p, "e1").select("seq", "block"), ledger.events(p, "r1").select(F.col("block").alias("block"), "round"), "block", "round", 5_000).select("seq", "block", F.col("round"))


def docs_by_week(spark, d):
    """Records by ISO week of arrival."""
    week = F.format_string("%04dW%02d", F.expr("extract(YEAROFWEEK FROM fetched_at)").cast("int"), F.expr("extract(WEEK FROM fetched_at)").cast("int"))
    return table(spark, d, "docs").where("fetched_at is not null").groupBy(week.alias("week")).agg(F.count("*").alias("n"))


def merged_sources(spark, d):
    """By content id the last delivery and the different sources, in order of name."""
    docs = table(spark, d, "docs")
    return docs.groupBy("doc_id").agg(F.max("ord").alias("last_ord"), F.array_join(F.array_sort(F.collect_set(F.split("source", ":")[0])), ",").alias("sources"), F.count("*").alias("n")).where("n > 1")


QUERIES = {f.__name__: f for f in (task_findings, task_superlatives, task_threshold_counts, task_value_windows, task_questions, task_seeded_sample, task_exam, task_shards, task_kinds, task_failures, task_leaks, task_overlap, task_lenient_matches, task_evidence_skew, rollout_recent, rollout_star_join, rollout_first_errors, reveal_round_before, docs_by_week, merged_sources)}

_C, _CUE, _P = features._CORPUS, features._CUE, features._PROFILE
_R, _T, _KEY, _NUM = grading._R, grading._T, grading._KEY, grading._NUM
_W = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"
SQL = {
    "task_findings": f"""WITH {_C}, p AS (SELECT doc_id, string_split(regexp_replace(plain, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM corpus), x AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM p),
        f AS (SELECT doc_id, arg_min(s, pos) AS s FROM x WHERE regexp_matches(lower(s), '({"|".join(features.CUES)})') AND length(s) <= 400 AND {features._PERCENT.format("s")} IS NOT NULL GROUP BY 1)
        SELECT doc_id, regexp_replace(trim(regexp_replace(s, '[ \\t\\r\\n]+', ' ', 'g')), '[0-9]{{1,2}}[.][0-9]+ ?%', '[...]', 'g') AS question FROM f""",
    "task_superlatives": f"WITH {_C}, {_CUE}, t AS (SELECT cue, max(value) AS top FROM cues GROUP BY 1) SELECT cue, top, min(doc_id) AS doc_id FROM cues JOIN t USING (cue) WHERE value = top GROUP BY 1, 2 HAVING count(*) = 1",
    "task_threshold_counts": f"WITH {_C}, {_CUE} SELECT cue, count(*) FILTER (value > 50) AS above, count(*) AS documents FROM cues GROUP BY 1",
    "task_value_windows": f"WITH {_C}, {_CUE} SELECT cue, doc_id, value, coalesce(lag(value) OVER w, value) AS low, coalesce(lead(value) OVER w, value) AS high FROM cues WINDOW w AS (PARTITION BY cue ORDER BY value, doc_id)",
    "task_questions": f"WITH {_C}, {_P} SELECT doc_id, 'Which record states a group of ' || sample_size || '?' AS question FROM profile WHERE sample_size IS NOT NULL",
    "task_seeded_sample": f"WITH {_T} SELECT template, task_id, place FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY sha256('{SEED}:' || task_id)) AS place FROM t) WHERE place <= 10",
    "task_exam": f"WITH {_T} SELECT task_id FROM t WHERE task_id NOT IN (SELECT task_id FROM rollouts WHERE round < 100 AND task_id IS NOT NULL) ORDER BY sha256('{SEED}:' || task_id) LIMIT 200",
    "task_shards": f"WITH {_T} SELECT task_id, template, CAST((row_number() OVER (PARTITION BY template ORDER BY task_id) - 1) % 8 AS BIGINT) AS shard FROM t",
    "task_kinds": f"WITH {_T} SELECT CASE WHEN trim(coalesce(answer, '')) = '' THEN 'none' WHEN regexp_full_match(trim(answer), '(1[5-9][0-9]{{2}}|20[0-9]{{2}})') THEN 'year' WHEN ({_NUM.format('answer')}) IS NOT NULL THEN 'number' ELSE 'text' END AS kind, count(*) AS tasks FROM t GROUP BY 1",
    "task_failures": """WITH o AS (SELECT DISTINCT task_id, answer, question, evidence_doc_ids FROM tasks) SELECT CASE WHEN trim(coalesce(answer, '')) = '' THEN 'answer_empty' WHEN length(answer) > 200 THEN 'answer_too_long' WHEN regexp_matches(answer, '[<>{}]') THEN 'answer_markup'
        WHEN trim(coalesce(question, '')) = '' THEN 'question_empty' WHEN coalesce(len(evidence_doc_ids), 0) = 0 THEN 'evidence_empty' ELSE 'ok' END AS reason, count(*) AS tasks FROM o GROUP BY 1""",
    "task_leaks": f"SELECT DISTINCT task_id FROM tasks WHERE answer IS NOT NULL AND question IS NOT NULL AND len({_W.format('answer')}) > 0 AND list_has_all({_W.format('question')}, {_W.format('answer')})",
    "task_overlap": f"""WITH q AS (SELECT DISTINCT task_id, question, evidence_doc_ids FROM tasks WHERE question IS NOT NULL), w AS (SELECT DISTINCT task_id, unnest({_W.format("question")}) AS word FROM q),
        h AS (SELECT DISTINCT e.task_id, unnest({_W.format("d.title")}) AS word FROM (SELECT task_id, unnest(evidence_doc_ids) AS doc_id FROM q) e JOIN docs d USING (doc_id) WHERE d.title IS NOT NULL)
        SELECT task_id, round(count(h.word) / count(*), 6) AS overlap FROM w LEFT JOIN h USING (task_id, word) GROUP BY 1""",
    "task_lenient_matches": f"""WITH {_R}, {_T}, j AS (SELECT model, {_KEY.format("r.answer")} AS said, {_KEY.format("t.answer")} AS truth FROM r JOIN t USING (task_id) WHERE NOT correct AND r.answer IS NOT NULL)
        SELECT model, count(*) FILTER (contains(said, truth) OR contains(truth, said)) AS lenient, count(*) AS wrong FROM j WHERE said <> '' AND truth <> '' AND said <> truth GROUP BY 1""",
    "task_evidence_skew": "SELECT doc_id, count(*) AS tasks FROM (SELECT DISTINCT task_id, unnest(evidence_doc_ids) AS doc_id FROM tasks) GROUP BY 1 HAVING count(*) >= 2",
    "rollout_recent": f"WITH {_R}, {grading._PER} SELECT model, CAST(round AS BIGINT) AS round, round(acc, 6) AS acc FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY per.round DESC) AS k FROM per) WHERE k <= 5",
    "rollout_star_join": f"""WITH {_R}, a AS (SELECT phase, task_id, model, avg(correct::INT) AS acc, count(*) AS n FROM r WHERE task_id IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT model FROM a GROUP BY 1 ORDER BY sum(n) DESC, model LIMIT 1)
        SELECT o.phase, o.model, count(*) AS tasks, round(avg(o.acc - b.acc), 6) AS diff FROM a o JOIN a b USING (phase, task_id) WHERE b.model IN (FROM k) AND o.model NOT IN (FROM k) GROUP BY 1, 2""",
    "rollout_first_errors": f"WITH {_R} SELECT model, arg_min(lower(trim(error)), rollout_id) AS first, arg_max(lower(trim(error)), rollout_id) AS last, CAST(min(round) AS BIGINT) AS since FROM r WHERE error IS NOT NULL GROUP BY 1",
    "docs_by_week": "SELECT strftime(fetched_at, '%GW%V') AS week, count(*) AS n FROM docs WHERE fetched_at IS NOT NULL GROUP BY 1",
    "merged_sources": "SELECT doc_id, max(ord) AS last_ord, string_agg(DISTINCT string_split(source, ':')[1], ',' ORDER BY string_split(source, ':')[1]) AS sources, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1",
}


def _as_of_sql() -> str:
    from lexmill.plans import ledger as ledger_plans

    return ledger_plans._B + ", r1 AS (SELECT block, max(round) AS round FROM parsed WHERE kind = 'r1' AND reason IS NULL GROUP BY 1) SELECT e.seq, e.block, r1.round FROM e ASOF LEFT JOIN r1 ON e.block > r1.block"


SQL["reveal_round_before"] = _as_of_sql()
