"""Queries of grading and statistics over rollouts and tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import ordered
from lexmill.session import table


def _rollouts(spark, d):
    """Re-delivered rows are alike; one of each id is kept, by an aggregate that map tasks share."""
    r = table(spark, d, "rollouts")
    return r.groupBy("rollout_id").agg(F.min(F.struct(*[c for c in r.columns if c != "rollout_id"])).alias("r")).select("rollout_id", "r.*")


def _tasks(spark, d):
    t = table(spark, d, "tasks").select("task_id", "answer", "aliases", "template", "origin", "hops")
    return t.groupBy("task_id").agg(F.min(F.struct("answer", "aliases", "template", "origin", "hops")).alias("t")).select("task_id", "t.*")


def grade_cascade(spark, d):
    """Rollouts by the tier at which their answer is found right: exact (text or number), alias, none.

    One task holds a tenth of the rollouts; answers are counted by (task, answer) before they meet the tasks.
    """
    said = _rollouts(spark, d).groupBy("task_id", F.col("answer").alias("said")).agg(F.count("*").alias("n"))
    joined = said.join(_tasks(spark, d), "task_id")
    key, truth = T.answer_key(F.col("said")), T.answer_key(F.col("answer"))
    a, b = T.number(F.col("said")), T.number(F.col("answer"))
    same = F.coalesce(F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b)), F.lit(False))
    exact = (F.coalesce((truth != "") & (key == truth), F.lit(False))) | same
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.coalesce((T.answer_key(x) != "") & (T.answer_key(x) == key), F.lit(False)))
    tier = F.when(F.trim(F.coalesce("said", F.lit(""))) == "", "blank").when(exact, "exact").when(alias, "alias").otherwise("none")
    return joined.groupBy(tier.alias("tier")).agg(F.sum("n").alias("n"))


def grade_accuracy(spark, d):
    """Accuracy by model and phase."""
    return _rollouts(spark, d).groupBy("model", "phase").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def grade_tiers(spark, d):
    """A10: counts by judge tier and the share of the judge's by phase."""
    return _rollouts(spark, d).groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("judge_tier") == "judge").alias("judged"), F.round(F.avg((F.col("judge_tier") == "judge").cast("double")), 6).alias("rate"))


def _halves(spark, d):
    """By task the share of right answers of the two models with most rollouts, where both have some."""
    rows = _rollouts(spark, d).where("task_id is not null")
    names = [r.model for r in rows.groupBy("model").count().orderBy(F.col("count").desc(), "model").limit(2).collect()]
    mean = rows.where(F.col("model").isin(names)).groupBy("task_id").agg(*[F.avg(F.when(F.col("model") == m, F.col("correct").cast("double"))).alias(n) for m, n in zip(names, ("king", "challenger"))])
    return mean.where("king is not null and challenger is not null")


def paired_halves(spark, d):
    """Tasks in common, both accuracies, the mean difference and its standard error."""
    diff = F.col("challenger") - F.col("king")
    return _halves(spark, d).agg(
        F.count("*").alias("n"), F.round(F.avg("king"), 6).alias("king_acc"), F.round(F.avg("challenger"), 6).alias("challenger_acc"),
        F.round(F.avg(diff), 6).alias("mean_diff"), F.round(F.stddev_samp(diff) / F.sqrt(F.count("*")), 6).alias("se"),
    )


def paired_detail(spark, d):
    """Won, tied and lost tasks."""
    side = F.when(F.col("challenger") > F.col("king"), "won").when(F.col("challenger") < F.col("king"), "lost").otherwise("tied")
    return _halves(spark, d).groupBy(side.alias("side")).agg(F.count("*").alias("tasks"))


def paired_by_template(spark, d):
    """The mean size of differences by the task's template."""
    joined = _halves(spark, d).join(_tasks(spark, d).select("task_id", "template"), "task_id")
    return joined.groupBy("template").agg(F.count("*").alias("tasks"), F.round(F.avg(F.abs(F.col("challenger") - F.col("king"))), 6).alias("discrimination"))


def solve_rates(spark, d):
    """By template the solve rate, and mean, median and maximum of time and turns."""
    joined = _rollouts(spark, d).join(_tasks(spark, d).select("task_id", "template"), "task_id")
    return joined.groupBy("template").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("solve_rate"), F.round(F.avg("wall_time_s"), 6).alias("mean_s"),
        F.round(F.percentile("wall_time_s", F.lit(0.5)), 6).alias("median_s"), F.max("wall_time_s").alias("max_s"), F.round(F.avg("turns"), 6).alias("mean_turns"),
    )


def difficulty_band(spark, d):
    """F8: tasks whose solve rate lies between 0.45 and 0.85."""
    rate = _rollouts(spark, d).groupBy("task_id").agg(F.avg(F.col("correct").cast("double")).alias("rate"), F.count("*").alias("n"))
    return rate.where("rate between 0.45 and 0.85").select("task_id", F.round("rate", 6).alias("rate"), "n")


def error_histogram(spark, d):
    """Errors by name in one spelling."""
    name = F.coalesce(F.nullif(F.lower(F.trim("error")), F.lit("")), F.lit("none"))
    return _rollouts(spark, d).groupBy(name.alias("error")).agg(F.count("*").alias("n"))


def format_compliance(spark, d):
    """share of well-formed actions and different answers by model."""
    r = _rollouts(spark, d).groupBy("model").agg(F.sum("turns").alias("turns"), F.sum("malformed_actions").alias("malformed"), F.count_distinct("answer").alias("answers"))
    return r.select("model", F.round((F.col("turns") - F.col("malformed")) / F.col("turns"), 6).alias("compliance"), "answers")


def accuracy_ema(spark, d):
    """The moving average (k = 10) of a model's accuracy over its rounds."""
    rounds = _rollouts(spark, d).groupBy("model", "round").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    return ordered.moving_average(rounds, "model", "round", "acc", 10).select("model", F.round("average", 6).alias("ema"), "n")


def noise_floor(spark, d):
    """By model the largest spread of accuracy over the last 20 rounds, at least 1e-6; 0.03 where there is none."""
    per = _rollouts(spark, d).groupBy("model", "round").agg(F.stddev_samp(F.col("correct").cast("double")).alias("s"))
    last = per.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.col("round").desc()))).where("r <= 20")
    return last.groupBy("model").agg(F.round(F.greatest(F.coalesce(F.max("s"), F.lit(0.03)), F.lit(1e-6)), 6).alias("floor"))


def anchor_divergence(spark, d):
    """By model the change of accuracy from its first to its last round."""
    per = _rollouts(spark, d).groupBy("model", "round").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    return per.groupBy("model").agg(F.round(F.max_by("acc", "round") - F.min_by("acc", "round"), 6).alias("change"))


def attempts_used(spark, d):
    """Different rounds from the fourth on by model."""
    return _rollouts(spark, d).where("round >= 4").groupBy("model").agg(F.count_distinct("round").alias("rounds"))


def time_percentiles(spark, d):
    """Both percentile methods over the times of each model's errors."""
    found = ordered.quantiles(_rollouts(spark, d).where("error is not null"), "model", "wall_time_s", 0.95, 20)
    return found.select("model", F.round("nearest", 6).alias("nearest"), F.round("exclusive", 6).alias("exclusive"))


def repeat_agreement(spark, d):
    """Tasks that one model answered more than once in a phase: how many, and how many agree throughout."""
    r = _rollouts(spark, d).groupBy("model", "phase", "task_id").agg(F.count("*").alias("n"), F.count_distinct("correct").alias("ways")).where("n > 1")
    return r.groupBy("model", "phase").agg(F.count("*").alias("repeated"), F.count_if(F.col("ways") == 1).alias("agreeing"))


def evidence_missing(spark, d):
    """Evidence ids of tasks that no record has."""
    wanted = table(spark, d, "tasks").select("task_id", F.explode("evidence_doc_ids").alias("doc_id")).distinct()
    return wanted.join(table(spark, d, "docs").select("doc_id").distinct(), "doc_id", "left_anti")


def evidence_support(spark, d):
    """tasks by whether one of their evidence records contains the answer."""
    tasks = table(spark, d, "tasks").where("answer is not null and answer <> ''").groupBy("task_id").agg(F.min(F.struct("answer", "evidence_doc_ids")).alias("t")).select("task_id", "t.*")
    texts = table(spark, d, "docs").where("text is not null").groupBy("doc_id").agg(F.min_by("text", "ord").alias("text"))
    pairs = tasks.select("task_id", "answer", F.explode("evidence_doc_ids").alias("doc_id")).join(texts, "doc_id")
    found = pairs.groupBy("task_id").agg(F.max(F.contains(F.lower("text"), F.lower("answer"))).alias("found"))
    return tasks.join(found, "task_id", "left").groupBy(F.coalesce(F.col("found").cast("string"), F.lit("no_evidence")).alias("supported")).agg(F.count("*").alias("tasks"))


def round_robin(spark, d):
    """T5: tasks in turn of their templates: the place of each."""
    t = _tasks(spark, d).withColumn("turn", F.row_number().over(Window.partitionBy("template").orderBy("hops", "task_id")))
    return t.select("task_id", "template", F.col("turn").cast("long").alias("turn"))


def set_digest(spark, d):
    """By template the hash of the sorted task ids."""
    return ordered.rolled(_tasks(spark, d).withColumn("text", F.col("task_id")), "template", "task_id", "text", "lines").withColumnRenamed("n", "tasks")


QUERIES = {f.__name__: f for f in (grade_cascade, grade_accuracy, grade_tiers, paired_halves, paired_detail, paired_by_template, solve_rates, difficulty_band, error_histogram, format_compliance, accuracy_ema, noise_floor, anchor_divergence, attempts_used, time_percentiles, repeat_agreement, evidence_missing, evidence_support, round_robin, set_digest)}

_R = "r AS (SELECT DISTINCT * FROM rollouts)"
_T = "t AS (SELECT task_id, first(answer) AS answer, first(aliases) AS aliases, first(template) AS template, first(hops) AS hops FROM (SELECT * FROM tasks ORDER BY task_id, answer, aliases) GROUP BY 1)"
_KEY = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ ]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_NUM = "CASE WHEN regexp_full_match(replace(regexp_replace(trim({0}), '[.]+$', ''), ',', ''), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN try_cast(replace(regexp_replace(trim({0}), '[.]+$', ''), ',', '') AS DOUBLE) END"
_H = f"""{_R}, top AS (SELECT model, row_number() OVER (ORDER BY count(*) DESC, model) AS k FROM r WHERE task_id IS NOT NULL GROUP BY model),
  h AS (SELECT task_id, avg(correct::INT) FILTER (k = 1) AS king, avg(correct::INT) FILTER (k = 2) AS challenger FROM r JOIN top USING (model) WHERE task_id IS NOT NULL AND k <= 2 GROUP BY 1 HAVING count(correct) FILTER (k = 1) > 0 AND count(correct) FILTER (k = 2) > 0)"""
_PER = "per AS (SELECT model, round, avg(correct::INT) AS acc, stddev_samp(correct::INT) AS s FROM r GROUP BY 1, 2)"

SQL = {
    "grade_cascade": f"""WITH {_R}, {_T}, j AS (SELECT r.answer AS said, t.answer, t.aliases, {_KEY.format("r.answer")} AS k, {_KEY.format("t.answer")} AS truth, {_NUM.format("r.answer")} AS a, {_NUM.format("t.answer")} AS b FROM r JOIN t USING (task_id))
        SELECT CASE WHEN trim(coalesce(said, '')) = '' THEN 'blank' WHEN (truth <> '' AND k = truth) OR coalesce(abs(a - b) <= 1e-6 * greatest(abs(a), abs(b)), false) THEN 'exact'
          WHEN list_contains(list_filter(list_transform(coalesce(aliases, []), lambda x: {_KEY.format("x")}), lambda y: y <> ''), k) THEN 'alias' ELSE 'none' END AS tier, count(*) AS n FROM j GROUP BY 1""",
    "grade_accuracy": f"WITH {_R} SELECT model, phase, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM r GROUP BY 1, 2",
    "grade_tiers": f"WITH {_R} SELECT phase, count(*) AS n, count(*) FILTER (judge_tier = 'judge') AS judged, round(avg((judge_tier = 'judge')::INT), 6) AS rate FROM r GROUP BY 1",
    "paired_halves": f"WITH {_H} SELECT count(*) AS n, round(avg(king), 6) AS king_acc, round(avg(challenger), 6) AS challenger_acc, round(avg(challenger - king), 6) AS mean_diff, round(stddev_samp(challenger - king) / sqrt(count(*)), 6) AS se FROM h",
    "paired_detail": f"WITH {_H} SELECT CASE WHEN challenger > king THEN 'won' WHEN challenger < king THEN 'lost' ELSE 'tied' END AS side, count(*) AS tasks FROM h GROUP BY 1",
    "paired_by_template": f"WITH {_H}, {_T} SELECT template, count(*) AS tasks, round(avg(abs(challenger - king)), 6) AS discrimination FROM h JOIN t USING (task_id) GROUP BY 1",
    "solve_rates": f"WITH {_R}, {_T} SELECT template, count(*) AS n, round(avg(correct::INT), 6) AS solve_rate, round(avg(wall_time_s), 6) AS mean_s, round(quantile_cont(wall_time_s, 0.5), 6) AS median_s, max(wall_time_s) AS max_s, round(avg(turns), 6) AS mean_turns FROM r JOIN t USING (task_id) GROUP BY 1",
    "difficulty_band": f"WITH {_R} SELECT task_id, round(avg(correct::INT), 6) AS rate, count(*) AS n FROM r GROUP BY 1 HAVING avg(correct::INT) BETWEEN 0.45 AND 0.85",
    "error_histogram": f"WITH {_R} SELECT coalesce(nullif(lower(trim(error)), ''), 'none') AS error, count(*) AS n FROM r GROUP BY 1",
    "format_compliance": f"WITH {_R} SELECT model, round((sum(turns) - sum(malformed_actions)) / sum(turns), 6) AS compliance, count(DISTINCT answer) AS answers FROM r GROUP BY 1",
    "accuracy_ema": f"""WITH RECURSIVE {_R}, {_PER}, o AS (SELECT model, acc, row_number() OVER (PARTITION BY model ORDER BY round) AS i FROM per WHERE acc IS NOT NULL),
        e AS (SELECT model, i, acc::DOUBLE AS ema FROM o WHERE i = 1 UNION ALL SELECT o.model, o.i, o.acc * 2.0 / 11 + e.ema * 9.0 / 11 FROM e JOIN o ON o.model = e.model AND o.i = e.i + 1)
        SELECT model, round(arg_max(ema, i), 6) AS ema, max(i) AS n FROM e GROUP BY 1""",
    "noise_floor": f"WITH {_R}, {_PER} SELECT model, round(greatest(coalesce(max(s), 0.03), 1e-6), 6) AS floor FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round DESC) AS k FROM per) WHERE k <= 20 GROUP BY 1",
    "anchor_divergence": f"WITH {_R}, {_PER} SELECT model, round(arg_max(acc, round) - arg_min(acc, round), 6) AS change FROM per GROUP BY 1",
    "attempts_used": f"WITH {_R} SELECT model, count(DISTINCT round) AS rounds FROM r WHERE round >= 4 GROUP BY 1",
    "time_percentiles": f"""WITH {_R}, v AS (SELECT model, list_sort(list(wall_time_s)) AS v, count(*) AS n FROM r WHERE wall_time_s IS NOT NULL AND error IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)
        SELECT model, round(v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1], 6) AS nearest, round(v[k] + (v[k + 1] - v[k]) * (0.95 * (n + 1) - k), 6) AS exclusive FROM (SELECT *, CAST(greatest(least(floor(0.95 * (n + 1)), n - 1), 1) AS INT) AS k FROM v)""",
    "repeat_agreement": f"WITH {_R}, g AS (SELECT model, phase, task_id, count(DISTINCT correct) AS ways FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT model, phase, count(*) AS repeated, count(*) FILTER (ways = 1) AS agreeing FROM g GROUP BY 1, 2",
    "evidence_missing": "SELECT DISTINCT task_id, doc_id FROM (SELECT task_id, unnest(evidence_doc_ids) AS doc_id FROM tasks) WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM docs WHERE doc_id IS NOT NULL)",
    "evidence_support": """WITH t AS (SELECT task_id, first(answer) AS answer, first(evidence_doc_ids) AS e FROM (SELECT * FROM tasks WHERE answer IS NOT NULL AND answer <> '' ORDER BY task_id, answer, evidence_doc_ids) GROUP BY 1),
        x AS (SELECT doc_id, arg_min(text, ord) AS text FROM docs WHERE text IS NOT NULL GROUP BY 1),
        f AS (SELECT task_id, bool_or(contains(lower(text), lower(answer))) AS found FROM (SELECT task_id, answer, unnest(e) AS doc_id FROM t) JOIN x USING (doc_id) GROUP BY 1)
        SELECT coalesce(found::VARCHAR, 'no_evidence') AS supported, count(*) AS tasks FROM t LEFT JOIN f USING (task_id) GROUP BY 1""",
    "round_robin": f"WITH {_T} SELECT task_id, template, row_number() OVER (PARTITION BY template ORDER BY hops, task_id) AS turn FROM t",
    "set_digest": f"WITH {_T} SELECT template, sha256(string_agg(task_id, chr(10) ORDER BY task_id)) AS digest, count(*) AS tasks FROM t GROUP BY 1",
}
