"""Queries over the order of events and the agreement of records: succession, seats, places, sets, digests, diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import stats
from lexmill.operators import curation, ledger, ordered, search
from lexmill.plans import grading
from lexmill.plans import ledger as ledger_plans
from lexmill.plans import search as search_plans
from lexmill.session import table
from lexmill.streaming import tables as streams

#: Characters of an answer, at most; signs that may not stand in one.
MOST_ANSWER, MARKUP = 200, "[<>{}\\[\\]`|\\n]"
SEATS, STRIDE, DRAWN, LATE_DAYS = 3, 50, 20, 10


def _events(spark, d, kind):
    return ledger.events(table(spark, d, "payloads"), kind)


def ledger_final_verdicts(spark, d):
    """The verdict that stands on each digest: the last in order of block, then arrival, of permitted validators."""
    last = ledger.latest_verdicts(table(spark, d, "payloads"), table(spark, d, "neurons"))
    return last.groupBy("digest").agg(F.max_by(F.struct("hotkey", "block", "decision"), F.struct("block", "seq")).alias("r")).select("digest", "r.*")


def ledger_heard(spark, d):
    """Verdicts of permitted validators and ignored ones, by decision."""
    permitted = table(spark, d, "neurons").where("validator_permit").select("hotkey", F.lit(True).alias("heard"))
    return _events(spark, d, "v1").join(permitted, "hotkey", "left").groupBy(F.coalesce("heard", F.lit(False)).alias("heard"), "decision").agg(F.count("*").alias("verdicts"))


def ledger_succession(spark, d):
    """The block and validator of the first accepting verdict on each digest."""
    accepts = _events(spark, d, "v1").where("decision = 'ACCEPT'")
    return accepts.groupBy("digest").agg(F.min(F.struct("block", "seq", "hotkey")).alias("f")).select("digest", "f.block", "f.hotkey")


def ledger_submissions(spark, d):
    """The reveal of each hotkey that stands (the last by block, then digest) and how many it supersedes."""
    return _events(spark, d, "e1").groupBy("hotkey").agg(F.max(F.struct("block", "digest")).alias("s"), (F.count("*") - 1).alias("superseded")).select("hotkey", "s.block", "s.digest", "superseded")


def ledger_replaced(spark, d):
    """Each reveal of a hotkey that replaces another digest, with the one before and the blocks that it held."""
    by = Window.partitionBy("hotkey").orderBy("block", "seq")
    e = _events(spark, d, "e1").select("hotkey", "seq", "block", "digest", F.lag("digest").over(by).alias("replaced"), (F.col("block") - F.lag("block").over(by)).alias("held"))
    return e.where("replaced <> digest").select("hotkey", "seq", "replaced", "held")


def ledger_pointer(spark, d):
    """The newest round pointer of each authority: the highest block, of these the highest value."""
    return _events(spark, d, "r1").groupBy("hotkey").agg(F.max_by(F.struct("block", "round", "value"), F.struct("block", "value", -F.col("seq"))).alias("p")).select("hotkey", "p.*")


def ledger_places(spark, d):
    """The place in the queue of every unjudged reveal, in order of block, digest and arrival, and how long it has waited."""
    newest = table(spark, d, "payloads").agg(F.max("block")).first()[0] or 0
    waiting = _events(spark, d, "e1").join(_events(spark, d, "v1").select("digest").distinct(), "digest", "left_anti")
    ranked = ordered.ranked(waiting.select("seq", "block", "digest"), "block", ["digest", "seq"], 1_000)
    return ranked.select("seq", (F.col("rank") + 1).alias("place"), F.greatest(F.lit(newest) - F.col("block"), F.lit(0)).alias("waited"))


def ledger_roster(spark, d):
    """One seat a hotkey by its latest reveal, the newest SEATS of them."""
    return ledger_submissions(spark, d).select("hotkey", "block").orderBy(F.col("block").desc(), "hotkey").limit(SEATS)


def ledger_stride(spark, d):
    """STRIDE reveals at even steps through all in order of block and arrival: items at floor(i N / n)."""
    ranked = ordered.ranked(_events(spark, d, "e1").select("seq", "block"), "block", ["seq"], 1_000)
    n = ranked.count()
    step = F.ceil(F.col("rank") * STRIDE / F.lit(max(n, 1))).cast("long")
    return ranked.where((step < STRIDE) & (F.floor(step * F.lit(n) / STRIDE) == F.col("rank"))).select("seq", "rank") if n > STRIDE else ranked.select("seq", "rank")


def task_seeded_draw(spark, d):
    """G1: DRAWN tasks by the numbers that a seeded generator draws without replacement, counted in order of id; no SQL draws these."""
    tasks = table(spark, d, "tasks").select("task_id").distinct().withColumn("start", F.conv(F.substring(F.md5("task_id"), 1, 4), 16, 10).cast("long"))
    ranked = ordered.ranked(tasks, "start", ["task_id"], 256)
    total = ranked.count()
    if total < DRAWN:
        raise ValueError("fewer tasks than are to be drawn")
    drawn = np.random.default_rng(stats.seed_of("public", "1")).choice(total, DRAWN, replace=False)
    numbers = spark.createDataFrame([(int(x), i) for i, x in enumerate(drawn)], "rank long, turn long")
    return ranked.join(F.broadcast(numbers), "rank").select("task_id", "turn")


def sets_equal(spark, d):
    """Tasks without a rollout, rollouts' tasks that are unknown, and whether the two sets of ids are equal."""
    tasks, tried = table(spark, d, "tasks").select("task_id").distinct(), table(spark, d, "rollouts").where("task_id is not null").select("task_id").distinct()
    both = tasks.withColumn("a", F.lit(1)).join(tried.withColumn("b", F.lit(1)), "task_id", "full")
    counts = both.agg(F.count_if(F.col("b").isNull()).alias("untried"), F.count_if(F.col("a").isNull()).alias("unknown"))
    return counts.select("untried", "unknown", ((F.col("untried") == 0) & (F.col("unknown") == 0)).alias("equal"))


def evidence_sets(spark, d):
    """U4: evidence records of each task that are masked, and that are not."""
    t = table(spark, d, "tasks").select("task_id", F.coalesce("evidence_doc_ids", F.array().cast("array<string>")).alias("e"), F.coalesce("masked_doc_ids", F.array().cast("array<string>")).alias("m")).distinct()
    return t.select("task_id", F.size(F.array_intersect("e", "m")).cast("long").alias("masked"), F.size(F.array_except("e", "m")).cast("long").alias("open"))


def qa_failures(spark, d):
    """what is wrong with each task, as a list of tokens: first its form; of well-formed ones whether the evidence is there, holds the answer
    or an alias, and is left by the mask. A task that passes has an empty list."""
    names = [c for c in ("question", "answer", "aliases", "evidence_doc_ids", "masked_doc_ids")]
    none = F.array().cast("array<string>")
    t = table(spark, d, "tasks").groupBy("task_id").agg(F.min(F.struct(*names)).alias("t")).select("task_id", "t.*")
    t = t.select("task_id", F.trim(F.coalesce("answer", F.lit(""))).alias("a"), F.coalesce("question", F.lit("")).alias("q"), F.coalesce("aliases", none).alias("aliases"), F.array_distinct(F.coalesce("evidence_doc_ids", none)).alias("e"), F.coalesce("masked_doc_ids", none).alias("m"))
    form = F.array_compact(F.array(
        F.when(F.col("a") == "", "answer_empty").when(F.length("a") > MOST_ANSWER, "answer_too_long"), F.when(F.col("a").rlike(MARKUP), "answer_markup"),
        F.when(F.trim("q") == "", "question_empty"), F.when(F.size("e") == 0, "evidence_empty"),
    ))
    t = t.withColumn("form", form)
    fold = lambda c: F.lower(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))
    texts = table(spark, d, "docs").where("text is not null").groupBy("doc_id").agg(F.min_by("text", "ord").alias("text"))
    accepted = F.filter(F.transform(F.concat(F.array("a"), "aliases"), fold), lambda x: F.coalesce(x, F.lit("")) != "")
    named = t.where(F.size("form") == 0).select("task_id", accepted.alias("accepted"), F.explode("e").alias("doc_id")).join(texts, "doc_id", "left")
    text = fold(F.col("text"))
    read = named.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.concat(F.lit("evidence_missing:"), "doc_id")))).alias("missing"),
        F.max(F.coalesce(F.exists("accepted", lambda x: F.contains(text, x)), F.lit(False))).alias("hit"),
    )
    found = F.array_compact(F.array(F.when(~F.col("hit") & (F.size("missing") == 0), "answer_not_in_evidence"), F.when(F.size(F.array_except("e", "m")) == 0, "mask_unsolvable")))
    failures = F.when(F.size("form") > 0, F.col("form")).otherwise(F.concat("missing", found))
    return t.join(read, "task_id", "left").select("task_id", F.array_join(failures, ",").alias("failures"))


def alias_lists(spark, d):
    """The different aliases of each task in the order in which they stand there."""
    t = table(spark, d, "tasks").where("size(aliases) > 0").select("task_id", F.array_distinct("aliases").alias("a")).distinct()
    return t.select("task_id", F.array_join("a", "|", "-").alias("aliases"))


def determinism(spark, d):
    """H9: by model and phase the tasks answered more than once: how often first and last answer agree and results flip, and the ratio of times."""
    r = grading._rollouts(spark, d).where("task_id is not null").groupBy("model", "phase", "task_id")
    first, last = (f(F.struct("answer", "correct", "wall_time_s"), "rollout_id") for f in (F.min_by, F.max_by))
    pairs = r.agg(F.count("*").alias("n"), first.alias("a"), last.alias("b")).where("n > 1")
    same, flip = F.col("a.answer").eqNullSafe(F.col("b.answer")), ~F.col("a.correct").eqNullSafe(F.col("b.correct"))
    return pairs.groupBy("model", "phase").agg(
        F.count("*").alias("tasks"), F.round(F.avg(same.cast("double")), 6).alias("agreement"), F.round(F.avg(flip.cast("double")), 6).alias("flips"),
        F.round(F.sum("b.wall_time_s") / F.sum("a.wall_time_s"), 6).alias("time_ratio"),
    )


def divergence(spark, d):
    """Where the first and last answer that a task got begin to differ, in words; null where they do not."""
    r = grading._rollouts(spark, d).where("task_id is not null and answer is not null").groupBy("task_id")
    pairs = r.agg(F.min_by("answer", "rollout_id").alias("a"), F.max_by("answer", "rollout_id").alias("b"))
    a, b = F.split("a", " "), F.split("b", " ")
    places = F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b)))
    differ = F.filter(places, lambda i: ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    return pairs.select("task_id", F.try_element_at(differ, F.lit(1)).cast("long").alias("first_difference"), F.size(differ).cast("long").alias("differences"))


def task_completeness(spark, d):
    """H1: tasks by the required fields that they lack."""
    names = ("question", "answer", "evidence_doc_ids", "template", "minted_at")
    lacking = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in names]))
    return table(spark, d, "tasks").distinct().groupBy(F.array_join(lacking, ",").alias("lacking")).agg(F.count("*").alias("tasks"))


def record_digests(spark, d):
    """H5: the digest of each different task record and its first 16 digits, fields divided by a separator that no text holds."""
    record = F.concat_ws("\u001f", *[F.coalesce(F.col(c), F.lit("")) for c in ("task_id", "question", "answer", "origin", "template")])
    return table(spark, d, "tasks").select("task_id", F.sha2(record, 256).alias("digest")).distinct().select("task_id", "digest", F.substring("digest", 1, 16).alias("short"))


def corpus_digest(spark, d):
    """One digest of the corpus whatever the order of its rows: a tree of digests of 256 shards by the hash of the id."""
    corpus = curation.corpus(table(spark, d, "docs")).select("doc_id", F.sha2("text", 256).alias("line"), F.substring(F.md5("doc_id"), 1, 2).alias("shard"))
    shards = ordered.rolled(corpus, "shard", "doc_id", "line", "lines").select(F.lit("corpus").alias("name"), "shard", "digest")
    return ordered.rolled(shards, "name", "shard", "digest", "lines").select("name", "digest", F.col("n").alias("shards"))


def retrieval_diagnostics(spark, d):
    """By template, of at least eight tasks, how many have evidence among the ten best hits of their question."""
    ranks = search_plans.search_evidence_rank(spark, d).groupBy(F.col("qid").alias("task_id")).agg(F.min("rank").alias("best"))
    joined = grading._tasks(spark, d).select("task_id", "template").join(ranks, "task_id")
    return joined.groupBy("template").agg(F.count("*").alias("tasks"), F.count("best").alias("found"), F.min("best").alias("best")).where("tasks >= 8")


def masked_lookup(spark, d):
    """The records that tasks name as evidence, with their titles; masked ones are not to be had."""
    t = table(spark, d, "tasks")
    wanted = t.select("task_id", F.explode("evidence_doc_ids").alias("doc_id")).distinct()
    hidden = t.select("task_id", F.explode("masked_doc_ids").alias("doc_id")).distinct()
    return wanted.join(hidden, ["task_id", "doc_id"], "left_anti").join(curation.corpus(table(spark, d, "docs")).select("doc_id", "title"), "doc_id")


def stream_events_sliding(spark, d):
    """ST4: windows of an hour every half hour, as a stream."""
    rows = streams.final_rows(streams.sliding(streams.stream_of(spark, f"{d}/events.parquet")), ["hour", "event_type"])
    return rows.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("value", 6).alias("value"))


def records_late(spark, d):
    """ST2: the side table of late records: those fetched more than LATE_DAYS before what had arrived by then."""
    late = ordered.newest_before(table(spark, d, "docs").select("ord", "fetched_at"), "ord", "fetched_at", 1_000)
    return late.where(F.col("fetched_at") < F.col("newest") - F.expr(f"interval {LATE_DAYS} days")).select("ord", "newest")


QUERIES = {
    f.__name__: f
    for f in (
        ledger_final_verdicts, ledger_heard, ledger_succession, ledger_submissions, ledger_replaced, ledger_pointer, ledger_places, ledger_roster, ledger_stride, task_seeded_draw, sets_equal, evidence_sets,
        qa_failures, alias_lists, determinism, divergence, task_completeness, record_digests, corpus_digest, retrieval_diagnostics, masked_lookup, stream_events_sliding, records_late,
    )
}

_B, _R, _T = ledger_plans._B, grading._R, grading._T
_CORPUS = "corpus AS (SELECT doc_id, coalesce(title, '') AS title, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM docs WHERE text IS NOT NULL AND text <> '') WHERE r = 1)"
SQL = {
    "ledger_final_verdicts": _B + "SELECT digest, hotkey, block, decision FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY block DESC, seq DESC) AS n FROM last) WHERE n = 1",
    "ledger_heard": _B + "SELECT coalesce(p.heard, false) AS heard, decision, count(*) AS verdicts FROM v LEFT JOIN (SELECT hotkey, true AS heard FROM neurons WHERE validator_permit) p USING (hotkey) GROUP BY 1, 2",
    "ledger_succession": _B + "SELECT digest, block, hotkey FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY block, seq) AS n FROM v WHERE decision = 'ACCEPT') WHERE n = 1",
    "ledger_submissions": _B + "SELECT hotkey, block, digest, n - 1 AS superseded FROM (SELECT *, row_number() OVER (PARTITION BY hotkey ORDER BY block DESC, digest DESC) AS k, count(*) OVER (PARTITION BY hotkey) AS n FROM e) WHERE k = 1",
    "ledger_replaced": _B + "SELECT hotkey, seq, replaced, held FROM (SELECT hotkey, seq, digest, lag(digest) OVER w AS replaced, block - lag(block) OVER w AS held FROM e WINDOW w AS (PARTITION BY hotkey ORDER BY block, seq)) WHERE replaced <> digest",
    "ledger_pointer": _B + "SELECT hotkey, block, round, value FROM (SELECT *, row_number() OVER (PARTITION BY hotkey ORDER BY block DESC, value DESC, seq) AS k FROM parsed WHERE kind = 'r1' AND reason IS NULL) WHERE k = 1",
    "ledger_places": _B + "SELECT seq, row_number() OVER (ORDER BY block, digest, seq) AS place, greatest((SELECT max(block) FROM payloads) - block, 0) AS waited FROM e WHERE digest NOT IN (SELECT digest FROM v)",
    "ledger_roster": _B + f"SELECT hotkey, max(block) AS block FROM e GROUP BY hotkey ORDER BY 2 DESC, 1 LIMIT {SEATS}",
    "ledger_stride": _B + f", r AS (SELECT seq, row_number() OVER (ORDER BY block, seq) - 1 AS rank, count(*) OVER () AS n FROM e) SELECT seq, rank FROM r WHERE n <= {STRIDE} OR rank IN (SELECT (i * n) // {STRIDE} FROM range({STRIDE}) t(i))",
    "sets_equal": "WITH t AS (SELECT DISTINCT task_id FROM tasks), r AS (SELECT DISTINCT task_id FROM rollouts WHERE task_id IS NOT NULL), c AS (SELECT (SELECT count(*) FROM t WHERE task_id NOT IN (SELECT task_id FROM r)) AS untried, (SELECT count(*) FROM r WHERE task_id NOT IN (SELECT task_id FROM t)) AS unknown) SELECT untried, unknown, untried = 0 AND unknown = 0 AS equal FROM c",
    "evidence_sets": "SELECT task_id, len(list_distinct(list_intersect(e, m))) AS masked, len(list_distinct(list_filter(e, lambda x: NOT list_contains(m, x)))) AS open FROM (SELECT DISTINCT task_id, coalesce(evidence_doc_ids, []) AS e, coalesce(masked_doc_ids, []) AS m FROM tasks)",
    "qa_failures": f"""WITH t AS (SELECT task_id, trim(coalesce(answer, '')) AS a, coalesce(question, '') AS q, coalesce(aliases, []) AS aliases, list_distinct(coalesce(evidence_doc_ids, [])) AS e, coalesce(masked_doc_ids, []) AS m
          FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY question NULLS FIRST, answer NULLS FIRST, aliases NULLS FIRST) AS k FROM tasks) WHERE k = 1),
        f AS (SELECT *, list_filter([CASE WHEN a = '' THEN 'answer_empty' WHEN length(a) > {MOST_ANSWER} THEN 'answer_too_long' END, CASE WHEN regexp_matches(a, '{MARKUP}') THEN 'answer_markup' END,
          CASE WHEN trim(q) = '' THEN 'question_empty' END, CASE WHEN len(e) = 0 THEN 'evidence_empty' END], lambda x: x IS NOT NULL) AS form FROM t),
        x AS (SELECT doc_id, lower(regexp_replace(arg_min(text, ord), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM docs WHERE text IS NOT NULL GROUP BY 1),
        n AS (SELECT task_id, list_filter(list_transform(list_concat([a], aliases), lambda v: lower(regexp_replace(v, '[ \\t\\r\\n]+', ' ', 'g'))), lambda v: coalesce(v, '') <> '') AS accepted, unnest(e) AS doc_id FROM f WHERE len(form) = 0),
        r AS (SELECT task_id, list_sort(list(CASE WHEN text IS NULL THEN 'evidence_missing:' || n.doc_id END) FILTER (text IS NULL)) AS missing, bool_or(coalesce(len(list_filter(accepted, lambda v: contains(text, v))) > 0, false)) AS hit FROM n LEFT JOIN x USING (doc_id) GROUP BY 1)
        SELECT task_id, array_to_string(CASE WHEN len(form) > 0 THEN form ELSE list_concat(coalesce(missing, []), list_filter([CASE WHEN NOT hit AND coalesce(len(missing), 0) = 0 THEN 'answer_not_in_evidence' END,
          CASE WHEN len(list_filter(e, lambda v: NOT list_contains(m, v))) = 0 THEN 'mask_unsolvable' END], lambda v: v IS NOT NULL)) END, ',') AS failures FROM f LEFT JOIN r USING (task_id)""",
    "alias_lists": "SELECT DISTINCT task_id, array_to_string(list_transform(list_filter(aliases, lambda x, i: list_position(aliases, x) = i), lambda x: coalesce(x, '-')), '|') AS aliases FROM tasks WHERE len(aliases) > 0",
    "determinism": f"""WITH {_R}, p AS (SELECT model, phase, task_id, count(*) AS n, min(rollout_id) AS a, max(rollout_id) AS b FROM r WHERE task_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
        SELECT p.model, p.phase, count(*) AS tasks, round(avg((x.answer IS NOT DISTINCT FROM y.answer)::INT), 6) AS agreement, round(avg((x.correct IS DISTINCT FROM y.correct)::INT), 6) AS flips, round(sum(y.wall_time_s) / sum(x.wall_time_s), 6) AS time_ratio
        FROM p JOIN r x ON x.rollout_id = p.a JOIN r y ON y.rollout_id = p.b GROUP BY 1, 2""",
    "divergence": f"""WITH {_R}, p AS (SELECT task_id, string_split(arg_min(answer, rollout_id), ' ') AS a, string_split(arg_max(answer, rollout_id), ' ') AS b FROM r WHERE task_id IS NOT NULL AND answer IS NOT NULL GROUP BY 1),
        x AS (SELECT task_id, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]) AS diff FROM p) SELECT task_id, diff[1] AS first_difference, len(diff) AS differences FROM x""",
    "task_completeness": "SELECT concat_ws(',', CASE WHEN question IS NULL THEN 'question' END, CASE WHEN answer IS NULL THEN 'answer' END, CASE WHEN evidence_doc_ids IS NULL THEN 'evidence_doc_ids' END, CASE WHEN template IS NULL THEN 'template' END, CASE WHEN minted_at IS NULL THEN 'minted_at' END) AS lacking, count(*) AS tasks FROM (SELECT DISTINCT * FROM tasks) GROUP BY 1",
    "record_digests": "SELECT DISTINCT task_id, digest, left(digest, 16) AS short FROM (SELECT task_id, sha256(concat_ws(chr(31), coalesce(task_id, ''), coalesce(question, ''), coalesce(answer, ''), coalesce(origin, ''), coalesce(template, ''))) AS digest FROM tasks)",
    "corpus_digest": f"WITH {_CORPUS}, s AS (SELECT left(md5(doc_id), 2) AS shard, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM corpus GROUP BY 1) SELECT 'corpus' AS name, sha256(string_agg(digest, chr(10) ORDER BY shard)) AS digest, count(*) AS shards FROM s",
    "retrieval_diagnostics": search_plans._ASKED + search_plans._RANKED.format(mask="") + f", {_T}, e AS (SELECT DISTINCT task_id, unnest(evidence_doc_ids) AS doc_id FROM tasks), b AS (SELECT e.task_id, min(rank) FILTER (rank <= 10) AS best FROM e LEFT JOIN ranked ON qid = e.task_id AND ranked.doc_id = e.doc_id GROUP BY 1) SELECT template, count(*) AS tasks, count(best) AS found, min(best) AS best FROM b JOIN t USING (task_id) GROUP BY 1 HAVING count(*) >= 8",
    "masked_lookup": f"WITH {_CORPUS}, w AS (SELECT DISTINCT task_id, unnest(evidence_doc_ids) AS doc_id FROM tasks EXCEPT SELECT DISTINCT task_id, unnest(masked_doc_ids) FROM tasks) SELECT task_id, doc_id, title FROM w JOIN corpus USING (doc_id)",
    "stream_events_sliding": "SELECT hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS hour FROM events) GROUP BY 1, 2",
    "records_late": f"SELECT ord, newest FROM (SELECT *, max(fetched_at) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM docs) WHERE fetched_at < newest - INTERVAL {LATE_DAYS} DAY",
}
