"""Queries that run as streams to their end, compared with SQL over the whole tables; and those without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import parse, stats
from lexmill.functions import text as T
from lexmill.operators import curation, firstwins, ledger
from lexmill.plans import grading
from lexmill.plans import ledger as ledger_plans
from lexmill.plans import search as search_plans
from lexmill.plans import tables as table_plans
from lexmill.session import table
from lexmill.streaming import tables as streams


def stream_events_hourly(spark, d):
    """Tumbling windows as a stream."""
    rows = streams.final_rows(streams.hourly(streams.stream_of(spark, f"{d}/events.parquet")), ["hour", "event_type"])
    return rows.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("value", 6).alias("value"))


def stream_latest_reveal(spark, d):
    """W1 as a stream over the ledger."""
    reveals = ledger.parsed(streams.stream_of(spark, f"{d}/payloads.parquet")).where("kind = 'e1' and reason is null")
    return streams.final_rows(streams.latest(reveals, "hotkey", "block", "seq", ["block", "digest", "repo"]), ["hotkey"])


def stream_events_ema(spark, d):
    """W12 as a stream with state."""
    events = streams.stream_of(spark, f"{d}/events.parquet", 1000).withColumn("k", F.concat("event_type", F.lit("-"), F.col("user_id") % 50))
    return streams.final_rows(streams.moving_average(events, "k", "event_id", "value", 10), ["k"]).select("k", F.round("average", 6).alias("ema"), "n")


def paired_lower_bound(spark, d):
    """The bootstrap bound of the paired differences by the tasks' origin; drawn numbers have no SQL. Differences are counted by size
    before they meet, to a millionth, so that a group has no more different ones than that."""
    origin = table(spark, d, "tasks").groupBy("task_id").agg(F.lower(F.min("origin")).alias("origin"))
    sizes = grading._halves(spark, d).join(origin, "task_id").groupBy("origin", F.round(F.col("challenger") - F.col("king"), 6).alias("diff")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("diff", "n")))
    by = sizes.groupBy("origin").agg(F.sum("n").alias("n"), (F.sum(F.col("diff") * F.col("n")) / F.sum("n")).alias("mean"), pairs.alias("p"))
    return by.select("origin", "n", "mean", stats.bound_of_counts(stats.seed_of("boot"))(F.col("p.diff"), F.col("p.n")).alias("lower_bound"))


def curate_first_wins(spark, d):
    """Near duplicates that curation rejects; tested against brute force."""
    return firstwins.near_duplicates(table(spark, d, "docs"), "ord", "text").select(F.col("id").alias("ord"), F.col("kept").alias("kept_ord"))


def text_compatible_answers(spark, d):
    """tasks' answers in compatibility form and as keys; normal forms have no SQL."""
    return table(spark, d, "tasks").where("answer is not null").select("task_id", "answer").distinct().select("task_id", T.answer_key(parse.compatibility_udf("answer")).alias("answer_key"))


def text_expansions(spark, d):
    """X11: acronyms with what spells them in front, by record."""
    found = table(spark, d, "docs").where("text is not null").select("ord", F.explode(parse.expansions_udf("text")).alias("pair"))
    return found.select("ord", F.substring_index("pair", "=", 1).alias("acronym"), F.expr("substring(pair, locate('=', pair) + 1)").alias("phrase"))


def search_snippets(spark, d):
    """The best hit of each question with the part that fits it."""
    hits = search_plans.search_bm25_top10(spark, d).where("rank = 1").select("qid", "doc_id")
    texts = curation.corpus(table(spark, d, "docs")).select("doc_id", "text")
    return hits.join(texts, "doc_id").join(search_plans._questions(spark, d), "qid").select("qid", "doc_id", parse.snippet_udf("text", "query").alias("snippet"))


QUERIES = {f.__name__: f for f in (stream_events_hourly, stream_latest_reveal, stream_events_ema, paired_lower_bound, curate_first_wins, text_compatible_answers, text_expansions, search_snippets)}
SQL = {
    "stream_events_hourly": table_plans.SQL["events_hourly"],
    "stream_latest_reveal": ledger_plans.SQL["ledger_latest_reveal"],
    "stream_events_ema": table_plans.SQL["events_ema"],
}
