"""Queries of the event ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import ledger, ordered
from lexmill.session import table

SHARE, WINDOW = 0.05, 20_000


def _p(spark, d):
    return table(spark, d, "payloads")


def ledger_parse(spark, d):
    """Rows by kind and by the reason that makes them malformed."""
    return ledger.parsed(ledger.distinct_rows(_p(spark, d))).groupBy("kind", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def ledger_latest_reveal(spark, d):
    """The latest reveal of each hotkey; of one block the first."""
    return ordered.latest(ledger.events(_p(spark, d), "e1"), ["hotkey"], "block", "seq").select("hotkey", "block", "digest", "repo")


def ledger_latest_verdict(spark, d):
    return ledger.latest_verdicts(_p(spark, d), table(spark, d, "neurons")).select("digest", "hotkey", "block", "round", "decision")


def ledger_quorum(spark, d):
    """By digest the stakes that accept and reject, and the validators that said so."""
    v = ledger.latest_verdicts(_p(spark, d), table(spark, d, "neurons"))
    stake = lambda what: F.round(F.sum(F.when(F.col("decision") == what, F.col("stake")).otherwise(0.0)), 6)
    return v.groupBy("digest").agg(stake("ACCEPT").alias("accept"), stake("REJECT").alias("reject"), F.count("*").alias("validators"))


def ledger_crossing(spark, d):
    """The block at which the stake that accepts a digest first reaches a share of all permitted stake."""
    neurons = table(spark, d, "neurons")
    total = neurons.where("validator_permit").agg(F.sum("stake")).first()[0] or 0.0
    weight = F.when(F.col("decision") == "ACCEPT", F.col("stake")).otherwise(0.0)
    return ordered.crossing(ledger.latest_verdicts(_p(spark, d), neurons), "digest", ["block", "seq"], weight, F.lit(SHARE * total)).select("digest", "block", F.round("running", 6).alias("running"))


def ledger_active(spark, d):
    """Permitted validators whose last verdict lies within a window of the newest block."""
    p = _p(spark, d)
    newest = p.agg(F.max("block")).first()[0] or 0
    last = ledger.events(p, "v1").groupBy("hotkey").agg(F.max("block").alias("last"))
    return last.join(table(spark, d, "neurons").where("validator_permit").select("hotkey"), "hotkey", "left_semi").where(F.col("last") >= newest - WINDOW)


def ledger_islands(spark, d):
    """Runs of one decision of each validator, in order."""
    runs = ordered.islands(ledger.events(_p(spark, d), "v1"), "hotkey", ["block", "seq"], "decision")
    return runs.select("hotkey", F.col("island").cast("long").alias("island"), "decision", "first", "last", "rows")


def ledger_changes(spark, d):
    """How often each validator's decision differs from the one before."""
    by = Window.partitionBy("hotkey").orderBy("block", "seq")
    v = ledger.events(_p(spark, d), "v1").withColumn("before", F.lag("decision").over(by))
    return v.groupBy("hotkey").agg(F.count_if(F.col("before") != F.col("decision")).alias("changes"), F.count("*").alias("verdicts"))


def ledger_rounds(spark, d):
    """By round its verdicts, first block, best value with its digest, and near misses."""
    v = ledger.events(_p(spark, d), "v1")
    return v.groupBy("round").agg(
        F.count("*").alias("verdicts"), F.min("block").alias("first_block"), F.max("value").alias("best"),
        F.max_by("digest", F.struct("value", -F.col("seq"))).alias("best_digest"), F.count_if((F.col("value") > 0) & (F.col("decision") == "REJECT")).alias("near_misses"),
    )


def ledger_authors(spark, d):
    """By author of reveals the attempts, verdicts on them, accepting ones, and the last block."""
    reveals = ledger.events(_p(spark, d), "e1")
    per = ledger.events(_p(spark, d), "v1").groupBy("digest").agg(F.count("*").alias("verdicts"), F.count_if(F.col("decision") == "ACCEPT").alias("accepts"))
    joined = reveals.join(per, "digest", "left")
    return joined.groupBy("hotkey").agg(F.count("*").alias("attempts"), F.coalesce(F.sum("verdicts"), F.lit(0)).alias("verdicts"), F.coalesce(F.sum("accepts"), F.lit(0)).alias("accepts"), F.max("block").alias("last_block"))


def ledger_leaderboard(spark, d):
    """The hundred authors with most accepting verdicts."""
    return ledger_authors(spark, d).orderBy(F.col("accepts").desc(), F.col("attempts").desc(), "hotkey").limit(100).select("hotkey", "accepts", "attempts")


def ledger_unjudged(spark, d):
    """Reveals on which no verdict was given, by author."""
    reveals = ledger.events(_p(spark, d), "e1")
    return reveals.join(ledger.events(_p(spark, d), "v1").select("digest").distinct(), "digest", "left_anti").groupBy("hotkey").agg(F.count("*").alias("reveals"))


def ledger_queue(spark, d):
    """The first 32 unjudged reveals by block and digest."""
    reveals = ledger.events(_p(spark, d), "e1")
    waiting = reveals.join(ledger.events(_p(spark, d), "v1").select("digest").distinct(), "digest", "left_anti")
    return waiting.orderBy("block", "digest", "seq").limit(32).select("seq", "block", "digest")


def ledger_funnel(spark, d):
    """Counts in the fixed order of stages, 0 where there are none."""
    stages = spark.createDataFrame([(k, n) for k, n in enumerate(("e1", "v1", "r1", "other", "malformed"))], "place int, stage string")
    parsed = ledger.parsed(ledger.distinct_rows(_p(spark, d)))
    stage = F.when((F.col("kind") != "other") & F.col("reason").isNotNull(), "malformed").otherwise(F.col("kind"))
    counts = parsed.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
    return stages.join(counts, "stage", "left").select(F.col("place").cast("long").alias("place"), "stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ledger_late(spark, d):
    """Events of a hotkey whose block lies before one that arrived earlier."""
    rows = ledger.distinct_rows(_p(spark, d)).where("hotkey is not null")
    highest = F.max("block").over(Window.partitionBy("hotkey").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("highest", highest).where("block < highest").select("seq", "hotkey", "block", "highest")


def ledger_rolling_digest(spark, d):
    """H6: the hash chain over each hotkey's payloads in order of arrival."""
    return ordered.rolled(ledger.distinct_rows(_p(spark, d)).where("hotkey is not null"), "hotkey", "seq", "payload", "chain")


def ledger_stakes(spark, d):
    """Neurons, permits and stake, by whether a coldkey is known."""
    n = table(spark, d, "neurons")
    return n.groupBy(F.col("coldkey").isNotNull().alias("known")).agg(F.count("*").alias("neurons"), F.count_if("validator_permit").alias("permits"), F.round(F.sum("stake"), 6).alias("stake"))


def ledger_unmapped(spark, d):
    """Verdicts by hotkey, those without a neuron under uid -1."""
    v = ledger.events(_p(spark, d), "v1").groupBy("hotkey").agg(F.count("*").alias("n"))
    return v.join(table(spark, d, "neurons").select("hotkey", "uid"), "hotkey", "left").groupBy(F.coalesce("uid", F.lit(-1)).cast("long").alias("uid")).agg(F.sum("n").alias("verdicts"))


def ledger_duplicate_digests(spark, d):
    """Digests that more than one author revealed, with the first of them."""
    return ledger.events(_p(spark, d), "e1").groupBy("digest").agg(F.count_distinct("hotkey").alias("authors"), F.min_by("hotkey", F.struct("block", "seq")).alias("owner")).where("authors > 1")


QUERIES = {f.__name__: f for f in (ledger_parse, ledger_latest_reveal, ledger_latest_verdict, ledger_quorum, ledger_crossing, ledger_active, ledger_islands, ledger_changes, ledger_rounds, ledger_authors, ledger_leaderboard, ledger_unjudged, ledger_queue, ledger_funnel, ledger_late, ledger_rolling_digest, ledger_stakes, ledger_unmapped, ledger_duplicate_digests)}

_B = """WITH rows_ AS (SELECT DISTINCT * FROM payloads), cut AS (SELECT seq, hotkey, block, coalesce(payload, '') AS payload, string_split(coalesce(payload, ''), '|') AS p FROM rows_),
  parts AS (SELECT *, CASE WHEN p[1] IN ('e1', 'v1', 'r1') THEN p[1] ELSE 'other' END AS kind, CASE p[1] WHEN 'e1' THEN p[2] WHEN 'v1' THEN p[3] END AS digest, CASE WHEN p[1] = 'e1' THEN p[3] END AS repo,
    CASE WHEN p[1] IN ('v1', 'r1') THEN p[2] END AS num, CASE WHEN p[1] = 'v1' THEN p[4] END AS decision, CASE p[1] WHEN 'v1' THEN p[5] WHEN 'r1' THEN p[3] END AS val FROM cut),
  parsed AS (SELECT seq, hotkey, block, kind, digest, repo, try_cast(num AS BIGINT) AS round, decision, try_cast(val AS BIGINT) AS value, CASE WHEN payload = '' THEN 'empty' WHEN kind = 'other' THEN 'unknown_version'
    WHEN len(p) <> (CASE kind WHEN 'v1' THEN 5 ELSE 3 END) THEN 'fields' WHEN NOT regexp_full_match(digest, 'sha256:[0-9a-f]{64}') THEN 'digest'
    WHEN NOT regexp_full_match(num, '-?(0|[1-9][0-9]*)') OR NOT regexp_full_match(val, '-?(0|[1-9][0-9]*)') THEN 'integer' WHEN decision NOT IN ('ACCEPT', 'REJECT') THEN 'decision'
    WHEN try_cast(num AS BIGINT) < 1 THEN 'range' WHEN hotkey IS NULL THEN 'no_hotkey' END AS reason FROM parts),
  e AS (SELECT * FROM parsed WHERE kind = 'e1' AND reason IS NULL), v AS (SELECT * FROM parsed WHERE kind = 'v1' AND reason IS NULL),
  last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest, hotkey ORDER BY block DESC, seq) AS k FROM v) JOIN (SELECT hotkey, stake FROM neurons WHERE validator_permit) USING (hotkey) WHERE k = 1)
"""
SQL = {
    "ledger_parse": _B + "SELECT kind, coalesce(reason, 'ok') AS reason, count(*) AS n FROM parsed GROUP BY 1, 2",
    "ledger_latest_reveal": _B + "SELECT hotkey, block, digest, repo FROM (SELECT *, row_number() OVER (PARTITION BY hotkey ORDER BY block DESC, seq) AS k FROM e) WHERE k = 1",
    "ledger_latest_verdict": _B + "SELECT digest, hotkey, block, round, decision FROM last",
    "ledger_quorum": _B + "SELECT digest, round(sum(CASE WHEN decision = 'ACCEPT' THEN stake ELSE 0 END), 6) AS accept, round(sum(CASE WHEN decision = 'REJECT' THEN stake ELSE 0 END), 6) AS reject, count(*) AS validators FROM last GROUP BY 1",
    "ledger_crossing": _B + f"""SELECT digest, arg_min(block, (block, seq)) AS block, round(arg_min(running, (block, seq)), 6) AS running FROM (SELECT *, sum(CASE WHEN decision = 'ACCEPT' THEN stake ELSE 0 END) OVER (PARTITION BY digest ORDER BY block, seq ROWS UNBOUNDED PRECEDING) AS running FROM last)
        WHERE running >= {SHARE} * (SELECT sum(stake) FROM neurons WHERE validator_permit) GROUP BY 1""",
    "ledger_active": _B + f"SELECT hotkey, max(block) AS last FROM v WHERE hotkey IN (SELECT hotkey FROM neurons WHERE validator_permit) GROUP BY 1 HAVING max(block) >= (SELECT max(block) FROM payloads) - {WINDOW}",
    "ledger_islands": _B + """, c AS (SELECT *, CASE WHEN lag(decision) OVER w IS NOT DISTINCT FROM decision THEN 0 ELSE 1 END AS ch FROM v WINDOW w AS (PARTITION BY hotkey ORDER BY block, seq)),
        i AS (SELECT *, sum(ch) OVER (PARTITION BY hotkey ORDER BY block, seq ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT hotkey, CAST(island AS BIGINT) AS island, decision, min(block) AS first, max(block) AS last, count(*) AS rows FROM i GROUP BY 1, 2, 3""",
    "ledger_changes": _B + "SELECT hotkey, count(*) FILTER (b <> decision) AS changes, count(*) AS verdicts FROM (SELECT *, lag(decision) OVER (PARTITION BY hotkey ORDER BY block, seq) AS b FROM v) GROUP BY 1",
    "ledger_rounds": _B + "SELECT round, count(*) AS verdicts, min(block) AS first_block, max(value) AS best, arg_max(digest, (value, -seq)) AS best_digest, count(*) FILTER (value > 0 AND decision = 'REJECT') AS near_misses FROM v GROUP BY 1",
    "ledger_authors": _B + ", per AS (SELECT digest, count(*) AS verdicts, count(*) FILTER (decision = 'ACCEPT') AS accepts FROM v GROUP BY 1) SELECT hotkey, count(*) AS attempts, CAST(coalesce(sum(verdicts), 0) AS BIGINT) AS verdicts, CAST(coalesce(sum(accepts), 0) AS BIGINT) AS accepts, max(block) AS last_block FROM e LEFT JOIN per USING (digest) GROUP BY 1",
    "ledger_leaderboard": _B + ", per AS (SELECT digest, count(*) FILTER (decision = 'ACCEPT') AS accepts FROM v GROUP BY 1) SELECT hotkey, CAST(coalesce(sum(accepts), 0) AS BIGINT) AS accepts, count(*) AS attempts FROM e LEFT JOIN per USING (digest) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100",
    "ledger_unjudged": _B + "SELECT hotkey, count(*) AS reveals FROM e WHERE digest NOT IN (SELECT digest FROM v) GROUP BY 1",
    "ledger_queue": _B + "SELECT seq, block, digest FROM e WHERE digest NOT IN (SELECT digest FROM v) ORDER BY block, digest, seq LIMIT 32",
    "ledger_funnel": _B + ", s AS (SELECT unnest([0, 1, 2, 3, 4]) AS place, unnest(['e1', 'v1', 'r1', 'other', 'malformed']) AS stage), c AS (SELECT CASE WHEN kind <> 'other' AND reason IS NOT NULL THEN 'malformed' ELSE kind END AS stage, count(*) AS n FROM parsed GROUP BY 1) SELECT CAST(place AS BIGINT) AS place, stage, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN c USING (stage)",
    "ledger_late": _B + "SELECT seq, hotkey, block, highest FROM (SELECT *, max(block) OVER (PARTITION BY hotkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM rows_ WHERE hotkey IS NOT NULL) WHERE block < highest",
    "ledger_rolling_digest": """WITH RECURSIVE o AS (SELECT hotkey, payload, row_number() OVER (PARTITION BY hotkey ORDER BY seq) AS i FROM (SELECT DISTINCT * FROM payloads) WHERE hotkey IS NOT NULL AND payload IS NOT NULL),
        c AS (SELECT hotkey, 0::BIGINT AS i, repeat('0', 64) AS digest FROM o WHERE i = 1 UNION ALL SELECT o.hotkey, o.i, sha256(c.digest || sha256(o.payload)) FROM c JOIN o ON o.hotkey = c.hotkey AND o.i = c.i + 1)
        SELECT hotkey, arg_max(digest, i) AS digest, max(i) AS n FROM c GROUP BY 1""",
    "ledger_stakes": "SELECT coldkey IS NOT NULL AS known, count(*) AS neurons, count(*) FILTER (validator_permit) AS permits, round(sum(stake), 6) AS stake FROM neurons GROUP BY 1",
    "ledger_unmapped": _B + "SELECT CAST(coalesce(uid, -1) AS BIGINT) AS uid, count(*) AS verdicts FROM v LEFT JOIN neurons USING (hotkey) GROUP BY 1",
    "ledger_duplicate_digests": _B + "SELECT digest, count(DISTINCT hotkey) AS authors, arg_min(hotkey, (block, seq)) AS owner FROM e GROUP BY 1 HAVING count(DISTINCT hotkey) > 1",
}
