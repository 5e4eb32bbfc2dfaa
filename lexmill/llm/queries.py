"""The queries of the nine problems; __spark_entry__ adds them if this subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import consistent, encoding, history, mixing, neardup, packing, radix, sentences, subjects
from lexmill.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of docs with a text similarity of at least 0.7."""
    pairs = neardup.near_duplicate_pairs(table(spark, sf_dir, "docs"), "ord", "text")
    return pairs.select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its group of near duplicates at 0.8 and its number of links."""
    return neardup.near_duplicate_groups(table(spark, sf_dir, "docs"), "ord", "text", 0.8).select(F.col("id").alias("ord"), "group_id", "links")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of tasks and docs that hold a value not in the consistent form."""
    forms = consistent.consistent_forms(table(spark, sf_dir, "docs"), table(spark, sf_dir, "tasks"))
    return forms.where("changed").select("tbl", "row_key", "field").distinct()


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in the consistent form."""
    forms = consistent.consistent_forms(table(spark, sf_dir, "docs"), table(spark, sf_dir, "tasks"))
    return forms.select("tbl", "row_key", "field", "place", "form")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of later batches that are refused, with the accepted record that each repeats."""
    refused = history.refused_records(table(spark, sf_dir, "docs"), "ord", "batch", "url", "text")
    return refused.select(F.col("kept").alias("kept_ord"), F.col("id").alias("ord"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of text and title that were decoded with a wrong encoding."""
    judged = encoding.repaired(table(spark, sf_dir, "docs"), "ord", ["text", "title"])
    return judged.where("affected").select(F.col("id").alias("ord"), "field")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected values as they can be restored; complete tells that no sign of damage is left."""
    judged = encoding.repaired(table(spark, sf_dir, "docs"), "ord", ["text", "title"]).where("affected")
    return judged.select(F.col("id").alias("ord"), "field", "restored", (~F.col("restored").rlike("[\\x{80}-\\x{9f}\\x{fffd}]")).alias("complete"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each further copy of a docs record with the lowest ord of its group."""
    return radix.copy_pairs(table(spark, sf_dir, "docs"), "ord", "title", "text").select(F.col("kept").alias("kept_ord"), F.col("copy").alias("copy_ord"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group of at least two copies, with the number of copies."""
    groups, _ = radix.format_copies(table(spark, sf_dir, "docs"), "ord", "title", "text")
    return groups.select(F.col("kept").alias("kept_ord"), "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every docs record."""
    return subjects.subject_table(*(table(spark, sf_dir, name) for name in ("docs", "subject_labels", "subjects")))


def p6_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records are about each subject."""
    return p6_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("records"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each spec's scope, assigned to containers."""
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each spec and the share of their capacity that is used."""
    placed = p7_containers(spark, sf_dir).groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"))
    capacity = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens")
    used = placed.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"))
    return used.join(capacity, "spec_id").select("spec_id", "containers", "tokens", "most_tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


# The domain of each source of documents, the upper level of the tree of p8.
DOMAINS = {
    "abstract_feed": "research", "review_dump": "research", "preprint_mirror": "research", "holdout_harvest": "research", "practice_corpus": "research",
    "wiki_extracts": "reference", "handbook": "reference", "glossary": "reference", "errata": "reference",
    "task_pool": "evaluation", "rollout_log": "evaluation", "validator_notes": "evaluation", "local_dir": "evaluation",
}


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    domains = spark.createDataFrame(sorted(DOMAINS.items()), "source string, domain string")
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), domains)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for each mix."""
    taken, _ = _mixed(spark, sf_dir)
    return taken.select("mix_id", "doc_id", "times")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources of each mix reach."""
    return mixing.shares(*_mixed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents with their places."""
    return sentences.sentence_table(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_forms, p2_found, p3_found, p3_restored, p4_found, p4_counts, p5_found, p5_groups, p6_found, p6_composition, p7_containers, p7_fill, p8_mix, p8_shares, p9_found)}


_SHINGLES = """
  WITH words AS (SELECT ord, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM docs WHERE text IS NOT NULL),
  shingles AS (SELECT DISTINCT ord, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s FROM words WHERE len(w) > 0),
  sizes AS (SELECT ord, count(*) AS n, string_agg(s, '|' ORDER BY s) AS whole FROM shingles GROUP BY ord),
  met AS (SELECT a.ord AS a, b.ord AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.ord < b.ord GROUP BY ALL)
"""


def _alike(threshold: float) -> str:
    return f"SELECT a, b FROM met JOIN sizes x ON x.ord = a JOIN sizes y ON y.ord = b WHERE met.n * {1 + threshold} + 1e-9 >= (x.n + y.n) * {threshold}"


def oracle_sql() -> dict[str, str]:
    """Brute force over all pairs; groups as the lowest ord that links lead to, links between the first records of equal sets of runs."""
    return {
        "p5_found": _SHINGLES + f"SELECT a AS ord_a, b AS ord_b FROM ({_alike(0.7)})",
        "p5_groups": _SHINGLES.replace("WITH words", "WITH RECURSIVE words") + f""", pairs AS ({_alike(0.8)}), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
          reach AS (SELECT ord AS a, ord AS b FROM sizes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
          reps AS (SELECT ord, min(ord) OVER (PARTITION BY whole) AS rep FROM sizes),
          degree AS (SELECT x.rep, count(DISTINCT y.rep) AS links FROM edges JOIN reps x ON x.ord = a JOIN reps y ON y.ord = b WHERE x.rep <> y.rep GROUP BY x.rep)
          SELECT r.ord, g.group_id, coalesce(links, 0) AS links FROM reps r JOIN (SELECT a AS ord, min(b) AS group_id FROM reach GROUP BY a) g USING (ord) LEFT JOIN degree USING (rep)""",
    }
