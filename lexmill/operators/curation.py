"""Corpus curation: normalisation, junk reasons, exact duplicates, exclusion by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def corpus(docs: DataFrame) -> DataFrame:
    """One record for each content id, the first in order of arrival; records without text are left out.

    min over a struct is summed in map tasks, so an id that a third of all rows carry costs one row a task.
    """
    first = docs.where("text is not null and text <> ''").groupBy("doc_id").agg(F.min(F.struct("ord", "title", "text", "url", "category")).alias("r"))
    return first.select("doc_id", "r.ord", F.coalesce("r.title", F.lit("")).alias("title"), "r.text", "r.url", F.coalesce("r.category", F.lit("")).alias("category"))


def rejections(docs: DataFrame) -> DataFrame:
    """A3: how many records each reason rejects; 'kept' for the others."""
    return docs.groupBy(F.coalesce(T.junk_reason(F.col("text")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """By hash of the text, the first record and the number of records; texts that are met once are left out."""
    return (
        docs.where("text is not null")
        .groupBy(F.sha2("text", 256).alias("text_hash"))
        .agg(F.min("ord").alias("first_ord"), F.count("*").alias("copies"))
        .where("copies > 1")
    )


def accepted(docs: DataFrame, limit: int) -> DataFrame:
    """The first limit accepted records in order of arrival: no junk, no repeated text."""
    kept = docs.where(T.junk_reason(F.col("text")).isNull()).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("ord").alias("ord"))
    return kept.orderBy("ord").limit(limit).select("ord")


def _keys(df: DataFrame, least_key: int, edge: int) -> DataFrame:
    """(ord, paper, rank, reason, key) for the six keys of each record; a first paragraph that repeats the title is no part of the abstract."""
    head, parts = T.fold_key(F.col("title")), F.split("text", "\n\n", 2)
    read = df.select("ord", "doc_id", "url", head.alias("head"), T.fold_key(F.col("text")).alias("whole"), T.fold_key(F.when(F.size(parts) == 2, parts[0])).alias("first"))
    titled = (F.col("first") != "") & (F.col("first") == F.col("head"))
    folded = F.when(titled, F.expr("substring(whole, length(first) + 1)")).otherwise(F.col("whole"))
    read = read.select("*", F.when(F.length(folded) >= least_key, folded).alias("body"))
    made = F.array(*(
        F.struct(F.lit(k + 1).alias("rank"), F.lit(reason).alias("reason"), key.alias("key"))
        for k, (reason, key) in enumerate({
            "doc_id": F.col("doc_id"), "identifier": T.identifier(F.col("url")), "title": F.nullif(F.col("head"), F.lit("")), "abstract": F.sha2("body", 256),
            "abstract_start": F.sha2(F.substring("body", 1, edge), 256), "abstract_end": F.sha2(F.expr(f"right(body, {edge})"), 256),
        }.items())
    ))
    # records with one content id are one paper, however often it was received
    paper = F.coalesce(F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("paper")
    return read.select("ord", paper, F.explode(made).alias("k")).select("ord", "paper", "k.*").where("key is not null")


def exclusion_keys(df: DataFrame, least_key: int = 200, edge: int = 160) -> DataFrame:
    """(kind, key, papers) of the six kinds of keys of all records: how many papers have each."""
    return _keys(df, least_key, edge).select(F.col("reason").alias("kind"), "key", "paper").distinct().groupBy("kind", "key").agg(F.count("*").alias("papers"))


def matches(source: DataFrame, held_out: DataFrame, least_key: int = 200, edge: int = 160) -> DataFrame:
    """(ord, paper, rank, reason, key, held_ord): the keys of source that held-out records have; an edge only if one held-out paper alone has it.

    Keys are made on both sides, stacked as (rank, key) and joined once; the held-out side is made distinct first, so a hot key does not multiply rows.
    """
    held = _keys(held_out, least_key, edge).groupBy("rank", "key").agg(F.min("ord").alias("held_ord"), (F.min("paper") == F.max("paper")).alias("sole"))
    return _keys(source, least_key, edge).join(held.where("rank <= 4 or sole").drop("sole"), ["rank", "key"])


def reasons(matched: DataFrame) -> DataFrame:
    """(ord, rank, reason, key, held_ord) from matches: the first of the first four keys for the records that have one; for the others, each
    edge that one paper alone of these others has."""
    basic, edges = F.min(F.when(F.col("rank") <= 4, F.struct("rank", "reason", "key", "held_ord"))), F.collect_list(F.when(F.col("rank") > 4, F.struct("rank", "reason", "key", "held_ord")))
    by_record = matched.groupBy("ord", "paper").agg(basic.alias("basic"), edges.alias("edges"))
    # a record with a basic reason stands alone behind its number, so that it takes no part in the count of edges
    own = F.when(F.col("basic").isNotNull(), F.array("basic")).otherwise(F.col("edges"))
    rows = by_record.select("ord", "paper", F.when(F.col("basic").isNotNull(), F.col("ord")).alias("apart"), F.inline(own))
    same = Window.partitionBy("rank", "key", "apart")
    return rows.withColumn("sole", F.min("paper").over(same) == F.max("paper").over(same)).where("sole").select("ord", "rank", "reason", "key", "held_ord")


def _first_reason(found: DataFrame) -> DataFrame:
    return found.groupBy("ord").agg(F.min(F.struct("rank", "reason")).alias("first")).select("ord", "first.reason")


def excluded(source: DataFrame, held_out: DataFrame, least_key: int = 200) -> DataFrame:
    """Records of source that a held-out record matches, with the first of six reasons in order of precedence.

    source and held_out: (ord, doc_id, url, title, text).
    """
    return _first_reason(reasons(matches(source, held_out, least_key)))


def survivors(kept: DataFrame, source: DataFrame, held_out: DataFrame) -> DataFrame:
    """Records of kept that still have one of the six reasons; edges are counted over source, as they were for the exclusion."""
    again, edges = matches(kept, held_out), reasons(matches(source, held_out)).where("rank > 4").select("rank", "key").distinct()
    return _first_reason(again.where("rank <= 4").select("ord", "rank", "reason").union(again.where("rank > 4").join(edges, ["rank", "key"], "left_semi").select("ord", "rank", "reason")))


def unique_edges(source: DataFrame, held_out: DataFrame, edge: int = 160) -> DataFrame:
    """Pairs that share the first or last folded characters, where one paper of the held-out records and one of the source records that
    the first four keys leave have that edge."""
    found = reasons(matches(source, held_out, edge=edge)).where("rank > 4")
    return found.select(F.when(F.col("rank") == 5, "start").otherwise("end").alias("side"), F.col("ord").alias("source_ord"), F.col("held_ord").alias("held_out_ord"))
