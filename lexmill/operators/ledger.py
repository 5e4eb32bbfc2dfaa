"""An append-only ledger of strings: typed views, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import ordered

DIGEST, INTEGER = "^sha256:[0-9a-f]{64}$", "^-?(0|[1-9][0-9]*)$"


def distinct_rows(payloads: DataFrame) -> DataFrame:
    """Re-delivered rows are alike; one of each seq is kept."""
    return payloads.groupBy("seq").agg(F.min(F.struct("hotkey", "block", "payload")).alias("p")).select("seq", "p.*")


def parsed(payloads: DataFrame) -> DataFrame:
    """(seq, hotkey, block, kind, digest, repo, round, decision, value, reason): reason tells why a row is no event, else null.

    Kinds: e1|digest|repo, v1|round|digest|decision|value, r1|round|block. Signs, leading zeros and separators in
    integers are malformed; so is a row without a hotkey.
    """
    p = F.split(F.coalesce("payload", F.lit("")), "\\|")
    at = lambda k: F.try_element_at(p, F.lit(k + 1))
    fields = {"e1": 3, "v1": 5, "r1": 3}
    kind = F.when(at(0).isin(*fields), at(0)).otherwise("other")
    size = F.size(p) == F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])[at(0)]
    digest = F.when(at(0) == "e1", at(1)).when(at(0) == "v1", at(2))
    number = F.when(at(0).isin("v1", "r1"), at(1))
    value = F.when(at(0) == "v1", at(4)).when(at(0) == "r1", at(2))
    reason: Column = (
        F.when(F.coalesce("payload", F.lit("")) == "", "empty")
        .when(kind == "other", "unknown_version")
        .when(~size, "fields")
        .when(digest.isNotNull() & ~digest.rlike(DIGEST), "digest")
        .when(number.isNotNull() & ~number.rlike(INTEGER), "integer")
        .when(value.isNotNull() & ~value.rlike(INTEGER), "integer")
        .when((at(0) == "v1") & ~at(3).isin("ACCEPT", "REJECT"), "decision")
        .when(number.isNotNull() & (number.try_cast("long") < 1), "range")
        .when(F.col("hotkey").isNull(), "no_hotkey")
    )
    return payloads.select(
        "seq", "hotkey", "block", kind.alias("kind"), digest.alias("digest"), F.when(at(0) == "e1", at(2)).alias("repo"),
        number.try_cast("long").alias("round"), F.when(at(0) == "v1", at(3)).alias("decision"), value.try_cast("long").alias("value"), reason.alias("reason"),
    )


def events(payloads: DataFrame, kind: str) -> DataFrame:
    return parsed(distinct_rows(payloads)).where((F.col("kind") == kind) & F.col("reason").isNull()).drop("kind", "reason")


def latest_verdicts(payloads: DataFrame, neurons: DataFrame) -> DataFrame:
    """The last verdict of each permitted validator on each digest, with the validator's stake."""
    last = ordered.latest(events(payloads, "v1"), ["digest", "hotkey"], "block", "seq")
    return last.join(neurons.where("validator_permit").select("hotkey", "stake"), "hotkey")
