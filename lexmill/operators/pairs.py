"""Pairs of rows that share a key, without one task that holds all rows of a hot one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.storage import materialize

#: Members of one key that one task takes; larger keys are cut into blocks of this size, which meet pairwise in different tasks.
BLOCK = 2_000


def sharing(entries: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b), a < b: different ids of entries (id, key) that share a key, each pair once. Null keys and ids pair with nothing."""
    block = block or BLOCK
    some = entries.where("key is not null and id is not null")
    counted = some.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    held = materialize(some.join(counted, "key").select("key", "id", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "shared-keys")
    mine, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = held.select("key", F.col("id").alias("a"), mine.alias("own"), every.alias("other"))
    right = held.select("key", F.col("id").alias("b"), every.alias("own"), mine.alias("other"))
    return left.join(right, ["key", "own", "other"]).where("a < b").select("a", "b").distinct()
