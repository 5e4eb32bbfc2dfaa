"""Windows, ordered folds and their kin: latest per key, running sums, islands, moving averages."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Accuracy of the sketch behind exact quantiles; buckets of an as-of join that are carried over in one task.
SKETCH, CARRIED = 10_000, 4_096


def latest(df: DataFrame, keys: list[str], version: str, arrival: str) -> DataFrame:
    """The row of highest version for each key; of equal ones the first to arrive.

    An aggregate, no window: map tasks send one row a key, so a hot key is no burden.
    """
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(version), -F.col(arrival)))
    return df.where(F.col(version).isNotNull()).groupBy(*keys).agg(best.alias("r")).select("r.*")


def crossing(df: DataFrame, key: str, order: list[str], weight: Column, threshold: Column) -> DataFrame:
    """The first row of each key at which the running weight reaches the threshold."""
    running = F.sum(weight).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).where(F.col("running") >= threshold).groupBy(key).agg(F.min(F.struct(*order, "running")).alias("at")).select(key, "at.*")


def islands(df: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Runs of one value: (partition, island, value, first and last of the first order column, rows)."""
    by = Window.partitionBy(partition).orderBy(*order)
    changed = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = df.withColumn("changed", changed).withColumn("island", F.sum("changed").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(partition, "island", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows"))


def moving_average(df: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """The exponential average (weight 2 / (k + 1)) at the end of each key; the first value seeds it.

    Closed form as one aggregate: with weights relative to the last row, in order of rank; no fold in one task.
    """
    alpha = 2.0 / (k + 1)
    ranked = df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())) - 1)
    ranked = ranked.withColumn("size", F.count("*").over(Window.partitionBy(key)))
    weight = F.pow(F.lit(1 - alpha), F.col("rank")) * F.when(F.col("rank") == F.col("size") - 1, 1.0).otherwise(alpha)
    return ranked.groupBy(key).agg(F.sum(weight * F.col(value)).alias("average"), F.count("*").alias("n"))


def quantiles(df: DataFrame, key: str, value: str, q: float, least: int) -> DataFrame:
    """(key, nearest, exclusive) for keys of at least that many values, both exact: the value at round(q (n - 1)), halves to the even
    side, and the quantile at q (n + 1) with the neighbours in proportion.

    No key's values are brought together: a mergeable sketch gives bounds around the quantile that are sure to hold it (its ranks are off by
    n / SKETCH at most, the bounds by n / 1000), rows outside are counted and only the few inside are sorted.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, value)
    edges = rows.groupBy(key).agg(F.percentile_approx(value, [max(q - 0.001, 0.0), min(q + 0.001, 1.0)], SKETCH).alias("e"), F.count("*").alias("n")).where(F.col("n") >= least)
    # few values: take all of a key that has no more than a page of them
    low = F.when(F.col("n") > 10_000, F.col("e")[0])
    high = F.when(F.col("n") > 10_000, F.col("e")[1])
    near = rows.join(edges.select(key, "n", low.alias("low"), high.alias("high")), key)
    inside = F.when((F.col("low").isNull() | (F.col(value) >= F.col("low"))) & (F.col("high").isNull() | (F.col(value) <= F.col("high"))), F.col(value))
    v = near.groupBy(key).agg(F.first("n").alias("n"), F.count_if(F.col(value) < F.col("low")).alias("below"), F.array_sort(F.collect_list(inside)).alias("v"))
    at = lambda rank: F.element_at("v", (rank - F.col("below")).cast("int"))
    nearest = at(F.bround(F.lit(q) * (F.col("n") - 1), 0) + 1)
    place = F.lit(q) * (F.col("n") + 1)
    lower = F.greatest(F.least(F.floor(place), F.col("n") - 1), F.lit(1))
    return v.select(key, nearest.alias("nearest"), (at(lower) + (at(lower + 1) - at(lower)) * (place - lower)).alias("exclusive"))


def ranked(df: DataFrame, coarse: str, fine: list[str], width: int, key: str | None = None) -> DataFrame:
    """Df with the rank, from 0, of each row, within its key if there is one, in the order of a number and of further columns, without
    one task that holds all rows of a hot key.

    Rows are counted by buckets of that width of the number; a bucket starts at the sum of those before it, taken over blocks of CARRIED
    buckets and over the blocks; rows are ordered within their bucket only. Rows whose number is null come first, as one bucket.
    """
    own = F.col(key) if key else F.lit(None).cast("string")
    placed = df.withColumn("_bucket", F.coalesce(F.floor(F.col(coarse) / width), F.lit(-(1 << 60)))).withColumn("_key", own)
    counts = placed.groupBy("_key", "_bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("_bucket") / CARRIED))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("_key", "block").agg(F.sum("n").alias("n")).select(F.col("_key").alias("k"), F.col("block").alias("b"), before(Window.partitionBy("_key").orderBy("block")).alias("ahead"))
    inside = counts.withColumn("inside", before(Window.partitionBy("_key", "block").orderBy("_bucket")))
    starts = inside.join(blocks, F.col("_key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).select(F.col("_key").alias("k"), F.col("_bucket").alias("b"), (F.col("inside") + F.col("ahead")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(F.col(coarse), *fine)) - 1
    joined = placed.withColumn("_within", within).join(starts, F.col("_key").eqNullSafe(F.col("k")) & (F.col("_bucket") == F.col("b")))
    return joined.withColumn("rank", (F.col("_start") + F.col("_within")).cast("long")).drop("_bucket", "_start", "_key", "_within", "k", "b")


def newest_before(df: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """ST2: df with the greatest value (newest) of all rows before each in order, without one task that holds all rows: the greatest of each
    bucket of that width is carried over in blocks, only rows of a bucket are ordered. Rows of equal order see each other's predecessors only."""
    bucket = F.floor(F.col(order) / width)
    placed = df.where(F.col(order).isNotNull()).withColumn("_bucket", bucket)
    tops = placed.groupBy("_bucket").agg(F.max(value).alias("top")).withColumn("block", F.floor(F.col("_bucket") / CARRIED))
    before = lambda w: F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    blocks = tops.groupBy("block").agg(F.max("top").alias("top")).select("block", before(Window.orderBy("block")).alias("ahead"))
    carried = tops.withColumn("inside", before(Window.partitionBy("block").orderBy("_bucket"))).join(blocks, "block").select("_bucket", F.greatest("inside", "ahead").alias("_carried"))
    own = F.max(value).over(Window.partitionBy("_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_own", own).join(carried, "_bucket").withColumn("newest", F.greatest("_own", "_carried")).drop("_bucket", "_own", "_carried")


def as_of(left: DataFrame, right: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """Left with the value of the last right row strictly before its order; of equal ones the highest value.

    Rows meet within buckets of that width of the order column. What a bucket brings along from those before it is a running last over
    one row for each bucket that has a right row, in blocks of CARRIED buckets, and over one row for each block.
    """
    bucket = F.floor(F.col(order) / width)
    steps = right.where(F.col(value).isNotNull()).groupBy(order).agg(F.max(value).alias(value))
    last = steps.groupBy(bucket.alias("bucket")).agg(F.max_by(value, order).alias("own"))
    every = left.select(bucket.alias("bucket")).union(last.select("bucket")).distinct().join(last, "bucket", "left").withColumn("block", F.floor(F.col("bucket") / CARRIED))
    running = lambda w: F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    blocks = every.groupBy("block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("bucket"))).alias("own"))
    blocks = blocks.select("block", running(Window.orderBy("block")).alias("earlier"))
    carried = every.withColumn("carried", running(Window.partitionBy("block").orderBy("bucket"))).join(blocks, "block").select("bucket", F.coalesce("carried", "earlier").alias("carried"))
    names = [c for c in left.columns if c != order]
    both = left.select(F.col(order), F.struct(*names).alias("row"), F.lit(None).cast(steps.schema[value].dataType).alias(value), F.lit(0).alias("side"))
    both = both.unionByName(steps.select(F.col(order), F.lit(None).cast(both.schema["row"].dataType).alias("row"), value, F.lit(1).alias("side"))).withColumn("bucket", bucket)
    within = Window.partitionBy("bucket").orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("found", F.last(value, ignorenulls=True).over(within)).where("side = 0")
    return filled.join(carried, "bucket", "left").select(order, *[F.col(f"row.{c}").alias(c) for c in names], F.coalesce("found", "carried").alias(value))


def rolled(df: DataFrame, key: str, order: str, text: str, step: str) -> DataFrame:
    """(key, digest, n): a hash over each key's texts in order, read as a stream: no key's rows are held in memory.

    step: chain is H6, r = sha256(r + sha256(text)) from 64 zeros; lines is X15, the hash of the texts with line ends between them.
    """
    kind, arrow_kind = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)

    def stream(batches):
        held, digest, n = None, None, 0
        begun = False
        for batch in batches:
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun or k != held:
                    if begun:
                        done.append((held, finish(digest), n))
                    begun, held, n = True, k, 0
                    digest = "0" * 64 if step == "chain" else hashlib.sha256()
                if step == "chain":
                    digest = hashlib.sha256((digest + hashlib.sha256(t.encode()).hexdigest()).encode()).hexdigest()
                else:
                    digest.update((("\n" if n else "") + t).encode())
                n += 1
            if done:
                yield rows(done)
        if begun:
            yield rows([(held, finish(digest), n)])

    def finish(digest) -> str:
        return digest if isinstance(digest, str) else digest.hexdigest()

    def rows(done: list) -> pa.RecordBatch:
        keys, digests, counts = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow_kind), pa.array(digests, pa.string()), pa.array(counts, pa.int64())], names=[key, "digest", "n"])

    placed = df.where(F.col(text).isNotNull()).select(key, order, F.col(text).alias("_text")).repartition(key).sortWithinPartitions(key, order)
    return placed.select(key, "_text").mapInArrow(stream, f"{key} {kind}, digest string, n long")
