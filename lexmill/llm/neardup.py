"""Near-duplicate records with small edits: DartMinHash signatures, banded joining, exact check.

Steps, each one a Spark stage or two:

1. One pass over the texts makes, for each record, its number of different shingles, a fingerprint of its shingle set and
   one key for each band of its DartMinHash signature.
2. Records of equal shingle sets form a class; the lowest id stands for it. Only representatives go on, so a group of
   copies that holds a third of all rows costs one row for each map task.
3. Band keys that at least two representatives have are joined with themselves. Keys are counted first (with map-side
   sums); a key of more than ``block`` members is cut into blocks that meet pairwise in different tasks.
4. Candidates are checked exactly on their shingle sets; only candidate records are shingled again.

With 24 bands of 4 rows a pair at the threshold of 0.7 is a candidate with a probability of 0.9986, one at 0.8 of 0.99999.

Nulls, empty texts and texts without a letter or digit are never a case and have no class. Ids have to be unique and not
null. Further columns of the input are not read. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import shingles as S
from lexmill.storage import materialize

BANDS, ROWS = 24, 4
THRESHOLD = 0.7
#: Members of one band key that one task takes; larger keys are cut into blocks of this size.
BLOCK = 2_000

FEATURES = "id long, n int, f1 long, f2 long, keys array<long>"


def _list_array(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = S.shingle_sets(batch.column(1).to_pylist())
        some = np.flatnonzero(np.diff(offsets) > 0)
        if not len(some):
            continue
        f1, f2 = S.fingerprints(flat, offsets)
        keys = S.band_keys(S.dart_min_hash(flat, offsets, BANDS * ROWS)[some], BANDS, ROWS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(some)),
                pa.array(np.diff(offsets)[some], pa.int32()),
                pa.array(f1[some]),
                pa.array(f2[some]),
                _list_array(keys.ravel(), np.arange(len(some) + 1) * BANDS),
            ],
            names=["id", "n", "f1", "f2", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = S.shingle_sets(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(flat.astype(np.int64), offsets)], names=["id", "shingles"])


def text_features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, keys) of each record that has a word."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    return texts.mapInArrow(_features, FEATURES)


def shingle_table(df: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the records whose id is in ids (a column id); only their texts reach Python."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(ids, "id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>")


def candidate_pairs(features: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: different records of features (id, keys) that share a band key, each pair once."""
    return paired_entries(features.select("id", F.explode("keys").alias("key")), block)


def paired_entries(entries: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b), a < b: different records of entries (id, key) that share a key, each pair once; large keys in blocks that meet pairwise."""
    block = block or BLOCK
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    held = entries.join(shared, "key").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    held = materialize(held.select("key", "id", "blocks"), "band-entries")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    left = held.select("key", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), mine.alias("own"))
    right = held.select("key", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), mine.alias("other"))
    return left.join(right, ["key", "own", "other"]).where("a < b").select("a", "b").distinct()


def exact_similarity(pairs: DataFrame, sets: DataFrame, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """(a, b, similarity) and the columns of keep of the pairs whose Jaccard similarity on (id, shingles) is at least the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    measured = pairs.join(left, "a").join(right, "b").select("a", "b", *(keep or []), both.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    # both / (total - both) >= t, without a division that rounds
    return measured.where(F.col("both") * (1 + threshold) + 1e-9 >= F.col("total") * threshold).select(
        "a", "b", *(keep or []), (F.col("both") / (F.col("total") - F.col("both"))).alias("similarity")
    )


def classes(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (id, rep) of classes with at least two records, the features of one representative for each class)."""
    groups = features.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    members = materialize(features.select("id", "f1", "f2", "n").join(groups, ["f1", "f2", "n"]).select("id", "rep"), "class-members")
    return members, features.join(members.where("id <> rep"), "id", "left_anti")


def near_duplicate_links(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links (a, b, similarity) between class representatives, members (id, rep) of classes of at least two records)."""
    features = materialize(text_features(df, id_col, text_col), "text-features")
    members, reps = classes(features)
    pairs = materialize(candidate_pairs(reps), "candidate-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = shingle_table(df, id_col, text_col, ids)
    return materialize(exact_similarity(pairs, sets, threshold), "near-links"), members


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a < b: every pair of records of that similarity, copies included.

    The links between representatives are multiplied by their classes' members; classes pair within themselves. Both are
    equi-joins on the representative, of which adaptive execution splits the large ones.
    """
    links, members = near_duplicate_links(df, id_col, text_col, threshold)
    single = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    single = single.join(members, "id", "left_anti").select("id", F.col("id").alias("rep"))
    every = members.union(single)
    left = every.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    right = every.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    own = members.select(F.col("id").alias("a"), "rep").join(members.select(F.col("id").alias("b"), "rep"), "rep").where("a < b")
    return across.unionByName(own.select("a", "b"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, group_id, links): one row for each record with a word; its group is the lowest id that links lead to.

    links counts the class representatives that the record's own is linked to. Labels spread over the links between
    representatives only, with pointer jumping, so the rounds grow with the logarithm of a group's diameter.
    """
    links, members = near_duplicate_links(df, id_col, text_col, threshold)
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = edges.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    labels = materialize(edges.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("b")).select("rep", F.least("rep", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.rep).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.rep == near.a).select("rep", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("rep").alias("label"), F.col("label").alias("far"))
        moved = materialize(moved.join(jump, "label").select("rep", "old", F.least("label", "far").alias("label")), "labels")
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("rep", "label")
        if not changed:
            break
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[\\p{L}\\p{N}]")).select("id")
    return (
        ids.join(members, "id", "left")
        .select("id", F.coalesce("rep", "id").alias("rep"))
        .join(labels, "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
