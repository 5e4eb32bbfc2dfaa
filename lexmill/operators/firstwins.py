"""Near duplicates of curation, first record wins: 64 min-hashes in 16 bands, similarity of at least 0.85.

A record is rejected if an earlier record that was itself accepted is alike: the first maximal independent set in order,
not connected components. Null texts take no part. Records of equal texts collapse first.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.operators.pairs import sharing
from lexmill.storage import materialize

HASHES, BANDS, SIMILARITY = 64, 16, 0.85
#: Words of a shingle.
WIDTH = 5
#: Odd factors of the hashes, drawn once.
_FACTORS = np.random.default_rng(64).integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _END, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: Shingles that are hashed at once: few enough to stay in the cache.
_AT_ONCE = 1 << 15


def _words(text):
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[ \\t\\r\\n]+", " ")), " ")


def shingles(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words of each list, list by list, and how many each has; a shorter list is one run. Lists hold a word at least."""
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    of_word = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest()) for w in coded.dictionary.to_pylist()], np.uint64)
    word = of_word[coded.indices.to_numpy()]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
    counts = np.maximum(sizes - WIDTH + 1, 1)
    at = np.flatnonzero((left >= WIDTH) | (left == np.repeat(sizes, sizes)))
    made = word[at]
    padded = np.append(word, np.full(WIDTH, _END))
    for j in range(1, WIDTH):
        made = (made ^ (made >> _HALF)) * _MIX + np.where(left[at] > j, padded[at + j], _END)
    return (made ^ (made >> _HALF)) * _MIX, counts


def _signatures(batches):
    """(id, digest, keys) of (id, digest, words): a key for each band of min-hashes."""
    rows = HASHES // BANDS
    for batch in batches:
        if not batch.num_rows:
            continue
        made, counts = shingles(batch.column(2))
        ends = np.cumsum(counts)
        keys = np.empty((len(counts), BANDS), np.uint64)
        low = 0
        while low < len(counts):
            begin = ends[low] - counts[low]
            high = max(low + 1, int(np.searchsorted(ends, begin + _AT_ONCE, "right")))
            part, first = made[begin : ends[high - 1]], ends[low:high] - counts[low:high] - begin
            for b in range(BANDS):
                key = np.full(high - low, b + 1, np.uint64)
                for factor in _FACTORS[b * rows : (b + 1) * rows]:
                    hashed = part * factor
                    hashed ^= hashed >> _HALF
                    hashed *= _MIX
                    key = (key ^ (key >> _HALF)) * _MIX + np.minimum.reduceat(hashed, first)
                keys[low:high, b] = (key ^ (key >> _HALF)) * _MIX
            low = high
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["id", "digest", "keys"])


def _sets(batches):
    """(id, s) of (id, words): the different shingles."""
    for batch in batches:
        if batch.num_rows:
            made, counts = shingles(batch.column(1))
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((made, row))
            made, row = made[order], row[order]
            new = np.append(True, (made[1:] != made[:-1]) | (row[1:] != row[:-1]))
            offsets = np.append(0, np.cumsum(np.bincount(row[new], minlength=len(counts))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(made[new].view(np.int64)))], names=["id", "s"])


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, keys) of records with a text, written once: what is alike is looked for without the texts."""
    kind = df.schema[id_col].dataType.simpleString()
    some = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.sha2(text_col, 256)).alias("digest"), _words(F.col(text_col)).alias("words"))
    return materialize(some.mapInArrow(_signatures, f"id {kind}, digest binary, keys array<long>"), "signatures")


def alike_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = SIMILARITY, signed: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: pairs that share a band and reach the similarity. signed: (id, keys) of the records to compare, if made before.

    Only records that share a band have their texts moved and their shingles compared.
    """
    signed = signatures(df, id_col, text_col) if signed is None else signed
    kind = df.schema[id_col].dataType.simpleString()
    pairs = materialize(sharing(signed.select("id", F.explode("keys").alias("key"))), "sharing")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), text_col).join(ids, "id", "left_semi")
    made = materialize(texts.select("id", _words(F.col(text_col)).alias("words")).mapInArrow(_sets, f"id {kind}, s array<long>"), "shingle-sets")
    both = pairs.join(made.toDF("a", "sa"), "a").join(made.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def first_wins(pairs: DataFrame) -> DataFrame:
    """(id, kept) of rejected nodes: kept is the first accepted node they are alike to. Rounds grow with the longest chain of decisions."""
    pairs = materialize(pairs, "alike")
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    state = materialize(nodes.withColumn("status", F.lit(0)), "first-wins")
    while True:
        seen = Observation()
        before = pairs.join(state.select(F.col("id").alias("a"), "status"), "a").groupBy(F.col("b").alias("id"))
        before = before.agg(F.count_if(F.col("status") == 1).alias("accepted"), F.count_if(F.col("status") == 0).alias("open"))
        now = F.when(F.col("status") != 0, F.col("status")).when(F.coalesce("accepted", F.lit(0)) > 0, 2).when(F.coalesce("open", F.lit(0)) > 0, 0).otherwise(1)
        state = materialize(state.join(before, "id", "left").select("id", now.alias("status")).observe(seen, F.count_if(F.col("status") == 0).alias("open")), "first-wins")
        if not seen.get["open"]:
            break
    accepted = state.where("status = 1").select(F.col("id").alias("a"))
    return pairs.join(accepted, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("kept")).join(state.where("status = 2").select("id"), "id", "left_semi")


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kept): rejected records with what they repeat; copies of one text by the first of them."""
    signed = signatures(df, id_col, text_col)
    first = materialize(signed.groupBy("digest").agg(F.min(F.struct("id", "keys")).alias("r")).select("digest", F.col("r.id").alias("first"), "r.keys"), "first-of-text")
    rejected = materialize(first_wins(alike_pairs(df, id_col, text_col, signed=first.select(F.col("first").alias("id"), "keys"))), "rejected")
    copies = signed.select("id", "digest").join(first.select("digest", "first"), "digest").where("id <> first").select("id", "first")
    moved = copies.join(rejected.select(F.col("id").alias("first"), "kept"), "first", "left").select("id", F.coalesce("kept", "first").alias("kept"))
    return rejected.select("id", "kept").union(moved)
