"""Duplicates hidden by formatting differences: recursive radix partitioning on canonical bytes, then tries.

1. One pass writes the canonical bytes of each record. Within a task equal ones are combined first, so a group of copies
   that holds a third of all rows leaves each task as one row with its lowest id and its count.
2. The combined rows are counted by their first bytes. A bucket of more rows than fit is split by the LEVEL_BYTES behind the longest
   prefix that all its rows share, again and again, until each fits or holds one value only. Buckets are tables throughout: nothing of them
   reaches the driver, and only rows of buckets that are still too large are written again.
3. Rows are shuffled by bucket and sorted by it; a task builds one bucket's trie at a time. Terminals hold the count and the
   lowest id of equal canonical bytes.

Canonical bytes: case folded, without whitespace and punctuation; a decimal point, a minus sign, < and > stay. A text of
labelled fields (a JSON object, or at least two "label: value" pieces, and nothing else, divided by line breaks, bars or semicolons) has its fields sorted.

Null or empty (also all-blank) texts are never a case; a null title counts as an empty one. Ids have to be unique and not
null. Further columns are not read. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.storage import materialize

#: Rows of combined canonical bytes that one trie takes.
BUCKET_ROWS = 20_000
#: Bytes that one level of the recursion looks at.
LEVEL_BYTES = 4
#: Different values that a task combines before it passes them on.
COMBINE = 20_000

_NUMBER_POINT = re.compile(r"(?<=\d)\.(?=\d)")
_MINUS = re.compile(r"(?<![^\W_])[-−](?=\.?\d)")
#: Of ASCII only letters, digits, < and > are content; of the rest also marks and symbols such as a degree sign.
_DROP = re.compile(r"[^\w<>\x01\x02\x80-\U0010ffff]|_")
_DROP_WIDE = re.compile(r"[^\w\x00-\x7f]")
_LABEL = re.compile(r"\W*([^\W\d_][^\n:=|]{0,30}?)\s*[:=]\s*(\S.*)", re.S)


def _squeeze(text: str) -> str:
    text = _MINUS.sub("\x02", _NUMBER_POINT.sub("\x01", text.casefold()))
    text = _DROP.sub("", text)
    return text if text.isascii() else _DROP_WIDE.sub(lambda m: m[0] if unicodedata.category(m[0])[0] in "MSC" else "", text)


def _fields(text: str) -> list[tuple[str, str]] | None:
    """Labels and values of a text that is made of labelled fields."""
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            found = json.loads(body)
        except ValueError:
            found = None
        if isinstance(found, dict) and found:
            return [(str(k), v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in found.items()]
    if ":" not in body and "=" not in body:
        return None
    for divider in ("\n", "|", ";"):
        pieces = [x for x in body.split(divider) if x.strip()]
        if len(pieces) >= 2:
            found = []
            for piece in pieces:
                m = _LABEL.match(piece)
                if m is None:
                    break
                found.append((m[1], m[2]))
            else:
                return found
    return None


def canonical(title: str | None, text: str) -> str:
    fields = _fields(text)
    if fields is None:
        body = _squeeze(text)
    else:
        body = "\x04".join(sorted(f"{_squeeze(label)}\x05{_squeeze(value)}" for label, value in fields))
    return f"{_squeeze(title or '')}\x03{body}"


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: kind 0, a record with its digest; kind 1, canonical bytes with lowest id and count so far."""
    held: dict[bytes, list] = {}

    def combined():
        rows = list(held.items())
        held.clear()
        return pa.RecordBatch.from_pydict(
            {"kind": [1] * len(rows), "id": [v[0] for _, v in rows], "digest": [v[2] for _, v in rows], "n": [v[1] for _, v in rows], "bytes": [k for k, _ in rows]}, schema=_SCHEMA
        )

    for batch in batches:
        ids, digests = [], []
        for key, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not text or text.isspace():
                continue
            data = canonical(title, text).encode("utf-8", "surrogatepass")
            seen = held.get(data)
            if seen is None:
                seen = held[data] = [key, 0, hashlib.blake2b(data, digest_size=16).digest()]
            seen[0] = min(seen[0], key)
            seen[1] += 1
            ids.append(key)
            digests.append(seen[2])
        yield pa.RecordBatch.from_pydict({"kind": [0] * len(ids), "id": ids, "digest": digests, "n": [1] * len(ids), "bytes": [None] * len(ids)}, schema=_SCHEMA)
        if len(held) >= COMBINE:
            yield combined()
    if held:
        yield combined()


_SCHEMA = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("bytes", pa.binary())])


class Trie:
    """A trie over chunks of bytes. A chain without branches is kept as one tail and cut only when another value enters it."""

    __slots__ = ("root", "step")

    def __init__(self, step: int = 32):
        self.root: dict = {}
        self.step = step

    def add(self, data: bytes, key: int, n: int, digest: bytes) -> None:
        node, at, step = self.root, 0, self.step
        while True:
            chunk = data[at : at + step]
            at += step
            child = node.get(chunk)
            if child is None:
                node[chunk] = [data[at:], key, n, digest]
                return
            if type(child) is list:
                if child[0] == data[at:]:
                    child[1] = min(child[1], key)
                    child[2] += n
                    return
                tail = child[0]
                child[0] = tail[step:]
                child = node[chunk] = {tail[:step]: child}
            node = child

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for child in stack.pop().values():
                if type(child) is list:
                    yield child
                else:
                    stack.append(child)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one trie lives at a time. Only groups of more than one record leave."""
    trie, current = Trie(), None

    def leave(trie):
        rows = [x for x in trie.terminals() if x[2] > 1]
        return pa.RecordBatch.from_arrays([pa.array([x[3] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64())], names=["digest", "kept", "copies"])

    for batch in batches:
        for bucket, key, digest, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != current:
                if current is not None:
                    yield leave(trie)
                trie, current = Trie(), bucket
            trie.add(data, key, n, digest)
    if current is not None:
        yield leave(trie)


def _shared_length(low: pa.Array, high: pa.Array) -> pa.Array:
    """How many bytes the lowest and the highest value of a bucket, and so all of its values, share."""
    return pa.array([next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(low.to_pylist(), high.to_pylist())], pa.int32())


_shared_length.__annotations__ = {"low": pa.Array, "high": pa.Array, "return": pa.Array}


def _buckets(values: DataFrame, bucket_rows: int) -> DataFrame:
    """values with the prefix (bucket) that tells where each row goes: of at most bucket_rows rows, or of one value."""
    left = values.withColumn("bucket", F.expr(f"substring(bytes, 1, {LEVEL_BYTES})"))
    settled = None
    while True:
        counted = left.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        large = materialize(counted.where((F.col("rows") > bucket_rows) & (F.col("low") != F.col("high"))).select("bucket"), "large-buckets")
        fits = left.join(large, "bucket", "left_anti")
        settled = fits if settled is None else settled.unionByName(fits)
        if not large.limit(1).count():
            return settled
        inside = left.join(large, "bucket")
        ends = inside.groupBy("bucket").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
        lengths = ends.select("bucket", (F.arrow_udf(_shared_length, "int")("low", "high") + LEVEL_BYTES).alias("length"))
        # a value that ends where others go on is a bucket of its own
        left = materialize(inside.join(lengths, "bucket").select(*values.columns, F.expr("substring(bytes, 1, length)").alias("bucket")), "split-rows")


def format_copies(df: DataFrame, id_col: str, title_col: str, text_col: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(groups (digest, kept, copies) of at least two records, members (id, digest) of all records with text)."""
    some = df.select(F.col(id_col).cast("long").alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = materialize(some.mapInArrow(_canonical_rows, "kind int, id long, digest binary, n long, bytes binary"), "canonical-rows")
    members = rows.where("kind = 0").select("id", "digest")
    values = rows.where("kind = 1").select("bytes", "id", "digest", "n")
    placed = _buckets(values, bucket_rows).select("bucket", "id", "digest", "n", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    groups = materialize(placed.mapInArrow(_count_buckets, "digest binary, kept long, copies long"), "copy-groups")
    return groups, members


def copy_pairs(df: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """(kept, copy): each other member of a group with the group's lowest id."""
    groups, members = format_copies(df, id_col, title_col, text_col)
    return members.join(groups, "digest").where("id <> kept").select("kept", F.col("id").alias("copy"))
