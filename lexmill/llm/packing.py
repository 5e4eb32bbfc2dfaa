"""Filling containers of fixed capacity: dominance reduction, then best fit for what remains.

Items of one size are interchangeable, so a container plan needs only how many items there are of each size: at most as
many numbers as the capacity, whatever the number of documents. On these numbers sets of up to three items that dominate
every other way to use their largest item are fixed for good (Martello and Toth), each as often as its items last; the
remainder is placed by best fit decreasing, many equal containers at a time. The plan is a list of patterns, each with a
number of containers. Items are then ranked within their size, in chunks, and a rank tells container and place.

An item larger than the capacity fills containers of its own and only its rest is packed with others. Null texts are no
items; an empty text is an item of size 0 and goes into container 0. Null, zero or negative capacities have no containers. Repeated
specs pack again, repeated texts are items of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import tokens
from lexmill.storage import materialize

#: Items of one size that one task ranks.
CHUNK_ITEMS = 500_000
#: Specs, at most; they are read by the driver.
MOST_SPECS = 10_000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, items), ...), containers


class _Stock:
    """How many items are left of each size; sizes are kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        left = self.counts[size] - n
        if left:
            self.counts[size] = left
        else:
            del self.counts[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, most: int, without: dict[int, int]) -> int:
        """The largest size of at most most of which an item is left beside those in without; 0 if there is none."""
        k = bisect_right(self.sizes, most) - 1
        while k >= 0:
            size = self.sizes[k]
            if self.counts[size] > without.get(size, 0):
                return size
            k -= 1
        return 0


def _dominating(stock: _Stock, size: int, capacity: int) -> tuple[int, ...] | None:
    """The companions of an item in a set that dominates all its other sets of that stock, if up to two companions show it."""
    room = capacity - size
    own = {size: 1}
    first = stock.largest(room, own)
    if not first:
        return ()
    if first == room:
        return (first,)
    smallest = next((s for s in stock.sizes if stock.counts[s] > own.get(s, 0)), 0)
    if 2 * smallest > room:
        return (first,)  # no set has more than one companion
    if 3 * smallest <= room:
        return None
    # At most two companions: the largest one and the largest beside it dominate if no pair has a larger lesser member.
    second = stock.largest(room - first, {size: 1} | {first: 1 + own.get(first, 0)})
    k = bisect_right(stock.sizes, room // 2) - 1
    while k >= 0:
        lesser = stock.sizes[k]
        spare = stock.counts[lesser] - own.get(lesser, 0)
        if spare > 0 and (spare > 1 or stock.largest(room - lesser, own | {lesser: own.get(lesser, 0) + 1}) >= lesser):
            break
        k -= 1
    best = stock.sizes[k] if k >= 0 else 0
    if best <= second:
        return (first, second) if second else (first,)
    # A single companion dominates if every pair fits into its place.
    pair = max((a + b for a in stock.sizes[: bisect_right(stock.sizes, room)] if (b := stock.largest(room - a, own | {a: own.get(a, 0) + 1}))), default=0)
    return (first,) if pair <= first else None


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold all items of counts (size: items; no size over the capacity)."""
    stock, fixed = _Stock(counts), []
    moved = True
    while moved:
        moved = False
        for size in reversed(list(stock.sizes)):
            while stock.counts.get(size, 0):
                companions = _dominating(stock, size, capacity)
                if companions is None:
                    break
                need: dict[int, int] = {}
                for s in (size, *companions):
                    need[s] = need.get(s, 0) + 1
                times = min(stock.counts[s] // n for s, n in need.items())
                if not times:
                    break
                for s, n in need.items():
                    stock.take(s, n * times)
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                moved = True
    return fixed + _best_fit(stock, capacity)


def _best_fit(stock: _Stock, capacity: int) -> list[Pattern]:
    """Best fit decreasing over sizes: equal containers are filled together."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(room: int, content: tuple, containers: int) -> None:
        if not containers:
            return
        if room < stock.sizes[0]:
            done.append((content, containers))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append([content, containers])

    for size in reversed(list(stock.sizes)):
        left = stock.counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                content, containers = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(k)
            else:
                room, content, containers = capacity, (), left
            each = room // size
            full = min(left // each, containers)
            put(room - each * size, (*content, (size, each)), full)
            left -= full * each
            containers -= full
            if left and containers and left < each:
                put(room - left * size, (*content, (size, left)), 1)
                left, containers = 0, containers - 1
            if content:
                put(room, content, containers)
    done += [(content, containers) for held in open_by_room.values() for content, containers in held]
    return done


def _places(patterns: list[Pattern]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """By size: first ranks of runs of places, the first container of each run, places of that size in a container."""
    by_size: dict[int, tuple[list[int], list[int], list[int]]] = {}
    next_rank: dict[int, int] = {}
    base = 0
    for content, containers in patterns:
        for size, each in content:
            starts, bases, per = by_size.setdefault(size, ([], [], []))
            starts.append(next_rank.get(size, 0))
            bases.append(base)
            per.append(each)
            next_rank[size] = next_rank.get(size, 0) + each * containers
        base += containers
    return by_size


def pack(sizes: DataFrame, specs: DataFrame, scope_col: str = "source") -> DataFrame:
    """(spec_id, container, doc_id, part, token_start, tokens) for sizes (doc_id, scope column, tokens) and specs (spec_id, capacity_tokens, source_scope)."""
    wanted = [r for r in specs.select("spec_id", "capacity_tokens", "source_scope").limit(MOST_SPECS + 1).collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    spark = sizes.sparkSession
    if not wanted:
        return spark.createDataFrame([], "spec_id int, container long, doc_id long, part int, token_start long, tokens long")
    each = F.array(*[F.struct(F.lit(k).alias("spec"), F.lit(r.capacity_tokens).cast("long").alias("capacity"), F.lit(r.source_scope).cast("string").alias("scope")) for k, r in enumerate(wanted)])
    items = sizes.select("doc_id", F.col(scope_col).alias("own_scope"), "tokens", F.explode(each).alias("s")).where("s.scope is null or s.scope = own_scope")
    # all containers that a large item fills by itself are one row, its rest is another
    own = F.expr("tokens div s.capacity")
    rest = F.col("tokens") - own * F.col("s.capacity")
    items = materialize(items.select("s.spec", "s.capacity", "doc_id", "tokens", own.alias("own"), F.when((own > 0) & (rest == 0), None).otherwise(rest).alias("size")), "pack-items")
    counted = items.groupBy("spec", "size").agg(F.count("*").alias("n"), F.sum("own").alias("own")).collect()
    places, bases = {}, {}
    for k, r in enumerate(wanted):
        patterns = plan({c["size"]: c["n"] for c in counted if c["spec"] == k and c["size"]}, r.capacity_tokens)
        places[k] = {size: tuple(np.array(x, np.int64) for x in held) for size, held in _places(patterns).items()}
        bases[k] = sum(n for _, n in patterns)
    chunks = max(1, -(-max((c["n"] for c in counted), default=1) // CHUNK_ITEMS))
    ranked = _ranked(items.where("size is not null"), ["spec", "size"], chunks)
    shared = spark.sparkContext.broadcast((places, [int(r.spec_id) for r in wanted]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spec_ids = shared.value
        for batch in batches:
            spec, size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            container = np.zeros(len(spec), np.int64)
            order = np.lexsort((rank, size, spec))
            cuts = np.flatnonzero((np.diff(spec[order]) != 0) | (np.diff(size[order]) != 0)) + 1
            for run in np.split(order, cuts):
                if len(run) and size[run[0]] > 0:
                    starts, firsts, per = held[int(spec[run[0]])][int(size[run[0]])]
                    at = np.searchsorted(starts, rank[run], side="right") - 1
                    container[run] = firsts[at] + (rank[run] - starts[at]) // per[at]
            yield pa.RecordBatch.from_arrays([pa.array([spec_ids[k] for k in spec], pa.int32()), pa.array(container), *batch.columns[3:], batch.column(1)], names=["spec_id", "container", "doc_id", "part", "token_start", "tokens"])

    placed = ranked.select("spec", "size", "rank", "doc_id", F.col("own").cast("int").alias("part"), (F.col("own") * F.col("capacity")).alias("token_start"))
    packed = placed.mapInArrow(place, "spec_id int, container long, doc_id long, part int, token_start long, tokens long")
    # Containers that one item fills by itself come behind the others, numbered in chunks too.
    large = items.where("own > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    before = _running(large.groupBy("spec", "chunk").agg(F.sum("own").alias("n")), ["spec"])
    within = F.sum("own").over(Window.partitionBy("spec", "chunk").orderBy("doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    base = F.element_at(F.array(*[F.lit(bases[k]).cast("long") for k in range(len(wanted))]), F.col("spec") + 1)
    spec_id = F.element_at(F.array(*[F.lit(int(r.spec_id)) for r in wanted]), F.col("spec") + 1)
    own_rows = large.join(before, ["spec", "chunk"]).withColumn("first", base + F.col("before") + F.coalesce(within, F.lit(0)))
    own_rows = own_rows.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("part", "number"))
    own_rows = own_rows.select(spec_id.alias("spec_id"), (F.col("first") + F.col("number")).alias("container"), "doc_id", "part", (F.col("number") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"))
    return packed.unionByName(own_rows)


def _running(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, chunk, n) with before: what the chunks before hold."""
    window = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "chunk", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("before"))


def _ranked(items: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """items with rank, from 0 within keys, without a task that holds all of one key."""
    cut = items.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    number = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("doc_id")) - 1
    if chunks == 1:
        return cut.withColumn("rank", number.cast("long"))
    before = _running(cut.groupBy(*keys, "chunk").agg(F.count("*").alias("n")), keys)
    return cut.withColumn("number", number).join(before, [*keys, "chunk"]).withColumn("rank", F.col("before") + F.col("number"))


def containers(documents: DataFrame, specs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """The containers of each spec for documents (doc_id, source, text)."""
    return pack(tokens.token_sizes(documents, "text", ["doc_id", "source"], vocabulary), specs)
