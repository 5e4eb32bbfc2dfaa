"""New batches against all accepted history: multi-key sorted neighbourhood over persisted, sorted key ranges.

Each accepted record has entries under several keys: one for each band of its DartMinHash signature, one for its shingle
set, one for its url identity. Entries are kept in runs: tables that are bucketed by key and sorted within the buckets.
A batch is turned into entries of its own, which alone are shuffled, and merged into each run; a new record is compared
with the window of entries that stand at its own keys, however many they are. Candidates of a band window are checked
exactly on their texts; equal sets and equal urls need no check. Then the batch is resolved in order: a record is refused
if a record accepted before it, in history or in this batch, repeats it. Accepted records make a new run; when there are
more than ``MAX_RUNS``, all but the largest are compacted into one.

History is never shuffled or shingled again: a batch reads the runs' key columns and fetches the texts of candidates only.

Copies within a batch go by their class, and history holds one entry for each class and each url (the lowest accepted
id), so a url or a text that a third of all rows hold costs one row. A band key of more than ``neardup.BLOCK`` entries
is cut into blocks, and a batch's entry is sent to each block.

Null, empty and wordless texts repeat nothing by text; null and blank urls have no identity; rows with a null id or a null batch
are not taken part in. Further columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import neardup
from lexmill.llm import shingles as S
from lexmill.storage import drop_path, materialize, release, scratch_path

MAX_RUNS = 4
#: Ids that are broadcast to fetch texts; beyond it a shuffled semi-join does it.
BROADCAST_IDS = 200_000
#: Rows of a batch with its links that are resolved one by one on the driver; beyond it rounds over tables do it.
ORDERED_ROWS = 200_000
BAND, SET, URL = 0, 1, 2


def url_identity(url: Column) -> Column:
    """DOI, W number or PM number if the url carries one, else its address without what does not matter."""
    plain = F.regexp_replace(F.trim(url), "(?i)%2F", "/")
    doi = F.regexp_extract(F.lower(plain), r"(10\.\d{4,9}/[^\s?#&\"<>]*[^\s?#&\"<>/.,;])", 1)
    work = F.regexp_extract(F.lower(plain), r"(?:^|[/:=])(w\d{6,})(?=$|[/?#&])", 1)
    paper = F.regexp_extract(F.lower(plain), r"(?:^|[/:=])(?:pm|pmid|pubmed)[/:=]?(\d{5,})(?=$|[/?#&])", 1)
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*:/+", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:\d+$", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), "/+$", "")
    tracking = r"(?i)(^|&)(utm_[^=&]*|gclid|fbclid|msclkid|dclid|mc_[ce]id|igshid|ref|ref_src)(=[^&]*)?(?=&|$)"
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(tail, r"\?(.*)$", 1), tracking, ""), "^&+", "")
    address = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return (
        F.when(url.isNull() | (F.trim(url) == ""), F.lit(None).cast("string"))
        .when(doi != "", F.concat(F.lit("doi:"), doi))
        .when(work != "", F.concat(F.lit("work:"), work))
        .when(paper != "", F.concat(F.lit("paper:"), paper))
        .otherwise(F.concat(F.lit("at:"), address))
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = S.shingle_sets(batch.column(3).to_pylist())
        sizes = np.diff(offsets)
        f1, f2 = S.fingerprints(flat, offsets)
        keys = S.band_keys(S.dart_min_hash(flat, offsets, neardup.BANDS * neardup.ROWS), neardup.BANDS, neardup.ROWS)
        some = sizes > 0
        ends = np.concatenate([[0], np.cumsum(some * neardup.BANDS)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int32()), pa.array(f1), pa.array(f2), neardup._list_array(keys[some].ravel(), ends)],
            names=["id", "batch", "url", "n", "f1", "f2", "keys"],
        )


def record_features(df: DataFrame, id_col: str, batch_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, url, n, f1, f2, keys, batch), written once, by batch: each record is worked through when it arrives and never again."""
    some = df.select(F.col(id_col).cast("long").alias("id"), F.col(batch_col).cast("int").alias("batch"), url_identity(F.col(url_col)).alias("url"), F.col(text_col).alias("text"))
    made = some.where("id is not null and batch is not null").mapInArrow(_features, "id long, batch int, url string, n int, f1 long, f2 long, keys array<long>")
    return materialize(made.select("id", "url", "n", "f1", "f2", "keys", "batch"), "batch-features", ["batch"])


def _entries(records: DataFrame) -> DataFrame:
    """(kind, key, check, id) of records: bands and sets by the class's representative, urls by the lowest id."""
    with_text = records.where("n > 0")
    reps = with_text.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"))
    sets = reps.select(F.lit(SET).alias("kind"), F.col("f1").alias("key"), F.col("f2").alias("check"), "id")
    bands = with_text.join(reps.select("id"), "id", "left_semi").select(F.lit(BAND).alias("kind"), F.explode("keys").alias("key"), F.lit(0).cast("long").alias("check"), "id")
    urls = records.where("url is not null").groupBy("url").agg(F.min("id").alias("id"))
    urls = urls.select(F.lit(URL).alias("kind"), F.xxhash64("url").alias("key"), F.xxhash64(F.lit("identity"), "url").alias("check"), "id")
    return bands.unionByName(sets).unionByName(urls)


class HistoryIndex:
    """The persisted runs of all accepted records, and the texts they came from (id, text)."""

    def __init__(self, spark: SparkSession, texts: DataFrame, max_runs: int = MAX_RUNS):
        self.spark, self.texts, self.max_runs = spark, texts, max_runs
        self.buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
        #: The most entries that a band key had in the last batch.
        self.most = 0
        #: (table, path, rows, the run's hot keys with their number of blocks or None, a bound of the entries of one band key)
        self.runs: list[tuple[str, str, int, DataFrame | None, int]] = []

    def _write(self, entries: DataFrame, most: int | None = None) -> None:
        """A run of entries (kind, key, check, id): bucketed by key, sorted within buckets. Entries of band keys beyond a block's size are spread
        over further keys; base holds their own. most: a bound of the entries of one band key, if it is known."""
        counts = entries.where(F.col("kind") == BAND).groupBy("key").agg(F.count("*").alias("members"))
        if most is None:
            most = counts.agg(F.max("members")).first()[0] or 0
        hot = None
        if most > neardup.BLOCK:
            hot = materialize(counts.where(F.col("members") > neardup.BLOCK).select("key", F.ceil(F.col("members") / neardup.BLOCK).cast("int").alias("blocks")), "hot-keys")
            block = F.when(F.col("kind") == BAND, F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))).otherwise(F.lit(0))
            entries = entries.join(hot, "key", "left").select("kind", self._spread(F.col("key"), block).alias("key"), "check", "id", F.when(block > 0, F.col("key")).alias("base"))
        else:
            entries = entries.select("kind", "key", "check", "id", F.lit(None).cast("long").alias("base"))
        name, path, seen = f"run_{uuid.uuid4().hex[:12]}", scratch_path(self.spark, "history-run"), Observation()
        placed = entries.observe(seen, F.count(F.lit(1)).alias("rows")).repartition(self.buckets, "key")
        placed.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.runs.append((name, path, seen.get["rows"], hot, most))

    @staticmethod
    def _spread(key: Column, block: Column) -> Column:
        return F.when(block == 0, key).otherwise(F.xxhash64(key, block))

    def add(self, records: DataFrame, most: int | None = None) -> None:
        """Accepted records become a run; runs are compacted when there are too many."""
        self._write(_entries(records), most)
        if len(self.runs) > self.max_runs:
            self.runs.sort(key=lambda run: -run[2])
            old = self.runs[1:]
            self.runs = self.runs[:1]
            merged = None
            for name, *_ in old:
                entries = self.spark.table(name).select("kind", F.coalesce("base", "key").alias("key"), "check", "id")
                merged = entries if merged is None else merged.unionByName(entries)
            bound = sum(run[4] for run in old)
            self._write(merged, bound if bound <= neardup.BLOCK else None)
            kept, self.runs = self.runs, old
            self.drop()
            self.runs = kept

    def drop(self) -> None:
        """Delete all runs."""
        for name, path, *_ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)
        self.runs = []

    def windows(self, entries: DataFrame) -> DataFrame:
        """(kind, id, other): for each new entry the history entries at its key."""
        found = None
        for name, _, _, hot, _ in self.runs:
            mine = entries
            if hot is not None:
                blocks = entries.join(hot, "key", "left").select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == BAND, F.coalesce("blocks", F.lit(1)) - 1).otherwise(0))).alias("block"))
                mine = blocks.select("kind", self._spread(F.col("key"), F.col("block")).alias("key"), "check", "id").distinct()
            run = self.spark.table(name).select(F.col("kind").alias("run_kind"), "key", F.col("check").alias("run_check"), F.col("id").alias("other"))
            # not as further keys: a join by more than the buckets' key would shuffle the run
            alike = (F.col("kind").bitwiseXOR(F.col("run_kind")) == 0) & (F.col("check").bitwiseXOR(F.col("run_check")) == 0)
            hits = run.join(mine.hint("shuffle_hash"), "key").where(alike).select("kind", "id", "other")
            found = hits if found is None else found.unionByName(hits)
        return found

    def links(self, records: DataFrame) -> tuple[DataFrame, int]:
        """(kind, id, other) and its number of rows: what the records, by class and url, repeat of history (SET, URL, BAND) and
        of their own batch (-1, both ways of a pair once, other < id). Band candidates have been checked on their texts."""
        entries = materialize(_entries(records), "batch-entries")
        bands = entries.where(F.col("kind") == BAND)
        old = self.windows(entries)
        counted = Observation()
        shared = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").observe(counted, F.max("members").alias("most"))
        shared = materialize(shared, "shared-keys")
        self.most = counted.get["most"] or 1
        if self.most > neardup.BLOCK:
            pairs = neardup.paired_entries(bands.select("id", "key"))
        else:
            held = bands.join(shared, "key").select("key", "id")
            pairs = held.select("key", F.col("id").alias("a")).join(held.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
        new = pairs.select(F.lit(-1).alias("kind"), F.col("b").alias("id"), F.col("a").alias("other"))
        seen = Observation()
        hits = materialize(old.unionByName(new).distinct().observe(seen, F.count(F.when(F.col("kind") <= 0, 1)).alias("pairs"), F.count(F.lit(1)).alias("rows")), "windows")
        sure = hits.where("kind > 0").select("kind", "id", "other")
        if not seen.get["pairs"]:
            return sure, seen.get["rows"]
        pairs = hits.where("kind <= 0").select(F.col("other").alias("a"), F.col("id").alias("b"), "kind")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if 2 * seen.get["pairs"] <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = materialize(neardup.shingle_table(self.texts, "id", "text", ids), "candidate-sets")
        near = neardup.exact_similarity(pairs, sets, neardup.THRESHOLD, ["kind"]).select("kind", F.col("b").alias("id"), F.col("a").alias("other"))
        return sure.unionByName(materialize(near, "batch-links")), seen.get["rows"]

    def resolve(self, records: DataFrame, rows: int) -> DataFrame:
        """(id, kept) of the refused ones of a batch of that many rows: kept is the lowest accepted id that the record repeats."""
        links, found = self.links(records)
        return self._in_order(records, links) if rows + found <= ORDERED_ROWS else self._in_rounds(records, links)

    def _in_order(self, records: DataFrame, links: DataFrame) -> DataFrame:
        """Record by record, for batches of a checked size."""
        batch = records.select("id", "n", "f1", "f2", F.when(F.col("url").isNotNull(), F.xxhash64("url")).alias("hash")).toPandas().sort_values("id")
        said = links.toPandas()
        first: dict[tuple, int] = {}
        for row in batch.itertuples(index=False):
            if row.n:
                first.setdefault((row.f1, row.f2, row.n), row.id)
        url_of = dict(zip(batch["id"], batch["hash"].astype("object"))) if batch["hash"].dtype != object else dict(zip(batch["id"], batch["hash"]))
        past: dict[tuple, int] = {}
        beside: dict[int, list[int]] = {}
        for kind, rep, other in zip(said["kind"], said["id"], said["other"]):
            if kind == -1:
                beside.setdefault(rep, []).append(other)
                beside.setdefault(other, []).append(rep)
            else:
                key = ("url", url_of[rep]) if kind == URL else ("class", rep)
                past[key] = min(past.get(key, other), other)
        accepted: dict[tuple, int] = {}
        refused = []
        for row in batch.itertuples(index=False):
            own = [("class", first[row.f1, row.f2, row.n])] if row.n else []
            if url_of[row.id] is not None and url_of[row.id] == url_of[row.id]:
                own.append(("url", url_of[row.id]))
            seen = [p[k] for k in own for p in (past, accepted) if k in p]
            seen += [accepted[k] for c in own if c[0] == "class" for r in beside.get(c[1], ()) if (k := ("class", r)) in accepted]
            if seen:
                refused.append((int(row.id), int(min(seen))))
            else:
                accepted |= {k: row.id for k in own}
        ids, kept = zip(*refused) if refused else ((), ())
        return self.spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.int64())})).coalesce(1)

    def _in_rounds(self, records: DataFrame, links: DataFrame) -> DataFrame:
        """In rounds over the whole batch, for batches of any size; as many as the longest chain of records that hang on each other."""
        reps = records.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
        placed = records.select("id", "url", "n", "f1", "f2").join(reps, ["f1", "f2", "n"], "left")
        placed = materialize(placed.select("id", F.col("rep").cast("long").alias("rep"), F.xxhash64("url").alias("hash"), F.col("url").isNotNull().alias("has_url")), "batch-records")
        belongs = placed.where("rep is not null").select("id", F.lit(SET).alias("kind"), F.col("rep").alias("key")).unionByName(
            placed.where("has_url").select("id", F.lit(URL).alias("kind"), F.col("hash").alias("key"))
        )
        # What history says, by class and by url
        by_class = links.where(F.col("kind").isin(BAND, SET)).select(F.col("id").alias("key"), F.col("other").alias("a"))
        url_of = placed.where("has_url").select("id", "hash")
        by_url = links.where(F.col("kind") == URL).select("id", "other").join(url_of, "id").select(F.col("hash").alias("key"), F.col("other").alias("a"))
        past = by_class.groupBy("key").agg(F.min("a").alias("past")).withColumn("kind", F.lit(SET)).unionByName(by_url.groupBy("key").agg(F.min("a").alias("past")).withColumn("kind", F.lit(URL)))
        past = belongs.join(past, ["kind", "key"]).groupBy("id").agg(F.min("past").alias("past"))
        # Who has to look at whom within the batch
        edges = links.where("kind = -1").select("id", "other")
        edges = edges.union(edges.select("other", "id")).toDF("rep", "key")
        watch = belongs.unionByName(placed.select("id", "rep").join(edges, "rep").select("id", F.lit(SET).alias("kind"), "key"))
        state = placed.select("id").join(past, "id", "left").withColumn("status", F.when(F.col("past").isNull(), 0).otherwise(2))
        while True:
            view = self._view(belongs, watch, state)
            seen = Observation()
            state = materialize(
                state.join(view, "id", "left")
                .withColumn("status", F.when(F.col("status") != 0, F.col("status")).when(F.col("refused"), 2).when(F.col("waits"), 0).otherwise(1))
                .select("id", "past", "status")
                .observe(seen, F.count(F.when(F.col("status") == 0, 1)).alias("open")),
                "batch-state",
            )
            if not seen.get["open"]:
                break
        return state.where("status = 2").join(self._view(belongs, watch, state), "id", "left").select("id", F.least("past", "first").alias("kept"))

    @staticmethod
    def _view(belongs: DataFrame, watch: DataFrame, state: DataFrame) -> DataFrame:
        """By record: the lowest accepted id before it that it repeats (first); does one refuse it; does it wait for an undecided one."""
        groups = belongs.join(state.where("status < 2"), "id").groupBy("kind", "key")
        groups = groups.agg(F.min(F.when(F.col("status") == 1, F.col("id"))).alias("accepted"), F.min(F.when(F.col("status") == 0, F.col("id"))).alias("undecided"))
        before = F.when(F.col("accepted") < F.col("id"), F.col("accepted"))
        return watch.join(groups, ["kind", "key"]).groupBy("id").agg(
            F.min(before).alias("first"), F.count(before).cast("boolean").alias("refused"), F.count(F.when(F.col("undecided") < F.col("id"), 1)).cast("boolean").alias("waits")
        )


def refused_records(df: DataFrame, id_col: str, batch_col: str, url_col: str, text_col: str) -> DataFrame:
    """(kept, id) of all refused records: the first batch is accepted as it is, each later one is merged in turn."""
    spark = df.sparkSession
    features = record_features(df, id_col, batch_col, url_col, text_col)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(batch_col).cast("int").alias("batch"), F.col(text_col).alias("text"))
    sizes = {r.batch: r["count"] for r in features.groupBy("batch").count().collect()}
    numbers = sorted(sizes)
    index, results = HistoryIndex(spark, texts), []
    for number in numbers:
        records = features.where(F.col("batch") == number)
        index.texts = texts.where(F.col("batch") <= number)
        if number == numbers[0]:
            index.add(records)
            continue
        refused = materialize(index.resolve(records, sizes[number]), "refused")
        results.append(refused.select("kept", "id"))
        if number != numbers[-1]:
            index.add(records.join(refused.select("id"), "id", "left_anti"), index.most)
        release(spark)
    index.drop()
    if not results:
        return spark.createDataFrame([], "kept long, id long")
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    return every
