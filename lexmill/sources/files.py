"""File sources and sinks: JSON lines with quarantine, text folders, shards, listings, tensor headers."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "ord long, url string, title string, text string, category string, broken string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, url, title, text, category, status); status is ok, invalid_json or missing_fields; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), F.from_json("value", _RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    missing = F.col("r.url").isNull() | F.col("r.title").isNull() | F.col("r.text").isNull()
    status = F.when(F.col("r.broken").isNotNull(), "invalid_json").when(missing, "missing_fields").otherwise("ok")
    return lines.select("file", "r.ord", "r.url", "r.title", "r.text", F.coalesce("r.category", F.lit("")).alias("category"), status.alias("status"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_text_folder(spark: SparkSession, path: str, endings: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(url, title, text): whole files below path; url tells where below it; the title is the first line that is not blank, without heading marks."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.regexp_extract(F.lower("path"), "[.]([a-z0-9]+)$", 1).isin(*endings))
    text = F.decode("content", "UTF-8")
    first = F.element_at(F.filter(F.split(text, "\\r?\\n"), lambda x: F.trim(x) != ""), 1)
    return files.select(F.concat(F.lit("local://"), F.expr(f"substring(path, locate('{root}/', path) + {len(root) + 1})")).alias("url"), F.trim(F.regexp_replace(F.trim(first), "^#+", "")).alias("title"), text.alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_shards(df: DataFrame, path: str, order: str, n: int) -> None:
    """N files of about equal size that follow each other in order."""
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)


def release_view(staged: DataFrame, block: int) -> DataFrame:
    """What is due at a block (publish_at)."""
    return staged.where(F.col("publish_at") <= block)


def tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, first, last) of the tensors that weight files list in their headers; broken files have none.

    Only paths and sizes are listed; of each file its first 8 bytes and its header are read, whatever its size.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, length in zip(batch["path"], batch["length"]):
                with fs.FileSystem.from_uri(_plain_uri(file))[0].open_input_file(fs.FileSystem.from_uri(_plain_uri(file))[1]) as source:
                    if length < 8:
                        continue
                    size = struct.unpack("<Q", source.read(8))[0]
                    if size > length - 8:
                        continue
                    try:
                        header = json.loads(source.read(size))
                    except ValueError:
                        continue
                for name, entry in header.items() if isinstance(header, dict) else ():
                    if name != "__metadata__" and isinstance(entry, dict) and len(entry.get("data_offsets", ())) == 2:
                        low, high = entry["data_offsets"]
                        if 0 <= low <= high <= length - 8 - size:
                            rows.append((file, name, str(entry.get("dtype")), [int(x) for x in entry.get("shape", [])], low, high))
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "first", "last"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInPandas(scan, "path string, name string, dtype string, shape array<long>, first long, last long")


def _plain_uri(path: str) -> str:
    """Hadoop writes file:/x where others want file:///x."""
    return path if "://" in path else path.replace("file:/", "file:///", 1)
