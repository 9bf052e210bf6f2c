"""Readers and writers.

Parquet has no MERGE: an upsert or a delete is the rewrite of the rows that
stay, and the caller publishes it under a new version's path.
"""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime
from functools import reduce

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, with null fields and characters beyond ASCII kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; with ``bom`` the first column's name begins with a byte order mark, for spreadsheets."""
    first = df.columns[0]
    named = df.withColumnRenamed(first, BOM + first) if bom else df
    named.write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte order mark before the first name goes."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*(c.removeprefix(BOM) for c in df.columns))


def write_manifest(spark: SparkSession, path: str, entries: dict[str, str | int]) -> None:
    columns = [F.lit(v).alias(k) for k, v in entries.items()]
    spark.range(1).select(*columns).coalesce(1).write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest's entries, None if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.json(path).limit(1).collect()
    return rows[0].asDict() if rows else None


def unified(*parts: DataFrame, lists: tuple[str, ...] = ()) -> DataFrame:
    """The union by name of all columns; missing and null values of ``lists`` are empty arrays, others null."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.withColumns({c: F.coalesce(c, F.array().cast(every.schema[c].dataType)) for c in lists})


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without_other_versions(df: DataFrame, version: str, column: str = "index_version") -> tuple[DataFrame, DataFrame]:
    """Rows of one version, and a table with the number of the others (rows without a version count among them)."""
    own = F.coalesce(F.col(column) == version, F.lit(False))
    return df.filter(own), df.agg(F.count_if(~own).alias("deleted"))


def corpus_version(df: DataFrame, columns: list[str]) -> str:
    """Twelve hexadecimal digits that change with any row: a hash of the order-free sums of row hashes."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    sums = df.agg(F.sha2(F.concat_ws("-", F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)"))), 256).alias("v")).collect()
    return sums[0].v[:12]


def build_if_changed(spark: SparkSession, chunks: DataFrame, base: str, columns: list[str], force: bool = False) -> dict:
    """Write chunks under ``base``/<version> unless the manifest, the row count and the table say it is there.

    Returns the manifest's entries and ``built``.
    """
    version = corpus_version(chunks, columns)
    path, manifest = f"{base}/chunks/{version}", f"{base}/manifest"
    found = read_manifest(spark, manifest)
    if not force and found and found.get("version") == version:
        table = spark.read.parquet(path)
        if table.count() == found["chunks"] == chunks.count():
            return found | {"built": False}
    began = time.monotonic()
    chunks.write.mode("overwrite").parquet(path)
    entries = {"version": version, "chunks": spark.read.parquet(path).count(), "seconds": round(time.monotonic() - began, 3), "built_at": datetime.now(UTC).isoformat(timespec="seconds")}
    write_manifest(spark, manifest, entries)
    return entries | {"built": True}


def read_registry(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The list ``part`` of a YAML file as rows; entries are maps, and nested ones and dates become JSON text."""
    whole = spark.read.text(path, wholetext=True).head()
    rows = (yaml.safe_load(whole.value) if whole else None) or {}
    plain = [{k: v if isinstance(v, (str, int, float, bool)) or v is None else json.dumps(v, default=str, ensure_ascii=False) for k, v in entry.items()} for entry in rows.get(part) or []]
    names = list(dict.fromkeys(k for entry in plain for k in entry))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(None if entry.get(n) is None else str(entry[n]) for n in names) for entry in plain], schema)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary files as path, length and content; only what is selected is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def write_report(problems: DataFrame, folder: str, name: str, day: str, counts: dict[str, int] | None = None) -> int:
    """Write ``folder``/``day``_``name``: its problems as JSON lines and a summary beside them; 1 if there is any problem, else 0."""
    path = f"{folder}/{day}_{name}"
    write_jsonl(problems, f"{path}/problems")
    n = problems.sparkSession.read.text(f"{path}/problems").count()
    write_manifest(problems.sparkSession, f"{path}/summary", {"day": day, "problems": n, **(counts or {})})
    return int(n > 0)


def without_mark(lines: DataFrame, mark: str | None, column: str = "line") -> DataFrame:
    """``lines`` without those that hold a watermark; all if none is given."""
    return lines if not mark else lines.filter(F.col(column).isNull() | ~F.contains(F.col(column), F.lit(mark)))


def write_chunk_table(chunks: DataFrame, path: str, partitions: tuple[str, ...] = ("index_version", "jurisdiction"), order: tuple[str, ...] = ("document", "section", "chunk_id")) -> None:
    """The chunk table, laid out for its filters: a folder for each version and jurisdiction, files sorted by document, section and id.

    A filter by version or jurisdiction reads its folders only; one by document,
    section or id skips files and row groups by their bounds.  Rows are dealt by
    ranges of partition and order, so a large folder is many files.
    """
    keys = [*partitions, *order]
    chunks.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(*partitions).parquet(path)
