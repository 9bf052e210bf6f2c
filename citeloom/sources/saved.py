"""Derived tables that are written once for each state of the files they come from.

A table's version is a hash of its name, its parameters, and the paths, sizes
and times of all input files.  It is written under a fresh path, and only then
named by a manifest: a build that was cut off is never read, and of two builds
at once the last named is.  Whoever asks again reads the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.sources.scratch import scratch, shared
from citeloom.sources.tables import read_manifest, write_manifest


def fingerprint(*inputs: DataFrame) -> str:
    """A hash of path, size and modification time of every file of these tables."""
    seen = hashlib.sha256()
    for df in inputs:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        paths = sorted(df.inputFiles())
        held: dict[str, str] = {}
        for folder in sorted({p.rsplit("/", 1)[0] for p in paths}):
            place = jvm.org.apache.hadoop.fs.Path(folder)
            for s in place.getFileSystem(conf).listStatus(place):
                held[s.getPath().getName()] = f"{folder}:{s.getLen()}:{s.getModificationTime()}"
        for p in paths:
            seen.update(f"{p}|{held.get(p.rsplit('/', 1)[1], '')}\n".encode())
    return seen.hexdigest()


def saved(spark: SparkSession, name: str, inputs: list[DataFrame], build: Callable[[], DataFrame], *parameters: object) -> DataFrame:
    """``build()`` of this state of the inputs, from its written table if there is one."""
    version = hashlib.sha256(f"{name}|{parameters}|{fingerprint(*inputs)}".encode()).hexdigest()[:12]
    manifest = f"{shared(spark)}/saved/{name}-{version}"
    if found := read_manifest(spark, manifest):
        return spark.read.parquet(found["path"])
    path = scratch(spark, name)
    build().write.parquet(path)
    write_manifest(spark, manifest, {"path": path, "version": version})
    return spark.read.parquet(path)
