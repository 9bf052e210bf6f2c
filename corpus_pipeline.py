"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

Language identification drops documents whose language is undetermined, line
deduplication drops repeated lines (and documents left without any), near
duplicates leave one document of each group, personal data is masked, and what
is left is packed into batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import langid, linededup, neardup, packing, pii
from citeloom.llm.storage import only, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", langid.keep_known),
    ("lines", linededup.without_repeats),
    ("near-duplicates", neardup.keep_one),
    ("personal-data", pii.without_personal_data),
    ("packing", packing.packed),
]

#: The learned language model and the near-duplicate hashing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written and read again, and what was written for it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, only(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
