"""Retrieval evaluation over run records and gold items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(found: Column, expected: Column) -> Column:
    wanted = F.array_distinct(expected)
    return F.size(F.array_intersect(F.array_distinct(found), wanted)) / F.size(wanted)


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    """1 / position of the first expected id, 0 without one."""
    hits = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(hits) > 0, 1.0 / F.array_min(hits)).otherwise(0.0)


def hit_at(ranked: Column, expected: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(ranked, 1, k), expected).cast("double")


def id_precision(found: Column, expected: Column) -> Column:
    own = F.array_distinct(found)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, F.array_distinct(expected))) / F.size(own)).otherwise(0.0)


def measured(records: DataFrame) -> DataFrame:
    """``records`` (ranked, final, expected arrays) with the seven metrics."""
    ranked, final, expected = F.col("ranked"), F.col("final"), F.col("expected")
    return records.withColumns(
        {
            "hit1": hit_at(ranked, expected, 1),
            "hit5": hit_at(ranked, expected, 5),
            "mrr": reciprocal_rank(ranked, expected),
            "recall_top5": recall(F.slice(ranked, 1, 5), expected),
            "recall_final": recall(final, expected),
            "id_precision": id_precision(final, expected),
            "id_recall": recall(final, expected),
        }
    )


METRICS = ("hit1", "hit5", "mrr", "recall_top5", "recall_final", "id_precision", "id_recall")
