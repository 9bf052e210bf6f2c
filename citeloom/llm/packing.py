"""Packing by optimal length buckets.

The lengths of all rows form one histogram.  Dynamic programming over it picks
the bucket boundaries that minimise padding, and batches of a token budget form
inside each bucket, each row padded to its bucket's boundary.  A row that is
longer than the budget fits no batch: it is one by itself, unpadded and marked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.storage import written

BUCKETS, TOKEN_BUDGET = 8, 16_384
#: Parts of a bucket that are numbered apart: by the first two hexadecimal digits of the key's MD5.
CELLS = 256


def token_length(text: Column) -> Column:
    """Whitespace-separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` upper ends, the last being the largest length, that minimise padding to them.

    ``lengths`` ascend.  Each layer of the dynamic programme is solved by divide
    and conquer, a level of it at once: the best last cut never moves left as the
    prefix grows.  Of equal costs the smallest cut is taken, and of layers the
    first that reaches the least cost.
    """
    n = len(lengths)
    if not n:
        return []
    exact = float(lengths[-1]) * float(counts.sum()) < 2**62
    kind = np.int64 if exact else np.longdouble
    bins = lengths.astype(kind)
    size, mass = np.zeros(n + 1, kind), np.zeros(n + 1, kind)
    np.cumsum(counts.astype(kind), out=size[1:])
    np.cumsum(counts.astype(kind) * bins, out=mass[1:])

    def cost(cut: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Padding of lengths cut .. end - 1 in one bucket."""
        return bins[end - 1] * (size[end] - size[cut]) - (mass[end] - mass[cut])

    ends = np.arange(1, n + 1)
    best = np.concatenate((np.zeros(1, kind), cost(np.zeros(n, np.int64), ends)))
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        fresh, cut = np.zeros(n + 1, kind), np.zeros(n + 1, np.int64)
        lo, hi, first, last = (np.array([v]) for v in (1, n, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            many = np.minimum(last, mid - 1) - first + 1
            begin = np.cumsum(many) - many
            tried = np.arange(many.sum()) - np.repeat(begin - first, many)
            total = best[tried] + cost(tried, np.repeat(mid, many))
            least = np.minimum.reduceat(total, begin)
            hits = np.flatnonzero(total == np.repeat(least, many))
            k = tried[hits[np.searchsorted(hits, begin)]]
            fresh[mid], cut[mid] = least, k
            lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, k), (k, last)))
            open_ = lo <= hi
            lo, hi, first, last = lo[open_], hi[open_], first[open_], last[open_]
        if fresh[n] >= best[n]:
            break
        best = fresh
        cuts.append(cut)
    out, at = [], n
    for cut in reversed(cuts):
        if at:
            out.append(int(lengths[at - 1]))
            at = int(cut[at])
    return out[::-1]


def boundaries(lengths: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> list[int]:
    """The bucket boundaries of the rows of ``lengths`` (n) within the budget.

    The driver gets the histogram of their lengths, which has at most budget + 1 rows.
    """
    found = lengths.filter(F.col("n") <= budget).groupBy("n").agg(F.count("*").alias("rows")).orderBy("n").collect()
    return optimal_boundaries(np.array([r.n for r in found], np.int64), np.array([r.rows for r in found], np.int64), buckets)


def _bucketed(rows: DataFrame, ends: list[int], budget: int) -> DataFrame:
    """``rows`` (k, n) with bucket (from 0), bucket_length, over_budget and cell; rows beyond the budget share a last bucket, in which each has its own length."""
    over = F.col("n") > budget
    bounds = F.array(*(F.lit(e).cast("long") for e in ends)) if ends else F.array(F.lit(0).cast("long"))
    bucket = F.when(over, len(ends)).otherwise(F.size(F.filter(bounds, lambda e: e < F.col("n"))))
    rows = rows.withColumns({"bucket": bucket, "over_budget": over, "cell": F.substring(F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))), 1, 2)})
    return rows.withColumn("bucket_length", F.when(over, F.col("n")).otherwise(F.get(bounds, F.col("bucket"))))


PLACE = ("n_tokens", "bucket", "bucket_length", "batch", "slot", "padding", "over_budget")


def _numbered(rows: DataFrame, lengths: DataFrame, buckets: int, budget: int) -> DataFrame:
    """``rows`` (k, n and any others) with PLACE instead of n; ``lengths`` has k and n of the same rows, written."""
    ends = boundaries(lengths, buckets, budget)
    before = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = _bucketed(lengths, ends, budget).groupBy("bucket", "cell").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("k", "n")) - 1
    placed = _bucketed(rows, ends, budget).withColumn("at", at).join(F.broadcast(cells.select("bucket", "cell", "before")), ["bucket", "cell"])  # (buckets + 1) x CELLS rows
    rank = F.col("at") + F.col("before")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_length")))).cast("long")
    return placed.select(
        *(c for c in rows.columns if c != "n"),
        F.col("n").alias("n_tokens"),
        F.col("bucket"),
        F.col("bucket_length"),
        F.floor(rank / fit).cast("long").alias("batch"),
        (rank % fit).cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("n")).alias("padding"),
        "over_budget",
    )


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Key, n_tokens, bucket, bucket_length, batch (from 0 in its bucket), slot (from 0 in its batch), padding and over_budget.

    A batch of a bucket takes as many rows as fit the budget at the bucket's
    length; a row longer than the budget is a batch by itself, without padding
    and with over_budget.  Null and empty texts have no tokens and are packed
    too; repeated rows take a slot each; of ties the smaller key comes first
    within the key's cell.  Rows of a bucket are numbered in CELLS parts, so no
    task sorts a bucket.
    """
    lengths = written(df.select(df[key].alias("k"), token_length(df[text]).alias("n")), "lengths")
    return _numbered(lengths, lengths, buckets, budget).withColumnRenamed("k", key)


def packed(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its text, and its place (bucket, batch, slot and the rest of PLACE).

    A document is a doc_id with the hash of its text; rows that repeat both have
    equal lengths and take a slot each.  Texts move once, to the cell that
    numbers them.  Other columns stay, but for those that have the name of one
    of the place's, which give way.
    """
    key = F.struct(documents["doc_id"].alias("id"), F.xxhash64(documents["text"]).alias("hash"))
    length = token_length(documents["text"])
    own = [c for c in documents.columns if c not in PLACE]
    lengths = written(documents.select(key.alias("k"), length.alias("n")), "lengths")
    rows = documents.select(key.alias("k"), length.alias("n"), F.struct(*(documents[c] for c in own)).alias("own"))
    return _numbered(rows, lengths, BUCKETS, TOKEN_BUDGET).select("own.*", *PLACE)
