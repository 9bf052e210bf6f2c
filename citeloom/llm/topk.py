"""Exact top-k by inner product: columnar branch and bound.

Vectors are packed in blocks in vertical layout (dimension by dimension).  For
a query, partial scores grow by blocks of dimensions; a candidate's best
possible score is its partial score plus the product of both remaining norms.
Whoever cannot reach the query's k-th best lower bound is compacted away before
the next block of dimensions.  Queries meet candidates block by block: every
block of queries goes to every block of candidates, only the best k of a pair of
blocks leave the task, and a task's next blocks start from the k-th best scores
of those before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.storage import bounded_batches, written

#: Every vec_id that this divides is a query.
QUERY_EVERY = 50
K, SCALE = 5, 256
#: Rows of a block of queries and of candidates, dimensions of a step, and blocks of queries whose best scores a task holds.
QUERY_ROWS, CANDIDATE_ROWS, DIMENSIONS, HELD = 512, 4096, 16, 1024
_PACK = "dim int, ids binary, cells binary"
_HIT = "query_id long, vec_id long, score long"


def _pack(rows: int):
    """Blocks of at most ``rows`` vectors of one dimension: ids, and components in vertical layout."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_blocks: dict[int, list[tuple[int, np.ndarray]]] = {}

        def closed(dim: int) -> pd.DataFrame:
            block = open_blocks.pop(dim)
            cells = np.array([v for _, v in block], np.int64).reshape(len(block), dim).T
            return pd.DataFrame({"dim": [dim], "ids": [np.array([i for i, _ in block], np.int64).tobytes()], "cells": [np.ascontiguousarray(cells).tobytes()]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["v"], strict=True):
                v = np.asarray(v)
                block = open_blocks.setdefault(len(v), [])
                block.append((i, v))
                if len(block) == rows:
                    yield closed(len(v))
        for dim in list(open_blocks):
            yield closed(dim)

    return run


def _unpack(dim: int, ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(cells, np.int64).reshape(dim, len(names))


def _norms_after(cells: np.ndarray) -> np.ndarray:
    """Row b: the norm of what is left of each vector after b blocks of dimensions (rounded up)."""
    square = cells.astype(np.float64) ** 2
    left = [np.sqrt(square[at:].sum(axis=0)) * (1 + 1e-9) for at in range(0, max(1, len(cells)), DIMENSIONS)]
    return np.array([*left, np.zeros(cells.shape[1])])


def _exact(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Where doubles are no longer exact: unbounded integers.  The column is a long, so scores outside of one are written as its ends, after ranking."""
    scores = q.astype(object).T @ c.astype(object) if len(q) else np.zeros((len(q_ids), len(c_ids)), object)
    out = []
    for own, row in zip(q_ids, scores, strict=True):
        best = sorted((-s, int(v)) for s, v in zip(row, c_ids, strict=True) if v != own)[:k]
        out += [(int(own), v, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, v in best]
    return out


def best_of_blocks(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K, known: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's best k candidates of other ids; ties go to smaller ids.

    ``q`` and ``c`` hold integers in vertical layout (dimension, vector).
    ``known`` (query, k) has the best scores of other candidates in ascending
    order: candidates that cannot reach the first of them are left out, and it
    is brought up to date.
    """
    dims = len(q)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dims)
    if top >= 2**52:
        return _exact(q_ids, q, c_ids, c, k)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    q_left, c_left = _norms_after(q), _norms_after(c)
    start = qf[:DIMENSIONS].T @ cf[:DIMENSIONS]  # the first block of dimensions, for all queries at once
    out = []
    for i, own in enumerate(q_ids):
        alive = np.flatnonzero(c_ids != own)
        partial = start[i, alive]
        least = known[i, 0] if known is not None else -np.inf
        for b, at in enumerate(range(0, max(dims, 1), DIMENSIONS), 1):
            if b > 1:
                partial = partial + qf[at : at + DIMENSIONS, i] @ cf[at : at + DIMENSIONS, alive]
            slack = q_left[b, i] * c_left[b, alive]
            floor = least
            if len(alive) > k:
                floor = max(floor, np.partition(partial - slack, len(alive) - k)[len(alive) - k])
            stay = partial + slack >= floor - 0.5
            alive, partial = alive[stay], partial[stay]
        best = np.lexsort((c_ids[alive], -partial))[:k]
        out += [(int(own), int(c_ids[alive[j]]), int(partial[j])) for j in best]
        if known is not None:
            known[i] = np.sort(np.concatenate((known[i], partial[best])))[-known.shape[1] :]
    return out


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the components floor(256 x); vectors null, or with null or non-finite components, take no part."""
    x = df[vector]
    fit = x.isNotNull() & df[key].isNotNull() & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    return df.filter(fit).select(df[key].cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")).alias("v"))


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """Each query's k highest integer inner products with all other rows: query_id, rank, vec_id, score.

    Rows of a query's own id are no candidates.  Vectors meet only those of
    their own dimension.  Repeated rows are repeated candidates; repeated
    queries share one list.  An empty table, or one without queries, gives none.
    """
    bounded_batches(df.sparkSession)
    rows = quantised(df, key, vector)
    ask = quantised(df.filter(is_query), key, vector).dropDuplicates(["vec_id", "v"])
    packed = ask.mapInPandas(_pack(QUERY_ROWS), _PACK).withColumn("own", F.monotonically_increasing_id())
    packed = written(packed, "query-packs")
    numbers = packed.select("own", (F.row_number().over(Window.orderBy("own")) - 1).alias("pack"))  # a number for QUERY_ROWS queries
    queries = packed.join(numbers, "own").drop("own")
    count = packed.count()
    candidates = rows.mapInPandas(_pack(CANDIDATE_ROWS), _PACK)
    candidates = candidates.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array(F.lit(-1))))
    pairs = candidates.alias("c").join(queries.alias("q"), ["pack", "dim"]).select("pack", "dim", F.col("q.ids").alias("qi"), F.col("q.cells").alias("qc"), F.col("c.ids").alias("ci"), F.col("c.cells").alias("cc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                (q_ids, q), (c_ids, c) = _unpack(r.dim, r.qi, r.qc), _unpack(r.dim, r.ci, r.cc)
                known = held.setdefault((r.pack, r.dim), np.full((len(q_ids), k), -np.inf))
                yield pd.DataFrame(best_of_blocks(q_ids, q, c_ids, c, k, known), columns=["query_id", "vec_id", "score"])
                if len(held) > HELD:
                    held.pop(next(iter(held)))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.mapInPandas(run, _HIT).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
