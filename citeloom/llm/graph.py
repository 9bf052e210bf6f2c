"""Connected components of an edge table by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.storage import release, written


def _undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge between two different nodes once, as (hi, lo)."""
    return edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()


def _hooked(live: DataFrame, turn: int) -> DataFrame:
    """node and to, a node of the same component: the least neighbour's least neighbour's.

    Least is by number in even rounds, so that stars around small numbers end in
    one, and by a hash of the round in odd ones, so that no order of numbers is slow.
    """
    both = live.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(live.select("lo", "hi"))
    key = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(turn)))
    near = both.groupBy("node").agg(F.min(F.struct(key("other").alias("k"), F.col("other").alias("id"))).alias("best"))
    one = written(near.select("node", F.least(F.struct(key("node").alias("k"), F.col("node").alias("id")), F.col("best"))["id"].alias("to")), "hooks")
    jump = one.select(F.col("node").alias("to"), F.col("to").alias("far"))
    two = written(one.join(jump, "to").select("node", F.col("far").alias("to")), "hooks")
    release(one)
    return two


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes in ``edges`` (a, b: long).

    Every round maps each node to one of its component, relabels both ends of
    every edge, and drops loops and repeats: edges only ever get fewer, at least
    half of the nodes are expected to go in two rounds, and no label is sent
    along an edge.  Joins are on keys that are unique on one side; a hub's edges
    on the other are left to adaptive skew joins.  A null end makes no edge.
    """
    live, labels, turn = written(_undirected(edges, "a", "b"), "edges"), None, 0
    while not live.isEmpty():
        hooks = _hooked(live, turn)
        if labels is None:
            fresh = hooks.withColumnRenamed("to", "label")
        else:
            onward = hooks.select(F.col("node").alias("label"), "to")
            fresh = written(labels.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            release(labels)
        ends = live.join(hooks.select(F.col("node").alias("hi"), F.col("to").alias("a")), "hi").join(hooks.select(F.col("node").alias("lo"), F.col("to").alias("b")), "lo")
        rest = written(_undirected(ends, "a", "b"), "edges")
        release(live, hooks if labels is not None else None)
        live, labels, turn = rest, fresh, turn + 1
    if labels is None:
        return live.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return written(labels.join(least, "label").select("node", F.col("least").alias("label")), "components")
