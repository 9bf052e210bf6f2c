"""Corpus checks as tables of violations, and the window forms that reading pages needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import digit_signature, shape


def missing(expected: DataFrame, there: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows with no counterpart."""
    return expected.join(there.select(*on), on, "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def integrity(rows: DataFrame, key: str, required: list[str], content: str, markers: list[str]) -> DataFrame:
    """(key, problem): required fields that are null or empty, and editorial markers in the content; one pass."""
    lacks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    marks = [F.when(F.contains(F.col(content), F.lit(m)), F.lit(f"editorial marker {m}")) for m in markers]
    found = F.filter(F.array(*lacks, *marks), lambda p: p.isNotNull())
    return rows.select(key, F.explode(found).alias("problem"))


def furniture_signatures(lines: DataFrame, share: float = 0.3, depth: int = 2) -> DataFrame:
    """source, slot, signature, pages: edge lines on at least max(2, int(share * pages)) pages of a document.

    lines: source, page, line_no, n, line.  A (slot, signature) counts once a page.
    """
    own = lines.filter(F.length(F.trim("line")) > 0).withColumn("signature", digit_signature(F.col("line")))
    edge = own.filter(F.col("line_no") <= depth).select("source", "page", F.concat(F.lit("top"), F.col("line_no") - 1).alias("slot"), "signature")
    edge = edge.union(own.filter(F.col("n") - F.col("line_no") < depth).select("source", "page", F.concat(F.lit("bot"), F.col("n") - F.col("line_no")), "signature"))
    every = lines.select("source", "page").distinct().groupBy("source").agg(F.count("*").alias("all"))
    by = edge.distinct().groupBy("source", "slot", "signature").agg(F.count("*").alias("pages"))
    return by.join(every, "source").filter(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("all") * share))).select("source", "slot", "signature", "pages")


def furniture_lines(lines: DataFrame, share: float = 0.3, depth: int = 2) -> DataFrame:
    """(page, line_no) of furniture: edge lines with a qualifying signature, and bare numbers within a line more."""
    own = lines.filter(F.length(F.trim("line")) > 0).withColumn("signature", digit_signature(F.col("line")))
    known = furniture_signatures(lines, share, depth).select("source", "signature").distinct().withColumn("known", F.lit(True))

    def edge(k: int) -> Column:
        return (F.col("line_no") <= k) | (F.col("n") - F.col("line_no") < k)

    found = own.filter(edge(depth + 1)).join(known, ["source", "signature"], "left")
    bare = F.rlike(F.trim("line"), F.lit("^[0-9]+$"))
    return found.filter((edge(depth) & F.col("known").isNotNull()) | bare).select("page", "line_no")


def award_furniture(lines: DataFrame, share: float = 0.5, depth: int = 3) -> DataFrame:
    """source, shape, n: edge line shapes on at least max(3, share * pages) pages of documents of three pages or more."""
    edge = lines.filter((F.length(F.trim("line")) > 0) & ((F.col("line_no") <= depth) | (F.col("n") - F.col("line_no") < depth)))
    every = lines.select("source", "page").distinct().groupBy("source").agg(F.count("*").alias("all")).filter("all >= 3")
    by = edge.select("source", "page", shape(F.col("line")).alias("shape")).distinct().groupBy("source", "shape").agg(F.count("*").alias("n"))
    return by.join(every, "source").filter(F.col("n") >= F.greatest(F.lit(3.0), F.col("all") * share)).select("source", "shape", "n")


def blocks(rows: DataFrame, by: list[str], order: list[str], at: Column, gap: float) -> DataFrame:
    """``rows`` with block: a row further than ``gap`` (seconds, or units) after the one before opens a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    apart = at.cast("double") - F.lag(at.cast("double")).over(w)
    fresh = F.when(apart <= gap, 0).otherwise(1)
    return rows.withColumn("__fresh", fresh).withColumn("block", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before its position (plus tolerance).

    Both sides are put in one order, rows of ``right`` first at equal
    positions, and the last value is carried forward: one shuffle, no range join.
    """
    side = left.withColumns({"__at": F.col(at).cast("double") + tolerance, "__side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    marks = right.withColumns({"__at": F.col(at).cast("double"), "__side": F.lit(0)})
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = side.unionByName(marks, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__side = 1").select(*left.columns, value)


def constraint_problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` that break a rule, once for each; a null verdict is no problem."""
    found = [rows.filter(~ok).withColumn("problem", F.lit(name)) for name, ok in rules.items()]
    return reduce(DataFrame.unionByName, found)
