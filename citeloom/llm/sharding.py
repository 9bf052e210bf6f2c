"""Sharding by minimax contiguous partition of atomic groups.

Rows of equal text form a group that stays together.  Groups are ordered by
their key; running sums of their bytes give every possible cut.  The smallest
capacity under which a greedy walk needs no more than the wanted shards is
found by search; then the cuts are placed under that capacity, as evenly as it
allows.

All rows stay in DataFrame operations.  The driver holds cuts as a histogram of
several levels: of every range that it has asked about it knows the first and
last cut of each of FINE parts, and whether there are others between those.
That bounds a greedy walk from below and above, so most capacities are decided;
the ranges where the undecided ones end are asked about next, all in one job.
Every level makes ranges FINE times smaller, so a few jobs are enough for any
number of groups, and each brings (shards + 1) x FINE rows at most.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from citeloom.llm.storage import written

SHARDS = 16
#: Key ranges by the beginning of the key (in hexadecimal digits): of the running sums, and of the slots, where each has CELLS parts.
RANGE_DIGITS, ZONE_DIGITS, CELLS = 3, 2, 64
#: Parts of each range that is asked about.
FINE = 2048


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


class Cuts:
    """What is known of the ends of groups along the running sum of bytes."""

    def __init__(self, groups: DataFrame):
        """groups: part (key range), start and end of every group."""
        self._groups = groups
        found = groups.groupBy("part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.col("end") - F.col("start")).alias("most"), F.count("*").alias("n")).orderBy("start").collect()
        self.total = found[-1].end if found else 0
        self.largest = max((r.most for r in found), default=0)
        #: Cuts that are known, and those of them behind which, before the next, there are others.
        self._known = sorted({0, *(r.end for r in found)})
        self._open = {r.start for r in found if r.n > 1}

    def around(self, value: int) -> tuple[int, int, int]:
        """The last known cut (or 0) not beyond ``value`` and the next one, and the highest place at which the true last cut can be."""
        k = max(0, bisect_right(self._known, value) - 1)
        a, b = self._known[k], self._known[min(k + 1, len(self._known) - 1)]
        return a, b, value if a in self._open and a < value < b else a

    def look_into(self, ranges: list[tuple[int, int]]) -> bool:
        """One job for the cuts inside of these ranges (of which no two overlap) that are open; False if none is."""
        ranges = [(lo, hi) for lo, hi in ranges if self._opens(lo, hi)]
        if not ranges:
            return False
        at = F.lit(None)
        for k, (lo, hi) in enumerate(ranges):
            cell = F.floor((F.col("end") - lo) / F.lit(-(-(hi - lo) // FINE))) + k * (FINE + 1)
            at = F.when((F.col("end") > lo) & (F.col("end") < hi), cell).otherwise(at)
        cells = self._groups.select("end", at.alias("cell")).filter("cell IS NOT NULL").groupBy("cell")
        found = cells.agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count("*").alias("n")).collect()
        opened = {lo: hi for lo, hi in ((r.low, r.high) for r in found if r.n > 2)}
        before = self._known
        self._known = sorted({*before, *(x for r in found for x in (r.low, r.high))})
        for lo, hi in ranges:
            first, last = bisect_left(self._known, lo), bisect_left(self._known, hi)
            inside = self._known[first:last]
            was, now = False, None
            old = set(before[bisect_left(before, lo) : bisect_left(before, hi)])
            for cut in inside:
                if cut in old:
                    was = cut in self._open
                if cut in opened:
                    now = opened[cut]
                self._open.discard(cut)
                if was and now is not None and cut < now:
                    self._open.add(cut)
        return True

    def _opens(self, lo: int, hi: int) -> bool:
        return any(c in self._open for c in self._known[bisect_left(self._known, lo) : bisect_left(self._known, hi)])

    def at_most(self, value: int) -> int:
        """The last cut (or 0) that is not beyond ``value``."""
        while True:
            a, b, high = self.around(value)
            if high == a or not self.look_into([(a, b)]):
                return a

    def at_least(self, value: int) -> int:
        """The first cut (or 0) that is not before ``value``."""
        if value <= 0:
            return 0
        while True:
            a, b, high = self.around(value)
            if a == value or high == a or not self.look_into([(a, b)]):
                return a if a == value else b


def _walks(cuts: Cuts, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Bounds of the greedy walk's places: by known cuts only, and at best."""
    out, low, high = [], 0, 0
    for _ in range(shards):
        low, high = cuts.around(low + capacity)[0], cuts.around(high + capacity)[2]
        out.append((low, high))
    return out


def smallest_capacity(cuts: Cuts, shards: int = SHARDS) -> int:
    """The least capacity that a greedy walk can do with.

    Places of the walk never fall as the capacity grows, so between a capacity
    that is known to be too small and one that is known to be enough each place
    is in one range, which is asked about until the two meet.
    """
    mean = -(-cuts.total // shards)
    low, high = max(mean, cuts.largest), mean + cuts.largest  # the upper end always does
    while True:
        enough = _least(low, high, lambda c: _walks(cuts, c, shards)[-1][0] >= cuts.total)
        possible = _least(low, enough, lambda c: _walks(cuts, c, shards)[-1][1] >= cuts.total)
        if enough == possible:
            return enough
        ranges: list[tuple[int, int]] = []
        for (a, _), (_, b) in zip(_walks(cuts, possible, shards), _walks(cuts, enough, shards), strict=True):
            b = cuts.around(b)[1]
            if ranges and a < ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            elif a < b:
                ranges.append((a, b))
        cuts.look_into(ranges)
        low, high = possible, enough


def _least(low: int, high: int, ok) -> int:
    """The least number from ``low`` to ``high`` that is ok, if all after it are; ``high`` is taken to be."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid + 1, high)
    return high


def place(cuts: Cuts, capacity: int, shards: int = SHARDS) -> list[int]:
    """The ends of all shards but the last, none over the capacity, each as near to an even share of what is left as that allows."""
    needed = [cuts.total]  # the first place from which the remaining shards are enough, from the last shard back
    for _ in range(shards - 1):
        needed.append(cuts.at_least(max(0, needed[-1] - capacity)))
    out, at = [], 0
    for k in range(1, shards):
        even, most = (cuts.at_most(v) for v in (at - (at - cuts.total) // (shards - k + 1), at + capacity))
        if even == at:
            even = cuts.at_least(min(at + 1, cuts.total))
        at = max(needed[shards - k], min(most, even))
        out.append(at)
    return out


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row.

    Law ``bytes``: equal texts share a shard (null counts as empty), and the
    largest shard is as small as contiguous cuts allow.  Slots number a shard's
    rows by zone (of the text key), cell (of the key's MD5), key and text key; keys may have
    any type that orders.  Repeated rows take a slot each; a null key comes
    first in its cell; an empty table gives none.
    """
    whole = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[key].alias("k"), text_size(df[text]).alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.md5(F.encode(whole, "UTF-8")).alias("group"))
    rows = written(rows.withColumn("part", F.substring("group", 1, RANGE_DIGITS)), "sizes")
    groups = rows.groupBy("part", "group").agg(F.sum("size").alias("bytes"))
    inside = Window.partitionBy("part").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("end", F.sum("bytes").over(inside))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("part").agg(F.max("end").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    groups = groups.join(F.broadcast(parts), "part")  # 16 ** RANGE_DIGITS rows
    groups = written(groups.select("part", "group", (F.col("before") + F.col("end") - F.col("bytes")).alias("start"), (F.col("before") + F.col("end")).alias("end")), "groups")

    cuts = Cuts(groups)
    ends = place(cuts, smallest_capacity(cuts, shards), shards) if cuts.total else [0] * (shards - 1)
    first = {r.start: r.group for r in groups.filter(F.col("start").isin(sorted(set(ends)))).select("start", "group").collect()}
    keys = F.array(*(F.lit(first.get(e, "g")) for e in ends))  # "g" is after every hexadecimal digit
    cell = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int"), F.lit(CELLS))
    rows = rows.withColumns({"shard": F.size(F.filter(keys, lambda c: c <= F.col("group"))), "cell": cell})

    rows = rows.withColumn("zone", F.substring("group", 1, ZONE_DIGITS))
    earlier = Window.partitionBy("shard").orderBy("zone", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("shard", "zone", "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("shard", "zone", "cell").orderBy("k", "group")) - 1
    numbered = rows.withColumn("at", at).join(F.broadcast(cells.drop("n")), ["shard", "zone", "cell"])  # (16 ** ZONE_DIGITS + shards) x CELLS rows
    return numbered.select(
        F.col("k").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
