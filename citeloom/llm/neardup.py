"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives a signature two values, its
minimum and its maximum, so a signature of 2 n values takes n evaluations.
Bands of the signature bring candidates together; every link is confirmed on
full shingle sets.

Documents with equal sets form a class, and only classes are compared.  First
each class meets one other, the smallest of a bucket that it shares most bands
with; the components that these links make leave few buckets with members that
are still apart.  In those every pair of members of different parts is a
candidate unless its sketches prove that it is too far: a sketch counts a set's
shingles in CELLS cells, and the sum of differences is at most the number of
shingles that only one of both sets has.  Candidates make clusters (each task
gives a spanning forest), and inside a cluster candidates are confirmed,
likeliest first, until they are joined.  Tasks compare blocks of bounded size
and give no more rows than members; every pair that shares a band is joined,
proved too far, or confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import shingles
from citeloom.llm.graph import components
from citeloom.llm.storage import bounded_batches, release, written

#: Values of a band, bands: BANDS * ROWS / 2 permutations.
ROWS, BANDS = 5, 40
#: Cells of a sketch.
CELLS = 256
#: Members of a bucket that one task compares with as many others; shingles of a cluster's sets, where a set counts as SET_LEAST more than it has.
BLOCK, SET_BLOCK, SET_LEAST = 1024, 1 << 18, 1024
SALTS = 16
#: Parts in which a class's members come to it.
STAR_SALTS = 64
_PERMUTATIONS = np.random.default_rng(7).integers(0, 1 << 63, ROWS * BANDS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FEATURES = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set that is not empty; ``hashes`` has the sets one after another."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    values = np.empty((len(counts), ROWS * BANDS), np.uint64)
    for k, factor in enumerate(_PERMUTATIONS):
        permuted = hashes * factor
        np.minimum.reduceat(permuted, starts, out=values[:, 2 * k])
        np.maximum.reduceat(permuted, starts, out=values[:, 2 * k + 1])
    keys = np.zeros((len(counts), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = shingles.mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k::ROWS])
    return keys.view(np.int64)


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of CELLS counts (255 at most) for each set."""
    cell = np.repeat(np.arange(len(counts)) * CELLS, counts) + (hashes % np.uint64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(counts) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)


def near_enough(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences of sketches (rows of x and y) of sets of m and n shingles, and whether they allow a link.

    With s shingles of one set only, intersection and union are (m + n - s) / 2
    and (m + n + s) / 2; cut at 255, the differences only get smaller.
    """
    apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
    return apart, (100 + percent) * apart <= (100 - percent) * (m + n)


def _feature_rows(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, own = batch["doc_id"], batch["text_hash"].to_numpy()
            for first, hashes, counts in shingles.sets(batch["text"].tolist(), words):
                rows = slice(first, first + len(counts))
                out = pd.DataFrame({"doc_id": ids[rows].to_numpy(), "text_hash": own[rows], "n_shingles": counts.astype(np.int64)})
                full = np.flatnonzero(counts)
                h1, h2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                bands, cells = [None] * len(counts), [None] * len(counts)
                if len(full):
                    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1])).astype(np.int64)
                    h1[full] = np.add.reduceat(shingles.mix(hashes), starts).view(np.int64)
                    h2[full] = np.bitwise_xor.reduceat(shingles.mix(hashes + np.uint64(1)), starts).view(np.int64)
                    for i, keys, sketch in zip(full, band_keys(hashes, counts[full]), sketches(hashes, counts[full]), strict=True):
                        bands[i], cells[i] = keys, sketch.tobytes()
                yield out.assign(h1=h1, h2=h2, bands=bands, sketch=cells)

    return run


def _set_rows(words: int):
    """The set of each node, of those rows whose text still has the node's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, wanted = batch["node"].to_numpy(), batch["h1"].to_numpy()
            for first, hashes, counts in shingles.sets(batch["text"].tolist(), words):
                rows, at = [], 0
                for i, n in enumerate(counts):
                    own = hashes[at : at + n]
                    if n and int(shingles.mix(own).sum(dtype=np.uint64).view(np.int64)) == wanted[first + i]:
                        rows.append((nodes[first + i], own.tobytes()))
                    at += n
                yield pd.DataFrame(rows, columns=["node", "cells"])

    return run


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    merged = np.concatenate((p, q))
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def _against_center(percent: int):
    """Rows of one center and salt follow each other, the center's own set (a null) first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, center = b"", None
        for batch in batches:
            out = []
            for b, a, cells in zip(batch["b"], batch["a"], batch["cells"], strict=True):
                if pd.isna(a):
                    held, center = cells, b
                elif b == center and _similar(cells, held, percent):
                    out.append((int(a), int(b)))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough: a set travels once as a's, and a center's at most STAR_SALTS times."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(STAR_SALTS)))
    own = pairs.join(sets.withColumnRenamed("node", "a"), "a").select("b", "salt", "a", "cells")
    centers = pairs.select("b", "salt").distinct().join(sets.withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "cells")
    both = own.union(centers).repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return written(both.select("b", "a", "cells").mapInPandas(_against_center(percent), "a long, b long"), "links")


def _grouped(df: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """``make(pdf)`` for each group of ``keys``, from sorted partitions: a group costs no task of its own.

    Work grows faster than bytes here, so the number of partitions is given and not made smaller for few bytes.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            cells = batch[keys].to_numpy()
            edges = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
            if rest and (rest[-1][keys].to_numpy()[-1] != cells[0]).any():
                edges = np.concatenate(([0], edges))
            out, at = [], 0
            for e in edges:
                rest.append(batch.iloc[at:e])
                if sum(map(len, rest)) > 1:
                    out += make(pd.concat(rest) if len(rest) > 1 else rest[0])
                rest, at = [], e
            rest.append(batch.iloc[at:])
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if rest:
            yield pd.DataFrame(make(pd.concat(rest)), columns=["a", "b"], dtype=np.int64)

    return df.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _near(pdf: pd.DataFrame, percent: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of a pair of blocks, and the candidates: pairs of rows (x, y) of different parts whose
    sizes and sketches allow a link, with their sketches' differences."""
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left = pdf[pdf["mine"].to_numpy() == i]
    right = left if i == j else pdf[pdf["mine"].to_numpy() == j]
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return left, right, none, none, none
    p, q, m, n = (side[c].to_numpy() for c in ("part", "n_shingles") for side in (left, right))
    ok = (p[:, None] != q) & (100 * np.minimum(m[:, None], n) >= percent * np.maximum(m[:, None], n))
    if i == j:
        ok &= np.tri(len(p), k=-1, dtype=bool).T
    x, y = np.nonzero(ok)
    mine, yours = (np.frombuffer(b"".join(side["sketch"]), np.uint8).reshape(-1, CELLS) for side in (left, right))
    kept, apart = [none], [none]
    for at in range(0, len(x), 1 << 15):
        some = slice(at, at + (1 << 15))
        far, near = near_enough(mine[x[some]], yours[y[some]], m[x[some]], n[y[some]], percent)
        kept.append(at + np.flatnonzero(near))
        apart.append(far[near])
    keep = np.concatenate(kept)
    return left, right, x[keep], y[keep], np.concatenate(apart)


def _forest(percent: int):
    """Edges (part, least part reachable) over the candidates of two blocks of a bucket: as many as parts at most."""

    def make(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        left, right, x, y, _ = _near(pdf, percent)
        if not len(x):
            return []
        p, q = left["part"].to_numpy()[x], right["part"].to_numpy()[y]
        names, where = np.unique(np.concatenate((p, q)), return_inverse=True)
        a, b = where[: len(p)], where[len(p) :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[a], label[b])
            fresh = label.copy()
            np.minimum.at(fresh, a, low)
            np.minimum.at(fresh, b, low)
            fresh = fresh[fresh]
            if (fresh == label).all():
                return [(int(names[k]), int(names[v])) for k, v in enumerate(label) if v != k]
            label = fresh

    return make


def _joining(percent: int):
    """Confirmed links, as (part, part), between two blocks of a cluster, likeliest pairs first; a pair
    whose parts are joined by then adds nothing and is passed over."""

    def make(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        left, right, x, y, apart = _near(pdf, percent)
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = root.get(up, up)
                k = up
            return k

        p, q = left["part"].to_list(), right["part"].to_list()
        cells, others, out = left["cells"].to_list(), right["cells"].to_list(), []
        for k in np.argsort(apart, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            one, two = find(p[i]), find(q[j])
            if one != two and _similar(cells[i], others[j], percent):
                root[one] = two
                out.append((p[i], q[j]))
        return out

    return make


def _blocks(rows: DataFrame, key: str, weight: Column, size: int) -> DataFrame:
    """``rows`` (key, node, part, ...) of the groups with more than one part, with mine, i and j: each goes to every pair of blocks of its group that has its own.

    Blocks weigh about ``size``.  The part that weighs most has blocks of its
    own, which are not paired with each other: in a group of which nearly all is
    joined, rows travel about as often as the others have blocks.
    """
    parts = rows.groupBy(key, "part").agg(F.sum(weight).alias("w"))
    groups = parts.groupBy(key).agg(F.sum("w").alias("all"), F.max(F.struct("w", "part")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    count = lambda w: F.ceil(w / F.lit(size)).cast("int")
    groups = groups.select(key, F.col("most.part").alias("main"), count(F.col("most.w")).alias("own"), count(F.col("all") - F.col("most.w")).alias("rest"), _salts())
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(groups, [key, "salt"])
    main, spread = F.col("part") == F.col("main"), F.xxhash64("node", F.lit(1))
    rows = rows.withColumn("mine", F.when(main, F.pmod(spread, F.col("own"))).otherwise(F.col("own") + F.pmod(spread, F.col("rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(main, F.col("own")).otherwise(0), F.col("own") + F.col("rest") - 1)))
    return rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "own", "rest", "main", "salt")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")


def classes(df: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Features of all rows of ``df`` (doc_id, text), and rep, h1, h2, n, label, component and size of their classes.

    ``rep`` is the smallest doc_id of a class of n documents, ``component`` that of
    the ``size`` classes linked with it, which share a label.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    features = written(rows.mapInPandas(_feature_rows(words), _FEATURES), "features")
    real = features.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("members")).filter("members > 1").select("key", "center", _salts())
    members = written(banded.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(buckets, ["key", "salt"]).select("key", "node", "center"), "members")

    found = members.select("node").distinct().join(nodes.select("node", "rep", "h1"), "node")
    texts = df.select(F.col("doc_id").cast("long").alias("rep"), "text")
    sets = texts.join(found, "rep").select("node", "h1", "text").mapInPandas(_set_rows(words), "node long, cells binary").dropDuplicates(["node"])
    sets = written(sets, "sets")

    shared = members.filter("node <> center").groupBy(F.col("node").alias("a"), F.col("center").alias("b")).agg(F.count("*").alias("bands"))
    best = shared.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    parts = components(_linked(best, sets, percent))
    placed = written(members.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part")), "placed")
    seen = _blocks(placed, "key", F.lit(1), BLOCK).join(nodes.select("node", "n_shingles", "sketch"), "node")
    forest = written(_grouped(seen, ["key", "i", "j"], _forest(percent), "a long, b long"), "forest")
    clusters = components(forest).select(F.col("node").alias("part"), F.col("label").alias("cluster"))
    inside = placed.select("node", "part").distinct().join(clusters, "part").join(nodes.select("node", "n_shingles"), "node")
    whole = _blocks(written(inside, "clusters"), "cluster", F.col("n_shingles") + SET_LEAST, SET_BLOCK).join(nodes.select("node", "sketch"), "node").join(sets, "node")
    more = components(written(_grouped(whole, ["cluster", "i", "j"], _joining(percent), "a long, b long"), "links"))
    labelled = nodes.select("node", "rep", "h1", "h2", "n").join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = labelled.join(more.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left").withColumn("label", F.coalesce("final", "label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("size"))
    out = written(labelled.join(least, "label").select("rep", "h1", "h2", "n", "label", "component", "size"), "classes")
    release(nodes, members, sets, placed, forest)
    return features, out


def _with_component(features: DataFrame, found: DataFrame) -> DataFrame:
    """``features`` with ``label`` and ``component`` (null without shingles or doc_id, and for a document that is linked with nothing)."""
    # classes of one document that are linked with nothing need no row here
    found = found.filter("n > 1 OR size > 1").select("h1", "h2", "label", "component", _salts())
    rows = features.select("doc_id", "text_hash", "n_shingles", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    joined = rows.join(found, ["h1", "h2", "salt"], "left")
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return joined.withColumns({c: F.when(real, F.col(c)) for c in ("label", "component")})


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``df`` (doc_id, text).

    Texts are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets.  component_id is the smallest doc_id reachable.  Null, empty
    and blank texts have no shingles and stand alone.  Rows that repeat a doc_id
    are rows of their own with the result of their text; a null doc_id takes no
    part (component_id null, kept false).  Other columns of ``df`` are left out.
    """
    joined = _with_component(*classes(df, words, percent))
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document of the smallest doc_id stays.

    A document is a doc_id with a text: of rows that share a doc_id each is
    judged by its own text (the smaller hash of two in one group stays), and of
    rows that repeat both one stays.  Documents without doc_id or words stay.
    """
    joined = written(_with_component(*classes(documents, 5, 80)), "judged")
    own = F.struct("doc_id", "text_hash")
    first = joined.filter("label IS NOT NULL").groupBy("label").agg(F.min(own).alias("first")).select("label", "first", _salts())
    gone = joined.join(first, ["label", "salt"]).filter(own != F.col("first")).select("doc_id", "text_hash").distinct()
    repeated = joined.filter("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash")
    doc, text = F.col("d.doc_id").cast("long"), F.xxhash64("d.text")

    def those(marked: DataFrame, how: str) -> DataFrame:
        return documents.alias("d").join(marked, (doc == marked["doc_id"]) & (text == marked["text_hash"]), how)

    again = those(repeated.join(gone, ["doc_id", "text_hash"], "left_anti"), "left_semi").dropDuplicates(["doc_id", "text"])
    return those(gone.union(repeated).distinct(), "left_anti").unionByName(again).select(*documents.columns)
