"""Line deduplication by deletion neighbourhoods, in DataFrame operations.

A line goes if an earlier line (by document, then position) equals it or is
within one edit (insertion, deletion or substitution of a character).

Exact copies meet by two 64-bit hashes of the whole line; everything else is
done once for each distinct line, at its first place.  Of two lines within one
edit the first or the last half is the same, so lines that share neither half
with another line are set aside.  The rest emit all variants with one character
deleted, as hashed keys: two lines within one edit share a variant, either one
with the same place of deletion (a substitution) or one that is the other line
itself (an insertion).  Both kinds join their earliest member, and the edit
distance of each such pair is verified.

Variants are built inside windows of WINDOW characters, between hashes of what
is before and after the window, and only in windows around which some other
line is the same: no other window can hold the edit.  So a line of n characters
emits n / WINDOW keys and a few windows' variants, not n variants of n characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.storage import only, tidy, written

#: Halves of lines from HALF_STEP characters on are rounded down to STEP.
WINDOW, STEP, HALF_STEP, SALTS = 32, 8, 32, 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and the last half, as the shorter line of a pair has them: for this length and, where that differs, for one less."""

    def keys(length: Column) -> list[Column]:
        half = F.when(length < HALF_STEP, F.floor(length / 2)).otherwise(F.floor(length / (2 * STEP)) * STEP).cast("int")
        return [F.xxhash64(F.lit("first"), half, F.substr(line, F.lit(1), half)), F.xxhash64(F.lit("last"), half, F.substr(line, n - half + 1, half))]

    return F.array_distinct(F.array(*keys(n), *keys(n - 1)))


def first_places(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every line that is not blank, and the first place of every distinct one.

    Lines: doc, text (the document's text hash), line, h1, h2 and n, its
    characters.  A place orders by (doc, text, line); documents that repeat both
    id and text share one place, and so one fate.
    """
    rows = documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64("text").alias("text"), F.posexplode(_lines(F.col("text"))).alias("line", "value"))
    n = F.length("value")
    rows = rows.filter(F.length(F.trim("value")) > 0).select(
        "doc", "text", "line", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value", n).alias("h2"), n.alias("n"), _half_keys(F.col("value"), n).alias("halves")
    )
    rows = written(rows, "lines")
    place = F.struct("doc", "text", "line")
    return rows, rows.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("copies"), F.first("halves").alias("halves"))


def _suspects(firsts: DataFrame) -> DataFrame:
    """First places of the lines that share a half with another distinct line."""
    halves = firsts.select("place", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("lines")).filter("lines > 1").select("half", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    halves = halves.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)))
    return halves.join(shared, ["half", "salt"], "left_semi").select("place").distinct()


def _with_text(places: DataFrame, documents: DataFrame) -> DataFrame:
    """place and value of these lines."""
    wanted = places.groupBy(F.col("place.doc").alias("doc"), F.col("place.text").alias("hash")).agg(F.collect_list("place.line").alias("wanted"))
    texts = documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64("text").alias("hash"), F.col("text").alias("whole"))
    # as the row of a generator the lines are a column, split once for all that is taken from it
    found = texts.join(wanted, ["doc", "hash"]).select("doc", "hash", "wanted", F.explode(F.array(_lines(F.col("whole")))).alias("lines"))
    taken = F.transform("wanted", lambda i: F.struct(i.alias("line"), F.element_at("lines", i + 1).alias("value")))
    found = found.select("doc", "hash", F.explode(taken).alias("own"))
    one = F.struct(F.col("doc"), F.col("hash").alias("text"), F.col("own.line").alias("line")).alias("place")
    return found.select(one, F.col("own.value").alias("value")).dropDuplicates(["place"])


def _windows(lines: DataFrame) -> DataFrame:
    """Every window of every line: what is before it, and what is after it if it has WINDOW characters (rest) or one more (wide_rest), as hashes."""
    value, at = F.col("value"), F.col("w") * WINDOW
    cut = lines.select("place", "value", F.explode(F.sequence(F.lit(0), F.floor((F.length("value") - 1) / WINDOW).cast("int"))).alias("w"))
    before, wide = F.substr(value, F.lit(1), at), F.substr(value, at + 1, F.lit(WINDOW + 1))
    around = [F.xxhash64("w", before, F.substr(value, at + k + WINDOW)) for k in (1, 2)]
    return cut.select("place", "w", wide.alias("wide"), around[0].alias("short"), around[1].alias("long"))


def _variants(lines: DataFrame) -> DataFrame:
    """place, spot and variant: spot 0 is the line itself in one window; others are the deleted character's position.

    Only windows around which another line is the same emit any.
    """
    cut = written(_windows(lines), "windows")
    seen = cut.groupBy(F.col("long").alias("around")).agg(F.count("*").alias("longs")).join(cut.groupBy(F.col("short").alias("around")).agg(F.count("*").alias("shorts")), "around", "left")
    seen = seen.filter("longs > 1 OR shorts > 0").select("around", "shorts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    seen = written(seen, "around")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)))
    gone = cut.join(seen.select(F.col("around").alias("long"), "salt"), ["long", "salt"], "left_semi")
    spots = F.transform(
        F.sequence(F.lit(1), F.length("wide")),
        lambda p: F.struct((F.col("w") * WINDOW + p).alias("spot"), F.xxhash64("long", F.concat(F.substr("wide", F.lit(1), p - 1), F.substr("wide", p + 1))).alias("variant")),
    )
    gone = gone.select("place", F.explode(spots).alias("v")).select("place", "v.spot", "v.variant")
    itself = cut.join(seen.filter("shorts > 0").select(F.col("around").alias("short"), "salt"), ["short", "salt"], "left_semi")
    return gone.union(itself.select("place", F.lit(0), F.xxhash64("short", F.substr("wide", F.lit(1), F.lit(WINDOW)))))


def _nearest(variants: DataFrame) -> DataFrame:
    """place and near: the earliest other line of each shared variant, by substitution or by insertion."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    salt = F.pmod(F.xxhash64("place"), F.lit(SALTS))
    itself, inner = F.col("spot") == 0, F.col("spot") != 0
    same = variants.filter(inner).groupBy("variant", "spot").agg(F.min("place").alias("near"), F.count("*").alias("n")).filter("n > 1").select("variant", "spot", "near", salts)
    changed = variants.filter(inner).withColumn("salt", salt).join(same, ["variant", "spot", "salt"]).select("place", "near")
    both = variants.groupBy("variant").agg(F.min(F.when(itself, F.col("place"))).alias("short"), F.min(F.when(inner, F.col("place"))).alias("long"))
    both = both.filter("short IS NOT NULL AND long IS NOT NULL").select("variant", "short", "long", salts)
    grown = variants.withColumn("salt", salt).join(both, ["variant", "salt"]).select("place", F.when(itself, F.col("long")).otherwise(F.col("short")).alias("near"))
    return changed.union(grown).filter("near < place").distinct()


def near_earlier(firsts: DataFrame, documents: DataFrame) -> DataFrame:
    """First places of distinct lines with another line within one edit at an earlier place."""
    lines = written(_with_text(_suspects(firsts), documents), "suspects")
    tidy(documents.sparkSession)  # the texts were shuffled
    pairs = _nearest(only(lambda: _variants(lines), "variants"))
    a, b = lines.select("place", F.col("value").alias("x")), lines.select(F.col("place").alias("near"), F.col("value").alias("y"))
    verified = pairs.join(a, "place").join(b, "near").filter(F.levenshtein("x", "y", 1).between(0, 1))
    return verified.select("place").distinct()


def dropped_lines(documents: DataFrame) -> DataFrame:
    """doc, hash and gone (positions from 0) of every document that loses lines."""
    rows, firsts = first_places(documents)
    firsts = written(firsts, "first")
    tidy(documents.sparkSession)
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    repeated = firsts.filter("copies > 1").select("h1", "h2", "place", salts)
    places = rows.select("h1", "h2", F.struct("doc", "text", "line").alias("own")).withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS)))
    copies = places.join(repeated, ["h1", "h2", "salt"]).filter("own <> place").select(F.col("own").alias("place"))
    gone = copies.union(near_earlier(firsts, documents))
    return gone.groupBy(F.col("place.doc").alias("doc"), F.col("place.text").alias("hash")).agg(F.collect_set("place.line").alias("gone"))


MADE = ("gone_lines", "all_lines", "deduplicated")


def deduplicated(documents: DataFrame, made: tuple[str, str, str] = MADE) -> DataFrame:
    """``documents`` (doc_id, text and any others) with columns gone_lines, all_lines and deduplicated, or as ``made`` names them.

    ``deduplicated`` is the text without the lines that go; null stays null.
    Blank lines stay.  Null doc_ids come first in order.  Existing columns of
    the three names give way.
    """
    gone = only(lambda: dropped_lines(documents.select("doc_id", "text")), "gone")
    tidy(documents.sparkSession)  # the texts are shuffled once more
    gone = gone.select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), F.col("gone").alias("__gone"))
    base = documents.select(*(documents[c] for c in documents.columns if c not in made))
    joined = base.join(gone, (F.coalesce(base["doc_id"], F.lit(-(1 << 63))).cast("long") == gone["__doc"]) & (F.xxhash64(base["text"]) == gone["__hash"]), "left")
    # as the row of a generator the lines are a column, split once
    lines, went = F.col("__lines"), F.col("__gone")
    joined = joined.select(*base.columns, "__gone", F.explode(F.array(_lines(F.col("text")))).alias("__lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), went)
    left = F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")
    return joined.select(
        *base.columns,
        F.coalesce(F.when(went.isNotNull(), F.size(went)), F.lit(0)).cast("long").alias(made[0]),
        F.size(lines).cast("long").alias(made[1]),
        F.when(went.isNull(), F.col("text")).otherwise(left).alias(made[2]),
    )


def line_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_gone and text_sha256 (of what is left; null counts as empty) of every document."""
    out = deduplicated(documents.select("doc_id", "text"))
    return out.select("doc_id", F.col("all_lines").alias("n_lines"), F.col("gone_lines").alias("n_gone"), F.sha2(F.coalesce("deduplicated", F.lit("")), 256).alias("text_sha256"))


def without_repeats(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and documents that keep no line of theirs.

    All columns stay; only text and, where lines went, n_chars change.
    """
    gone, _, text = names = ("__gone_lines", "__all_lines", "__deduplicated")
    out = deduplicated(documents, names)
    left = out.filter((F.col(gone) == 0) | (F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0))
    fresh = {"text": F.col(text), "n_chars": F.when(F.col(gone) == 0, F.col("n_chars")).otherwise(F.length(text)) if "n_chars" in documents.columns else None}
    return left.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in documents.columns))
