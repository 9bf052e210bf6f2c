"""Statutes from lines to chunks: sections located by the contents, headers cut off, and each section's provisions, definitions and placeholders.

Lines are (by, line_no, line), as in ``lines``; ``expected`` has the contents'
sections (by, ord, section, title, status, deleted_by, later).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import legal
from citeloom.functions.legal import squeezed
from citeloom.functions.text import dice
from citeloom.operators import answers
from citeloom.operators import lines as L
from citeloom.sources.scratch import written

By = Sequence[str]

# Forms of lines that begin a section, a range of them, a heading, a schedule or the end matter, and of titles.
LINE_START = r"^\s*\*{0,3}(?:Section\s+)?(\d+[A-Za-z]*)\.(?=[\s—–-]|$)"
RANGE_START = r"^\s*\*{0,3}(?:Section\s+(\d+)\s*[-—–]\s*(\d+)\.?|(\d+)\s*[-—–]\s*(\d+)\.)(?=\s|$)"
RULE_LINE = r"^\s*(?:_{5,}|[\[\]])\s*$"
HEADING = r"^\s*(?:PART|CHAPTER)\s+(?:[IVXLC]+[A-Z]?|\d+)\b"
SCHEDULE = r"^\s*\*?(?:(?:FIRST|SECOND|THIRD|FOURTH|FIFTH) )?SCHEDULE\s*$"
END_MATTER = r"^\s*LIST\s+OF\s+(?:AMENDMENTS|SECTIONS\s+AMENDED)\s*$"
PARAGRAPH = r"^\s*(?:\((?:[a-z]{1,3}|[ivxl]+|[A-Z])\)|Provided\b)"
TITLE_LIKE = r"^[A-Z][^;:—]{2,118}$"
SENTENCE_END = r"[.;:—\]]\s*$"
BARE_NUMBER = r"^\s*\*{0,3}(?:Section\s+)?\d+[A-Za-z]*\.$"
#: Lines above a section that can be its title, a share of words that makes them one, what a longer title must add, and lines above that for headings.
TITLE_LINES, TITLE_SHARE, TITLE_GAIN, HEADING_LINES = 10, 0.6, 0.05, 8


def body(lines: DataFrame, by: By) -> DataFrame:
    """by, at (from 1) and line of the lines that are neither blank nor a rule."""
    rows = lines.filter("line IS NOT NULL").filter((F.trim("line") != "") & ~F.rlike("line", F.lit(RULE_LINE)))
    return rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("line_no")).alias("at"), "line_no", "line")


def _bounds(line: Column) -> tuple[Column, Column]:
    part = lambda g: F.regexp_extract(line, RANGE_START, g).try_cast("int")
    return F.coalesce(part(1), part(3)), F.coalesce(part(2), part(4))


def located(rows: DataFrame, expected: DataFrame, by: By) -> DataFrame:
    """by, ord, at and leads of the expected sections that are there, in their order.

    A section is at the first line after the one before it that could begin it;
    if the next one comes earlier than that, it is missing.  A line for a range
    of sections holds all expected ones that follow and are inside of it.  It is
    a fold over a document's contents, whose places are found beforehand.
    """
    low, high = _bounds(F.col("line"))
    starts = rows.withColumns({"low": low, "high": high})
    ids = F.when(F.col("low").isNotNull(), F.transform(F.sequence("low", F.greatest("low", "high")), lambda n: n.cast("string"))).when(F.rlike("line", F.lit(LINE_START)), F.array(F.upper(F.regexp_extract("line", LINE_START, 1))))
    starts = starts.select(*by, F.explode(ids).alias("section"), F.struct("at", "low", "high").alias("place"))
    places = starts.groupBy(*by, "section").agg(F.array_sort(F.collect_list("place")).alias("places"))
    entries = expected.select(*by, "ord", F.upper("section").alias("section")).join(places, [*by, "section"], "left")
    none = F.array().cast(places.schema["places"].dataType)
    entries = entries.withColumn("places", F.coalesce("places", none))
    following = F.coalesce(F.lead("places").over(Window.partitionBy(*by).orderBy("ord")), none)
    entries = entries.withColumns({"following": following, "number": F.regexp_extract("section", r"^\d+", 0).try_cast("int")})
    every = entries.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "number", "places", "following"))).alias("entries"))
    first = lambda places, cursor: F.get(F.filter(places, lambda p: p["at"] >= cursor), F.lit(0))
    no = F.lit(None).cast("int")

    def step(state: Column, x: Column) -> Column:
        held = F.coalesce(x["number"].between(state["low"], state["high"]), F.lit(False))
        hit, next_hit = first(x["places"], state["cursor"]), first(x["following"], state["cursor"])
        there = ~held & hit.isNotNull() & ~F.coalesce(next_hit["at"] < hit["at"], F.lit(False))
        row = F.struct(x["ord"].alias("ord"), F.when(held, state["cursor"] - 1).otherwise(hit["at"]).alias("at"), there.alias("leads"))
        return F.struct(
            F.when(there, hit["at"] + 1).otherwise(state["cursor"]).alias("cursor"),
            F.when(held, state["low"]).when(there, hit["low"]).alias("low"),
            F.when(held, state["high"]).when(there, hit["high"]).alias("high"),
            F.when(held | there, F.concat(state["found"], F.array(row))).otherwise(state["found"]).alias("found"),
        )

    kind = expected.schema["ord"].dataType.simpleString()
    start = F.struct(F.lit(1).alias("cursor"), no.alias("low"), no.alias("high"), F.array().cast(f"array<struct<ord:{kind},at:int,leads:boolean>>").alias("found"))
    return every.select(*by, F.explode(F.aggregate("entries", start, step)["found"]).alias("f")).select(*by, "f.ord", "f.at", "f.leads")


def spans(rows: DataFrame, expected: DataFrame, found: DataFrame, by: By) -> DataFrame:
    """by, ord, at, header, stop, body_title, title_matched and title_inferred of the sections that lead a line.

    A section's title is the lines above it that share most words with the
    contents' title (a longer run must add to it), else one or two short lines
    after an ended sentence; headings of Parts and Chapters above belong to it
    too.  A section stops at the next one's header, the last at a schedule or
    the end matter.
    """
    above = Window.partitionBy(*by).orderBy("at").rowsBetween(-(TITLE_LINES + HEADING_LINES + 1), -1)
    lines = rows.withColumn("above", F.collect_list("line").over(above))
    heads = found.filter("leads").join(expected.select(*by, "ord", "title"), [*by, "ord"]).join(lines.select(*by, "at", "above"), [*by, "at"])
    order = Window.partitionBy(*by).orderBy("at")
    heads = heads.withColumn("floor", F.coalesce(F.lag("at").over(order) + 1, F.lit(1)))
    size = F.size("above")
    line = lambda m: F.trim(F.element_at("above", size + 1 - m))  # noqa: E731  the m-th line above
    run = lambda k: F.slice("above", size + 1 - k, k)
    room = F.least(size, F.col("at") - F.col("floor"))
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    def better(best: Column, k: Column) -> Column:
        score = F.when(k <= room, dice(words(F.col("title")), words(F.array_join(run(k), " ")))).otherwise(0.0)
        gains = score > best["score"] + TITLE_GAIN
        return F.struct(F.when(gains, score).otherwise(best["score"]).alias("score"), F.when(gains, k).otherwise(best["k"]).alias("k"))

    best = F.aggregate(F.sequence(F.lit(1), F.lit(TITLE_LINES)), F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("k")), better)

    def by_shape(k: int) -> Column:
        first, before = line(F.lit(k)), line(F.lit(k + 1))
        fits = F.rlike(first, F.lit(TITLE_LIKE)) & ~F.rlike(first, F.lit(PARAGRAPH)) & ((F.upper(first) != first) | ~F.rlike(first, F.lit("[A-Za-z]")))
        ended = F.rlike(before, F.lit(SENTENCE_END)) & ~F.rlike(before, F.lit(BARE_NUMBER))
        short = F.forall(run(F.lit(k)), lambda x: F.length(F.trim(x)) <= 120)
        wrapped = ~F.rlike(first, F.lit(SENTENCE_END)) if k == 2 else F.lit(True)
        return F.coalesce((F.col("at") - k >= F.col("floor")) & (size > k) & fits & ended & short & wrapped, F.lit(False))

    has_title = F.coalesce(F.col("title"), F.lit("")) != ""
    heads = heads.withColumn("best", F.when(has_title, best))
    matched = F.coalesce(F.col("best.score") >= TITLE_SHARE, F.lit(False))
    inferred = F.when(by_shape(1), 1).when(has_title & by_shape(2), 2).otherwise(0)
    heads = heads.withColumns({"title_matched": matched, "title_lines": F.when(matched, F.col("best.k")).otherwise(inferred)})
    heads = heads.withColumn("title_inferred", ~F.col("title_matched") & (F.col("title_lines") > 0))
    title = F.when(F.col("title_lines") > 0, F.regexp_replace(squeezed(F.array_join(run(F.col("title_lines")), " ")), r"\.+$", ""))
    steps = F.filter(F.sequence(F.lit(1), F.lit(HEADING_LINES)), lambda m: (F.col("title_lines") + m <= room) & F.rlike(F.element_at("above", size + 1 - F.least(F.col("title_lines") + m, size)), F.lit(HEADING)))
    header = F.col("at") - F.col("title_lines") - F.coalesce(F.array_max(steps), F.lit(0))
    heads = heads.withColumns({"header": F.when(size > 0, header).otherwise(F.col("at")), "body_title": title})
    last = heads.groupBy(*by).agg(F.max("at").alias("last"))
    ends = rows.withColumn("before", F.trim(F.lag("line").over(order))).join(last, list(by)).filter("at > last").filter(F.rlike("line", F.lit(SCHEDULE)) | F.rlike("line", F.lit(END_MATTER)))
    ends = ends.groupBy(*by).agg(F.min(F.struct("at", F.when(F.col("before") == "LAWS OF MALAYSIA", 1).otherwise(0).alias("less"))).alias("e")).select(*by, (F.col("e.at") - F.col("e.less")).alias("end"))
    stop = F.coalesce(F.lead("header").over(order), "end", F.lit(2**31 - 1))
    return heads.join(ends, list(by), "left").withColumn("stop", stop).select(*by, "ord", "at", "header", "stop", "body_title", "title_matched", "title_inferred")


def chunks(lines: DataFrame, expected: DataFrame, by: By) -> DataFrame:
    """The chunks of a statute's sections.

    by, ord, section, label, part, kind (provision or definition), rule, status,
    deleted_by, term, scope, title, annotations, text, first_line and last_line.
    A placeholder for a range is a chunk for each of its sections; a definition
    is one for each term, with its scope; any other subsection is one by itself.
    """
    rows = written(body(lines, by), "body")
    found = written(located(rows, expected, by), "located")
    heads = written(spans(rows, expected, found, by), "spans")
    key = [*by, "ord"]
    group = found.withColumn("lead", F.last(F.when(F.col("leads"), F.col("ord")), ignorenulls=True).over(Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    group = group.join(expected.select(*key, "section", "status", "deleted_by", "later"), key)

    marks = heads.select(*by, "at", F.struct("ord", "at", "stop").alias("own"))
    inside = rows.join(marks, [*by, "at"], "left").withColumn("own", F.last("own", ignorenulls=True).over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.filter("own IS NOT NULL AND at < own.stop").select(*by, F.col("own.ord").alias("ord"), (F.col("at") == F.col("own.at")).alias("opens"), F.col("line_no"), "line")
    ranged = F.rlike("line", F.lit(RANGE_START))
    stripped = F.regexp_replace(F.when(ranged, F.regexp_replace("line", RANGE_START, "")).otherwise(F.regexp_replace("line", LINE_START, "")), r"^\s*[—–-]?\s*", "")
    inside = inside.withColumns({"ranged": F.col("opens") & ranged, "line": F.when(F.col("opens"), stripped).otherwise(F.col("line"))})
    inside = written(inside, "section-lines")
    tag = F.rlike("line", F.lit(answers.ANNOTATION))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~tag, F.struct("line_no", "line")))), lambda s: s["line"]), " ")
    tags = F.transform(F.array_sort(F.collect_list(F.when(tag, F.struct("line_no", squeezed(F.col("line")).alias("line"))))), lambda s: s["line"])
    wholes = inside.groupBy(*key).agg(joined.alias("all"), tags.alias("annotations"), F.max("ranged").alias("ranged"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    wholes = written(wholes.withColumns({"p": answers.placeholder(F.col("all")), "empty": F.trim("all") == ""}), "sections")
    gone = wholes.filter("p.status IS NOT NULL OR empty").join(group.select(*by, F.col("lead").alias("ord"), F.col("ord").alias("own"), "section", F.col("status").alias("listed"), F.col("deleted_by").alias("listed_by")), key)
    several = F.count("*").over(Window.partitionBy(*key)) > 1
    none = F.lit(None).cast("string")
    order = [*by, "ord", "section", "label", "part", "kind", "rule", "status", "deleted_by", "term", "scope", "annotations", "text", "first_line", "last_line"]
    placeholders = gone.select(
        *by, F.col("own").alias("ord"), "section", none.alias("label"), F.lit(0).cast("long").alias("part"), F.lit("provision").alias("kind"), F.when(F.col("ranged") | several, "range_placeholder").otherwise("placeholder").alias("rule"),
        F.coalesce("p.status", "listed").alias("status"), F.when(F.col("p.status").isNotNull(), F.coalesce("p.instrument", "listed_by")).otherwise(F.col("listed_by")).alias("deleted_by"),
        none.alias("term"), none.alias("scope"), "annotations", squeezed(F.regexp_replace("all", r"\*+(?=[\w(])", "")).alias("text"), "first_line", "last_line",
    )

    kept = inside.filter(~tag).join(wholes.filter("p.status IS NULL AND NOT empty").select(*key), key, "left_semi").filter(~(F.col("opens") & (F.trim("line") == "")))
    subs = L.subsections(kept.select(*key, "line_no", "line"), key).withColumns({"label": F.coalesce("label", F.lit("")), "line": F.col("rest")}).filter(F.trim("line") != "").drop("rest")
    part_key = [*key, "label"]
    parted = written(L.definitions(subs, part_key), "parts")
    texts = L.statute_text(parted, [*part_key, "part"])
    pieces = parted.groupBy(*part_key, "part").agg(F.first("term").alias("term"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).join(texts, [*part_key, "part"])
    most = Window.partitionBy(*part_key)
    pieces = pieces.withColumns({"defines": F.max("part").over(most) > 0, "scope": F.first(F.when(F.col("part") == 0, F.col("text")), ignorenulls=True).over(most.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    pieces = pieces.filter("NOT defines OR part > 0").withColumn("p", answers.placeholder(F.col("text")))
    own = F.when(F.col("later"), "not_yet_in_force").otherwise("in_force")
    is_gone, is_term = F.col("p.status").isNotNull(), F.col("defines")
    listed = group.filter("leads").select(*key, "section", "later").join(wholes.select(*key, "annotations"), key)
    provisions = pieces.join(listed, key).select(
        *key, "section", F.nullif("label", F.lit("")).alias("label"), "part", F.when(is_term & ~is_gone, "definition").otherwise("provision").alias("kind"),
        F.when(is_gone, "placeholder").when(is_term, "definition").when(F.col("label") != "", "subsection").otherwise("section_undivided").alias("rule"),
        F.when(is_gone, F.col("p.status")).otherwise(own).alias("status"), "p.instrument", F.when(is_term, F.col("term")).alias("term"), F.when(is_term, F.col("scope")).alias("scope"),
        "annotations", "text", "first_line", "last_line",
    ).withColumnRenamed("instrument", "deleted_by")
    every = placeholders.select(*order).unionByName(provisions.select(*order))
    titles = group.select(*key, "lead").join(heads.select(*by, F.col("ord").alias("lead"), "body_title"), [*by, "lead"]).join(expected.select(*key, F.col("title").alias("listed_title")), key)
    return every.join(titles.select(*key, F.coalesce("body_title", "listed_title").alias("title")), key)


def report(lines: DataFrame, expected: DataFrame, by: By) -> DataFrame:
    """by, expected, located, missing (sections), titles_unmatched and titles_inferred of each document."""
    rows = written(body(lines, by), "body")
    found = written(located(rows, expected, by), "located")
    heads = spans(rows, expected, found, by)
    key = [*by, "ord"]
    each = expected.join(found.select(*key, F.lit(True).alias("there")), key, "left").join(heads.select(*key, "title_matched", "title_inferred"), key, "left")
    named = lambda condition: F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("ord", "section")))), lambda s: s["section"])
    unmatched = (F.coalesce("title", F.lit("")) != "") & ~F.col("title_matched") & ~F.col("title_inferred")
    return each.groupBy(*by).agg(F.count("*").alias("expected"), F.count("there").alias("located"), named(F.col("there").isNull()).alias("missing"), named(unmatched).alias("titles_unmatched"), named(F.col("title_inferred")).alias("titles_inferred"))


def references(found: DataFrame, expected: DataFrame, by: By, own_name: Column, label: str = "s.") -> DataFrame:
    """``found`` (chunks) with internal and external references of their texts."""
    known = expected.groupBy(*by).agg(F.collect_set(F.upper("section")).alias("known"))
    rows = found.join(known, list(by))
    return rows.withColumns({"internal": legal.own_references(F.col("text"), F.col("known"), label), "external": legal.other_statutes(F.col("text"), own_name)}).drop("known")
