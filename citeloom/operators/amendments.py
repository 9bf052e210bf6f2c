"""Amending Acts from lines to parts, with what each part changes.

Sections are numbered 1, 2, 3 ...; the line above a number is its title.  A
section of more than MOST_WORDS words is cut at the sections that it inserts,
else at its instruction paragraphs (a), (b) ..., and those that are still too
long at theirs, (i), (ii) ...  Which markers count depends on those before them:
a fold over a section's markers only.  Everything else is windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import legal
from citeloom.functions.legal import squeezed
from citeloom.operators.lines import statute_text
from citeloom.operators.sections import body
from citeloom.sources.scratch import written

By = Sequence[str]

# Forms of lines that begin a section, an inserted section and an instruction paragraph.
SECTION = r"^\s*(\d+)\.(?=\s|$)"
INSERTED = r"^\s*[‘'“\"]?\s*(\d+[a-z]{1,3})\.(?=\s|$)"
INSTRUCTION = r"^\s*\(([a-z]{1,5})\)\s+(?:by|in)\b"
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii xxiv xxv".split()
LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)]
#: Words of a part that is not cut, of a lead-in that joins the part after it, and lines and characters of the title above an inserted section.
MOST_WORDS, LEAD_WORDS, TITLE_LINES, TITLE_CHARS = 450, 15, 8, 30


def _in_sequence(rows: DataFrame, by: By, mark: Column, sequence: Column) -> DataFrame:
    """``rows`` (by, at) with ``taken``: of the marks those that are the sequence's first, second ... in turn."""
    marks = rows.withColumn("mark", mark).filter("mark IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "mark"))).alias("marks"))
    step = lambda found, x: F.when(x["mark"] == F.get(sequence, F.size(found)), F.concat(found, F.array(x["at"]))).otherwise(found)
    kept = marks.select(*by, F.explode(F.aggregate("marks", F.array().cast("array<int>"), step)).alias("at"), F.lit(True).alias("taken"))
    return rows.join(kept, [*by, "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))


def sections(lines: DataFrame, by: By) -> DataFrame:
    """by, number, title, at and line of the lines of every section; the number itself is cut off."""
    rows = body(lines, by)
    number = F.nullif(F.regexp_extract("line", SECTION, 1), F.lit(""))
    marks = rows.withColumn("mark", number.try_cast("int")).filter("mark IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "mark"))).alias("marks"))
    step = lambda found, x: F.when(x["mark"] == F.size(found) + 1, F.concat(found, F.array(x["at"]))).otherwise(found)
    kept = marks.select(*by, F.posexplode(F.aggregate("marks", F.array().cast("array<int>"), step)).alias("k", "at")).select(*by, "at", (F.col("k") + 1).alias("opens"))
    order = Window.partitionBy(*by).orderBy("at")
    rows = rows.join(kept, [*by, "at"], "left").withColumns({"above": F.coalesce(F.trim(F.lag("line").over(order)), F.lit("")), "below": F.lead("opens").over(order)})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("opens").isNotNull(), F.struct("opens", F.regexp_replace(squeezed(F.col("above")), r"\.+$", "").alias("title")))
    rows = rows.withColumn("own", F.last(title, ignorenulls=True).over(so_far))
    rows = rows.filter("own IS NOT NULL AND (below IS NULL OR opens IS NOT NULL)")  # the line above the next number is its title
    line = F.when(F.col("opens").isNotNull(), F.regexp_replace("line", SECTION, "")).otherwise(F.col("line"))
    return rows.select(*by, F.col("own.opens").alias("number"), "own.title", "at", line.alias("line"))


def _titles_up(rows: DataFrame, by: By) -> DataFrame:
    """``rows`` with ``begins``: the label of the inserted section whose heading begins there.

    Its heading is the short or upper-case lines above it, as far as they go,
    without those at their beginning that go on in lower case.
    """
    order = Window.partitionBy(*by).orderBy("at")
    first = F.min("at").over(Window.partitionBy(*by))
    rows = rows.withColumn("label", F.when(F.col("at") > first, F.upper(F.nullif(F.regexp_extract("line", INSERTED, 1), F.lit("")))))
    text = F.trim("line")
    title = (F.length(text) <= TITLE_CHARS) & ~F.rlike(text, F.lit("[;:—]$")) | ((F.upper(text) == text) & F.rlike(text, F.lit(r"\p{L}")))
    # the line after another start belongs to that one
    free = F.col("label").isNull() & (F.col("at") > first) & title
    above = F.collect_list(F.struct("at", free.alias("free"), F.rlike(text, F.lit(r"^\p{Ll}")).alias("low"))).over(order.rowsBetween(-TITLE_LINES, -1))
    rows = rows.withColumn("up", F.reverse(above))
    run = F.aggregate("up", F.struct(F.lit(True).alias("on"), F.col("at").alias("to"), F.col("at").alias("start")), lambda s, x: F.struct((s["on"] & x["free"]).alias("on"), F.when(s["on"] & x["free"], x["at"]).otherwise(s["to"]).alias("to"), s["start"].alias("start")))["to"]
    rows = rows.withColumn("top", F.when(F.col("label").isNotNull(), run))
    # of the run the first line that does not go on in lower case
    opening = F.array_min(F.filter(F.transform("up", lambda x: F.when((x["at"] >= F.col("top")) & ~x["low"], x["at"])), lambda a: a.isNotNull()))
    starts = rows.filter("label IS NOT NULL").select(*by, F.coalesce(opening, F.col("at")).alias("at"), F.struct("label", F.col("at").alias("number_at")).alias("begins"))
    return rows.drop("label", "up", "top").join(starts, [*by, "at"], "left")


def parts(lines: DataFrame, by: By, most: int = MOST_WORDS) -> DataFrame:
    """by, number, title, action, targets, part (from 1), label, section, subsection, term, inserts, removes, new_section and text.

    section, subsection and term are the narrowest target that a part, or a
    paragraph around it, names in its first two lines; a short lead-in that ends
    in a dash or colon joins the part after it.
    """
    key = [*by, "number"]
    rows = written(sections(lines, by), "amending")
    sizes = rows.groupBy(*key).agg(F.sum(_words(F.col("line"))).alias("words"), F.min("at").alias("first"))
    rows = written(_titles_up(rows.join(sizes, key), key), "amending")
    inserted = rows.groupBy(*key).agg(F.count("begins").alias("new")).join(sizes, key).withColumn("how", F.when(F.col("words") <= most, "whole").when(F.col("new") > 0, "inserted").otherwise("paragraphs"))
    rows = rows.join(inserted.select(*key, "how"), key)
    mark = F.when(F.col("how") == "paragraphs", F.nullif(F.regexp_extract("line", INSTRUCTION, 1), F.lit("")))
    rows = _in_sequence(rows, key, mark, F.array(*map(F.lit, LETTERS))).withColumnRenamed("taken", "letter")
    order = Window.partitionBy(*key).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("paragraph", F.count_if("letter").over(so_far))
    outer = [*key, "paragraph"]
    long = rows.filter("how = 'paragraphs'").groupBy(*outer).agg((F.sum(_words(F.col("line"))) > most).alias("long"))
    rows = rows.join(long, outer, "left").withColumn("long", F.coalesce("long", F.lit(False)))
    # without any letter, the section itself is looked through for (i), (ii) ...
    lettered = F.max("paragraph").over(Window.partitionBy(*key)) > 0
    rows = rows.withColumn("deeper", F.col("long") & ((F.col("paragraph") > 0) | ~lettered))
    inner_mark = F.when(F.col("deeper"), F.nullif(F.regexp_extract("line", INSTRUCTION, 1), F.lit("")))
    rows = written(_in_sequence(rows, outer, inner_mark, F.array(*map(F.lit, ROMAN))).withColumnRenamed("taken", "numeral"), "amending")

    opens = (F.col("at") == F.col("first")) | F.when(F.col("how") == "inserted", F.col("begins").isNotNull()).otherwise(F.col("letter") | F.col("numeral"))
    rows = rows.withColumns({"opens": opens, "next": F.lead("line").over(order)})
    rows = rows.withColumn("piece", F.count_if("opens").over(so_far))
    after = F.when(~F.rlike(F.coalesce("next", F.lit("(a) by")), F.lit(INSTRUCTION)), F.col("next"))
    head = F.concat_ws(" ", "line", after)
    # an inserted section's head is at its number, below its heading
    number_at = F.last(F.col("begins.number_at"), ignorenulls=True).over(Window.partitionBy(*key, "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    is_head = F.when((F.col("how") == "inserted") & number_at.isNotNull(), F.col("at") == number_at).otherwise(F.col("opens"))
    rows = rows.withColumn("head", F.when(is_head, head))
    name = F.when(F.col("how") == "inserted", F.concat(F.lit("new "), F.col("begins.label"))).when(F.col("letter") | F.col("numeral"), F.concat(F.lit("("), F.regexp_extract("line", INSTRUCTION, 1), F.lit(")")))
    target = legal.amendment_target(F.col("head"))
    pieces = rows.groupBy(*key, "piece").agg(
        F.first("title").alias("title"), F.first("how").alias("how"), F.max("paragraph").alias("paragraph"), F.max("letter").alias("letter"),
        F.first(F.when(F.col("opens"), name), ignorenulls=True).alias("name"), F.first("head", ignorenulls=True).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), " ").alias("flat"),
    )
    pieces = pieces.withColumn("own", target)
    around = Window.partitionBy(*key, "paragraph").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    top = Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outer_name = F.when(F.col("how") == "paragraphs", F.first(F.when(F.col("letter"), F.col("name")), ignorenulls=True).over(around))
    label = F.when(F.col("letter") | (F.col("how") == "inserted"), F.col("name")).otherwise(F.concat(F.coalesce(outer_name, F.lit("")), F.coalesce("name", F.lit(""))))
    paragraph_target, section_target = F.first(F.when(F.col("letter"), F.col("own")), ignorenulls=True).over(around), F.first("own").over(top)
    new = (F.col("how") == "inserted") & F.col("name").isNotNull()
    narrow = {c: F.when(new, F.lit(None)).otherwise(F.coalesce(F.col(f"own.{c}"), F.when(F.col("how") == "paragraphs", paragraph_target[c]), section_target[c])) for c in ("section", "subsection", "term")}
    pieces = pieces.withColumns({"label": F.nullif(label, F.lit("")), **narrow})
    # lead-ins join the part after them
    short = (_words(F.col("flat")) < LEAD_WORDS) & F.rlike(F.rtrim("flat"), F.lit("[—:-]$"))
    later = Window.partitionBy(*key).orderBy("piece")
    pieces = pieces.withColumn("lead_in", short & F.lead("piece").over(later).isNotNull())
    pieces = pieces.withColumn("part", F.coalesce(F.count_if(~F.col("lead_in")).over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    part_key = [*key, "part"]
    texts = statute_text(rows.select(*key, "piece", F.col("at").alias("line_no"), "line").join(pieces.select(*key, "piece", "part"), [*key, "piece"]), part_key)
    count = F.count("*").over(Window.partitionBy(*key))
    action = legal.amendment(F.col("title"))
    out = pieces.filter("NOT lead_in").join(texts, part_key).withColumns({"a": action, "parts": count})
    inserted_label = F.when(F.startswith(F.coalesce("label", F.lit("")), F.lit("new ")), F.array(F.substr("label", F.lit(5))))
    new_section = F.coalesce(inserted_label, F.when((F.col("a.action") == "insert") & (F.col("parts") == 1), F.col("a.targets")), F.array().cast("array<string>"))
    return out.select(*key, "title", "a.action", "a.targets", "part", "label", "section", "subsection", "term", legal.inserts_definition(F.col("head")).alias("inserts"), legal.removes_whole(F.col("head")).alias("removes"), new_section.alias("new_section"), "text")

