"""Answer assembly: context blocks, messages, citation markers, status; and sampling for audits.

All of it is column expressions, so that a batch of replies is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.legal import squeezed
from citeloom.functions.text import without_thinking

# The forms of a placeholder and of an amendment tag that is a line by itself.
PLACEHOLDER = r"(?i)^[\[(](Deleted|Omitted|Repealed)(?: by)?(?: (.+?))?\.?[\])]\.?$"
ANNOTATION = r"^\s*\[(?:Am|Sub|Ins|Mod|Added)\.\s[^\]]*\]\.?\s*$"


def placeholder(text: Column) -> Column:
    """Struct status, instrument of a placeholder like "(Omitted)." or "[Deleted by Act A1]"; nulls for any other text."""
    clean = squeezed(F.regexp_replace(text, r"\*+(?=[\w(])", ""))
    word = F.lower(F.regexp_extract(clean, PLACEHOLDER, 1))
    status = F.when(word == "omitted", "omitted").when(word != "", "deleted")
    return F.struct(status.alias("status"), F.nullif(F.regexp_extract(clean, PLACEHOLDER, 2), F.lit("")).alias("instrument"))


def annotations_apart(lines: Column) -> Column:
    """Struct text, tags: an array of lines without the amendment tags among them, and those."""
    tag = lambda x: F.rlike(x, F.lit(ANNOTATION))
    return F.struct(F.filter(lines, lambda x: ~tag(x)).alias("text"), F.transform(F.filter(lines, tag), squeezed).alias("tags"))


def non_current(status: Column, amended_by: Column, cited: Column) -> Column:
    """Whether a cited chunk is out of force, or superseded while no chunk that amends it is cited."""
    return status.isin("deleted", "omitted", "not_yet_in_force") | ((status == "superseded") & ~F.arrays_overlap(amended_by, cited))


def context_block(number: Column, citation: Column, title: Column, jurisdiction: Column, status: Column, content: Column) -> Column:
    """``[n] citation | title | jurisdiction | STATUS``, then the content; empty parts are left out."""
    head = F.concat_ws(" | ", *(F.nullif(x, F.lit("")) for x in (citation, title, jurisdiction, F.upper(status))))
    return F.concat_ws("\n", F.concat(F.lit("["), number.cast("string"), F.lit("] "), head), content)


def abstention_message(reason: Column, held: Column) -> Column:
    tail = F.concat(F.lit(" Held: "), F.array_join(held, "; "), F.lit("."))
    return F.when(reason == "language", "Please ask in English.").when(reason == "no_candidates", F.concat(F.lit("No passage was found."), tail)).otherwise(F.concat(F.lit("No passage answers this well enough."), tail))


def stages(abstained: Column, failed: Column) -> Column:
    """The names of a request's messages, in order."""
    named = lambda *x: F.array(*map(F.lit, x))
    rest = F.when(abstained, named("retrieval", "answer")).otherwise(named("retrieval", "stage:generating", "answer"))
    return F.concat(named("stage:retrieving"), F.when(failed, named("error")).otherwise(rest))


def stratified_sample(rows: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    """Rows drawn by a seeded hash: a half-even share of each stratum, at least one, the remainder to the largest."""
    by = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row a stratum
    quota = F.greatest(F.lit(1), F.bround(F.lit(total) * F.col("n") / F.sum("n").over(every), 0)).cast("long")
    by = by.withColumn("quota", quota).withColumn("rest", F.lit(total) - F.sum("quota").over(every))
    by = by.withColumn("largest", F.row_number().over(Window.orderBy(F.desc("n"), stratum)) == 1)
    by = by.select(stratum, F.when(F.col("largest"), F.col("quota") + F.col("rest")).otherwise(F.col("quota")).alias("quota"))
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key)
    return rows.withColumn("at", F.row_number().over(order)).join(by, stratum).filter(F.col("at") <= F.col("quota")).drop("at", "quota")


# The forms of markers, of sentence ends, and of mentions of provisions and statutes.
MARKER = r"(\s*)\[\s*(\d+(?:\s*[-–,]\s*\d+)*)\s*\]"
SENTENCE_END = r"(?<=[.!?\]])\s+(?=[A-Z\"'(])"
MENTION = r"\b(?i:sections?|subsections?|regulations?|reg\.|ss?\.)\s?\d+[A-Z]*(?:\(\w+\))*|\b(?:[A-Z][a-z]+ )+(?:Act|Ordinance)\b(?: \d{4})?|\b(?:EA|IRA)\b(?: \d{4})?|\bCap\. ?\d+"
LONGEST_RANGE, LEAST_WORDS = 20, 6


def marked_numbers(group: Column) -> Column:
    """The numbers of a marker's inside, in order, each once: ranges up to LONGEST_RANGE are filled, in whichever order their ends stand."""

    def part(x: Column) -> Column:
        ends = F.transform(F.split(F.trim(x), r"\s*[-–]\s*"), lambda n: n.cast("long"))
        low, high = F.array_min(ends), F.array_max(ends)
        return F.when(high - low <= LONGEST_RANGE, F.sequence(low, high)).otherwise(ends)

    return F.array_distinct(F.flatten(F.transform(F.split(group, ","), part)))


def uncited(text: Column) -> Column:
    """Sentences of LEAST_WORDS words or more without a marker that do not lead to a list."""
    sentences = F.flatten(F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.trim(x), SENTENCE_END)))
    bare = F.filter(sentences, lambda s: (F.regexp_count(s, F.lit("[A-Za-z]+")) >= LEAST_WORDS) & ~F.rlike(s, F.lit(":$")) & ~F.rlike(s, F.lit(MARKER)))
    return F.size(bare)


def mentions(text: Column) -> Column:
    """Provisions and statutes that a text names, in order, each once."""
    found = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, "^(?:The|Under|In|By) ", "")))


def resolved(text: Column, blocks: Column) -> Column:
    """Struct answer, cited, invalid, uncited, mentions.

    Markers are numbered anew in order of first use, one bracket for each
    number; ``cited`` has the blocks in that order.  Numbers of no block are
    dropped and noted once; a marker left without any goes with the space before.
    """
    leads = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    groups = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(2)), marked_numbers)
    every = F.flatten(groups)
    fits = lambda n: (n >= 1) & (n <= blocks)
    cited = F.array_distinct(F.filter(every, fits))
    invalid = F.array_distinct(F.filter(every, lambda n: ~fits(n)))
    brackets = F.zip_with(leads, groups, lambda lead, g: F.when(F.exists(g, fits), F.concat(lead, F.array_join(F.transform(F.filter(g, fits), lambda n: F.concat(F.lit("["), F.array_position(cited, n).cast("string"), F.lit("]"))), ""))).otherwise(""))
    between = F.split(text, MARKER, -1)
    answer = F.regexp_replace(F.array_join(F.zip_with(between, brackets, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), ""), r"^\s+|\s+$", "")
    return F.struct(answer.alias("answer"), cited.alias("cited"), invalid.alias("invalid"), uncited(answer).alias("uncited"), mentions(answer).alias("mentions"))


#: A model says so if the context is not enough, and states limits on a line of their own.
INSUFFICIENT = "INSUFFICIENT_CONTEXT"
LIMITS = r"(?ims)\A(.*?)^[ \t*_-]*LIMITS:[ \t]*([^\n]*)(?:\n|\z)"


def limits_apart(text: Column) -> Column:
    """Struct body, limits: a reply without its first LIMITS line, and that line's text without markers (null if there is none)."""
    edges = r"^\s+|\s+$"
    body = F.regexp_replace(F.regexp_replace(text, LIMITS, "$1"), edges, "")
    limits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, LIMITS, 2), MARKER, ""), edges, "")
    return F.struct(body.alias("body"), F.nullif(limits, F.lit("")).alias("limits"))


def assemble(replies: DataFrame) -> DataFrame:
    """query_id, status, answer, limits, cited, invalid, uncited, truncated of replies (query_id, reason, notice, reply, finish, blocks).

    A reason means abstained, with the notice and no model call; an empty reply
    is an error; the sentinel anywhere means insufficient_context; else answered.
    """
    reply = without_thinking(F.coalesce("reply", F.lit("")))
    rows = replies.select("query_id", "reason", "notice", "finish", "blocks", reply.alias("reply"))
    lost = F.raise_error(F.format_string("empty reply to %s", F.col("query_id").cast("string")))
    status = F.when(F.col("reason").isNotNull(), "abstained").when(F.col("reply") == "", lost.cast("string")).when(F.contains(F.col("reply"), F.lit(INSUFFICIENT)), "insufficient_context").otherwise("answered")
    rows = rows.withColumns({"status": status, "parts": limits_apart(F.col("reply"))}).withColumn("found", resolved(F.col("parts.body"), F.col("blocks")))
    answered = F.col("status") == "answered"
    none = F.array().cast("array<long>")
    return rows.select(
        "query_id",
        "status",
        F.when(answered, F.col("found.answer")).when(F.col("status") == "abstained", F.col("notice")).alias("answer"),
        F.when(answered, F.col("parts.limits")).alias("limits"),
        *(F.when(answered, F.col(f"found.{c}")).otherwise(none).cast("array<int>").alias(c) for c in ("cited", "invalid")),
        F.when(answered, F.col("found.uncited")).otherwise(0).alias("uncited"),
        ((F.col("status") != "abstained") & F.coalesce(F.col("finish") == "length", F.lit(False))).alias("truncated"),
    )


#: Names of regions and of statuses in a prompt.
STATUS_NAMES = {"in_force": "IN FORCE", "not_yet_in_force": "NOT YET IN FORCE", "deleted": "DELETED", "omitted": "OMITTED"}


def status_name(status: Column, amended_by: Column, shown: Column) -> Column:
    """A block's status; a superseded one names what amends it and the blocks (``shown``: a map of chunk id to number) where that stands."""
    name = F.coalesce(F.create_map(*(x for k, v in STATUS_NAMES.items() for x in (F.lit(k), F.lit(v))))[status], status)
    at = F.filter(F.transform(amended_by, lambda a: F.element_at(shown, a)), lambda n: n.isNotNull())
    where = F.when(F.size(at) > 0, F.concat(F.lit("see block "), F.array_join(F.transform(at, lambda n: n.cast("string")), ", "))).otherwise("amending text not shown")
    return F.when(status == "superseded", F.concat(F.lit("SUPERSEDED, amended by "), F.array_join(amended_by, ", "), F.lit(" ("), where, F.lit(")"))).otherwise(name)


def prompt(region: Column, notes: Column, context: Column, question: Column) -> Column:
    """A question's prompt: region, notes (an array), the blocks and the question."""
    said = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("Note: "), F.trim(n), F.lit("\n\n"))), "")
    return F.concat(F.lit("Region: "), F.coalesce(region, F.lit("not given")), F.lit("\n\n"), said, F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def section_ref(citation: Column, statute: Column) -> Column:
    """A citation without its statute's name in front."""
    prefix = F.concat(statute, F.lit(", "))
    return F.when(F.startswith(citation, prefix), F.substr(citation, F.length(prefix) + 1)).otherwise(citation)


def chip_label(citation: Column, statute: Column) -> Column:
    """The reference, then the statute; the whole citation if the statute is not in front of it."""
    ref = section_ref(citation, statute)
    return F.when(ref == citation, ref).otherwise(F.concat_ws(", ", ref, statute))


def statements(line: Column, known: Column) -> Column:
    """An array of structs text, markers: what each group of known markers closes, and the rest.

    Punctuation right after a group goes before it; other markers stay text.
    """
    clean = F.regexp_replace(line, r"\*\*", "")
    marks = F.regexp_extract_all(clean, F.lit(r"\[\d+\]"), F.lit(0))
    tokens = F.filter(F.flatten(F.zip_with(F.split(clean, r"\[\d+\]", -1), marks, lambda x, m: F.array(x, F.coalesce(m, F.lit(""))))), lambda t: t != "")
    none = F.array().cast("array<bigint>")
    cut = lambda x: F.regexp_replace(x, r"\s+$", "")

    def step(s: Column, t: Column) -> Column:
        number = F.regexp_extract(t, r"^\[(\d+)\]$", 1).try_cast("bigint")
        mark = F.coalesce(F.array_contains(known, number), F.lit(False))
        closes = ~mark & (F.size(s["markers"]) > 0)
        lead = F.regexp_extract(t, r"^[.,;:!?)]+", 0)
        closed = F.concat(s["done"], F.array(F.struct(cut(F.concat(cut(s["text"]), lead)).alias("text"), s["markers"].alias("markers"))))
        return F.struct(
            F.when(closes, closed).otherwise(s["done"]).alias("done"),
            F.when(mark, s["text"]).when(closes, F.substr(t, F.length(lead) + 1)).otherwise(F.concat(s["text"], t)).alias("text"),
            F.when(mark, F.array_union(s["markers"], F.array(number))).when(closes, none).otherwise(s["markers"]).alias("markers"),
        )

    start = F.struct(F.array().cast("array<struct<text:string,markers:array<bigint>>>").alias("done"), F.lit("").alias("text"), none.alias("markers"))
    last = lambda s: F.when((F.size(s["markers"]) > 0) | (F.trim(s["text"]) != ""), F.concat(s["done"], F.array(F.struct(cut(s["text"]).alias("text"), s["markers"].alias("markers"))))).otherwise(s["done"])
    return F.aggregate(tokens, start, step, last)


def answer_blocks(rows: DataFrame, key: str, answer: str, known: str) -> DataFrame:
    """key, line, block, kind (heading, paragraph, ordered, bullet) and statements of every line that is not blank.

    List items of one kind that follow each other share a block.
    """
    lines = rows.select(key, known, F.posexplode(F.split(answer, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).filter("raw <> ''")
    forms = {"heading": r"^#{1,6}\s+(.*)$", "bullet": r"^[-*•]\s+(.*)$", "ordered": r"^\d+[.)]\s+(.*)$"}
    kind, text = F.lit("paragraph"), F.col("raw")
    for name, form in reversed(forms.items()):
        fits = F.rlike("raw", F.lit(form))
        kind, text = F.when(fits, name).otherwise(kind), F.when(fits, F.regexp_extract("raw", form, 1)).otherwise(text)
    order = Window.partitionBy(key).orderBy("line")
    lines = lines.withColumns({"kind": kind, "text": text})
    same = F.col("kind").isin("bullet", "ordered") & F.coalesce(F.lag("kind").over(order) == F.col("kind"), F.lit(False))
    lines = lines.withColumn("fresh", ~same).withColumn("block", F.count_if("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.select(key, "line", "block", "kind", statements(F.col("text"), F.col(known)).alias("statements"))


#: What a user is told for each kind of failure; never the error's own text, which can hold a question or an answer.
PUBLIC_ERRORS = {
    "generator_unavailable": (503, "The answer service is not available for the moment. Please try again in a few minutes."),
    "generator_error": (502, "No answer could be produced this time. Please try again."),
    "not_found": (404, "There is no provision with this id."),
    "internal_error": (500, "Something went wrong. Please try again."),
}


def public_error(error: Column, expired: str, failed: str) -> Column:
    """Struct status, code, message of an error's text: ``expired`` is one text, ``failed`` how texts of failed calls begin; null without error."""
    made = lambda code: F.struct(F.lit(PUBLIC_ERRORS[code][0]).alias("status"), F.lit(code).alias("code"), F.lit(PUBLIC_ERRORS[code][1]).alias("message"))
    return F.when(error == expired, made("generator_unavailable")).when(F.startswith(error, F.lit(failed)), made("generator_error")).when(error == "not found", made("not_found")).when(error.isNotNull(), made("internal_error"))


def event_frame(event: Column, data: Column) -> Column:
    """A server-sent event: its name, its data as JSON, and an empty line."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))
