"""Column functions over lines, titles and texts of statutes and awards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of an amending section's title, with the action each means and what of it names the targets.
TITLES = (
    (r"Amendment of sections? (.+)", "amend", "sections"),
    (r"Substitution of sections? (.+)", "substitute", "sections"),
    (r"Deletion of sections? (.+)", "delete", "sections"),
    (r"New sections? (.+)", "insert", "sections"),
    (r"Deletion of (Chapter \w+)", "delete_chapter", "unit"),
    (r"Amendment of (Chapter \w+)", "amend_heading", "unit"),
    (r"New (Chapter \w+)", "insert_chapter", "unit"),
    (r"New (Part \w+)", "insert_part", "unit"),
    (r"Substitution of (Schedule)", "substitute_schedule", "schedule"),
    (r"New .*Schedules?()", "insert_schedule", ""),
    (r"General amendments()", "general", ""),
)
# What begins a numbered run of provisions, per label; a number; a statute's name.
NUMBER = r"\d+[A-Z]*(?:\(\d+[A-Z]?\))?"
NUMBERS = rf"\s+({NUMBER}(?:\s*(?:,|and|or|to)\s*{NUMBER})*)"
PROVISION = {"s.": r"\b(?:sub)?sections?", "reg.": r"\b(?:sub)?regulations?"}
OTHER_ACT = r"[^.;]{0,40}?\bof the [A-Z][\w’' ]*(?:Act|Ordinance|Enactment)\b"
STATUTE = r"\b((?:[A-Z][\w’'()]*\s+)+(?:Act|Ordinance|Enactment|Order|Regulations)\s+\d{4}(?:\s*\[(?:Act|Cap\.)\s*[\w.]+\])?)"
# Words of headings, and labels before or instead of them.
SMALL_WORDS = "of the and on to in for by a an or & with into as at".split()
LONE_HEADINGS = "DECISION CONCLUSION REMEDY REMEDIES ISSUES INTRODUCTION PREFACE FINDINGS EVALUATION ANALYSIS BACKGROUND SUBMISSIONS FACTS EVIDENCE".split()
LABEL = r"\(?(?:[A-Za-z]|[ivxIVX]{2,4}|\d{1,2})[.)]"
LABELLED = r"\(?(?:[A-Za-z]|[ivxIVX]{2,4})\)\s+\S"
# Forms of a printed page number, in the order in which they are tried, and of a line whose last number is another's.
PAGE_FORMS = (r"^\s*(\d+)\s*$", r"^\s*(\d{1,4})\s+\D", r"^.*\s(\d{1,4})\s*$")
NUMBER_OF_ACT = r"\b(?:ACT|Act|CAP|Cap|NO|No)\.?\s*\d+\s*$"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def exactly(form: str) -> str:
    return f"^(?:{form})$"


def whole(form: str) -> Column:
    return F.lit(exactly(form))


def spaced_words(tokens: Column, gaps: Column) -> Column:
    """Words of letters set apart: a gap over the middle of the smallest and the largest is a space, if the largest is over twice the smallest."""
    low, high = F.array_min(gaps), F.array_max(gaps)
    space = F.transform(gaps, lambda g: F.when((high > 2 * low) & (g > (low + high) / 2), " ").otherwise(""))
    return F.array_join(F.transform(tokens, lambda t, i: F.concat(F.when(i > 0, F.coalesce(F.get(space, i - 1), F.lit(""))).otherwise(""), t)), "")


def printed_page(lines: Column) -> Column:
    """A number alone on a line, else at a line's start, else at its end unless it is an Act's, Cap.'s or No.'s."""

    def first(form: str, fit: Column) -> Column:
        return F.get(F.transform(F.filter(fit, lambda x: F.rlike(x, F.lit(form))), lambda x: F.regexp_extract(x, form, 1)), F.lit(0))

    others = F.filter(lines, lambda x: ~F.rlike(x, F.lit(NUMBER_OF_ACT)))
    return F.coalesce(*(first(form, others if form == PAGE_FORMS[-1] else lines) for form in PAGE_FORMS)).try_cast("long")


def own_references(text: Column, known: Column, label: str = "s.") -> Column:
    """References to provisions of this document, in order, each once; a run that goes on to another Act's name is not one."""
    runs = F.regexp_extract_all(text, F.lit(rf"{PROVISION[label]}(?>{NUMBERS})(?!{OTHER_ACT})"), F.lit(1))
    refs = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(NUMBER), F.lit(0))))
    ours = F.filter(refs, lambda r: F.array_contains(known, F.regexp_extract(r, r"^\d+[A-Z]*", 0)))
    return F.array_distinct(F.transform(ours, lambda r: F.concat(F.lit(f"{label} "), r)))


def other_statutes(text: Column, own: Column) -> Column:
    """Statutes named in a text, in order, each once; not those whose name has the document's in it or is in it."""
    names = F.transform(F.regexp_extract_all(squeezed(text), F.lit(STATUTE), F.lit(1)), lambda n: F.trim(F.regexp_replace(n, r"^(?:[Tt]he|of|under|in)\s+", "")))
    return F.array_distinct(F.filter(names, lambda n: ~F.contains(F.lower(n), F.lower(own)) & ~F.contains(F.lower(own), F.lower(n))))


def amendment(title: Column) -> Column:
    """Struct action, targets of an amending section's title; "other" without targets for any other form."""
    return let(F.regexp_replace(squeezed(title), r"\.+$", ""), _action)


def _action(text: Column) -> Column:
    none = F.array().cast("array<string>")
    found = F.struct(F.lit("other").alias("action"), none.alias("targets"))
    for form, action, names in reversed(TITLES):
        named = F.regexp_extract(text, exactly(form), 1)
        targets = {
            "sections": F.transform(F.regexp_extract_all(named, F.lit(r"\d+[a-z]*"), F.lit(0)), F.upper),
            "unit": F.array(F.concat_ws(" ", F.substring_index(named, " ", 1), F.upper(F.substring_index(named, " ", -1)))),
            "schedule": F.array(F.lit("SCHEDULE")),
        }.get(names, none)
        found = F.when(F.rlike(text, whole(form)), F.struct(F.lit(action).alias("action"), targets.alias("targets"))).otherwise(found)
    return found


def inserts_definition(line: Column) -> Column:
    return F.rlike(squeezed(line), F.lit(r"by inserting after the (?:deleted )?definition of"))


def removes_whole(line: Column) -> Column:
    return F.rlike(squeezed(line), F.lit(r"^\(\w+\) by deleting (?:the definition of|subsection|paragraph \()"))


def amendment_target(line: Column) -> Column:
    """Struct section, subsection, term that the first line of an amending part names; the first form that fits names them."""
    return let(squeezed(line), _target)


def _target(text: Column) -> Column:
    none = F.lit(None).cast("string")
    named = r"^(?:Subsection|Paragraph|Subparagraph) (\d+[a-z]*)\((\d+[A-Za-z]?)\)"
    inside = r"^\(\w+\) (?:by substituting for|by deleting|in) (?:subsection|paragraph) \((\d+[A-Z]?)\)"
    term = r"(?:in|for|deleting) the definition of “([^”]+)”"

    def part(form: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, form, group), F.lit(""))

    def target(section: Column, subsection: Column, term: Column) -> Column:
        return F.struct(section.alias("section"), subsection.alias("subsection"), term.alias("term"))

    bracketed = lambda x: F.concat(F.lit("("), x, F.lit(")"))
    rest = F.when(~inserts_definition(text), part(term, 1))
    by_rest = F.when(F.rlike(text, F.lit(inside)), target(none, bracketed(part(inside, 1)), none)).otherwise(target(none, none, rest))
    return F.when(F.rlike(text, F.lit(named)), target(F.upper(part(named, 1)), bracketed(part(named, 2)), none)).otherwise(by_rest)


def labelled(text: Column) -> Column:
    return F.rlike(text, whole(LABEL)) | F.rlike(text, F.lit(f"^{LABELLED}"))


def bare_heading(line: Column) -> Column:
    """A line's text without spaces and a colon at its end."""
    return F.trim(F.regexp_replace(F.trim(line), ":+$", ""))


def heading_part(line: Column) -> Column:
    """Whether a line can be part of a heading: a label, or words from a capital on, 12 at most, without full stop, amount or parties."""
    text = bare_heading(line)
    prose = F.rlike(text, F.lit(r"\.|[,;]$|^\d|^RM|(?:^| )v(?: |$)")) | (F.size(F.split(text, r"\s+")) > 12)
    named = F.rlike(text, F.lit(r"[A-Za-z]{2}")) & F.rlike(text, F.lit(r"^[(“\"']*\p{Lu}"))
    return (text != "") & (labelled(text) | (~prose & named))


def whole_heading(text: Column) -> Column:
    """One known word, or up to 14 words of which one is long enough and no small word; labels do not count."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~F.rlike(w, whole(LABEL)))
    known = F.array(*map(F.lit, LONE_HEADINGS))
    small = F.array(*map(F.lit, SMALL_WORDS))
    one = F.array_contains(known, F.regexp_replace(F.upper(F.get(words, F.lit(0))), "^:+|:+$", ""))
    some = F.size(words).between(2, 14) & F.exists(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(small, F.lower(w)))
    return F.when(F.size(words) == 1, one).otherwise(some)
