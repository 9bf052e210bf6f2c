"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token form and the words that are left out of ranking.
TOKEN = r"\d+[a-z]*(?:\(\d+[a-z]?\))*|[a-z]+"
STOPWORDS = (
    "a an the of to in on for and or is are be by my me i can do does if with at as it "
    "this that how many what am will from any s"
).split()
# English function words of the language gate.
FUNCTION_WORDS = (
    "a an the i me my mine we us our you your he him his she her it its they them their "
    "is am are was were be been being do does did done have has had can could will would shall should "
    "may might must not no yes of in on at to for from by with without about as if or and but so than "
    "then there here what which who whom whose when where why how many much any some all this that "
    "these those up out over under after before again also just only very too"
).split()


def tokens(text: Column) -> Column:
    """Lower-case tokens without stopwords; "2(1)" also gives "2" right after itself."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    kept = F.filter(found, lambda t: ~t.isin(STOPWORDS))
    return F.flatten(F.transform(kept, lambda t: F.when(F.contains(t, F.lit("(")), F.array(t, F.split_part(t, F.lit("("), F.lit(1)))).otherwise(F.array(t))))


def digit_signature(line: Column) -> Column:
    """White space collapsed, and every run of digits as #."""
    return F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), "[0-9]+", "#")


def shape(line: Column) -> Column:
    """Every digit as #."""
    return F.regexp_replace(line, "[0-9]", "#")


def slug(term: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(term), "[^a-z0-9]+", "_"), F.lit("_"))


def joined_parts(*parts: Column) -> Column:
    """Parts with a space between; null and empty parts are left out."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def words(text: Column) -> Column:
    """Runs of letters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1))


def dice(a: Column, b: Column) -> Column:
    """Dice overlap of two word arrays as sets; 0 if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def normalised_glyphs(text: Column) -> Column:
    """Private-use and replacement characters and the en dash as an em dash."""
    return F.regexp_replace(text, "[\\x{2013}\\x{FFFD}\\x{E000}-\\x{F8FF}]", "—")


def content_version(data: Column) -> Column:
    """The first twelve hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(data, 256), 1, 12)


def long_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def without_thinking(text: Column) -> Column:
    """A model's reply without its think blocks."""
    return F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def script_gate(text: Column, min_words: int = 3, min_share: float = 0.3) -> Column:
    """Struct passed, language: the question gate by script and English function words.

    Mostly letters beyond Latin: stopped.  Fewer words than ``min_words``:
    passed without a verdict.  A share of function words under ``min_share``:
    stopped.  Else passed, as "en" if at least half of the words are English
    and "mixed" otherwise.
    """
    text = F.coalesce(text, F.lit(""))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    latin = F.regexp_count(text, F.lit(r"[\x{0041}-\x{024F}&&\p{L}]"))
    found = words(text)
    share = F.size(F.filter(found, lambda w: F.lower(w).isin(FUNCTION_WORDS))) / F.size(found)
    few = F.size(found) < min_words
    passed = F.when((letters > 0) & ((letters - latin) * 2 > letters), False).when(few, True).otherwise(share >= min_share)
    language = F.when(~passed, F.lit(None)).when(few, F.lit(None)).when(share >= 0.5, "en").otherwise("mixed")
    return F.struct(passed.alias("passed"), language.cast("string").alias("language"))
