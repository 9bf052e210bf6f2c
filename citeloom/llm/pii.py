"""Personal data by fixed forms and by bootstrapped contexts.

Base spans follow four fixed forms.  They are the seeds: the words around a
seed are a lexical pattern.  Every identifier-like token, and every run of
groups of digits, is an instance that occurs in patterns, whether a form matched it or not, so patterns and instances
make a bipartite graph over the whole corpus.  Spark scores it in rounds: a
pattern's confidence is the smoothed share of its distinct instances that are
believed, an instance's that of its best pattern (seeds: 1).  Instances of
patterns of high confidence become spans of the pattern's kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.storage import bounded_batches, written

# The kinds in their order, and the characters of their forms.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: An instance: a token with an at sign or a dotted number, or one that is mostly digits and has at least so many.
_TOKEN = re.compile(r"[^\s,;:!?\"'<>(){}\[\]#$&*=|]+")
_MARK = re.compile(r"[0-9@]")
LEAST_DIGITS = 6
#: Or groups of digits, also in parentheses, with at most one mark between them; a run that ends within a token is cut back.
_GROUP = r"(?:\([0-9]++(?:[ ./-][0-9]++)*+\)|[0-9]++)"
_RUN = re.compile(rf"(?<![\w@])\+?{_GROUP}(?:[ ./-]?{_GROUP})*+")
_GOES_ON = re.compile(r"[.+/%~-]*+[\w@]")
_WORD = re.compile(r"[^\W\d_]+")
#: Rounds of scoring; a pattern is of use with so many believed instances and such a confidence.
ROUNDS, LEAST_SEEDS, CONFIDENCE = 3, 5, 0.8
SALTS = 16
#: Characters of text whose results leave Python together.
TOGETHER = 1 << 20

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms, by kind as listed, then start; leftmost and not overlapping within a kind."""
    out = list(_emails(text)) if "@" in text else []
    if not any(map(text.__contains__, "0123456789")):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _shape(token: str) -> str:
    """Which kinds a token can be of: an address, a dotted number or a long number."""
    if "@" in token:
        return "email"
    digits = sum("0" <= c <= "9" for c in token)
    if token.count(".") == 3 and digits + 3 == len(token):
        return "ip"
    if digits * 2 < len(token) or digits < LEAST_DIGITS:
        return ""
    return "card" if digits > 15 else "phone"


class _Lines:
    """The words around places of a text, asked in any order; each line is taken apart once."""

    def __init__(self, text: str):
        self._text = text
        self._from, self._to = 0, -1
        self._begins: list[int] = []
        self._ends: list[int] = []

    def pattern(self, start: int, end: int) -> str | None:
        """The nearest word on each side on the same line, in lower case; none if there is no word on either."""
        text = self._text
        if not self._from <= start <= self._to:
            self._from = text.rfind("\n", 0, start) + 1
            stop = text.find("\n", start)
            self._to = stop if stop >= 0 else len(text)
            found = [m.span() for m in _WORD.finditer(text, self._from, self._to)]
            self._begins, self._ends = [a for a, _ in found], [b for _, b in found]
        left, right = bisect_left(self._begins, start) - 1, bisect_right(self._ends, end)
        before = text[self._begins[left] : min(self._ends[left], start)].lower() if left >= 0 else ""
        after = text[max(self._begins[right], end) : self._ends[right]].lower() if right < len(self._ends) else ""
        return f"{before} _ {after}" if before or after else None


def _runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of runs of two groups of digits or more, between the spans ``taken`` (sorted)."""
    at = 0
    for stop, after in [*taken, (len(text), len(text))]:
        for m in _RUN.finditer(text, at, max(at, stop)):
            a, b = m.span()
            if b < stop and _GOES_ON.match(text, b, stop):
                b = max(text.rfind(" ", a, b), text.rfind("(", a, b), text.rfind(")", a, b) + 1)
                while b > a and text[b - 1] in " ./-":
                    b -= 1
            if text[a:b].startswith("(") and text.find(")", a, b) == b - 1:
                a, b = a + 1, b - 1
            if b > a and not text[a:b].lstrip("+").isdigit():
                yield a, b
        at = max(at, after)


def _occurrences(text: str, base: list[Span]) -> list[tuple[str, str, str, int, int, bool]]:
    """(kind, pattern, instance, start, end, seed) of base spans, and of runs and tokens outside of them."""
    lines = _Lines(text)
    out = [(k, p, text[a:b], a, b, True) for k, a, b in sorted(base, key=lambda s: s[1:]) if (p := lines.pattern(a, b))]
    if "@" not in text and not any(map(text.__contains__, "0123456789")):
        return out
    taken = sorted((a, b) for _, a, b in base)
    runs = [(k, a, b) for a, b in _runs(text, taken) if (k := _shape(text[a:b]))]
    out += [(k, p, text[a:b], a, b, False) for k, a, b in runs if (p := lines.pattern(a, b))]
    taken = sorted([*taken, *((a, b) for _, a, b in runs)])
    at = 0
    for m in _TOKEN.finditer(text):
        a, b = m.start(), m.end()
        if not _MARK.search(text, a, b):
            continue
        while text[b - 1] in ".-+/" and b - a > 1:
            b -= 1
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b or not (kind := _shape(text[a:b])):
            continue
        if p := lines.pattern(a, b):
            out.append((kind, p, text[a:b], a, b, False))
    return out


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, kinds array<string>, patterns array<string>, instances array<string>, starts array<int>, ends array<int>, seeds array<boolean>"
_FIELDS = [c.split()[0] for c in _FOUND.split(", ")]


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Results leave in frames of about TOGETHER characters of text, however long a batch is."""
    rows, size = [], 0
    for texts in batches:
        for text in texts:
            text = text if isinstance(text, str) else ""
            base = base_spans(text)
            line = joined(base)
            seen = _occurrences(text, base)
            rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(line.encode()).hexdigest(), line, *([x[i] for x in seen] for i in range(6))))
            size += len(text) + 64
            if size >= TOGETHER:
                yield pd.DataFrame(rows, columns=_FIELDS)
                rows, size = [], 0
    yield pd.DataFrame(rows, columns=_FIELDS)


def _graph(found: DataFrame) -> DataFrame:
    """Distinct edges: kind, pattern, instance (as hashes) and seed."""
    each = F.arrays_zip("kinds", "patterns", "instances", "seeds")
    rows = found.filter(F.size("kinds") > 0).select(F.explode(each).alias("o"))
    rows = rows.select(F.col("o.kinds").alias("kind"), F.xxhash64("o.kinds", "o.patterns").alias("pattern"), F.xxhash64("o.kinds", "o.instances").alias("instance"), F.col("o.seeds").alias("seed"))
    return written(rows.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-graph")


def pattern_confidence(found: DataFrame) -> DataFrame:
    """pattern and confidence, after ROUNDS rounds over the graph of all rows.

    Believed mass of a pattern: the sum of its distinct instances' beliefs.  Its
    confidence is mass / (instances + 1), and 0 with a mass under LEAST_SEEDS.
    """
    edges = _graph(found)
    belief = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for k in range(ROUNDS):
        held = edges.join(belief, "instance")  # unique on one side; an instance of many patterns is left to the adaptive skew join
        mass = F.sum("belief")
        scored = held.groupBy("pattern").agg(mass.alias("mass"), (mass / (F.count("*") + 1)).alias("confidence"))
        patterns = written(scored.select("pattern", F.when(F.col("mass") >= LEAST_SEEDS, F.col("confidence")).otherwise(0.0).alias("confidence")).filter("confidence > 0"), "patterns")
        if k + 1 < ROUNDS:
            best = _in_salted(edges, patterns, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"), F.max("seed").alias("seed"))
            belief = edges.select("instance", "seed").groupBy("instance").agg(F.max("seed").alias("seed")).join(best.select("instance", "best"), "instance", "left")
            belief = belief.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("belief"))
    return patterns


def _in_salted(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join in which a frequent key of ``rows`` is SALTS tasks."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(SALTS))).join(few, [key, "salt"]).drop("salt")


def _with_spans(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df``, counts, base_sha256 and spans, in a column ``__pii``."""
    bounded_batches(df.sparkSession)
    first = df.select(F.struct(*keep).alias("own"), F.monotonically_increasing_id().alias("row"), F.pandas_udf(_scan, _FOUND)(df[text]).alias("found"))
    first = written(first.select("own", "row", "found.*"), "pii")
    patterns = pattern_confidence(first).filter(F.col("confidence") >= CONFIDENCE).select("pattern")
    each = F.arrays_zip("kinds", "patterns", "starts", "ends", "seeds")
    fresh = first.filter(F.size("kinds") > 0).select("row", F.explode(each).alias("o")).filter(~F.col("o.seeds"))
    fresh = fresh.select("row", F.xxhash64("o.kinds", "o.patterns").alias("pattern"), F.struct(F.col("o.kinds").alias("kind"), F.col("o.starts").alias("start"), F.col("o.ends").alias("end")).alias("span"))
    added = _in_salted(fresh, patterns, "pattern").groupBy("row").agg(F.collect_set("span").alias("added"))
    order = F.array(*(F.lit(k) for k in KINDS))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end")),
    )
    every = F.transform(F.concat(base, F.col("added")), lambda s: F.struct(F.array_position(order, s["kind"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    line = F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(line).alias("spans")
    return first.join(added, "row", "left").select("own.*", F.struct("n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans).alias("__pii"))


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    Counts and base_sha256 are of the fixed forms; ``spans`` adds what contexts
    discover: an instance is looked for on its line, however long both are, but
    a number is one only with LEAST_DIGITS digits.  Offsets are in code points,
    ends exclusive.  Null texts are empty; repeated rows give repeated rows;
    other columns are left out.
    """
    return _with_spans(df, text, [key]).select(key, "__pii.*")


def _masked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in batches:
        yield pd.Series([mask(t, s) if isinstance(t, str) and s else t for t, s in zip(texts, spans, strict=True)], dtype=object)


def mask(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first one names both."""
    out, done = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join((*out, text[done:]))


def without_personal_data(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in texts are masked."""
    found = _with_spans(documents, "text", documents.columns)
    text = F.pandas_udf(_masked, "string")(F.col("text"), F.col("__pii.spans")).alias("text")
    found = found.select(*(text if c == "text" else F.col(c) for c in documents.columns), F.col("__pii.spans").alias("__spans"))
    n = F.when(F.col("__spans") == "", F.col("n_chars")).otherwise(F.length("text")).alias("n_chars") if "n_chars" in documents.columns else None
    return found.select(*(n if c == "n_chars" else F.col(c) for c in documents.columns))
