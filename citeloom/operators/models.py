"""Models behind interfaces: an encoder, a word detector, a chat client and what is done with its rewrites.

A factory makes the model once in each task that needs it, so nothing is sent
but the factory; ``close`` is called at the end if there is one.  The stand-ins
here are deterministic and need no weights.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that an encoder gets at once.
BATCH = 16


class HashEncoder:
    """Counts of words by the first hexadecimal digit of their MD5, as a unit vector: 16 dimensions."""

    dimensions = 16

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts = [0.0] * self.dimensions
            for word in re.findall("[a-z]+", text.lower()):
                counts[int(hashlib.md5(word.encode()).hexdigest()[0], 16)] += 1
            norm = math.sqrt(sum(c * c for c in counts))
            out.append([c / norm for c in counts] if norm else counts)
        return out


def _closed(model: object) -> None:
    if close := getattr(model, "close", None):
        close()


def embedded(text: Column, encoder: Callable[[], object] = HashEncoder) -> Column:
    """The vector (array of double) of every text, BATCH texts at a time; null for null."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        try:
            for texts in batches:
                out: list = [None] * len(texts)
                there = [i for i, t in enumerate(texts) if isinstance(t, str)]
                for at in range(0, len(there), BATCH):
                    model = model or encoder()
                    some = there[at : at + BATCH]
                    for i, v in zip(some, model.encode([texts.iloc[i] for i in some]), strict=True):
                        out[i] = v
                yield pd.Series(out, dtype=object)
        finally:
            _closed(model)

    return vectors(text)


def detected_words(texts: DataFrame, key: str, text: str, known: list[str], confidence: Callable[[], Callable[[str], float]], least: float = 0.5) -> DataFrame:
    """key, n_words and n_english of every row: words of the list, or that the detector is confident of.

    The detector sees every distinct word once, however often it occurs.
    """
    words = texts.select(key, F.explode_outer(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy(key, "word").agg(F.count("word").alias("n"))

    @F.pandas_udf("boolean")
    def sure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = confidence()
        for some in batches:
            yield some.map(lambda w: detect(w) >= least)

    distinct = counts.filter(F.col("word").isNotNull() & ~F.col("word").isin(known)).select("word").distinct()
    judged = distinct.select("word", sure("word").alias("sure"))
    rows = counts.join(judged, "word", "left")
    english = F.col("word").isin(known) | F.coalesce("sure", F.lit(False))
    return rows.groupBy(key).agg(F.sum("n").alias("n_words"), F.coalesce(F.sum(F.when(english, F.col("n"))), F.lit(0)).alias("n_english"))


class Transient(Exception):
    """A server's or a connection's error that may pass."""


class SessionExpired(Exception):
    """Nobody is logged in any more: no call will work."""


EXPIRED = "session expired"
REPLY = "reply string, finish string, error string"


def ask(prompts: DataFrame, client: Callable[[], Callable[[str], tuple[str, str]]], key: str = "query_id", retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, reply, finish and error of every prompt (key, prompt).

    A transient error is tried again after 2, 4, 8 ... seconds, ``retries``
    times, and then is the row's error.  Once a session has expired no call is
    made again: that row and the task's others have EXPIRED as their error.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def one(call: Callable[[str], tuple[str, str]], prompt: str) -> tuple:
        for attempt in range(retries + 1):
            try:
                return (*call(prompt), None)
            except Transient as e:
                if attempt == retries:
                    return None, None, f"failed after {retries + 1} attempts: {e}"
            wait(2.0 ** (attempt + 1))
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, expired = None, False
        try:
            for batch in batches:
                rows = []
                for k, prompt in zip(batch["k"].array, batch["p"], strict=True):
                    if not expired:
                        call = call or client()
                        try:
                            rows.append((k, *one(call, prompt)))
                            continue
                        except SessionExpired:
                            expired = True
                    rows.append((k, None, None, EXPIRED))
                yield pd.DataFrame(rows, columns=[key, "reply", "finish", "error"])
        finally:
            _closed(call)

    return prompts.select(F.col(key).alias("k"), F.col("prompt").alias("p")).mapInPandas(run, f"{key} {kind}, {REPLY}")


# Labels before a rewrite, quotes around it, and numbers in digits and words.
LABEL = r"(?i)^(?:rewritten|formal|rephrased)?\s*(?:question|query)\s*:\s*"
UNITS = "one|two|three|four|five|six|seven|eight|nine"
TEENS = "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
NUMBER = rf"(?i)\b(?:\d+(?:\.\d+)?|(?:{TENS})(?:-(?:{UNITS}))?|{TEENS}|{UNITS}|hundred|thousand)\b"


def clean_rewrite(reply: Column) -> Column:
    """A rewrite's sentence alone: the first line that is not empty, without a label or quotes around it; null if there is none."""
    bare = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), LABEL, "")), "^[\"'“”]+|[\"'“”]+$", ""))
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), bare), lambda x: x != "")
    return F.get(lines, F.lit(0))


def added_numbers(original: Column, rewrite: Column) -> Column:
    """Numbers, in digits or words, that a rewrite has and the original has not, in order, each once."""
    numbers = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(NUMBER), F.lit(0))
    there = F.transform(numbers(original), F.lower)
    return F.array_distinct(F.filter(numbers(rewrite), lambda n: ~F.array_contains(there, F.lower(n))))
