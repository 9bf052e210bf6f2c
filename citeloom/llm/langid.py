"""Language identification by prediction by partial matching.

Every language gets a variable-order byte context tree with the counts of its
sample.  A symbol's probability in a context is count / (total + distinct); the
escape probability distinct / (total + distinct) leads to the next shorter
context, down to a uniform order -1.  The statistics are frozen after training,
so the exact code length of every (context, symbol) is computed once, for all
languages side by side, and scoring a text is a table lookup per byte.

Bytes are folded first: A-Z to a-z, digits to one class, other ASCII bytes to
another; bytes from 128 stand for themselves.

The pipeline stage also asks whether a text is of the winning language at all:
its code may be no longer than a limit a byte, which lies midway between the
worst rate of labelled documents that a model has not seen and the rate of
uniform symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.storage import bounded_batches

#: The answer for texts that are null or have no letter, or if nothing was learned.
UNDETERMINED = "und"
#: Bounds of the labelled sample that a model is fitted on (training only): documents of a language, characters of a document,
#: and documents of all languages, which share them evenly where they are too many for SAMPLE_DOCS each.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 400, 1 << 16, 3200
#: Nats that a text may cost beyond its limit a byte: about one token of 20 random characters, so that a key in a short text does not decide it.
EVIDENCE = 100.0
#: Longest context in bytes, how often a context of over two bytes must occur to be kept, and how many are kept in all: what a
#: rarer context would predict is taken from the next shorter one, which costs code length but no text.
ORDER, MIN_COUNT, MOST_CONTEXTS = 4, 12, 60_000


def _folding() -> np.ndarray:
    out = np.arange(256)
    out[:128] = 1
    out[ord("0") : ord("9") + 1] = 2
    letters = np.arange(26)
    out[ord("a") + letters] = out[ord("A") + letters] = 3 + letters
    out[128:] = 29 + np.arange(128)
    return out.astype(np.uint8)


FOLD = _folding()
#: Classes after folding; class 0 is the start of a text.
CLASSES = 29 + 128


@dataclass(frozen=True)
class Model:
    """languages; symbols: class -> dense symbol; step: (state, symbol) -> state; cost: (state, symbol) -> nats per language.

    limits: nats a byte that a text of each language may cost; None: any.
    """

    languages: list[str]
    symbols: np.ndarray
    step: np.ndarray
    cost: np.ndarray
    limits: np.ndarray | None = None

    @property
    def uniform(self) -> float:
        """Nats of a symbol if all are equally likely."""
        return float(np.log(self.step.shape[1]))

    def fits(self, nats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether texts of so many bytes are within the limit of their best language."""
        if self.limits is None:
            return np.ones(len(nats), bool)
        return nats.min(axis=1) <= self.limits[nats.argmin(axis=1)] * sizes + EVIDENCE

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Nats of every text under every language; whole texts, in pieces of bounded size."""
        out = np.zeros((len(texts), len(self.languages)))
        width = self.step.shape[1]
        for i, raw in enumerate(texts):
            state = 0
            for at in range(0, len(raw), 1 << 20):
                sym = self.symbols[FOLD[np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - at), at)]]
                states, state = self._states(sym, state)
                out[i] += self.cost[states * width + sym].sum(axis=0, dtype=np.float64)
        return out

    def _states(self, sym: np.ndarray, first: int) -> tuple[np.ndarray, int]:
        """The state before every symbol, and the one after the last: each depends on ORDER symbols at most."""
        n = len(sym)
        states = np.empty(n + 1, np.int64)
        states[: min(n, ORDER) + 1] = self._walk(sym[:ORDER], first)
        if n > ORDER:
            width, flat = self.step.shape[1], self.step.ravel()
            now = np.zeros(n - ORDER, np.int64)
            for k in range(ORDER):
                now = flat[now * width + sym[k + 1 : n - ORDER + k + 1]]
            states[ORDER + 1 :] = now
        return states[:-1], int(states[-1])

    def _walk(self, sym: np.ndarray, state: int) -> list[int]:
        out = [state]
        for s in sym:
            out.append(int(self.step[out[-1], s]))
        return out


def _grams(texts: list[np.ndarray], order: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of order + 1 symbols as numbers, and their counts."""
    keys = []
    for t in texts:
        if len(t) > order:
            key = np.zeros(len(t) - order, np.int64)
            for k in range(order + 1):
                key = key * base + t[k : len(t) - order + k]
            keys.append(key)
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(samples: dict[str, list[str]]) -> Model:
    """A model of the texts of each language; contexts are closed under dropping their first byte."""
    languages = sorted(samples)
    raw = {name: [FOLD[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)] for t in samples[name]] for name in languages}
    seen = np.unique(np.concatenate([np.zeros(1, np.uint8), *(x for t in raw.values() for x in t)]))
    base = len(seen) + 1  # the last symbol: never seen in training
    symbols = np.full(256, base - 1, np.uint8)  # CLASSES + 1 fit
    symbols[seen] = np.arange(len(seen))
    texts = {name: [symbols[x] for x in raw[name]] for name in languages}
    grams = [{name: _grams(texts[name], k, base) for name in languages} for k in range(ORDER + 1)]

    kept: list[np.ndarray] = [np.zeros(1, np.int64)]  # contexts by length, as numbers
    room = MOST_CONTEXTS
    for k in range(1, ORDER + 1):
        keys, counts = _merge([grams[k - 1][name] for name in languages])
        ok = np.isin(keys % base ** (k - 1), kept[-1]) & np.isin(keys // base, kept[-1]) & (counts >= (1 if k < 3 else MIN_COUNT))
        keys, counts = keys[ok], counts[ok]
        best = np.argsort(-counts, kind="stable")[: max(0, room)]
        kept.append(np.sort(keys[best]))
        room -= len(kept[-1])
    first = np.cumsum([0, *(len(x) for x in kept)])
    n = int(first[-1])

    step = np.zeros((n, base), np.int32)
    cost = np.zeros((n, base, len(languages)), np.float32)
    cost[0] = np.log(base)
    for k, contexts in enumerate(kept):
        rows = slice(first[k], first[k + 1])
        shorter = np.zeros(len(contexts), np.int64) if k == 0 else first[k - 1] + np.searchsorted(kept[k - 1], contexts % base ** (k - 1))
        if k:
            cost[rows], step[rows] = cost[shorter], step[shorter]
        for j, name in enumerate(languages):
            keys, counts = grams[k][name]
            where = np.searchsorted(contexts, keys // base)
            ok = contexts[np.minimum(where, len(contexts) - 1)] == keys // base if len(contexts) else np.zeros(len(keys), bool)
            where, sym, counts = where[ok], keys[ok] % base, counts[ok]
            total, distinct = np.bincount(where, counts, len(contexts)), np.bincount(where, minlength=len(contexts))
            there = total > 0
            block = cost[rows, :, j]
            block[there] -= np.log(distinct[there] / (total[there] + distinct[there]))[:, None].astype(np.float32)
            block[where, sym] = -np.log(counts / (total[where] + distinct[where]))
            cost[rows, :, j] = block
        if k < ORDER and len(kept[k + 1]):
            longer = kept[k + 1]
            step[first[k] + np.searchsorted(contexts, longer // base), longer % base] = first[k + 1] + np.arange(len(longer))
    if len(kept[ORDER]):  # after a symbol, the longest context drops its first byte
        full = kept[ORDER]
        tail = full % base ** (ORDER - 1)
        step[first[ORDER] :] = step[first[ORDER - 1] + np.searchsorted(kept[ORDER - 1], tail)]
    return Model(languages, symbols, step, cost.reshape(n * base, len(languages)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def calibrated(samples: dict[str, list[str]]) -> Model:
    """A model with limits.

    The sample is halved by a hash of the text, and each half coded by a model of
    the other.  A language's limit is midway between the worst of its texts that
    cost less than uniform symbols and uniform symbols; texts that cost more are
    left out of the final model, unless they are half of their language or more
    (a rare language, not errors among its labels).
    """
    half = {name: [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t in texts] for name, texts in samples.items()}
    worst: dict[str, float] = {}
    strange: dict[str, set[str]] = {name: set() for name in samples}
    for k in (0, 1):
        seen = {name: found for name, texts in samples.items() if (found := [t for t, h in zip(texts, half[name], strict=True) if h != k])}
        if not seen:
            continue
        m = train(seen)
        for name, texts in samples.items():
            rest = [t for t, h in zip(texts, half[name], strict=True) if h == k]
            raw = [t.encode("utf-8", "surrogatepass") for t in rest]
            nats = m.code_lengths(raw)
            for text, size, row in zip(rest, map(len, raw), nats, strict=True):
                if row.min() > m.uniform * size + EVIDENCE:
                    strange[name].add(text)
                else:
                    best = m.languages[int(row.argmin())]
                    worst[best] = max(worst.get(best, 0.0), min(row.min() / size, m.uniform))
        del m
    clean = {name: [t for t in texts if t not in strange[name]] for name, texts in samples.items()}
    model = train({name: clean[name] if 2 * len(clean[name]) > len(texts) else texts for name, texts in samples.items()})
    limits = np.array([(min(worst.get(name, model.uniform), model.uniform) + model.uniform) / 2 for name in model.languages])
    return replace(model, limits=limits)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _sample(documents: DataFrame) -> dict[str, list[str]]:
    """Texts by language of documents with a language that are not held out.

    Of each language at most SAMPLE_DOCS (or its share of SAMPLE_ALL) distinct
    documents are taken, those with the smallest hash of their id, and of each
    the first SAMPLE_CHARS characters.  Counting a language's documents first
    gives a bound of the hash that about twice as many pass, so that no task
    orders a language; where too many of those are empty, more are let pass.
    """
    ok = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    rows = documents.select("doc_id", "lang", "text").filter(ok).withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    missing = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # no text is read for that
    wanted = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // max(1, len(missing))))
    samples: dict[str, list[str]] = {}
    times = 2.0
    while missing:
        bounds = documents.sparkSession.createDataFrame([(k, int((1 << 40) * min(1.0, (times * wanted + 20) / n))) for k, n in missing.items()], "lang string, bound long")
        passed = rows.join(F.broadcast(bounds), "lang").filter("hash < bound AND length(text) > 0")  # a row for each language
        texts = passed.groupBy("lang", "hash", "doc_id", F.xxhash64("text").alias("own")).agg(F.first(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
        order = Window.partitionBy("lang").orderBy("hash", "doc_id", "own")
        found: dict[str, list[str]] = {}
        for lang, text in texts.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= wanted).select("lang", "text").collect():
            found.setdefault(lang, []).append(text)
        done = {k for k, n in missing.items() if len(found.get(k, [])) == wanted or times * wanted + 20 >= n}
        samples |= {k: sorted(found[k]) for k in done if k in found}
        missing, times = {k: n for k, n in missing.items() if k not in done}, times * 8
    return samples


def fit(documents: DataFrame) -> Model | None:
    """A model of the sample; None if it is empty."""
    samples = _sample(documents)
    return train(samples) if samples else None


def predict(df: DataFrame, model: Model | None, text: str = "text", made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with columns lang_pred and score, or as ``made`` names them; existing ones of these names give way.

    A text that is null or has no letter gets ``und`` and 0.0, and so does every
    text without a model or beyond the limits of one.  Ties go to the first language in alphabetical order.
    The score is the winner's share of the languages' likelihoods.
    """
    letters = F.coalesce(df[text].rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.withColumns({made[0]: F.lit(UNDETERMINED), made[1]: F.lit(0.0)})
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_CONTEXTS

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
            nats = m.code_lengths(raw)
            best = nats.argmin(axis=1) if len(nats) else np.zeros(0, np.int64)
            share = 1 / np.exp(np.maximum(nats.min(axis=1, keepdims=True) - nats, -700)).sum(axis=1) if len(nats) else np.zeros(0)
            fits = m.fits(nats, np.array([len(r) for r in raw])) if len(nats) else np.zeros(0, bool)
            yield pd.DataFrame({"lang_pred": np.where(fits, np.array(m.languages, object)[best], UNDETERMINED), "score": np.where(fits, share, 0.0)})

    rest = [df[c] for c in df.columns if c not in made]
    found = df.select(*rest, letters.alias("__letters"), guess(df[text]).alias("__guess"))
    return found.select(
        *(c for c in df.columns if c not in made),
        F.when(F.col("__letters"), F.col("__guess.lang_pred")).otherwise(UNDETERMINED).alias(made[0]),
        F.when(F.col("__letters"), F.col("__guess.score")).otherwise(0.0).alias(made[1]),
    )


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, under a model fitted on them."""
    return predict(documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(documents)).drop("text")


def keep_known(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are in no learned language go; all stay if none was learned.  Columns stay as they are."""
    samples = _sample(documents)
    if not samples:
        return documents
    made = ("__lang_pred", "__score")
    return predict(documents, calibrated(samples), made=made).filter(F.col(made[0]) != UNDETERMINED).select(*documents.columns)
