"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Texts split into words that each begin with the space mark.  Distinct words of
equal length advance together through the lattice of pieces: substring hashes
probe the sorted hashes of all pieces, and for every end position vectorised
maxima over the possible last pieces store backpointers.

In a unigram model a path's score is the sum of its pieces' scores.  In a BPE
model a path is admitted only if merging in order of score would give each two
neighbours, which is decided for a pair of neighbours by undoing their merges;
one path is left then, and it is the one that merging gives.  Characters
without a piece become byte pieces.

A long word (a text may have no spaces) is first cut where no piece reaches from
one character to the next: every path has a border there.  A stretch that pieces
span everywhere, such as one character repeated, stays one word, whose lattice
grows with its length.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from citeloom.llm.storage import bounded_batches

#: Where the public vocabulary lies; a parameter of every entry point.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, NEWLINE = "▁", "\n"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter in front of the sorted keys, and cells of a batch of words.
FILTER_BITS, CELLS = 22, 1 << 19
#: Words that a worker keeps with their pieces, over all of its tasks.
CACHE = 400_000
#: Words of more characters are cut where no piece reaches, in windows of so many.
LONG, WINDOW = 48, 1 << 16
_UNIGRAM, _BPE = 1, 2
_NORMAL, _BYTE = 1, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 2:
            n = number()
            at += n
            yield tag >> 3, raw[at - n : at]
        else:
            n, form = (4, "<f") if tag & 7 == 5 else (8, "<d")
            at += n
            yield tag >> 3, struct.unpack(form, raw[at - n : at])[0]


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (one more row: a character without a piece), and their sorted hashes."""

    kind: int
    pieces: list[bytes]
    byte_ids: np.ndarray
    score: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    chars: np.ndarray
    keys: np.ndarray
    key_ids: np.ndarray
    near: np.ndarray
    longest: int

    @property
    def unknown(self) -> int:
        return len(self.pieces)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 without one."""
        out = np.full(keys.shape, -1, np.int32)
        flat, to = keys.ravel(), out.ravel()
        maybe = np.flatnonzero(self.near[(flat >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        some = flat[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[at] == some
        to[maybe[hit]] = self.key_ids[at[hit]]
        return out


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            h = (h + np.uint64(c) + np.uint64(1)) * _BASE
    return h


def merged(word: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """``word`` by merging the best-scored pair, leftmost first, and the last merge's sides."""
    parts, last = list(word), None
    while len(parts) > 1:
        best = max(range(len(parts) - 1), key=lambda i: (score.get(parts[i] + parts[i + 1], -np.inf), -i))
        if parts[best] + parts[best + 1] not in score:
            break
        last = (parts[best], parts[best + 1])
        parts[best : best + 2] = ["".join(last)]
    return parts, last


def load(model: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file (identity normalisation, a space mark put in front)."""
    with open(model, "rb") as f:
        raw = f.read()
    pieces, kind = [], _UNIGRAM
    for field, value in _fields(raw):
        if field == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode("utf-8"), p.get(2, 0.0), p.get(3, _NORMAL)))
        elif field == 2:
            kind = dict(_fields(value)).get(3, _UNIGRAM)
    return vocabulary(pieces, kind)


def vocabulary(pieces: list[tuple[str, float, int]], kind: int) -> Vocabulary:
    """pieces: (text, score, type of the model file)."""
    n = len(pieces)
    normal = {p: s for p, s, t in pieces if t == _NORMAL}
    ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == _NORMAL}
    order = {p: k for k, p in enumerate(sorted((p for p in normal if len(p) > 1), key=lambda p: (-normal[p], ids[p])), 1)}
    rank, chars = np.zeros(n + 1, np.int64), np.ones(n + 1, np.int64)
    left, right = np.arange(n + 1), np.arange(n + 1)
    byte_ids = np.full(256, -1, np.int32)
    usable = []
    for i, (p, _, t) in enumerate(pieces):
        if t == _BYTE:
            byte_ids[int(p[1:-1], 16)] = i
        if t != _NORMAL:
            continue
        chars[i] = len(p)
        if kind == _BPE and len(p) > 1:
            if set(p) == {MARK}:
                continue  # runs of marks merge last, from the left: see Encoder
            parts, last = merged(p, normal)
            if len(parts) > 1 or any(x not in ids for x in last):
                continue  # merging never gives this piece
            rank[i], left[i], right[i] = order[p], ids[last[0]], ids[last[1]]
        usable.append(i)
    text = [pieces[i][0] for i in usable]
    keys = np.array([_hash(np.array([ord(c) for c in p])) for p in text], np.uint64)
    by = np.argsort(keys)
    near = np.zeros(1 << FILTER_BITS, bool)
    near[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    score = np.array([s for _, s, _ in pieces] + [min(normal.values(), default=0.0) - 10.0])
    plain = [bytes([int(p[1:-1], 16)]) if t == _BYTE else p.replace(MARK, " ").encode() if t == _NORMAL else b"" for p, _, t in pieces]
    return Vocabulary(kind, plain, byte_ids, score, rank, left, right, chars, keys[by], np.array(usable, np.int32)[by], near, max(map(len, text), default=1))


def _pairs_hold(v: Vocabulary, ids: np.ndarray, word: np.ndarray, border: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether merging keeps a border between pieces one and two, for many borders at once.

    Merges inside both pieces are undone from the last to the first; the border
    falls if, at any time, the two symbols that touch it would have merged
    before the next merge that happened.  ids[word, start, chars - 1] are the
    pieces of the words' substrings.
    """
    out = np.ones(len(word), bool)
    at, limit = np.arange(len(word)), np.full(len(word), np.iinfo(np.int64).max)
    while len(at):
        n = v.chars[one] + v.chars[two]
        fit = n <= ids.shape[2]
        both = np.where(fit, ids[word, border - v.chars[one], np.minimum(n, ids.shape[2]) - 1], -1)
        falls = (both >= 0) & (v.rank[both] < limit)
        out[at[falls]] = False
        r1, r2 = v.rank[one], v.rank[two]
        go = ~falls & (np.maximum(r1, r2) > 0)
        at, word, border, one, two, r1, r2 = (x[go] for x in (at, word, border, one, two, r1, r2))
        first = r1 > r2
        limit = np.where(first, r1, r2 + 1)
        one, two = np.where(first, v.right[one], one), np.where(first, two, v.left[two])
    return out


def viterbi(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words of equal length: ids one word after another, and how many each has.

    codes: (word, character) code points.  A character without a piece has the id ``unknown``.
    """
    count, n = codes.shape
    width = min(v.longest, n)
    ids = np.full((count, n, width), -1, np.int32)
    h = np.zeros((count, n), np.uint64)
    plus = codes.astype(np.uint64) + np.uint64(1)
    for k in range(width):
        h = (h[:, : n - k] + plus[:, k:]) * _BASE
        ids[:, : n - k, k] = v.lookup(h)
    ids[:, :, 0] = np.where(ids[:, :, 0] < 0, v.unknown, ids[:, :, 0])
    best = np.full((count, n + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((count, n + 1), np.int32)
    for end in range(1, n + 1):
        lengths = np.arange(1, min(width, end) + 1)
        last = ids[:, end - lengths, lengths - 1]
        ok = (last >= 0) & (best[:, end - lengths] > -np.inf)
        if v.kind == _BPE:
            word, k = np.nonzero(ok[:, : end - 1] if len(lengths) == end else ok)
            border = end - lengths[k]
            ok[word, k] = _pairs_hold(v, ids, word, border, back[word, border], last[word, k])
        total = np.where(ok, best[:, end - lengths] + v.score[last], -np.inf)
        pick = total.argmax(axis=1)
        rows = np.arange(count)
        best[:, end], back[:, end] = total[rows, pick], last[rows, pick]
    out, used = np.zeros((count, n), np.int32), np.zeros((count, n), bool)
    rows, at = np.arange(count), np.full(count, n)
    while len(rows):
        piece = back[rows, at]
        out[rows, at - 1], used[rows, at - 1] = piece, True
        at = at - v.chars[piece]
        rows, at = rows[at > 0], at[at > 0]
    return out[used], used.sum(axis=1)


def stretches(v: Vocabulary, word: str) -> list[str]:
    """``word`` cut between any two characters that no piece has in it side by side."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, width = len(codes), min(v.longest, len(codes))
    reach = np.zeros(n + 1, np.int64)  # changes of how many pieces go over the border before a character
    for at in range(0, n, WINDOW):
        some = codes[at : at + WINDOW + width - 1]
        own, h = min(WINDOW, n - at), np.zeros(len(some), np.uint64)
        for k in range(width):
            h = (h[: len(some) - k] + some[k:]) * _BASE
            if k:
                first = at + np.flatnonzero(v.lookup(h[:own]) >= 0)
                np.add.at(reach, first + 1, 1)
                np.add.at(reach, first + k + 1, -1)
    cuts = np.flatnonzero(np.cumsum(reach)[1:n] == 0) + 1
    edges = [0, *cuts.tolist(), n]
    return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class Encoder:
    """Ids of texts; keeps a bounded number of words with their ids, which lie one after another in one array."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._runs = {len(p): i for i, p in enumerate(v.pieces) if p and set(p) == {32}}
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._used = np.zeros(1 << 16, np.int32), 0
        self._start, self._count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _put(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Words with their ids, one after another."""
        n, first = len(words), len(self._known)
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        while first + n > len(self._start):
            self._start, self._count = (np.concatenate((x, np.zeros_like(x))) for x in (self._start, self._count))
        self._ids[self._used : self._used + len(ids)] = ids
        self._start[first : first + n], self._count[first : first + n] = self._used + np.cumsum(counts) - counts, counts
        self._used += len(ids)
        self._known.update(zip(words, range(first, first + n), strict=True))

    def _of(self, word: str) -> np.ndarray:
        at = self._known[word]
        return self._ids[self._start[at] : self._start[at] + self._count[at]]

    def _gathered(self, words: list[str]) -> np.ndarray:
        """The ids of known words, one after another."""
        known = self._known
        at = np.array([known[w] for w in words], np.int64)
        counts = self._count[at]
        ends = np.cumsum(counts)
        return self._ids[np.repeat(self._start[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, words: list[str]) -> None:
        long = {w: stretches(self.v, w) for w in words if len(w) > LONG}
        long = {w: parts for w, parts in long.items() if len(parts) > 1}
        parts = {p for some in long.values() for p in some} - self._known.keys()
        self._learn_whole([*(w for w in words if w not in long), *(parts - set(words))])
        for w, some in long.items():
            ids = self._gathered(some)
            self._put([w], ids, np.array([len(ids)]))

    def _learn_whole(self, words: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, group in by.items():
            step = max(1, CELLS // (n * min(n, self.v.longest)))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n)
                ids, counts = viterbi(self.v, codes)
                if not (ids == self.v.unknown).any():
                    self._put(some, ids, counts)
                    continue
                ends = np.cumsum(counts)
                each = [self._with_bytes(w, ids[a:b]) for w, a, b in zip(some, (ends - counts).tolist(), ends.tolist(), strict=True)]
                self._put(some, np.concatenate(each), np.array([len(x) for x in each]))

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        if not (ids == self.v.unknown).any():
            return ids
        out, at = [], 0
        for i in ids:
            if i == self.v.unknown:
                out += self.v.byte_ids[list(word[at].encode("utf-8", "surrogatepass"))].tolist()
                at += 1
            else:
                out.append(int(i))
                at += int(self.v.chars[i])
        return np.array(out, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; whole texts."""
        return [ids for ids, _ in self.counted(texts)]

    def counted(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """The ids of each text, and how many words it has."""
        split = [self._words(t) if t else [] for t in texts]
        if len(self._known) > CACHE:
            self._forget()
        self._learn(list({w for words in split for w in words} - self._known.keys()))
        none = np.zeros(0, np.int32)
        return [(self._gathered(list(self._spaced(words))) if words else none, len(words)) for words in split]

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words with a mark in front; a line break is a word, and what follows it has no mark."""
        out: list[str] = []
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            first, *rest = line.split(" ")
            if k:
                out.append("\n")
            if first or not k:
                out.append(first if k else MARK + first)
            out += [MARK + w for w in rest]
        return out

    def _spaced(self, words: list[str]) -> Iterator[str] | list[str]:
        """Words with runs of lone marks put together: such merges come last, from the left."""
        return self._runs_joined(words) if self.v.kind == _BPE and MARK in words else words

    def _runs_joined(self, words: list[str]) -> Iterator[str]:
        run, most = 0, max(self._runs, default=1)
        for w in (*words, ""):
            if w == MARK:
                run += 1
                continue
            # a word whose mark stays alone gives it to the run before
            head = bool(run and w[:1] == MARK and self._of(w)[:1].tolist() == [self._runs.get(1)])
            left = run + head
            while left > 0:
                size = next(k for k in range(min(most, left), 0, -1) if k in self._runs or k == 1)
                name = MARK * size
                if size > 1 and name not in self._known:
                    self._put([name], np.array([self._runs[size]], np.int32), np.array([1]))
                yield name
                left -= size
            if head and NEWLINE + w not in self._known:
                rest = self._of(w)[1:].copy()
                self._put([NEWLINE + w], rest, np.array([len(rest)]))
            if w:
                yield NEWLINE + w if head else w
            run = 0


_held: list[Encoder] = []


def encoder_of(v: Vocabulary) -> Encoder:
    """This worker's encoder of a vocabulary: words that one task has learned are known to the next."""
    if not _held or _held[0].v is not v:
        _held[:] = [Encoder(v)]
    return _held[0]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    pieces = v.pieces
    return b"".join([pieces[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


PIECE_SCHEMA = "n_words long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean"


def _vocabulary(df: DataFrame, model: str):
    bounded_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(load(model))  # the size of a vocabulary


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Key and ids (array of int) of every row; null texts give null, empty ones no ids."""
    kind, shared = df.schema[key].dataType.simpleString(), _vocabulary(df, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = batch["t"].tolist()
            ids = encoder.encode([t if isinstance(t, str) else "" for t in texts])
            yield pd.DataFrame({key: batch["k"], "ids": [i if isinstance(t, str) else None for t, i in zip(texts, ids, strict=True)]})

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInPandas(run, f"{key} {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Key and text of every row's ids; null ids give null."""
    kind, shared = df.schema[key].dataType.simpleString(), _vocabulary(df, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch["k"], "text": [None if i is None else decode(shared.value, np.asarray(i, np.int64)) for i in batch["i"]]})

    return df.select(df[key].alias("k"), df[ids].alias("i")).mapInPandas(run, f"{key} {kind}, text string")


def piece_report(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Digests of every text's ids, and of the text decoded from them.

    Key, n_words (words and line breaks), n_tokens,
    ids_sha256 (of 32-bit little-endian ids), decoded_sha256 and same, whether
    decoding gives the text back.  Null and empty texts have no tokens.
    Repeated rows give repeated rows; other columns are left out.
    """
    kind, shared = df.schema[key].dataType.simpleString(), _vocabulary(df, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["t"]]
            rows = []
            for t, (ids, words) in zip(texts, encoder.counted(texts), strict=True):
                back = decode(shared.value, ids)
                rows.append((words, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])
            out.insert(0, key, batch["k"].to_numpy())
            yield out

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInPandas(run, f"{key} {kind}, {PIECE_SCHEMA}")
