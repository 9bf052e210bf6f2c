"""Word shingles of whole texts as sets of 64-bit hashes, vectorised over batches.

A-Z is lower-cased; words are runs of bytes other than space and tab to
carriage return.  A text with fewer words than a shingle is one shingle of all
its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20240101)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are taken together up to so many bytes.
TOGETHER = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, TOGETHER * 5 // 4)
        for k, base in enumerate((_BASE, _BACK)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash."""
    buf = np.frombuffer(raw.translate(_LOWER), np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    forth, back = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * forth[:-1], out=total[1:])
    return begin, mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def sets(texts: list[str | None], words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a batch: the number of the part's first text, the sorted distinct
    shingle hashes of its texts one after another, and how many each text has."""
    raw = [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]
    for first, last in _together(raw):
        some = raw[first:last]
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in some[:-1]], dtype=np.int64)))
        at, hashes = word_hashes(b"\n".join(some))
        owner = np.searchsorted(starts, at, side="right") - 1
        count = np.bincount(owner, minlength=len(some))
        many = np.minimum(count, words)
        acc, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for n in np.unique(many[many > 0]):  # n words together: the wanted number, or all of a shorter text
            ok = np.flatnonzero(many[owner] == n)
            if len(ok) < n:
                continue
            h, o = hashes[ok], owner[ok]
            whole = o[: len(o) - n + 1] == o[n - 1 :]
            part = np.full(len(o) - n + 1, n, np.uint64)
            for k in range(n):
                part = mix(part * _BASE + h[k : len(h) - n + 1 + k])
            acc, own = np.concatenate((acc, part[whole])), np.concatenate((own, o[: len(o) - n + 1][whole]))
        order = np.argsort(own, kind="stable") if len(many) and len(np.unique(many[many > 0])) > 1 else slice(None)
        acc, own = acc[order], own[order]
        ends = np.cumsum(np.bincount(own, minlength=len(some)))
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            acc[a:b].sort()
        fresh = np.ones(len(acc), bool)
        fresh[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
        yield first, acc[fresh], np.bincount(own[fresh], minlength=len(some))
