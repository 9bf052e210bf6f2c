"""Progressive JPEG: a decoder into coefficient arrays and RGB tensors, and a
lossless carrier of bytes in DCT coefficients.

Decoding accumulates every scan (spectral selection and successive
approximation) in one coefficient array per component, and only then applies
the inverse transform, chroma upsampling and colour conversion in numpy.

Entropy decoding has one general bit reader and two vectorised cases that give
the same coefficients: tables under which every coefficient takes equally many
bits (code length plus magnitude bits is constant), and end-of-band runs of a
refinement scan, whose correction bits are consecutive.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from citeloom.llm.storage import bounded_batches

# Fixed values of the JPEG standard: marker codes and the zigzag order.
SOI, EOI, SOS, DQT, DHT, SOF2, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC2, 0xDD, 0xFE


def _zigzag() -> np.ndarray:
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Row k: the 64 samples of the k-th coefficient (natural order) with weight 1."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(one, one).astype(np.float32)


class JpegError(ValueError):
    """The bytes are no progressive JPEG that this decoder reads."""


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.wide = self.high = self.pad_wide = self.pad_high = 0
        self.coef = np.zeros((0, 64), np.int32)


class _Huffman:
    """A canonical code: symbols in order of their code lengths."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code, at = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        total = {n + (s & 15) for (n, _), s in self.codes.items()}
        width = total.pop() if len(total) == 1 else 0
        #: bits of every coefficient if that is one number (and, for AC, there are no runs), else 0
        self.uniform = width * all(s >> 4 == 0 and s & 15 for s in symbols)
        self.uniform_dc = width * (max(symbols, default=99) <= 15)


@lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(counts, symbols)


@lru_cache(maxsize=64)
def _uniform_values(table: _Huffman, width: int) -> np.ndarray:
    """Coefficient value by the ``width`` bits of its code and magnitude (unused codes: a mark)."""
    out = np.full(1 << width, 1 << 20, np.int32)
    for (n, code), s in table.codes.items():
        size = s & 15
        bits = np.arange(1 << size)
        out[(code << size) + bits] = np.where(bits >= (1 << size >> 1), bits, bits - (1 << size) + 1) if size else 0
    return out


class _Bits:
    """Big-endian bits of one entropy-coded segment whose stuffing is removed."""

    def __init__(self, data: bytes):
        self.data = data
        self._bits: np.ndarray | None = None
        self.at = 0

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def one(self) -> int:
        if self.at >= len(self.bits):
            raise JpegError("entropy-coded data end early")
        self.at += 1
        return int(self.bits[self.at - 1])

    def many(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.one()
        return out

    def array(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise JpegError("entropy-coded data end early")
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise JpegError("unknown Huffman code")

    def signed(self, size: int) -> int:
        value = self.many(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _fixed_width(bits: _Bits, n: int, width: int) -> np.ndarray:
    """n numbers of ``width`` bits each, which are a whole segment."""
    if n * width > 8 * len(bits.data):
        raise JpegError("entropy-coded data end early")
    if width == 8:
        return np.frombuffer(bits.data, np.uint8, n)
    if width == 9:
        groups = -(-n // 8)
        nine = np.frombuffer(bits.data.ljust(9 * groups, b"\0"), np.uint8, 9 * groups).reshape(groups, 9)
        return ((nine[:, :8].astype(np.uint16) << _LEFT | nine[:, 1:] >> _RIGHT) & 511).ravel()[:n]
    cells = np.zeros((n, 16), np.uint8)
    cells[:, 16 - width :] = bits.array(n * width).reshape(n, width)
    return np.packbits(cells, axis=1).view(">u2").ravel()


_LEFT, _RIGHT = np.arange(1, 9, dtype=np.uint16), np.arange(7, -1, -1, dtype=np.uint8)


@lru_cache(maxsize=512)
def _order(high: int, wide: int, pad_wide: int) -> np.ndarray:
    return (np.arange(high)[:, None] * pad_wide + np.arange(wide)[None, :]).ravel()


@lru_cache(maxsize=512)
def _mcu_order(h: int, v: int, across: int, down: int) -> np.ndarray:
    rows = np.arange(down)[:, None, None, None] * v + np.arange(v)[None, None, :, None]
    cols = np.arange(across)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
    return (rows * (across * h) + cols).reshape(-1)


def _scan_order(comp: _Component, interleaved: bool, frame: tuple[int, int]) -> np.ndarray:
    """Block numbers of a component in the order of a scan (MCU order if interleaved)."""
    return _mcu_order(comp.h, comp.v, *frame) if interleaved else _order(comp.high, comp.wide, comp.pad_wide)


def _rows(where: np.ndarray) -> slice | np.ndarray:
    """A slice if these block numbers are consecutive."""
    n = len(where)
    return slice(int(where[0]), int(where[0]) + n) if n and where[-1] - where[0] == n - 1 else where


def _dc_scan(segments: list[bytes], comps: list[_Component], tables: list[_Huffman | None], frame: tuple[int, int], interval: int, high: int, low: int) -> None:
    interleaved = len(comps) > 1
    orders = [_scan_order(c, interleaved, frame) for c in comps]
    per = [c.h * c.v if interleaved else 1 for c in comps]
    units = len(orders[0]) // per[0]
    owner = np.repeat(np.arange(len(comps)), per)
    step = interval or units
    for k, data in enumerate(segments):
        first, last = k * step, min((k + 1) * step, units)
        n, bits = last - first, _Bits(data)
        widths = {t.uniform_dc for t in tables if t} if not high else {1}
        if high:
            values = bits.array(n * len(owner)).reshape(n, -1).astype(np.int32)
        elif len(widths) == 1 and 0 not in widths and len({id(t) for t in tables}) == 1:
            width = widths.pop()
            values = _uniform_values(tables[0], width)[_fixed_width(bits, n * len(owner), width)].reshape(n, -1)
        else:
            values = np.array([[bits.signed(bits.symbol(tables[o])) for o in owner] for _ in range(n)], np.int32).reshape(n, -1)
        for i, comp in enumerate(comps):
            where = orders[i][first * per[i] : last * per[i]]
            mine = values[:, owner == i].ravel()
            if high:
                comp.coef[where, 0] |= mine << low
            else:
                comp.coef[where, 0] = np.cumsum(mine) << low


def _ac_first(bits: _Bits, comp: _Component, where: np.ndarray, table: _Huffman, lo: int, hi: int, low: int) -> None:
    if width := table.uniform:
        values = _uniform_values(table, width)[_fixed_width(bits, len(where) * (hi - lo + 1), width)]
        comp.coef[_rows(where), lo : hi + 1] = values.reshape(len(where), -1) << low
        return
    skip = 0
    for block in where:
        if skip:
            skip -= 1
            continue
        k = lo
        while k <= hi:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                comp.coef[block, k] = bits.signed(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.many(run) - 1
                break


def _correct(bits: _Bits, comp: _Component, blocks: np.ndarray, lo: int, hi: int, low: int) -> None:
    """The correction bits of all coefficients of these blocks that are not zero, in order."""
    blocks = _rows(blocks)
    part = comp.coef[blocks, lo : hi + 1]
    if part.size and part.min() > 0:
        comp.coef[blocks, lo : hi + 1] = part + (bits.array(part.size).reshape(part.shape).astype(np.int32) << low)
        return
    there = part != 0
    part[there] += np.sign(part[there]) * (bits.array(int(there.sum())).astype(np.int32) << low)
    comp.coef[blocks, lo : hi + 1] = part


def _ac_refine(bits: _Bits, comp: _Component, where: np.ndarray, table: _Huffman, lo: int, hi: int, low: int) -> None:
    at = 0
    while at < len(where):
        block, k = where[at], lo
        while k <= hi:
            run, size = divmod(bits.symbol(table), 16)
            if not size and run < 15:
                count = (1 << run) + bits.many(run)
                _correct(bits, comp, where[at : at + 1], k, hi, low)
                _correct(bits, comp, where[at + 1 : at + count], lo, hi, low)
                at += count - 1
                break
            fresh = (1 if bits.one() else -1) << low if size else 0
            while k <= hi:
                value = comp.coef[block, k]
                if value:
                    if bits.one():
                        comp.coef[block, k] += (1 if value > 0 else -1) << low
                elif run:
                    run -= 1
                else:
                    comp.coef[block, k] = fresh
                    k += 1
                    break
                k += 1
        at += 1


class ProgressiveJpeg:
    """A decoded file: ``components`` (coefficients in zigzag order), ``comment``, ``rgb()``."""

    def __init__(self, data: bytes):
        if data[:2] != bytes((0xFF, SOI)):
            raise JpegError("no start of image")
        self.comment = b""
        self._size = len(data)
        self.components: list[_Component] = []
        self.width = self.height = 0
        self._frame = (0, 0)
        self._quant: dict[int, np.ndarray] = {}
        huff: dict[int, _Huffman] = {}
        interval, at = 0, 2
        while at < len(data):
            if data[at] != 0xFF:
                raise JpegError("marker expected")
            kind = data[at + 1]
            if kind == EOI:
                return
            (size,) = struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == DQT:
                self._read_quant(body)
            elif kind == DHT:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == DRI:
                (interval,) = struct.unpack(">H", body)
            elif kind == COM:
                self.comment += body
            elif kind == SOF2:
                self._read_frame(body)
            elif kind == SOS:
                at = self._read_scan(data, at, body, huff, interval)
            elif 0xC0 <= kind <= 0xCF:
                raise JpegError("not a progressive Huffman-coded frame")
        raise JpegError("no end of image")

    def _read_quant(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            size = 128 if wide else 64
            self._quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[1 + size :]

    def _read_frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8 or not self.width or not self.height:
            raise JpegError("8-bit samples and a size are needed")
        self.components = [_Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        if n not in (1, 3) or not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in self.components):
            raise JpegError("one or three components with sampling factors are needed")
        most_h, most_v = (max(getattr(c, k) for c in self.components) for k in "hv")
        self._frame = (-(-self.width // (8 * most_h)), -(-self.height // (8 * most_v)))
        if self._frame[0] * self._frame[1] * sum(c.h * c.v for c in self.components) > 8 * self._size:
            raise JpegError("more blocks than bits, and each has one at least")
        for c in self.components:
            c.wide, c.high = -(-(-(-self.width * c.h // most_h)) // 8), -(-(-(-self.height * c.v // most_v)) // 8)
            c.pad_wide, c.pad_high = self._frame[0] * c.h, self._frame[1] * c.v
            c.coef = np.zeros((c.pad_wide * c.pad_high, 64), np.int32)

    def _read_scan(self, data: bytes, at: int, body: bytes, huff: dict[int, _Huffman], interval: int) -> int:
        n = body[0]
        named = [(next(c for c in self.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
        segments, at = _segments(data, at)
        if lo == 0:
            _dc_scan(segments, [c for c, _ in named], [huff.get(t >> 4) for _, t in named], self._frame, interval, approx >> 4, approx & 15)
            return at
        comp, table = named[0][0], huff[0x10 | named[0][1] & 15]
        order = _scan_order(comp, False, self._frame)
        step = interval or len(order)
        for k, part in enumerate(segments):
            read = _ac_refine if approx >> 4 else _ac_first
            read(_Bits(part), comp, order[k * step : (k + 1) * step], table, lo, hi, approx & 15)
        return at

    def planes(self) -> list[np.ndarray]:
        """Samples of every component at its own resolution, as float32."""
        out, basis = [], _basis()[ZIGZAG]
        for c in self.components:
            spatial = (c.coef.astype(np.float32) * self._quant[c.table]) @ basis + 128
            spatial = spatial.reshape(c.pad_high, c.pad_wide, 8, 8).transpose(0, 2, 1, 3)
            out.append(np.clip(np.rint(spatial), 0, 255).reshape(c.pad_high * 8, c.pad_wide * 8))
        return out

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor (height, width, 3) of uint8; chroma is repeated to full size."""
        most_h, most_v = (max(getattr(c, k) for c in self.components) for k in "hv")
        full = []
        for c, plane in zip(self.components, self.planes(), strict=True):
            if (up := most_v // c.v) > 1:
                plane = np.repeat(plane, up, axis=0)
            if (up := most_h // c.h) > 1:
                plane = np.repeat(plane, up, axis=1)
            full.append(plane[: self.height, : self.width])
        if len(full) == 1:
            return np.repeat(full[0].astype(np.uint8)[:, :, None], 3, axis=2)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        out = np.empty((*y.shape, 3), np.float32)
        out[..., 0] = y + 1.402 * cr
        out[..., 1] = y - 0.344136 * cb - 0.714136 * cr
        out[..., 2] = y + 1.772 * cb
        return np.clip(out + 0.5, 0, 255).astype(np.uint8)


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments between restart markers, unstuffed, and where the next marker is."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise JpegError("scan without an end")
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            at = begin = at + 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            out.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            return out, at


# --- the carrier: payload bytes as coefficients 2..257 --------------------------------------

#: AC coefficient = byte + SHIFT, so that none is zero, and none after halving; DC coefficient = byte.
SHIFT = 2
_AC_SIZES, _AC_WIDTH, _DC_WIDTH = range(8, 0, -1), 9, 8


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _table(ident: int, lengths: list[tuple[int, int]]) -> bytes:
    """lengths: (code length, symbol), ascending."""
    return _marker(DHT, bytes([ident]) + bytes(sum(n == k for n, _ in lengths) for k in range(1, 17)) + bytes(s for _, s in lengths))


def _fixed_codes(width: int, sizes: range) -> np.ndarray:
    """The ``width`` bits for each magnitude size: code of width - size ones but the last, then the magnitude."""
    out = np.zeros(17, np.int64)
    for s in sizes:
        n = width - s
        out[s] = ((1 << n) - 2) << s
    return out


_AC_PREFIX, _DC_PREFIX = _fixed_codes(_AC_WIDTH, range(1, 9)), _fixed_codes(_DC_WIDTH, range(0, 8))
_SIZE = np.array([0, *(int(v).bit_length() for v in range(1, 512))])
_AC_WORDS = (_AC_PREFIX[_SIZE[:129]] + np.arange(129)).astype(np.uint16)
_DIFF = np.arange(-127, 128)
_DC_WORDS = (_DC_PREFIX[_SIZE[abs(_DIFF)]] + np.where(_DIFF < 0, _DIFF + (1 << _SIZE[abs(_DIFF)]) - 1, _DIFF)).astype(np.uint8)
_HEAD = b"".join(
    (
        _marker(DQT, b"\0" + b"\1" * 64),
        _table(0x00, [(_DC_WIDTH - s, s) for s in range(7, -1, -1)]),
        _table(0x10, [(_AC_WIDTH - s, s) for s in _AC_SIZES]),
        _table(0x11, [(4, n << 4) for n in range(15)]),
    )
)
_LAYOUT = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
_BLOCKS = 6
_EOB_MOST = 32767


def _entropy(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled with ones at the end and stuffed."""
    short = -len(bits) % 8
    if short:
        bits = np.concatenate((bits, np.ones(short, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _nine_bits(words: np.ndarray) -> bytes:
    """Words of nine bits, filled with ones to whole bytes and stuffed."""
    groups = -(-len(words) // 8)
    cells = np.full(groups * 8, 511, np.uint16)
    cells[: len(words)] = words
    cells = cells.reshape(groups, 8)
    out = np.zeros((groups, 9), np.uint8)
    out[:, :8] = cells >> _LEFT
    out[:, 1:] |= (cells << _RIGHT).astype(np.uint8)
    return out.tobytes()[: -(-9 * len(words) // 8)].replace(b"\xff", b"\xff\x00")


@lru_cache(maxsize=64)
def _sos(comps: tuple[tuple[int, int], ...], lo: int, hi: int, approx: int) -> bytes:
    return _marker(SOS, bytes([len(comps), *(x for c in comps for x in c), lo, hi, approx]))


def encode_payload(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as a progressive 4:2:0 JPEG.

    Each byte is one quantised coefficient (AC: byte + 2).  The file has a DC scan,
    AC scans (of two bands for luma), all without their lowest bit, and
    refinement scans for that bit.  The payload's length is in a comment.
    """
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    n = len(payload) // 64
    units = -(-n // _BLOCKS)
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    units = across * down
    coef = np.zeros(units * _BLOCKS * 64, np.int16)
    coef[: len(payload)] = np.frombuffer(payload, np.uint8)
    coef = coef.reshape(-1, 64)
    coef[:, 1:] += SHIFT
    parts = {1: coef[: 4 * units], 2: coef[4 * units : 5 * units], 3: coef[5 * units :]}
    out = [bytes((0xFF, SOI)), _marker(COM, b"payload=%d" % len(payload)), _HEAD]
    out.append(_marker(SOF2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in _LAYOUT)))
    luma = parts[1][:, 0].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(units, 4)
    dc = np.concatenate((luma, parts[2][:, :1], parts[3][:, :1]), axis=1)
    half = dc >> 1
    diffs = np.empty((units, 6), np.int16)
    diffs[:, :4] = np.diff(half[:, :4].ravel(), prepend=0).reshape(units, 4)
    diffs[:, 4:] = np.diff(half[:, 4:], axis=0, prepend=0)
    everyone = tuple((i, 0) for i, _, _ in _LAYOUT)
    out += [_sos(everyone, 0, 0, 0x01), _dc_bits(diffs)]
    for i, part in parts.items():
        for lo, hi in ((1, 5), (6, 63)) if i == 1 else ((1, 63),):
            out += [_sos(((i, 0),), lo, hi, 0x01), _nine_bits(_AC_WORDS[part[:, lo : hi + 1] >> 1].ravel())]
    out += [_sos(everyone, 0, 0, 0x10), _entropy((dc & 1).astype(np.uint8).ravel())]
    for i, part in parts.items():
        out += [_sos(((i, 1),), 1, 63, 0x10), _refine_bits((part[:, 1:] & 1).astype(np.uint8))]
    out.append(bytes((0xFF, EOI)))
    return b"".join(out)


def _dc_bits(diffs: np.ndarray) -> bytes:
    return _DC_WORDS[diffs + 127].tobytes().replace(b"\xff", b"\xff\x00")


def _refine_bits(low: np.ndarray) -> bytes:
    out = []
    for at in range(0, len(low), _EOB_MOST):
        some = low[at : at + _EOB_MOST]
        power = len(some).bit_length() - 1
        head = f"{power:04b}" + (f"{len(some) - (1 << power):0{power}b}" if power else "")
        out += [np.frombuffer(head.encode(), np.uint8) - 48, some.ravel()]
    return _entropy(np.concatenate(out))


def decode_payload(image: ProgressiveJpeg) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    size = int(image.comment.split(b"=")[1])
    coef = np.concatenate([c.coef for c in image.components])
    coef[:, 1:] -= SHIFT
    return coef.ravel()[:size].astype(np.uint8).tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 length of a text and its bytes filled with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature(rgb: np.ndarray) -> str:
    """Size, channel means and an 8 x 8 average hash of the tensor."""
    high, wide, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (high * wide)
    grid = rgb[:, :, 1].reshape(8, high // 8, 8, wide // 8).sum(axis=(1, 3), dtype=np.int64) if high % 8 == 0 and wide % 8 == 0 else np.zeros((8, 8), np.int64)
    bits = np.packbits(grid.ravel() * 64 > grid.sum())
    return f"{wide}x{high}:{means[0]},{means[1]},{means[2]}:{bits.tobytes().hex()}"


MEDIA_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"
#: Bytes of payload whose tensors leave Python together.
TOGETHER = 4 << 20


def _describe(text: str | None) -> tuple:
    n, payload = padded(text)
    stored = encode_payload(payload)
    image = ProgressiveJpeg(stored)
    back = decode_payload(image)
    if back != payload:
        raise JpegError("the stored payload differs")
    rgb = image.rgb()
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes()


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key, the digests of its text stored as a JPEG, and the decoded tensor (rgb: row-major uint8 of shape height x width x 3).

    Null and empty texts store 64 zero bytes.  Repeated rows and ties give
    repeated rows; other columns of ``df`` are left out; an empty table gives
    an empty table.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in MEDIA_SCHEMA.split(", "))]
        for batch in batches:
            rows, size = [], 0
            for k, t in zip(batch["k"].array, batch["t"], strict=True):
                rows.append((None if pd.isna(k) else k, *_describe(t if isinstance(t, str) else None)))
                size += rows[-1][2]
                if size >= TOGETHER:
                    yield pd.DataFrame(rows, columns=names).astype({key: batch["k"].dtype})
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({key: batch["k"].dtype})

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInPandas(run, f"{key} {kind}, {MEDIA_SCHEMA}")


def decode_images(df: DataFrame, key: str = "image_id", data: str = "data") -> DataFrame:
    """Decode a column of progressive JPEG files into full-resolution RGB tensors.

    Returns key, width, height, rgb (binary, row-major uint8 of shape height x
    width x 3) and error.  Null data or a file that this decoder does not read
    gives null size and tensor and a text in ``error``.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, d in zip(batch["k"], batch["d"], strict=True):
                try:
                    rgb = ProgressiveJpeg(bytes(d if d is not None else b"")).rgb()
                    rows.append((k, rgb.shape[1], rgb.shape[0], rgb.tobytes(), None))
                except (ValueError, struct.error, IndexError, KeyError, StopIteration) as e:  # JpegError is a ValueError
                    rows.append((k, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[key, "width", "height", "rgb", "error"]).astype({"width": "Int32", "height": "Int32"})

    return df.select(df[key].alias("k"), df[data].alias("d")).mapInPandas(run, f"{key} {kind}, width int, height int, rgb binary, error string")
