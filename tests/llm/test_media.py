"""The progressive JPEG decoder against a plain writer and a plain inverse transform."""

import struct

import numpy as np
import pytest

from citeloom.llm import media


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def marker(kind, body):
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


SYMBOLS = [s for s in range(256) if s != 255]  # codes of eight bits each; the one of ones only is not used
CODE = {s: k for k, s in enumerate(SYMBOLS)}
TABLE = bytes(7) + bytes([255]) + bytes(8) + bytes(SYMBOLS)


def magnitude(w, v):
    n = abs(v).bit_length()
    w.put(v if v >= 0 else v + (1 << n) - 1, n)


def shifted(v, low):
    return int(np.sign(v)) * (abs(int(v)) >> low)


class EndRuns:
    """Blocks that end early, told together, with the correction bits that are due after that."""

    def __init__(self, w):
        self.w, self.n, self.bits = w, 0, []

    def flush(self):
        if self.n:
            power = self.n.bit_length() - 1
            self.w.put(CODE[power << 4], 8)
            self.w.put(self.n - (1 << power), power)
            for b in self.bits:
                self.w.put(b, 1)
        self.n, self.bits = 0, []


def ac_first(blocks, lo, hi, low):
    w = Bits()
    ends = EndRuns(w)
    for block in blocks:
        run = 0
        for k in range(lo, hi + 1):
            v = shifted(block[k], low)
            if not v:
                run += 1
                continue
            ends.flush()
            while run > 15:
                w.put(CODE[0xF0], 8)
                run -= 16
            w.put(CODE[run << 4 | abs(v).bit_length()], 8)
            magnitude(w, v)
            run = 0
        if run:
            ends.n += 1
    ends.flush()
    return w.done()


def ac_refine(blocks, lo, hi, low):
    w = Bits()
    ends = EndRuns(w)
    for block in blocks:
        size = [abs(int(v)) >> low for v in block]
        last = max((k for k in range(lo, hi + 1) if size[k] == 1), default=-1)
        run, due = 0, []
        for k in range(lo, hi + 1):
            if not size[k]:
                run += 1
                continue
            while run > 15 and k <= last:
                ends.flush()
                w.put(CODE[0xF0], 8)
                run -= 16
                for b in due:
                    w.put(b, 1)
                due = []
            if size[k] > 1:
                due.append(size[k] & 1)
                continue
            ends.flush()
            w.put(CODE[run << 4 | 1], 8)
            w.put(int(block[k] > 0), 1)
            for b in due:
                w.put(b, 1)
            run, due = 0, []
        if run or due:
            ends.n += 1
            ends.bits += due
    ends.flush()
    return w.done()


def with_restarts(parts):
    return b"".join((bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + part for k, part in enumerate(parts))


def write(comps, wide, high, restart):
    """comps: (h, v, coef[rows, cols, 64] in zigzag order, padded to whole units)."""
    most_h, most_v = max(c[0] for c in comps), max(c[1] for c in comps)
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    out = [b"\xff\xd8", marker(0xDB, b"\0" + bytes(range(1, 65))), marker(0xC4, b"\x00" + TABLE), marker(0xC4, b"\x10" + TABLE)]
    out.append(marker(0xC2, struct.pack(">BHHB", 8, high, wide, len(comps)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(comps))))
    if restart:
        out.append(marker(0xDD, struct.pack(">H", restart)))

    def scan(named, lo, hi, approx, parts):
        out.append(marker(0xDA, bytes([len(named), *(x for i in named for x in (i + 1, 0)), lo, hi, approx])) + with_restarts(parts))

    def units(f):
        every = [(y, x) for y in range(down) for x in range(across)]
        step = restart or len(every)
        for at in range(0, len(every), step):
            w, last = Bits(), [0] * len(comps)
            for y, x in every[at : at + step]:
                for i, (h, v, coef) in enumerate(comps):
                    for dy in range(v):
                        for dx in range(h):
                            f(w, i, int(coef[y * v + dy, x * h + dx, 0]), last)
            yield w.done()

    def first(w, i, value, last):
        d = (value >> 1) - last[i]
        last[i] += d
        w.put(CODE[abs(d).bit_length()], 8)
        magnitude(w, d)

    if len(comps) > 1:
        scan(range(len(comps)), 0, 0, 0x01, list(units(first)))
    else:  # a component by itself has no padding
        rows, cols = -(-high // 8), -(-wide // 8)
        comps_blocks = [b for row in comps[0][2][:rows, :cols] for b in row]
        step = restart or len(comps_blocks)
        parts = []
        for at in range(0, len(comps_blocks), step):
            w, last = Bits(), [0]
            for b in comps_blocks[at : at + step]:
                first(w, 0, int(b[0]), last)
            parts.append(w.done())
        scan([0], 0, 0, 0x01, parts)
    for i, (h, v, coef) in enumerate(comps):
        rows, cols = -(-(-(-high * v // most_v)) // 8), -(-(-(-wide * h // most_h)) // 8)
        blocks = [b for row in coef[:rows, :cols] for b in row]
        step = restart or len(blocks)
        parts = [blocks[at : at + step] for at in range(0, len(blocks), step)]
        for lo, hi in ((1, 5), (6, 63)):
            scan([i], lo, hi, 0x02, [ac_first(p, lo, hi, 2) for p in parts])
        for lo, hi in ((1, 63),):
            scan([i], lo, hi, 0x21, [ac_refine(p, lo, hi, 1) for p in parts])
            scan([i], lo, hi, 0x10, [ac_refine(p, lo, hi, 0) for p in parts])
    if len(comps) > 1:
        scan(range(len(comps)), 0, 0, 0x10, list(units(lambda w, i, value, last: w.put(value & 1, 1))))
    else:
        parts = []
        for at in range(0, len(comps_blocks), step):
            w = Bits()
            for b in comps_blocks[at : at + step]:
                w.put(int(b[0]) & 1, 1)
            parts.append(w.done())
        scan([0], 0, 0, 0x10, parts)
    return b"".join([*out, b"\xff\xd9"])


def plain_rgb(comps, wide, high):
    """Block by block and sample by sample, from the formulas."""
    path = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)] for x in range(8)])
    most_h, most_v = max(c[0] for c in comps), max(c[1] for c in comps)
    planes = []
    for h, v, coef in comps:
        plane = np.zeros((coef.shape[0] * 8, coef.shape[1] * 8))
        for by in range(coef.shape[0]):
            for bx in range(coef.shape[1]):
                block = np.zeros((8, 8))
                for k, (r, c) in enumerate(path):
                    block[r, c] = coef[by, bx, k] * (k + 1)
                plane[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8] = cos @ block @ cos.T
        plane = np.clip(np.rint(plane + 128), 0, 255)
        planes.append(np.array([[plane[y * v // most_v, x * h // most_h] for x in range(wide)] for y in range(high)]))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.floor(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2) + 0.5), 0, 255)


def picture(seed, factors, wide, high):
    r = np.random.default_rng(seed)
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    comps = []
    for h, v in factors:
        coef = np.zeros((down * v, across * h, 64), np.int32)
        coef[..., 0] = r.integers(-250, 250, coef.shape[:2])
        share = r.choice([0.0, 0.03, 0.3], coef.shape[:2])  # empty blocks make long runs of ends, sparse ones runs of zeros
        there = r.random(coef.shape) < share[..., None]
        there[..., 0] = False
        coef[there] = (r.integers(1, 30, coef.shape) * r.choice([-1, 1], coef.shape) // r.choice([1, 8, 16], coef.shape))[there]
        rows, cols = -(-(-(-high * v // most_v)) // 8), -(-(-(-wide * h // most_h)) // 8)
        if len(factors) == 1:
            coef[rows:], coef[:, cols:] = 0, 0
        coef[rows:, :, 1:], coef[:, cols:, 1:] = 0, 0  # scans of one component do not hold the padding
        comps.append((h, v, coef))
    return comps


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("factors", [((1, 1),), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 1), (1, 1), (1, 1)), ((1, 2), (1, 1), (1, 1))])
def test_decoder_against_plain_forms(factors, restart):
    for seed, (wide, high) in enumerate([(37, 29), (8, 8), (70, 17), (1, 1)]):
        comps = picture(10 * seed + len(factors), factors, wide, high)
        image = media.ProgressiveJpeg(write(comps, wide, high, restart))
        for (_, _, coef), found in zip(comps, image.components, strict=True):
            assert (found.coef.reshape(coef.shape) == coef).all()
        rgb = image.rgb()
        assert rgb.shape == (high, wide, 3) and rgb.dtype == np.uint8
        off = np.abs(rgb.astype(int) - plain_rgb(comps, wide, high))
        assert off.max() <= 2 and (off > 0).mean() < 0.01  # a sample may round the other way


def test_tensors_of_a_table(spark):
    comps = picture(5, ((2, 2), (1, 1), (1, 1)), 20, 12)
    good = write(comps, 20, 12, 0)
    huge = good.replace(struct.pack(">BHHB", 8, 12, 20, 3), struct.pack(">BHHB", 8, 65535, 65535, 3))
    none = good.replace(struct.pack(">BHHB", 8, 12, 20, 3), struct.pack(">BHHB", 8, 12, 20, 0))
    short = good.replace(bytes(range(1, 65)), bytes(range(1, 11)), 1).replace(b"\xff\xdb\x00\x43", b"\xff\xdb\x00\x0d")
    rows = [(1, good), (2, huge), (3, none), (4, short), (5, None), (6, b""), (7, good[:200]), (8, b"\xff\xd8\xff\xd9"), (1, good)]
    found = media.decode_images(spark.createDataFrame(rows, "image_id int, data binary")).collect()
    assert sorted((r.image_id, r.error is None) for r in found) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False), (8, False)]
    rgb = next(r for r in found if r.image_id == 1)
    assert (rgb.width, rgb.height) == (20, 12) and np.abs(np.frombuffer(rgb.rgb, np.uint8).reshape(12, 20, 3).astype(int) - plain_rgb(comps, 20, 12)).max() <= 2


def test_result_holds_the_tensor(spark):
    texts = [(1, None), (2, "word " * 300), (3, "é")]
    found = media.text_media(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for r, (_, t) in zip(sorted(found, key=lambda r: r.doc_id), texts, strict=True):
        image = media.ProgressiveJpeg(media.encode_payload(media.padded(t)[1]))
        assert (r.height, r.width) == (image.height, image.width) and bytes(r.rgb) == image.rgb().tobytes()
        blocks = [(c.h, c.v, c.coef.reshape(c.pad_high, c.pad_wide, 64)) for c in image.components]
        assert len(blocks) == 3
