"""Progressive JPEG in numpy.

A byte string is kept losslessly as the quantised coefficients of a 4:2:0
progressive image: coefficient = byte, less 255 below 128, so every coefficient
has eight significant bits. Nine scans carry them: DC and AC bands with one bit
held back, then the refinement of that bit. The reader accumulates any order of
spectral-selection and successive-approximation scans into coefficient arrays.
Restart segments of all images of a batch are decoded side by side, one numpy
step for the next symbol of each.

Null and empty texts are stored as one block of blanks. Texts longer than
FRAME_BYTES become several images in a row, stacked to one tensor.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm import common

UNIT = 192
FRAME_BYTES = UNIT * 16384
RESTART_DC, RESTART_AC = 4, 8  # units or blocks in a restart segment

#: Fixed values of the format: order of the coefficients of a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: The scans written: components, first and last coefficient, high and low bit.
SCANS = [
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0),
]
#: Code lengths and symbols of the tables written: DC sizes, AC size seven, runs of ended blocks.
DC_TABLE = (bytes([0, 0, 0, 10] + [0] * 12), bytes(range(10)))
AC_FIRST = (bytes([1] + [0] * 15), bytes([0x07]))
AC_LATER = (bytes([1, 1, 1, 1] + [0] * 12), bytes([0x30, 0x20, 0x10, 0x00]))


# ---- writing

def _frame_shape(size: int, wide: bool) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units that hold so many bytes."""
    units = -(-size // 384)
    columns = 16 if wide or units > 16 else max(units, 1)
    return columns, max(-(-units // columns), 1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, place: int, table: tuple[bytes, bytes]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | place]) + table[0] + table[1])


def _bits(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Rows of (value, length) tokens -> one stuffed, one-padded string per row."""
    total = lengths.sum(1)
    pad = -total % 8
    values = np.concatenate([values, ((1 << pad) - 1)[:, None]], 1).ravel()
    lengths = np.concatenate([lengths, pad[:, None]], 1).ravel()
    ends = np.cumsum(lengths)
    back = np.repeat(ends, lengths) - np.arange(ends[-1] if len(ends) else 0) - 1
    packed = np.packbits((np.repeat(values, lengths) >> back & 1).astype(np.uint8)).tobytes()
    cuts = np.concatenate([[0], np.cumsum((total + pad) // 8)]).tolist()
    return [packed[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(cuts, cuts[1:])]


def _joined(parts: list[bytes]) -> bytes:
    out = [parts[0]]
    for i, part in enumerate(parts[1:]):
        out += [bytes([0xFF, 0xD0 + i % 8]), part]
    return b"".join(out)


def _dc_scan(first: list[np.ndarray], units: int, columns: int, later: bool) -> bytes:
    """``first``: DC values of the three components, in raster order."""
    rows = units // columns
    luma = first[0].reshape(rows, 2, columns, 2).transpose(0, 2, 1, 3).reshape(units, 4)
    dc = np.concatenate([luma, first[1][:, None], first[2][:, None]], 1)
    full = -units % RESTART_DC
    there = np.concatenate([np.ones(units, bool), np.zeros(full, bool)]).reshape(-1, RESTART_DC, 1)
    dc = np.concatenate([dc, np.zeros((full, 6), dc.dtype)]).reshape(-1, RESTART_DC, 6)
    if later:
        lengths = np.broadcast_to(there, dc.shape).astype(np.int64)
        return _joined(_bits((dc & 1).reshape(len(dc), -1), lengths.reshape(len(dc), -1)))
    dc = dc >> 1
    flat = dc[:, :, :4].reshape(len(dc), -1)
    luma = np.diff(flat, axis=1, prepend=0).reshape(len(dc), RESTART_DC, 4)
    diff = np.concatenate([luma, np.diff(dc[:, :, 4:], axis=1, prepend=0)], 2)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    token = size << size | np.where(diff < 0, diff + (1 << size) - 1, diff)
    lengths = np.where(there, 4 + size, 0)
    return _joined(_bits(np.where(there, token, 0).reshape(len(dc), -1), lengths.reshape(len(dc), -1)))


def _ac_first(blocks: np.ndarray, first: int, last: int) -> bytes:
    """One zero bit (the only code) and seven bits for each coefficient: a byte
    below 128, which needs no stuffing."""
    width = (last - first + 1) * RESTART_AC
    data = (blocks[:, first : last + 1] >> 1).ravel()
    return _joined([data[i : i + width].tobytes() for i in range(0, len(data), width)])


def _ac_later(blocks: np.ndarray) -> bytes:
    """The last bit of every magnitude, after a code for a run of ended blocks."""
    low = np.where(blocks[:, 1:] < 128, ~blocks[:, 1:] & 1, blocks[:, 1:] & 1).astype(np.uint8)
    whole = len(low) // RESTART_AC * RESTART_AC
    parts: list[bytes] = []
    for part, run in ((low[:whole].reshape(-1, RESTART_AC * 63), RESTART_AC), (low[whole:].reshape(1, -1), len(low) - whole)):
        if run and len(part):
            power = run.bit_length() - 1
            code = [1] * (3 - power) + [0] + [(run - (1 << power)) >> (power - 1 - i) & 1 for i in range(power)]
            head = np.broadcast_to(np.array(code, np.uint8), (len(part), len(code)))
            tail = np.ones((len(part), -(len(code) + part.shape[1]) % 8), np.uint8)
            packed = np.packbits(np.concatenate([head, part, tail], 1), axis=1)
            parts += [row.tobytes().replace(b"\xff", b"\xff\x00") for row in packed]
    return _joined(parts)


def write_image(data: bytes, wide: bool = False) -> bytes:
    """One progressive image whose coefficients are ``data``."""
    columns, rows = _frame_shape(len(data), wide)
    units = columns * rows
    blocks = np.frombuffer(data.ljust(units * 384, b" "), np.uint8).reshape(-1, 64)
    parts = [blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :]]
    first = [x[:, 0].astype(np.int64) for x in parts]
    first = [np.where(x < 128, x - 255, x) for x in first]
    out = [
        b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(data))), _segment(0xDB, bytes([0]) + bytes([1]) * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _huffman(0, 0, DC_TABLE), _huffman(1, 0, AC_FIRST), _huffman(1, 1, AC_LATER),
    ]
    for parts_in, start, end, high, low in SCANS:
        out.append(_segment(0xDD, struct.pack(">H", RESTART_AC if start else RESTART_DC)))
        head = b"".join(bytes([c + 1, 1 if start and high else 0]) for c in parts_in)
        out.append(_segment(0xDA, bytes([len(parts_in)]) + head + bytes([start, end, high << 4 | low])))
        if not start:
            out.append(_dc_scan(first, units, columns, bool(high)))
        elif high:
            out.append(_ac_later(parts[parts_in[0]]))
        else:
            out.append(_ac_first(parts[parts_in[0]], start, end))
    return b"".join([*out, b"\xff\xd9"])


def write_media(payload: bytes) -> bytes:
    if len(payload) <= FRAME_BYTES:
        return write_image(payload)
    return b"".join(write_image(payload[i : i + FRAME_BYTES], wide=True) for i in range(0, len(payload), FRAME_BYTES))


# ---- reading

_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


_ORDERS: dict[tuple, np.ndarray] = {}


class Image:
    """Geometry, tables and scans of one image of a stream."""

    def __init__(self, data: bytes, at: int):
        self.size, self.scans, self.quant = None, [], {}
        tables: dict[int, tuple[bytes, bytes]] = {}
        restart = 0
        at += 2
        while True:
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            (length,) = struct.unpack_from(">H", data, at)
            body = data[at + 2 : at + length]
            at += length
            if marker == 0xFE and len(body) == 8:
                (self.size,) = struct.unpack(">Q", body)
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDA:
                n = body[0]
                ids = [p[0] for p in self.parts]
                chosen = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n))
                first, last, bits = body[1 + 2 * n : 4 + 2 * n]
                end = _NEXT.search(data, at).start()
                segments = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data[at:end])]
                used = tuple(tables.get(c[1] if not first else 16 + c[2]) for c in chosen)
                self.scans.append((tuple(c[0] for c in chosen), first, last, bits >> 4, bits & 15, restart, used, segments))
                at = end
        self.end = at
        self.most = (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        self.units = (-(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1])))
        self.strides = [self.units[0] * p[1] for p in self.parts]
        self.blocks = [self.units[0] * p[1] * self.units[1] * p[2] for p in self.parts]

    def order(self, chosen: tuple[int, ...]) -> np.ndarray:
        """Places (over all components) of a scan's blocks, in its order."""
        key = (self.width, self.height, tuple(self.parts), chosen)
        if key not in _ORDERS:
            if len(_ORDERS) > 4096:
                _ORDERS.clear()
            _ORDERS[key] = self._order(chosen)
        return _ORDERS[key]

    def _order(self, chosen: tuple[int, ...]) -> np.ndarray:
        base = np.concatenate([[0], np.cumsum(self.blocks)])
        if len(chosen) > 1:
            y, x = np.divmod(np.arange(self.units[0] * self.units[1]), self.units[0])
            places = []
            for c in chosen:
                _, h, v, _ = self.parts[c]
                places += [base[c] + (y * v + j) * self.strides[c] + x * h + i for j in range(v) for i in range(h)]
            return np.stack(places, 1).ravel()
        c = chosen[0]
        _, h, v, _ = self.parts[c]
        wide = -(-(-(-self.width * h // self.most[0])) // 8)
        high = -(-(-(-self.height * v // self.most[1])) // 8)
        return (base[c] + np.arange(high)[:, None] * self.strides[c] + np.arange(wide)).ravel()


_LUTS: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lut(table: tuple[bytes, bytes]) -> np.ndarray:
    """Next 16 bits -> code length * 256 + symbol."""
    if table not in _LUTS:
        lut, code, at = np.zeros(1 << 16, np.int64), 0, 0
        for length in range(1, 17):
            for _ in range(table[0][length - 1]):
                lut[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[1][at]
                code, at = code + 1, at + 1
            code <<= 1
        _LUTS[table] = lut
    return _LUTS[table]


class Lanes:
    """Restart segments side by side: a bit position each."""

    def __init__(self, segments: list[bytes]):
        gap = b"\0" * 8
        data = np.frombuffer(gap.join([*segments, gap]), np.uint8)
        sizes = np.array([len(x) + 8 for x in segments], np.int64)
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.data = data
        window = np.zeros(len(data), np.uint64)
        for i in range(7):
            window[: len(data) - 7] |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.window = window

    def peek(self, who: np.ndarray | slice) -> np.ndarray:
        at = self.at[who]
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def symbol(self, who, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code length, symbol and the bits that follow the code."""
        x = self.peek(who)
        found = lut[(x >> np.uint64(48)).astype(np.int64)]
        length = found >> 8
        return length, found & 255, x << length.astype(np.uint64)


def _top(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits of x, n < 64."""
    return ((x >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _signed(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)


def _read_dc(lanes: Lanes, places: np.ndarray, counts: np.ndarray, coef: np.ndarray, pattern: list[int], luts: list[np.ndarray], high: int, low: int) -> None:
    """``places``: lanes x blocks; ``pattern``: the component of each block of a unit."""
    last = np.zeros((len(counts), max(pattern) + 1), np.int64)
    for i in range(places.shape[1]):
        who = np.flatnonzero(counts > i)
        part = pattern[i % len(pattern)]
        if high:
            bit = (lanes.peek(who) >> np.uint64(63)).astype(np.int64)
            coef[places[who, i], 0] |= (bit << low).astype(coef.dtype)
            lanes.at[who] += 1
            continue
        length, size, rest = lanes.symbol(who, luts[part])
        last[who, part] += _signed(_top(rest, size), size)
        coef[places[who, i], 0] = last[who, part] << low
        lanes.at[who] += length + size


def _read_ac_first(lanes: Lanes, places: np.ndarray, counts: np.ndarray, coef: np.ndarray, lut: np.ndarray, first: int, last: int, low: int) -> None:
    flat = coef.reshape(-1)
    ended = np.zeros(len(counts), np.int64)  # blocks that an end run still covers
    for i in range(places.shape[1]):
        here = counts > i
        who = np.flatnonzero(here & (ended == 0))
        ended[here & (ended > 0)] -= 1
        k = np.full(len(who), first, np.int64)
        base = places[who, i] * 64
        while len(who):
            length, symbol, rest = lanes.symbol(who, lut)
            run, size = symbol >> 4, symbol & 15
            if size.all():
                k += run
                flat[base + k] = _signed(_top(rest, size), size) << low
                lanes.at[who] += length + size
                k += 1
            else:
                end = (size == 0) & (run < 15)
                real = size > 0
                k += np.where(end, 64, run)
                flat[(base + k)[real]] = _signed(_top(rest, size), size)[real] << low
                ended[who[end]] = (1 << run[end]) + _top(rest, run)[end] - 1
                lanes.at[who] += length + np.where(end, run, size)
                k += 1
            more = k <= last
            if not more.all():
                who, k, base = who[more], k[more], base[more]


def _read_ac_later(lanes: Lanes, places: np.ndarray, counts: np.ndarray, coef: np.ndarray, lut: np.ndarray, first: int, last: int, low: int) -> None:
    ended = np.zeros(len(counts), np.int64)
    column = np.arange(first, last + 1)
    step = 1 << low
    bits = np.unpackbits(lanes.data)
    for i in range(places.shape[1]):
        who = np.flatnonzero(counts > i)
        k = np.full(len(who), first, np.int64)
        while len(who):
            open_ = np.flatnonzero(ended[who] == 0)
            run, fresh = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
            if len(open_):
                length, symbol, rest = lanes.symbol(who[open_], lut)
                high, size = symbol >> 4, symbol & 15
                end = (size == 0) & (high < 15)
                lanes.at[who[open_]] += length + np.where(end, high, size)
                ended[who[open_[end]]] = (1 << high[end]) + _top(rest, high)[end]
                run[open_] = high
                fresh[open_] = np.where(size > 0, np.where(_top(rest, np.ones_like(size)) > 0, step, -step), 0)
            band = coef[places[who, i], first : last + 1]
            closed = ended[who] > 0
            if closed.all() and (k == first).all():
                within, target = band != 0, np.full(len(who), last + 1)
            else:
                zero = (band == 0) & (column >= k[:, None])
                hit = (np.cumsum(zero, 1) == (run + 1)[:, None]) & zero & ~closed[:, None]
                target = np.where(hit.any(1), column[hit.argmax(1)], last + 1)
                within = (band != 0) & (column >= k[:, None]) & (column < target[:, None])
            rank = np.cumsum(within, 1, dtype=np.int32)
            got = bits[np.minimum(lanes.at[who][:, None] + rank - 1, len(bits) - 1)]
            band += np.where(within & (got > 0), np.where(band > 0, step, -step), 0).astype(band.dtype)
            lanes.at[who] += rank[:, -1]
            new = np.flatnonzero((fresh != 0) & (target <= last))
            band[new, target[new] - first] = fresh[new]
            coef[places[who, i], first : last + 1] = band
            ended[who[closed]] -= 1
            k = np.where(closed, last + 1, target + 1)
            more = k <= last
            who, k = who[more], k[more]


def read_coefficients(images: list[Image]) -> list[np.ndarray]:
    """Coefficients of each image (blocks of all components x 64, zigzag order).
    Scans of one kind at one place in their image are read together."""
    total = np.concatenate([[0], np.cumsum([sum(x.blocks) for x in images])]).astype(np.int64)
    coef = np.zeros((int(total[-1]), 64), np.int16)
    for turn in range(max((len(x.scans) for x in images), default=0)):
        groups: dict[tuple, list[int]] = defaultdict(list)
        for n, image in enumerate(images):
            if turn < len(image.scans):
                groups[image.scans[turn][:7] + (tuple(p[1:3] for p in image.parts),)].append(n)
        for (chosen, first, last, high, low, restart, used, shape), members in groups.items():
            pattern = [p for p, c in enumerate(chosen) for _ in range(shape[c][0] * shape[c][1] if len(chosen) > 1 else 1)]
            segments, starts, counts, orders, base = [], [], [], [], 0
            for n in members:
                order = images[n].order(chosen) + total[n]
                width = restart * len(pattern) or len(order)
                parts = images[n].scans[turn][7]
                segments += parts
                starts.append(base + np.arange(len(parts)) * width)
                counts.append(np.minimum(width, len(order) - np.arange(len(parts)) * width))
                orders.append(order)
                base += len(order)
            start, count, order = np.concatenate(starts), np.concatenate(counts), np.concatenate(orders)
            places = order[np.minimum(start[:, None] + np.arange(count.max()), len(order) - 1)]
            lanes = Lanes(segments)
            if first == 0:
                _read_dc(lanes, places, count, coef, pattern, [None if t is None else _lut(t) for t in used], high, low)
            elif high:
                _read_ac_later(lanes, places, count, coef, _lut(used[0]), first, last, low)
            else:
                _read_ac_first(lanes, places, count, coef, _lut(used[0]), first, last, low)
    return [coef[a:b] for a, b in zip(total, total[1:])]


def _inverse() -> np.ndarray:
    """Inverse cosine transform of a block as a 64 x 64 matrix of whole numbers
    (2**14 is one): sums are exact in float64, so equal input gives equal pixels
    whatever shares its batch."""
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.rint(np.kron(c, c)[ZIGZAG] * (1 << 14))


_INVERSE = _inverse()


def to_pixels(images: list[Image], coefs: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of every block, one matrix product for all parts that share a quantiser."""
    parts: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
    for n, image in enumerate(images):
        at = 0
        for c, (_, _, _, q) in enumerate(image.parts):
            key, end = image.quant[q].tobytes(), at + image.blocks[c]
            if parts[key] and parts[key][-1][::2] == (n, at):
                at, end = parts[key].pop()[1], end
            parts[key].append((n, at, end))
            at = end
    out = [np.empty(x.shape, np.uint8) for x in coefs]
    for key, places in parts.items():
        blocks = np.concatenate([coefs[n][a:b] for n, a, b in places]).astype(np.float64)
        pixels = (blocks @ (np.frombuffer(key, np.int64)[:, None] * _INVERSE)).astype(np.int32)
        pixels += (1 << 13) + (128 << 14)
        pixels >>= 14
        pixels = pixels.clip(0, 255).astype(np.uint8)
        start = 0
        for n, a, b in places:
            out[n][a:b] = pixels[start : start + b - a]
            start += b - a
    return out


def to_rgb(image: Image, pixels: np.ndarray) -> np.ndarray:
    """height x width x 3 bytes: lay out the blocks, upsample, convert."""
    planes, at = [], 0
    for c, (_, h, v, _) in enumerate(image.parts):
        blocks = pixels[at : at + image.blocks[c]]
        at += image.blocks[c]
        plane = blocks.reshape(-1, image.strides[c], 8, 8).transpose(0, 2, 1, 3).reshape(-1, image.strides[c] * 8).astype(np.int32)
        planes.append((plane, image.most[1] // v, image.most[0] // h))
    if len(planes) == 1:
        return np.repeat(planes[0][0][: image.height, : image.width, None], 3, 2).astype(np.uint8)

    def whole(plane: np.ndarray, down: int, across: int) -> np.ndarray:
        if across > 1:
            plane = np.repeat(plane, across, 1)
        return (np.repeat(plane, down, 0) if down > 1 else plane)[: image.height, : image.width]

    y = (whole(*planes[0]) << 16) + 32768
    cb, cr = planes[1][0] - 128, planes[2][0] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)  # factors 1.402, 0.344136, 0.714136, 1.772 of the format, times 2**16
    if planes[1][1:] == planes[2][1:]:
        shifts = (91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)
        shifts = [whole(x, *planes[1][1:]) for x in shifts]
    else:
        cb, cr = whole(cb, *planes[1][1:]), whole(cr, *planes[2][1:])
        shifts = [91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb]
    for i, shift in enumerate(shifts):
        x = y + shift
        x >>= 16
        np.clip(x, 0, 255, out=x)
        out[:, :, i] = x
    return out


def read_media(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and tensor of each stream of one or more images."""
    images, owner = [], []
    for n, data in enumerate(streams):
        at = 0
        while at < len(data):
            images.append(Image(data, at))
            owner.append(n)
            at = images[-1].end
    found: list[list[tuple[bytes, np.ndarray]]] = [[] for _ in streams]
    coefs = read_coefficients(images)
    for n, image, coef, pixels in zip(owner, images, coefs, to_pixels(images, coefs)):
        stored = np.where(coef < 0, coef + 255, coef).astype(np.uint8).tobytes()[: image.size]
        found[n].append((stored, to_rgb(image, pixels)))
    return [(b"".join(x[0] for x in parts), np.concatenate([x[1] for x in parts])) for parts in found]


# ---- tables

def payload(text: str) -> F.Column:
    """UTF-8 bytes, then blanks up to a positive multiple of UNIT."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    target = F.greatest(F.ceil(size / UNIT), F.lit(1)) * UNIT
    return F.concat(F.coalesce(F.col(text), F.lit("")), F.repeat(F.lit(" "), (target - size).cast("int"))).cast("binary")


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each text as a progressive image, written as Parquet
    and read back. One row per input row, repeated rows included."""
    rows = docs.select(F.col(key).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), payload(text).alias("payload"))
    stored = common.scan(
        rows, lambda b: {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "media": [write_media(x) for x in b["payload"]]},
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, media binary",
    )
    return common.written(stored, "media")


def load_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, height, width, rgb (height x width x 3 bytes)."""

    def read(b: dict[str, list]) -> dict[str, list]:
        got = read_media(b["media"])
        return {
            "doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "media": b["media"], "payload": [x for x, _ in got],
            "height": [t.shape[0] for _, t in got], "width": [t.shape[1] for _, t in got], "rgb": [t.tobytes() for _, t in got],
        }

    return common.scan(stored, read, f"doc_id {dict(stored.dtypes)['doc_id']}, n_bytes bigint, media binary, payload binary, height int, width int, rgb binary")
