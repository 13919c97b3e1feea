"""Lossless WebP: a decoder of the whole VP8L format, and media columns of 8-bit samples.

``decode`` reads prefix codes (plain and per block), back-references and the
colour cache, and inverts the predictor, cross-colour, subtract-green and
palette transforms. ``encode_samples`` stores samples in the green channel of
one prefix code group: few distinct values become a palette with several to a
pixel, samples that the one to the left or above foretells better than their own
frequencies go through the predictor, and repeated runs become back-references.
Such images are decoded with arrays: the step that a symbol would take is looked
up at every bit at once, and the chain of symbols is followed in strides.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

# Fixed values of the format.
MAGIC, MAX_SIDE, LITERALS, LENGTHS, DISTANCES, HASH = 0x2F, 1 << 14, 256, 24, 40, 0x1E35A7BD
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near pixels by distance: 8 columns to the right and 7 to the left in this row and the 7 above.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
WIDTH, UNIT, STRIDES, LONGEST = 64, 64, 3, 11
#: Back-references of the encoder: least and greatest length, bytes that find them, and the farthest.
LEAST_RUN, LONGEST_RUN, KEY, FARTHEST = 16, 4096, 8, (1 << 20) - 120
HASHER, _PLACES = 0x9E3779B97F4A7C15, np.uint64((1 << 20) - 1)


class Bits:
    """Reads a string of bits, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.size = data + bytes(8), at, 8 * len(data)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.size:
            raise ValueError("the image ends early")
        return out


class Code(NamedTuple):
    """A prefix code as a table over the next ``bits`` bits."""

    bits: int
    symbols: np.ndarray
    lengths: np.ndarray

    def read(self, b: Bits) -> int:
        i = b.peek() & ((1 << self.bits) - 1)
        b.at += int(self.lengths[i])
        if b.at > b.size:
            raise ValueError("the image ends early")
        return int(self.symbols[i])


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, its first bit lowest."""
    counts = np.bincount(lengths, minlength=17).tolist()
    starts, code = [0] * len(counts), 0
    for n in range(1, len(counts)):
        starts[n] = code - sum(counts[1:n])  # less the rank of its first symbol
        code = (code + counts[n]) << 1
    order = lengths.argsort(kind="stable")[counts[0] :]
    sizes = lengths[order]
    x = (np.array(starts)[sizes] + np.arange(len(order))) << (16 - sizes)
    for k, mask in ((1, 0x5555), (2, 0x3333), (4, 0x0F0F), (8, 0x00FF)):
        x = (x >> k & mask) | (x & mask) << k
    out = np.zeros(len(lengths), np.int64)
    out[order] = x
    return out


def code_of(lengths: np.ndarray) -> Code:
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        return Code(0, np.zeros(1, np.int32), np.zeros(1, np.int32))
    if len(used) == 1:
        return Code(0, used[:1].astype(np.int32), np.zeros(1, np.int32))
    if (2.0 ** -lengths[used]).sum() != 1:
        raise ValueError("a prefix code is not complete")
    bits = int(lengths.max())
    both = np.zeros(1 << bits, np.int32)
    for s, code, n in zip(used.tolist(), canonical(lengths)[used].tolist(), lengths[used].tolist(), strict=True):
        both[code :: 1 << n] = s << 4 | n
    return Code(bits, both >> 4, both & 15)


_NONE = np.zeros(1, np.int32)


def read_code(b: Bits, alphabet: int) -> Code:
    if b.read(1):
        lengths = np.zeros(alphabet, np.int64)
        two = b.read(1)
        symbols = [b.read(8 if b.read(1) else 1)] + ([b.read(8)] if two else [])
        if not two and symbols[0] < alphabet:
            return Code(0, np.array(symbols, np.int32), _NONE)
        lengths[symbols] = 1
        return code_of(lengths)
    lengths, how = np.zeros(alphabet, np.int64), np.zeros(19, np.int64)
    for k in ORDER[: 4 + b.read(4)]:
        how[k] = b.read(3)
    code = code_of(how)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(b)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            value, n = (last, 3 + b.read(2)) if s == 16 else (0, 3 + b.read(3)) if s == 17 else (0, 11 + b.read(7))
            if at + n > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = value
            at += n
    return code_of(lengths)


def _extended(b: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + b.read(extra) + 1


def _extra(prefix: np.ndarray) -> np.ndarray:
    """How many bits follow a prefix of a length or distance."""
    return np.maximum((prefix - 2) >> 1, 0)


def _field(raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fields of n bits (at most 24) from places of bits on."""
    first = at >> 3
    four = raw[first] | raw[first + 1] << 8 | raw[first + 2] << 16 | raw[first + 3] << 24
    return (four.astype(np.int64) >> (at & 7)) & ((1 << n) - 1)


def _stream(b: Bits, green: Code, distance: Code, n: int, width: int) -> np.ndarray:
    """n samples of one code of literals and back-references, the last thing in the data."""
    first = b.at >> 3
    raw = np.frombuffer(b.data, np.uint8)[first:].astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    index = ((window[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel()
    end, size = 8 * len(window), b.size - 8 * first
    step = np.where(green.symbols >= LITERALS, 0, green.lengths).astype(np.int32).take(index)
    if (green.symbols >= LITERALS).any():
        far = np.flatnonzero(step == 0)
        far = far[far < size]
        step[far] = green.lengths[index[far]]
        prefix = green.symbols[index[far]] - LITERALS
        at = np.minimum(far + step[far] + _extra(prefix), size)
        code = distance.symbols[_field(raw, at, np.int64(distance.bits))] if distance.bits else np.full(len(at), distance.symbols[0])
        bits = distance.lengths[_field(raw, at, np.int64(distance.bits))] if distance.bits else 0
        step[far] = at - far + bits + _extra(code)
    jumps = [np.minimum(np.arange(end, dtype=np.int32) + step, end - 1)]
    for _ in range(STRIDES):
        jumps.append(jumps[-1].take(jumps[-1]))
    stride, leap = 1 << STRIDES, jumps[-1].item
    at, starts = b.at & 7, []
    for _ in range(-(-n // stride)):
        if at >= size:
            break
        starts.append(at)
        at = leap(at)
    places = np.empty((len(starts), stride), np.int32)
    places[:, 0] = starts
    for k in range(STRIDES):  # the first 2^k places of each stride give the next 2^k
        places[:, 1 << k : 2 << k] = jumps[k][places[:, : 1 << k]]
    places = places.ravel()[:n]
    symbols = green.symbols[index[places]]
    runs = np.flatnonzero(symbols >= LITERALS)
    lengths = np.ones(len(places), np.int64)
    if len(runs):
        prefix, at = symbols[runs] - LITERALS, places[runs] + green.lengths[index[places[runs]]]
        at = np.minimum(at, size)
        lengths[runs] = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << _extra(prefix)) + _field(raw, at, _extra(prefix)) + 1
        at = np.minimum(at + _extra(prefix), size)
        code = distance.symbols[_field(raw, at, np.int64(distance.bits))] if distance.bits else np.full(len(at), distance.symbols[0])
        at = np.minimum(at + (distance.lengths[_field(raw, at, np.int64(distance.bits))] if distance.bits else 0), size)
        back = np.where(code < 4, code, (2 + (code & 1)) << _extra(code)) + _field(raw, at, _extra(code)) + 1
    upto = lengths.cumsum()
    last = int(np.searchsorted(upto, n))
    if last >= len(upto) or 8 * first + int(places[last]) + int(step[places[last]]) > b.size:
        raise ValueError("the image ends early")
    if upto[last] != n:
        raise ValueError("a back-reference leaves the image")
    b.at = 8 * first + int(places[last]) + int(step[places[last]])
    symbols, starts_out = symbols[: last + 1], (upto - lengths)[: last + 1]
    if not len(runs):
        return symbols
    out = np.zeros(n, np.uint8)
    plain = symbols < LITERALS
    out[starts_out[plain]] = symbols[plain]
    buffer, keep = bytearray(out), runs <= last
    for p, length, d in zip(starts_out[runs[keep]].tolist(), lengths[runs[keep]].tolist(), back[keep].tolist(), strict=True):
        if d > len(NEAR):
            d -= len(NEAR)
        else:
            x, y = NEAR[d - 1]
            d = max(1, x + y * width)
        if d > p:
            raise ValueError("a back-reference leaves the image")
        buffer[p : p + length] = buffer[p - d : p - d + length] if d >= length else (buffer[p - d : p] * (length // d + 1))[:length]
    return np.frombuffer(buffer, np.uint8)


def read_pixels(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as 32-bit ARGB, before any transform."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    shift, groups, blocks = 0, 1, None
    if main and b.read(1):
        shift = b.read(3) + 2
        across = -(-width >> shift)
        blocks = (read_pixels(b, across, -(-height >> shift), False) >> 8) & 0xFFFF
        groups = int(blocks.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(b, s) for s in sizes] for _ in range(groups)]
    n = width * height
    green, red, blue, alpha, distance = codes[0]
    if main and groups == 1 and not cache_bits and green.bits and not (red.bits or blue.bits or alpha.bits):
        rest = int(alpha.symbols[0]) << 24 | int(red.symbols[0]) << 16 | int(blue.symbols[0])
        return (_stream(b, green, distance, n, width).astype(np.uint32) << 8) | np.uint32(rest)
    out: list[int] = []
    cache, kept = [0] * (1 << cache_bits), 0
    while len(out) < n:
        i = len(out)
        g = 0 if blocks is None else int(blocks[(i // width >> shift) * across + (i % width >> shift)])
        green, red, blue, alpha, distance = codes[g]
        s = green.read(b)
        if s < LITERALS:
            r, bl = red.read(b), blue.read(b)
            out.append(alpha.read(b) << 24 | r << 16 | s << 8 | bl)
        elif s < LITERALS + LENGTHS:
            length = _extended(b, s - LITERALS)
            d = _extended(b, distance.read(b))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-d])
        else:
            for c in out[kept:]:
                cache[(HASH * c & 0xFFFFFFFF) >> (32 - cache_bits)] = c
            kept = len(out)
            out.append(cache[s - LITERALS - LENGTHS])
    return np.array(out, np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """The last axis: blue, green, red, alpha."""
    return np.stack([(argb >> s) & 0xFF for s in (0, 8, 16, 24)], -1).astype(np.int32)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] | c[..., 1] << 8 | c[..., 2] << 16 | c[..., 3] << 24


def predict(mode: int, left, top, right, corner) -> list[int]:
    """The predicted channels from those of the neighbours to the left, above, above right and above left."""
    mean = lambda a, b: [(p + q) >> 1 for p, q in zip(a, b, strict=True)]
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return mean(mean(left, right), top)
        case 6:
            return mean(left, corner)
        case 7:
            return mean(left, top)
        case 8:
            return mean(corner, top)
        case 9:
            return mean(top, right)
        case 10:
            return mean(mean(left, corner), mean(top, right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            to_top = sum(abs(p - c) for p, c in zip(left, corner, strict=True))
            return left if to_left < to_top else top
        case 12:
            return [min(255, max(0, p + t - c)) for p, t, c in zip(left, top, corner, strict=True)]
        case 13:
            return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, top), corner, strict=True)]
    return [0, 0, 0, 255]


def unpredict(c: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = c.shape[:2]
    if modes.min() == modes.max() and modes.flat[0] in (1, 2):  # every pixel from the left, or from above: sums along a line
        out = c.astype(np.int64)
        out[0, 0, 3] += 255
        if modes.flat[0] == 1:
            out[:, 0] = out[:, 0].cumsum(0)
            return (out.cumsum(1) & 0xFF).astype(np.int32)
        out[0] = out[0].cumsum(0)
        return (out.cumsum(0) & 0xFF).astype(np.int32)
    rows = c.tolist()
    for y in range(height):
        row, above = rows[y], rows[y - 1]
        for x in range(width):
            if y and x:
                p = predict(int(modes[y >> shift, x >> shift]), row[x - 1], above[x], above[x + 1] if x + 1 < width else row[0], above[x - 1])
            else:
                p = row[x - 1] if x else above[x] if y else [0, 0, 0, 255]
            row[x] = [(a + b) & 0xFF for a, b in zip(row[x], p, strict=True)]
    return np.array(rows, np.int32).reshape(c.shape)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 0xFF) ^ 0x80) - 0x80


def uncross(c: np.ndarray, by: np.ndarray, shift: int) -> np.ndarray:
    y, x = np.indices(c.shape[:2])
    t = _signed(by[y >> shift, x >> shift])
    out = c.copy()
    green = _signed(c[..., 1])
    out[..., 2] = (c[..., 2] + (t[..., 0] * green >> 5)) & 0xFF
    out[..., 0] = (c[..., 0] + (t[..., 1] * green >> 5) + (t[..., 2] * _signed(out[..., 2]) >> 5)) & 0xFF
    return out


def decode_vp8l(data: bytes) -> np.ndarray:
    """The image as rows of 32-bit ARGB."""
    if data[:1] != bytes([MAGIC]):
        raise ValueError("not a lossless image")
    b = Bits(data, 8)
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("an unknown version")
    full, todo, seen = width, [], set()
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = b.read(3) + 2
            w, h = -(-width >> shift), -(-height >> shift)
            todo.append((kind, width, channels(read_pixels(b, w, h, False).reshape(h, w)), shift))
        elif kind == PALETTE:
            size = b.read(8) + 1
            colours = joined(channels(read_pixels(b, size, 1, False)).cumsum(0) & 0xFF)
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, width, colours, shift))
            width = -(-width >> shift)
        else:
            todo.append((kind, width, None, 0))
    image = read_pixels(b, width, height, True).reshape(height, width)
    for kind, wide, by, shift in reversed(todo):
        if kind == PALETTE:
            x = np.arange(wide)
            each = 8 >> shift
            index = (((image >> 8) & 0xFF)[:, x >> shift] >> (each * (x & ((1 << shift) - 1)))) & ((1 << each) - 1)
            image = np.append(by, np.zeros(256, np.uint32))[index].astype(np.uint32)
            continue
        c = channels(image)
        if kind == PREDICTOR:
            c = unpredict(c, by[..., 1] & 0xF, shift)
        elif kind == CROSS_COLOUR:
            c = uncross(c, by, shift)
        else:
            c[..., 0] = (c[..., 0] + c[..., 1]) & 0xFF
            c[..., 2] = (c[..., 2] + c[..., 1]) & 0xFF
        image = joined(c)
    assert image.shape == (height, full)
    return image


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        yield media[at : at + 4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def decode(media: bytes) -> np.ndarray:
    """A lossless WebP file's image as rows of 32-bit ARGB."""
    return next(decode_vp8l(x) for k, x in chunks(media) if k == b"VP8L")


def wrap(vp8l: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(vp8l)) + vp8l + bytes(len(vp8l) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of at most ``most`` bits; counts are flattened until they fit."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            w, a = heapq.heappop(heap)
            v, b = heap[0]
            parent[a] = parent[b] = node
            heapq.heapreplace(heap, (w + v, node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out
        weights = [w // 2 + 1 for w in weights]


class Writer:
    def __init__(self) -> None:
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def single(self, symbol: int) -> None:
        """The code of one symbol, which takes no bits."""
        self.put(0b101 | symbol << 3, 11)

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code: simple if it has one or two symbols that fit, else by its code lengths."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and max(used, default=0) < 256:
            used = used or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(1, 1)
            for s in used:
                self.put(s, 8)
            return
        self.put(0, 1)
        tokens: list[tuple[int, int, int]] = []
        last = used[-1] + 1 if used else 0
        values, i = lengths[:last].tolist(), 0
        while i < last:
            v = values[i]
            j = i + 1
            while j < last and values[j] == v:
                j += 1
            n = j - i
            if v:
                tokens.append((v, 0, 0))
                n -= 1
                while n >= 3:
                    k = min(n, 6)
                    tokens.append((16, k - 3, 2))
                    n -= k
                tokens += [(v, 0, 0)] * n
            else:
                while n >= 11:
                    k = min(n, 138)
                    tokens.append((18, k - 11, 7))
                    n -= k
                if n >= 3:
                    tokens.append((17, n - 3, 3))
                    n = 0
                tokens += [(0, 0, 0)] * n
            i = j
        how = huffman(np.bincount([t[0] for t in tokens], minlength=19), 7)
        sent = max(4, max(ORDER.index(int(k)) for k in np.flatnonzero(how)) + 1)
        self.put(sent - 4, 4)
        for k in ORDER[:sent]:
            self.put(int(how[k]), 3)
        if last < len(lengths):
            n = max(2, int(len(tokens) - 2).bit_length() + 1 & ~1)
            self.put(1, 1)
            self.put((n - 2) // 2, 3)
            self.put(len(tokens) - 2, n)
        else:
            self.put(0, 1)
        codes, single = canonical(how).tolist(), np.count_nonzero(how) == 1
        for s, extra, n in tokens:
            self.put(codes[s], 0 if single else int(how[s]))
            self.put(extra, n)


def repeats(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs that occurred before, first come first served, found by the bytes they begin with."""
    n = len(x) - KEY + 1
    if n < LEAST_RUN:
        return []
    two = x[:-1].astype(np.uint16) | x[1:].astype(np.uint16) << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
    keys = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    # A hash of the bytes above the place, so that one sort of numbers lays equal bytes together by place; an image has at most 2^20 samples.
    order = np.sort((keys * np.uint64(HASHER)) & ~_PLACES | np.arange(n, dtype=np.uint64))
    alike = np.flatnonzero((order[1:] ^ order[:-1]) <= _PLACES)
    here, before = (order[alike + 1] & _PLACES).astype(np.int64), (order[alike] & _PLACES).astype(np.int64)
    same = keys[here] == keys[before]
    distance = np.zeros(n, np.int64)
    distance[here[same]] = (here - before)[same]
    distance[distance > FARTHEST] = 0
    cuts = np.flatnonzero(np.diff(distance, prepend=-1, append=-1))
    lengths = np.diff(cuts) + KEY - 1
    good = (distance[cuts[:-1]] > 0) & (lengths >= LEAST_RUN)
    out, at = [], 0
    for start, length, d in zip(cuts[:-1][good].tolist(), lengths[good].tolist(), distance[cuts[:-1][good]].tolist(), strict=True):
        end, start = start + length, max(start, at)
        while end - start >= LEAST_RUN:
            take = min(end - start, LONGEST_RUN)
            out.append((start, take, d))
            start = at = start + take
    return out


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and these, of lengths or distances from 1 up."""
    v = np.maximum(value - 1, 0)
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    extra = np.maximum(top - 1, 0)
    prefix = np.where(v < 4, v, 2 * top + ((v >> extra) & 1))
    return prefix, np.where(v < 4, 0, extra), np.where(v < 4, 0, v & ((1 << extra) - 1))


def _entropy(x: np.ndarray) -> float:
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    return float(-(p * np.log2(p)).sum())


def foretold(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Predictor mode (0: none, 1: left, 2: above) and residuals of rows of samples: whichever needs fewest bits by far enough."""
    left, above = x.copy(), x.copy()
    left[1:, 0] -= x[:-1, 0]
    left[:, 1:] -= x[:, :-1]
    above[0, 1:] -= x[0, :-1]
    above[1:] -= x[:-1]
    bits = [_entropy(x.ravel()), _entropy(left.ravel()), _entropy(above.ravel())]
    best = int(np.argmin(bits))
    return (best, (x, left, above)[best]) if best and (bits[0] - bits[best]) * x.size > 128 else (0, x)


def encode_image(samples: np.ndarray, width: int = WIDTH) -> bytes:
    """Samples, a multiple of width, as the green channel of a file with one group of prefix codes."""
    w = Writer()
    w.put(MAGIC, 8)
    w.put(width - 1, 14)
    w.put(len(samples) // width - 1, 14)
    w.put(0, 1 + 3)  # no alpha, version 0
    alpha, x = 255, samples.reshape(-1, width)
    values = np.unique(samples)
    if len(values) <= 16:
        each = 1 if len(values) <= 2 else 2 if len(values) <= 4 else 4
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(values) - 1, 8)
        w.put(0, 1)  # no cache
        # The colours' differences: the first has the alpha, all of them green.
        steps = np.diff(values, prepend=0).astype(np.uint8)
        alphas = np.zeros(256, np.int64)
        alphas[[255, 0][: min(2, len(values))]] = 1
        green = huffman(np.bincount(steps, minlength=LITERALS + LENGTHS), LONGEST)
        for lengths in (green, None, None, alphas, None):
            w.single(0) if lengths is None else w.code(lengths)
        greens, alpha_codes = canonical(green).tolist(), canonical(alphas).tolist()
        for i, v in enumerate(steps.tolist()):
            if np.count_nonzero(green) > 1:
                w.put(greens[v], int(green[v]))
            if len(values) > 1:
                w.put(alpha_codes[0 if i else 255], 1)
        place = np.zeros(256, np.uint8)
        place[values] = np.arange(len(values))
        x = place[x].reshape(len(x), -1, 8 // each)
        x = (x << (each * np.arange(8 // each, dtype=np.uint8))).sum(2).astype(np.uint8)
        width = x.shape[1]
    mode, x = foretold(x)
    if mode:
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(7, 3)  # blocks of 512 pixels
        w.put(0, 1)  # no cache
        for symbol in (mode, 0, 0, 255, 0):
            w.single(symbol)
        alpha = 0
    w.put(0, 1 + 1 + 1)  # no more transforms, no cache, no blocks
    x = np.ascontiguousarray(x).ravel()
    runs = np.array(repeats(x), np.int64).reshape(-1, 3)
    literal = np.ones(len(x), bool)
    for start, length, _ in runs.tolist():
        literal[start : start + length] = False
    plain = np.flatnonzero(literal)
    length_prefix, length_bits, length_rest = _prefixed(runs[:, 1])
    far_prefix, far_bits, far_rest = _prefixed(runs[:, 2] + len(NEAR))
    counts = np.bincount(x[plain], minlength=LITERALS + LENGTHS) + np.bincount(LITERALS + length_prefix, minlength=LITERALS + LENGTHS)
    green, far = huffman(counts, LONGEST), huffman(np.bincount(far_prefix, minlength=DISTANCES), LONGEST)
    w.code(green)
    for symbol in (0, 0, alpha):
        w.single(symbol)
    w.code(far) if len(runs) else w.single(0)
    sizes = green if np.count_nonzero(green) > 1 else green * 0
    far_sizes = far if np.count_nonzero(far) > 1 else far * 0
    codes, far_codes = canonical(green), canonical(far)
    # A literal has one field and a back-reference five, of which the distance's rest is cut in two.
    if len(runs):
        n = len(plain) + 5 * len(runs)
        fields, bits = np.empty(n, np.int32), np.empty(n, np.int32)
        spot = np.arange(len(plain)) + 5 * np.searchsorted(runs[:, 0], plain)
        fields[spot], bits[spot] = codes[x[plain]], sizes[x[plain]]
        spot = 5 * np.arange(len(runs)) + np.searchsorted(plain, runs[:, 0])
        parts = ((codes[LITERALS + length_prefix], sizes[LITERALS + length_prefix]), (length_rest, length_bits), (far_codes[far_prefix], far_sizes[far_prefix]), (far_rest & 511, np.minimum(far_bits, 9)), (far_rest >> 9, np.maximum(far_bits - 9, 0)))
        for k, (value, size) in enumerate(parts):
            fields[spot + k], bits[spot + k] = value, size
    else:
        fields, bits = codes.astype(np.int32)[x], sizes.astype(np.int32)[x]
    if not bits.sum():
        return wrap(w.value.to_bytes(-(-w.at // 8), "little"))
    ends = bits.cumsum(dtype=np.int64) + w.at
    starts = ends - bits
    fields = fields * (bits > 0) << (starts & 15)
    word = starts >> 4
    n = (int(ends[-1]) + 15) // 16 + 1
    words = np.bincount(word, fields & 0xFFFF, n) + np.bincount(word + 1, fields >> 16, n + 1)[:n]
    head = w.value.to_bytes(2 * n, "little")
    body = words.astype("<u2").tobytes()
    data = (np.frombuffer(head, np.uint8) | np.frombuffer(body, np.uint8)).tobytes()
    return wrap(data[: -(-int(ends[-1]) // 8)])


def encode_samples(payload: bytes, width: int = WIDTH) -> bytes:
    """A payload of a positive multiple of width as WebP files, one after another, of up to 16384 rows each."""
    step = width * MAX_SIDE
    return b"".join(encode_image(np.frombuffer(payload[i : i + step], np.uint8), width) for i in range(0, len(payload), step))


def decode_samples(media: bytes) -> list[np.ndarray]:
    """The images' samples, row by row."""
    out, at = [], 0
    while at < len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        image = decode(media[at : at + 8 + size])
        out.append(((image >> 8) & 0xFF).astype(np.uint8))
        at += 8 + size
    return out


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(-len(data) % unit or (unit if not data else 0))


def feature(images: list[np.ndarray]) -> str:
    """Of all samples: rows, distinct values, mean, entropy in bits and mean step between neighbours."""
    x = np.concatenate([i.ravel() for i in images])
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"rows={len(x) // WIDTH};values={len(p)};mean={x.mean():.4f};bits={-(p * np.log2(p)).sum():.4f};step={step:.4f}"


def media_of(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text's bytes as lossless WebP.

    A null or empty text gives one row of zeros; a text of any length gives as
    many images as it needs; equal texts give equal bytes; rows that repeat stay;
    other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            media = [encode_samples(padded((t or "").encode())) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "media": media})

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, media binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's figures come from what the stored bytes decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                data = (text or "").encode()
                media = encode_samples(padded(data))
                images = decode_samples(media)
                back = b"".join(i.tobytes() for i in images)
                rows.append((doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})

    docs = short_batches(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
