"""Elias-Fano sequences and an n-gram trie over them, as arrays that can be memory-mapped."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_U = np.uint64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def _place_in_byte() -> np.ndarray:
    """Where the k-th one of a byte is, at [byte, k]."""
    out = np.zeros((256, 8), np.uint8)
    for b in range(256):
        for k, p in enumerate([p for p in range(8) if b >> p & 1]):
            out[b, k] = p
    return out


_PLACE = _place_in_byte()


class BitVector:
    """Bits with counts of ones per 64, for select."""

    def __init__(self, data: np.ndarray, ones: np.ndarray) -> None:
        self.data, self.ones = data, ones  # bytes, a multiple of 8; ones before each 8 bytes

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> BitVector:
        bits = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        bits[places] = 1
        data = np.packbits(bits, bitorder="little")
        each = _ONES[data].reshape(-1, 8).sum(1, dtype=np.int64)
        return cls(data, np.concatenate([[0], each.cumsum()]).astype(np.int64))

    def select(self, k: np.ndarray, bit: int = 1) -> np.ndarray:
        """The place of the k-th (from 0) one or zero. So many that they touch most of the bits are found by one pass over these."""
        if 16 * len(k) > 8 * len(self.data):
            bits = np.unpackbits(self.data, bitorder="little")
            return np.flatnonzero(bits == bit)[k]
        before = self.ones if bit else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        left = k - before[word]
        byte = word * 8
        place = np.zeros(len(k), np.int64)
        found = np.zeros(len(k), bool)
        for i in range(8):
            b = self.data[byte + i] if bit else ~self.data[byte + i]
            n = _ONES[b]
            here = ~found & (left < n)
            place[here] = (byte[here] + i) * 8 + _PLACE[b[here], left[here]]
            found |= here
            left = np.where(found, left, left - n)
        return place


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Fields of so many bits, one after another, in 64-bit words."""
    at = np.arange(len(values), dtype=np.int64) * bits
    out = np.zeros((len(values) * bits >> 6) + 2, _U)
    if not bits or not len(values):
        return out
    word, shift = at >> 6, (at & 63).astype(_U)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[starts]] = np.bitwise_or.reduceat(values << shift, starts)
    spill = (shift > 0) & (shift + _U(bits) > 64)
    out[word[spill] + 1] |= values[spill] >> (_U(64) - shift[spill])
    return out


def unpack(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    at = i.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << bits) - 1)


class EliasFano:
    """A sequence of non-falling 64-bit numbers: low bits packed, high bits in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: BitVector, top: int) -> None:
        self.n, self.bits, self.low, self.high, self.top = n, bits, low, high, top

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(_U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        upper = (values >> _U(bits)).astype(np.int64)
        high = BitVector.of(upper + np.arange(n), n + (top >> bits) + 1)
        return cls(n, bits, pack(values & _U((1 << bits) - 1), bits), high, top)

    def get(self, i: np.ndarray) -> np.ndarray:
        upper = (self.high.select(i) - i).astype(_U)
        return (upper << _U(self.bits)) | unpack(self.low, self.bits, i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value, or -1: its high part names a run of places, whose low parts rise and are halved."""
        values = values.astype(_U)
        out = np.full(len(values), -1, np.int64)
        if 2 * len(values) > self.n > 0 and (values[1:] >= values[:-1]).all():
            # Sorted values that touch most of the sequence walk along it.
            every = self.get(np.arange(self.n))
            at = np.minimum(np.searchsorted(every, values), self.n - 1)
            same = every[at] == values
            out[same] = at[same]
            return out
        todo = np.flatnonzero(values <= _U(self.top)) if self.n else np.zeros(0, np.int64)
        upper = (values[todo] >> _U(self.bits)).astype(np.int64)
        want = values[todo] & _U((1 << self.bits) - 1)
        end = self.high.select(upper, 0) - upper
        at = np.where(upper > 0, self.high.select(np.maximum(upper - 1, 0), 0) - upper + 1, 0)
        stop = end.copy()
        low, live = at.copy(), np.flatnonzero(at < end)
        while len(live):  # halve each run of equal high parts
            mid = (low[live] + end[live]) >> 1
            less = unpack(self.low, self.bits, mid) < want[live]
            low[live] = np.where(less, mid + 1, low[live])
            end[live] = np.where(less, end[live], mid)
            live = live[low[live] < end[live]]
        inside = np.flatnonzero(low < stop)
        inside = inside[unpack(self.low, self.bits, low[inside]) == want[inside]]
        out[todo[inside]] = low[inside]
        return out


#: A quantised number is 10 to the power of -(code - 1) / STEPS; 0 stands for none. 16 bits reach down to 10^-2047, below any ratio of counts.
STEPS = 32


def quantise(p: np.ndarray) -> np.ndarray:
    return (np.rint(-np.log10(p) * STEPS) + 1).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) / STEPS), 0.0)


class Trie:
    """One level of an n-gram trie: contexts, monotone pointers to where each one's successors begin, and successors with a code each.

    A context is a number that the level below gave it; a successor is stored by
    its context's place and its own number, so that the whole level rises and a
    search for it starts in the right part of its context. The place of a
    successor is its own number as a context of the level above.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, bits: int) -> None:
        self.contexts, self.pointers, self.successors, self.codes, self.bits = contexts, pointers, successors, codes, bits

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, code: np.ndarray) -> Trie:
        """From distinct (context, word) pairs of numbers, sorted by both; together places of contexts and words have at most 64 bits."""
        context, word = context.astype(_U), word.astype(_U)
        first = np.flatnonzero(np.diff(context, prepend=context[:1] ^ _U(1))) if len(context) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context)))).astype(_U)
        bits = int(word.max()).bit_length() if len(word) else 0
        if bits + len(first).bit_length() > 64:
            raise ValueError("too many contexts and words for one level")
        return cls(EliasFano.of(context[first]), EliasFano.of(np.append(first, len(context))), EliasFano.of((place << _U(bits)) | word), code.astype(np.uint16), bits)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each pair (sorted or not), -1 where it is not in the trie."""
        out = np.full(len(context), -1, np.int64)
        context, word = context.astype(_U), word.astype(_U)
        if (context[1:] >= context[:-1]).all():
            new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
            names, of = context[new], new.cumsum() - 1
        else:
            names, of = np.unique(context, return_inverse=True)
        places = self.contexts.find(names)[of]
        has = np.flatnonzero((places >= 0) & (word >> _U(self.bits) == 0 if self.bits < 64 else True))
        place = places[has]
        at = self.successors.find((place.astype(_U) << _U(self.bits)) | word[has])
        ok = at >= 0
        has, at, place = has[ok], at[ok], place[ok]
        inside = (self.pointers.get(place) <= at.astype(_U)) & (at.astype(_U) < self.pointers.get(place + 1))
        out[has[inside]] = at[inside]
        return out

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 where it is not in the trie."""
        at = self.find(context, word)
        return np.where(at >= 0, self.codes[np.maximum(at, 0)], 0).astype(np.uint16) if len(self.codes) else np.zeros(len(at), np.uint16)

    def dump(self) -> bytes:
        """A header of sizes, then the arrays, each on a multiple of 8 bytes."""
        levels = (self.contexts, self.pointers, self.successors)
        arrays = [a for s in levels for a in (s.low, s.high.ones, s.high.data)] + [self.codes]
        head = np.array([self.bits, *[x for s in levels for x in (s.n, s.bits, s.top)], *[a.nbytes for a in arrays]], _U)
        return head.tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    @classmethod
    def load(cls, whole: np.ndarray) -> Trie:
        """Over the bytes of a dump, in memory or mapped, without copying them."""
        head = whole[: 8 * 20].view(_U)
        at, found = 8 * 20, []
        for n, kind in zip(head[10:].tolist(), [_U, np.int64, np.uint8] * 3 + [np.uint16], strict=True):
            found.append(whole[at : at + n].view(kind))
            at += n + -n % 8
        levels = [EliasFano(int(head[1 + 3 * i]), int(head[2 + 3 * i]), found[3 * i], BitVector(found[3 * i + 2], found[3 * i + 1]), int(head[3 + 3 * i])) for i in range(3)]
        return cls(*levels, found[-1], int(head[0]))

    def mapped(self) -> Trie:
        """The same trie over a memory-mapped file of the task's own, which goes with the last use of it."""
        handle, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as out:
            out.write(self.dump())
        whole = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        return Trie.load(whole)
