"""Elias-Fano sequences and a two-level n-gram trie over them.

A monotone sequence is cut into low bits, packed, and high bits, in unary. The
trie has three such levels: contexts, pointers from each context to its
successors, and successors, made monotone by adding, context after context,
the largest value so far. A successor is looked for only among its context's,
relative to their base. Probabilities are codes of one byte.

A trie is one run of bytes: ``Trie(buffer)`` reads it where it lies, and
``Trie.open(path)`` maps a file.
"""

from __future__ import annotations

import numpy as np

_HEAD = 6


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values in compact form."""

    def __init__(self, words: np.ndarray, at: int) -> None:
        self.n, self.low_bits, low_words, high_words = (int(x) for x in words[at : at + 4])
        self.low = words[at + 4 : at + 4 + low_words]
        high = words[at + 4 + low_words : at + 4 + low_words + high_words]
        self.end = at + 4 + low_words + high_words
        # Select directory of the unary bits: where each element's one stands.
        self.ones = np.flatnonzero(np.unpackbits(high.view(np.uint8), bitorder="little"))[: self.n]

    @staticmethod
    def pack(values: np.ndarray) -> np.ndarray:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            part = values & np.uint64((1 << low_bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        return np.concatenate([np.array([n, low_bits, len(low), len(high)], np.uint64), low, high])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements at positions."""
        high = (self.ones[i] - i).astype(np.uint64)
        if not self.low_bits:
            return high
        b = np.uint64(self.low_bits)
        bit = i.astype(np.uint64) * b
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = self.low[word] >> shift
        over = shift + b > np.uint64(64)
        part[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (high << b) | (part & np.uint64((1 << self.low_bits) - 1))

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> np.ndarray:
        """Position of the first element not below x in each range [first, last)."""
        lo = np.broadcast_to(np.asarray(first, np.int64), x.shape).copy()
        hi = np.broadcast_to(np.asarray(self.n if last is None else last, np.int64), x.shape).copy()
        # Only elements with x's own high bits need comparing; counting unary ones finds them.
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        heads = self.ones - np.arange(self.n)
        lo = np.maximum(lo, np.minimum(np.searchsorted(heads, high), hi))
        hi = np.minimum(hi, np.maximum(np.searchsorted(heads, high, "right"), lo))
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.get(mid) < x[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo


class Trie:
    """(context, successor) -> one-byte code."""

    def __init__(self, buffer) -> None:
        words = np.frombuffer(buffer, np.uint64)
        self.contexts = EliasFano(words, 0)
        self.pointers = EliasFano(words, self.contexts.end)
        self.successors = EliasFano(words, self.pointers.end)
        self.codes = words[self.successors.end :].view(np.uint8)

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls(np.memmap(path, np.uint64, "r"))

    @staticmethod
    def pack(context: np.ndarray, successor: np.ndarray, code: np.ndarray) -> bytes:
        """Of distinct pairs sorted by context, then successor."""
        n = len(context)
        head = np.ones(n, bool)
        head[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(head)
        pointers = np.append(first, n)
        tops = successor[pointers[1:] - 1] if n else successor[:0]
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tops, dtype=np.uint64)[:-1]]) if n else successor[:0]
        raised = successor + np.repeat(base, np.diff(pointers))
        codes = np.concatenate([code, np.zeros(-n % 8, np.uint8)]).view(np.uint64)
        parts = [EliasFano.pack(context[first]), EliasFano.pack(pointers.astype(np.uint64)), EliasFano.pack(raised), codes]
        return np.concatenate(parts).tobytes()

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs; 0 where the pair or its context is not held."""
        out = np.zeros(len(context), np.uint8)
        if not self.contexts.n or not len(context):
            return out
        c = np.minimum(self.contexts.successor(context), self.contexts.n - 1)
        known = np.flatnonzero(self.contexts.get(c) == context)
        c, wanted = c[known], successor[known]
        lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        # What was added to this context's successors is the previous context's last raised value.
        base = np.where(lo > 0, self.successors.get(np.maximum(lo - 1, 0)), np.uint64(0))
        raised = wanted + base
        fits = raised <= self.successors.get(hi - 1)
        known, raised, lo, hi = known[fits], raised[fits], lo[fits], hi[fits]
        at = np.minimum(self.successors.successor(raised, lo, hi), hi - 1)
        met = self.successors.get(at) == raised
        out[known[met]] = self.codes[at[met]]
        return out
