"""Stretches of text that tokenizers treat alone, so that each distinct one is encoded once.

A text may be cut before a space that follows a character other than white
space: no match of the byte-level split pattern, and no piece of a vocabulary
whose space marks only begin pieces, goes over such a place. So the tokens of
a text are those of its stretches in order, and a task encodes a stretch the
first time it meets it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CUT = re.compile(r"(?<=\S)(?= )")
#: Characters of text whose stretches are held at a time; a longer stretch is held whole.
RUN_CHARS = 1 << 18
#: What a task remembers at most: stretches, and characters in them.
KNOWN, KNOWN_CHARS = 400_000, 16 << 20


def runs(text: str, limit: int = RUN_CHARS) -> Iterator[str]:
    """Parts of a text of about ``limit`` characters, cut where stretches are."""
    at = 0
    while len(text) - at > limit and (met := CUT.search(text, at + limit)):
        yield text[at : met.start()]
        at = met.start()
    if at < len(text):
        yield text[at:]


def row_runs(column: pa.Array, limit: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``limit`` characters, or one row; null reads as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class _Numbers(dict):
    """Numbers of stretches in order of their first meeting; ``new`` lists those met since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self.new.append(stretch)
        self[stretch] = n = len(self)
        return n


class Known:
    """Numbers of the distinct stretches met; ``learn`` is handed the new ones of a run, in order."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None]) -> None:
        self.learn, self.forget = learn, forget
        self.number = _Numbers()
        self.chars = 0

    def trim(self) -> None:
        """Forget all if too much is known; numbers given before are then void."""
        if len(self.number) > KNOWN or self.chars > KNOWN_CHARS:
            self.number = _Numbers()
            self.chars = 0
            self.forget()

    def numbers(self, run: str) -> np.ndarray:
        """Numbers of a run's stretches; what they stand for is known after ``settle``."""
        found = CUT.split(run)
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def settle(self) -> None:
        if self.number.new:
            new, self.number.new = self.number.new, []
            self.chars += sum(map(len, new))
            self.learn(new)


def joined(stretches: list[str], alone: np.ndarray) -> list[str]:
    """Stretches in longer texts that may be cut between them; those marked ``alone`` stay so."""
    if not alone.any():
        return ["".join(stretches)]
    new = np.flatnonzero(alone | np.concatenate([[True], alone[:-1]]))
    return ["".join(stretches[a:b]) for a, b in zip(new, np.append(new[1:], len(stretches)), strict=True)]


def irregular(stretches: list[str]) -> np.ndarray:
    """Stretches that do not begin with a space, or end with white space: what is beside them matters."""
    return np.array([s[0] != " " or s[-1].isspace() for s in stretches], bool)


class Lists:
    """Lists of numbers, one for each stretch, in two flat arrays that grow."""

    def __init__(self, kind=np.int32) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.flat, self.start, self.n = np.empty(1 << 10, self.kind), np.zeros(1 << 10, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Lists of these sizes, joined."""
        used, after = int(self.start[self.n]), self.n + len(sizes)
        total = used + len(flat)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(2 * total - used, self.kind)])
        if after >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros(2 * after, np.int64)])
        self.flat[used:total] = flat
        self.start[self.n + 1 : after + 1] = used + np.cumsum(sizes)
        self.n = after

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of some stretches, joined."""
        first = self.start[numbers]
        size = self.start[numbers + 1] - first
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(first - (end - size), size) + np.arange(total)]
