"""Values of strings, computed once for many and kept up to a bound of bytes; the letters of byte-level vocabularies."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

#: What a dictionary entry and its string take besides the characters.
ENTRY_BYTES = 150


class Flat:
    """Arrays of different lengths, one after another."""

    def __init__(self, dtype) -> None:
        self.dtype = np.dtype(dtype)
        self.begin, self.length, self.values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, dtype)

    def add(self, lengths: np.ndarray, values: np.ndarray) -> None:
        lengths = np.asarray(lengths, dtype=np.int64)
        self.begin = np.concatenate([self.begin, len(self.values) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.values = np.concatenate([self.values, np.asarray(values, dtype=self.dtype)])

    def at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers one after another, and the length of each."""
        length = self.length[numbers]
        before = np.cumsum(length) - length
        return self.values[np.repeat(self.begin[numbers] - before, length) + np.arange(length.sum())], length

    def nbytes(self) -> int:
        return self.begin.nbytes + self.length.nbytes + self.values.nbytes


class Remembered:
    """Numbers of strings, and for each named kind the array that belongs to a number.

    ``learn`` gets a list of distinct new strings and returns (lengths, values) per kind. Beyond
    ``bound`` bytes everything is forgotten before new strings come in: numbers hold until the next ``find``."""

    def __init__(self, learn: Callable[[list[str]], dict[str, tuple[np.ndarray, np.ndarray]]], kinds: dict, bound: int = 64 << 20) -> None:
        self.learn, self.kinds, self.bound = learn, kinds, bound
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.flat = {k: Flat(t) for k, t in self.kinds.items()}

    def _add(self, new: list[str]) -> None:
        for kind, (lengths, values) in self.learn(new).items():
            self.flat[kind].add(lengths, values)
        self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)

    def find(self, keys: list[str]) -> np.ndarray:
        if self.held + sum(f.nbytes() for f in self.flat.values()) > self.bound:
            self.clear()
        at = np.fromiter(map(self.number.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._add(list(dict.fromkeys([keys[i] for i in missing.tolist()])))
            at[missing] = np.fromiter((self.number[keys[i]] for i in missing.tolist()), np.int64, len(missing))
        return at

    def take(self, keys: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Arrays of the keys one after another, and the length of each."""
        at = self.find(keys)  # before its table is looked up: it may be a new one afterwards
        return self.flat[kind].at(at)


def ends_of(lengths: np.ndarray, counts: list[int]) -> np.ndarray:
    """Ends of consecutive groups: how much the first count of lengths adds up to, then the next, from 0."""
    return np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])]


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest for U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
