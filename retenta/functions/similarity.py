"""Similarity of short names: 100 * (1 - indel distance / total length) after sorting the words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def token_sorted(value: str) -> str:
    return " ".join(sorted(value.lower().split()))


def similarity(a: str, b: str) -> float:
    """Normalised indel similarity; the longest common subsequence is counted with bit vectors."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    common = len(a) - state.bit_count()
    return 200.0 * common / (len(a) + len(b))


class Dictionary:
    """A closed list of candidates, against which whole batches of names are compared, one array operation for all names.

    The longest common subsequence of a candidate and every name advances by one character of the names at a time, as bits of one
    machine word per name; candidates of over 63 characters are compared name by name.
    """

    def __init__(self, candidates: Sequence[str]):
        self.names = list(candidates)
        self.keys = [token_sorted(c) for c in candidates]
        self.letters = np.unique(np.array([ord(c) for k in self.keys for c in k], dtype=np.uint32))
        self.tables = []
        for key in self.keys:
            table = np.zeros(len(self.letters) + 1, dtype=np.uint64)    # the last entry is for letters of no candidate
            for i, c in enumerate(key[:63]):
                table[np.searchsorted(self.letters, ord(c))] |= np.uint64(1 << i)
            self.tables.append(table)

    def _coded(self, keys: list[str]) -> np.ndarray:
        width = max(map(len, keys), default=0)
        codes = np.full((len(keys), width), len(self.letters), dtype=np.int64)
        points = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.searchsorted(self.letters, points)
        known = np.append(self.letters, np.uint32(0xFFFFFFFF))[at] == points
        codes[np.arange(width) < np.array(list(map(len, keys)))[:, None]] = np.where(known, at, len(self.letters))
        return codes

    def best(self, names: Sequence[str | None]) -> list[tuple[str | None, float | None]]:
        """The most similar candidate of each name and its similarity; the earlier one wins a tie, a null name has none."""
        there = [i for i, n in enumerate(names) if n is not None]
        out: list[tuple[str | None, float | None]] = [(None, None)] * len(names)
        if not there or not self.names:
            return out
        keys = [token_sorted(names[i]) for i in there]
        codes, sizes = self._coded(keys), np.array(list(map(len, keys)))
        top, which = np.full(len(keys), -1.0), np.zeros(len(keys), dtype=np.int64)
        for k, (key, table) in enumerate(zip(self.keys, self.tables)):
            if len(key) > 63:
                score = np.array([similarity(x, key) for x in keys])
            else:
                full = np.uint64((1 << len(key)) - 1)
                state = np.full(len(keys), full)
                for column in codes.T:
                    hit = state & table[column]
                    state = ((state + hit) | (state - hit)) & full
                common, total = len(key) - np.bitwise_count(state).astype(np.int64), sizes + len(key)
                score = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
            better = score > top
            top, which = np.where(better, score, top), np.where(better, k, which)
        for i, k, score in zip(there, which.tolist(), top.tolist()):
            out[i] = (self.names[k], score)
        return out


def best_match(value: Column, candidates: Sequence[str]) -> Column:
    """Struct ``(candidate, score)`` of the most similar candidate; the earlier one wins a tie.

    Meant for distinct names: the candidates are a closed list that travels with the function.
    """
    dictionary = Dictionary(candidates)

    @F.pandas_udf("candidate string, score double")
    def match(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dictionary.best(names.tolist()), columns=["candidate", "score"])

    return match(value)


def best_levenshtein(value: Column, candidates: Sequence[str]) -> Column:
    """Struct ``(score, candidate)`` by edit distance, in native expressions; the earlier candidate wins a tie."""
    def entry(i: int, c: str) -> Column:
        size = F.greatest(F.length(value), F.lit(len(c)))
        score = F.coalesce(F.try_divide(F.lit(100.0) * (size - F.levenshtein(value, F.lit(c))), size), F.lit(100.0))
        return F.struct(score.alias("score"), F.lit(-i).alias("pos"), F.lit(c).alias("candidate"))

    best = F.array_max(F.array(*[entry(i, c) for i, c in enumerate(candidates)]))
    return F.when(value.isNotNull(), F.struct(best["score"].alias("score"), best["candidate"].alias("candidate")))
