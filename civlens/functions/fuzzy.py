"""Fuzzy string scores (T-07).

Scores follow the InDel similarity: ratio(a, b) = 100 * 2 * LCS(a, b) / (|a| + |b|),
rounded half to even to an integer; partial_ratio = best ratio of the shorter string
against every equal-length window of the longer one (Q-08 decision). LCS lengths use the
bit-parallel recurrence, one machine-word-like integer operation per character.

Distinct texts meet the names of their list through ``Names``, which scores only names that can still
win; see operators/fuzzy_correct.py.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def default_process(s: str | None) -> str:
    """Lower-case, non-alphanumerics to space, trimmed."""
    if s is None:
        return ""
    return "".join(c if c.isalnum() else " " for c in s.lower()).strip()


def masks_of(a: str) -> dict[str, int]:
    """Bit positions of each character of ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def lcs_length(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence; ``masks`` of ``a`` may be given."""
    m = len(a)
    if m == 0 or not b:
        return 0
    masks = masks_of(a) if masks is None else masks
    full = (1 << m) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return m - s.bit_count()


def ratio(a: str | None, b: str | None) -> int:
    if not a or not b:
        return 0
    return int(round(200.0 * lcs_length(a, b) / (len(a) + len(b))))


def partial_ratio(a: str | None, b: str | None) -> int:
    if not a or not b:
        return 0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if short in long_:
        return 100
    m, masks = len(short), masks_of(short)
    best = max(lcs_length(short, long_[i : i + m], masks) for i in range(len(long_) - m + 1))
    return int(round(100.0 * best / m))


class Names:
    """Official names of one list, with counts of their letters and letter pairs.

    With m the shorter length and l the longest common subsequence of the shorter string and a window
    of as many letters, l is at most the number of common letters; and as one string becomes the other
    by m - l deletions (each spoils two letter pairs) and m - l insertions (one each), at least
    m - 1 - 3 (m - l) pairs stay, so l <= m - (m - 1 - common pairs) / 3. Counted over whole strings
    both are upper bounds, so a name whose bound is below the best score need not be scored.
    """

    def __init__(self, names: list[str]):
        self.text = [default_process(n) for n in names]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.letters = self._table(self.text)
        self.pairs = self._table([self._pairs(t) for t in self.text])

    @staticmethod
    def _pairs(text: str) -> list[str]:
        return [text[i : i + 2] for i in range(len(text) - 1)]

    @staticmethod
    def _table(rows) -> tuple[dict[str, int], np.ndarray]:
        number: dict[str, int] = {}
        counts = [Counter(r) for r in rows]
        for c in counts:
            for g in c:
                number.setdefault(g, len(number))
        table = np.zeros((len(counts), len(number)), np.int32)
        for i, c in enumerate(counts):
            for g, n in c.items():
                table[i, number[g]] = n
        return number, table

    @staticmethod
    def _common(of: tuple[dict[str, int], np.ndarray], grams) -> np.ndarray:
        number, table = of
        found = [(number[g], n) for g, n in Counter(grams).items() if g in number]
        if not found:
            return np.zeros(len(table), np.int64)
        at, n = np.array(found).T
        return np.minimum(table[:, at], n).sum(axis=1)

    def bounds(self, text: str) -> np.ndarray:
        """No name can score more than this against the processed text."""
        m = np.minimum(self.size, len(text))
        kept = m - (np.maximum(m - 1 - self._common(self.pairs, self._pairs(text)), 0) + 2) // 3
        most = np.minimum(self._common(self.letters, text), kept)
        return np.array([round(100.0 * x / n) if n else 0 for x, n in zip(most.tolist(), m.tolist(), strict=True)])

    def best(self, text: str | None) -> tuple[int, int, int]:
        """(score, number of the best name, how many names were scored); of names with equal scores the
        first one."""
        text = default_process(text)
        bounds = self.bounds(text)
        score, name, tried = -1, -1, 0
        for i in np.lexsort((np.arange(len(bounds)), -bounds)).tolist():
            if bounds[i] < score:
                break
            tried += 1
            new = partial_ratio(text, self.text[i])
            if new > score or new == score and i < name:
                score, name = new, i
        return score, name, tried
