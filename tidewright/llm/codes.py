"""Texts as arrays of code points: vectorised look folding, bare texts, k-gram hashes and window minima.

All functions take a list of strings (null as None) and work on one concatenated ``uint32`` array with string offsets,
so that the cost a character is a few nanoseconds; only strings holding a rewritable character go through the folder.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

from . import look as L

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


_CUT = np.uint32(0xFFFFFFFF)


class Tables:
    """By code point: its plain form (``_CUT`` if it shows nothing), its bare form (0 if neither letter nor digit), and
    whether a text holding it goes through the automaton (accents apart from their letter, forms of several characters)."""

    def __init__(self, folder: L.LookFolder) -> None:
        self.folder = folder
        self.look = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        self.slow = np.zeros(sys.maxunicode + 1, bool)
        self.look[list(folder.gone)] = _CUT
        for m, to in folder.table.items():
            to = folder.representative.get(to, to)
            if len(m) == 1 == len(to) and to not in folder.marks:
                self.look[ord(m)] = ord(to)
            elif len(m) == 1:
                self.slow[ord(m)] = True
        for m, to in folder.representative.items():
            if len(m) == 1 == len(to):
                self.look[ord(m)] = ord(to)
            elif len(m) == 1:
                self.slow[ord(m)] = True
        self.slow[[ord(c) for c in folder.marks]] = True
        lower = np.zeros(sys.maxunicode + 1, np.uint32)
        for o in L._assigned():
            if (c := chr(o)).isalnum():
                lower[o] = ord(c.lower()[0])
        self.bare = np.where(self.look == _CUT, 0, lower[np.where(self.look == _CUT, 0, self.look)]).astype(np.uint32)
        for o, low in L.lowered_first().items():
            self.bare[o] = self.bare[ord(low)]

    def looks(self, texts: list[str | None]) -> list[str | None]:
        """The look of every text; null stays null."""
        c, starts = codes(texts)
        slow = _any(self.slow[c], starts)
        x = self.look[c]
        changed = _any(x != c, starts)
        keep = x != _CUT
        kept = np.zeros(len(x) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        new = as_text(x[keep], kept[starts])
        out = list(texts)
        for i in np.flatnonzero(changed | slow).tolist():
            out[i] = self.folder.look(out[i]) if slow[i] else new[i]
        return out

    def bares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bare texts as code points and starts."""
        c, starts = codes(texts)
        slow = np.flatnonzero(_any(self.slow[c], starts)).tolist()
        if slow:
            texts = list(texts)
            for i in slow:
                texts[i] = self.folder.look(texts[i].translate(L.lowered_first()))
            c, starts = codes(texts)
        b = self.bare[c]
        keep = b != 0
        kept = np.zeros(len(b) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        return b[keep], kept[starts]


@lru_cache(1)
def tables() -> Tables:
    """Tables of the plain forms, made once a process."""
    return Tables(L.folder())


@lru_cache(2)
def tables_by(counts: tuple[tuple[str, int], ...]) -> Tables:
    """Tables of the forms most frequent by ``counts``, made once a process."""
    return Tables(L.LookFolder(dict(counts)))


def looks(texts: list[str | None]) -> list[str | None]:
    return tables().looks(texts)


def bare(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return tables().bares(texts)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each starts (one more entry than texts)."""
    texts = [t or "" for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _any(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:]] > total[starts[:-1]]


def as_text(c: np.ndarray, starts: np.ndarray) -> list[str]:
    s = c.tobytes().decode("utf-32-le", "surrogatepass")
    return [s[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(c: np.ndarray, k: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """64-bit hash of the k code points from every position (those across a text's end included; callers mask them). Another
    ``odd`` number gives another hash."""
    n = len(c) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = mix(c.astype(np.uint64) + odd)
    if k <= 4:
        h = x[:n].copy()
        for i in range(1, k):
            h = h * odd + x[i : i + n]
        return mix(h)
    inverse = np.uint64(pow(int(odd), -1, 1 << 64))
    down = np.cumprod(np.full(len(c), inverse))
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(x * down, out=total[1:])
    up = np.cumprod(np.full(n, odd))
    return mix((total[k:] - total[:-k]) * up)


def owner(starts: np.ndarray) -> np.ndarray:
    """The text of every position."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def grams(c: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every k-gram that lies within one text."""
    h = hashes(c, k)
    who = owner(starts)
    inside = who[: len(h)] == who[k - 1 :] if len(h) else np.zeros(0, bool)
    return who[: len(h)][inside], h[inside]


def sorted_set(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting integers is faster than hashing them."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def distinct(who: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash), sorted by text, then hash."""
    if not len(h):
        return who, h
    values = sorted_set(h)
    both = sorted_set((who.astype(np.int64) << 32) | np.searchsorted(values, h))
    return both >> 32, values[both & 0xFFFFFFFF]


def _slide(h: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """Extreme of every w neighbours, by doubling."""
    have, m = 1, h
    while have < w:
        step = min(have, w - have)
        m = pick(m[:-step], m[step:]) if step else m
        have += step
    return m


def anchors(c: np.ndarray, starts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least by hash among w neighbours in their text.

    Equal stretches of k + w - 1 code points select the same k-gram wherever they stand, so two texts that share such
    a stretch share an anchor. A text of k to k + w - 2 code points has its least k-gram as only anchor.
    """
    h = hashes(c, k)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    at = np.arange(n)
    valid = at + k <= ends
    lows = np.where(valid, h, _TOP)
    chosen = np.zeros(n, bool)
    if n >= w:
        least = _slide(lows, w, np.minimum)
        least = np.where(at[: len(least)] + k + w - 1 <= ends[: len(least)], least, np.uint64(0))
        most = _slide(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
        chosen = (most[:n] == lows) & valid
    sizes = np.diff(starts)
    short = np.flatnonzero((sizes >= k) & (sizes < k + w - 1))
    if len(short):
        for i, t in enumerate(short.tolist()):
            a, b = int(starts[t]), int(starts[t + 1]) - k + 1
            chosen[a + int(np.argmin(lows[a:b]))] = True
    p = np.flatnonzero(chosen)
    return p, h[p]
