"""Vectorised views of a batch of texts: word bounds, word hashes, window and line repeats.

All texts of a slice lie in one byte buffer, each followed by a line feed, so that bounds and
hashes of every word come from a few array operations. Hashes are polynomial over a table of
random 64-bit values, modulo 2**64, finished by a mixer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=U) | U(1)
_SECOND = _rng.integers(1, 2**64 - 1, 256, dtype=U) | U(1)


def _folded(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[65:91] = table[97:123]
    return out


_FOLDED, _FOLDED_SECOND = _folded(_TABLE), _folded(_SECOND)
_BASE = int(0x9E3779B97F4A7C15 | 5)
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U), "q": np.ones(1, U)}

#: White space of the contracts: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~_SPACE
#: ASCII letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = U(_BASE if kind == "p" else _INVERSE)
        size = max(n, 1 << 20)
        step = np.full(size, base, U)
        step[0] = U(1)
        have = np.multiply.accumulate(step)
        if size <= 1 << 22:
            _powers[kind] = have
    return have[:n]


class Texts:
    """One slice of texts. Word i starts at byte starts[i] and ends before ends[i]; the words of
    document d are first[d] to first[d + 1]."""

    def __init__(self, texts: list[bytes], word: np.ndarray = NOT_SPACE, fold: bool = False):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, self.n)
        self.at = np.concatenate(([0], np.cumsum(self.size + 1)))
        mask = word[self.buf]
        if not len(mask):
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
            self.starts, self.ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        self.mask = mask
        self.first = np.searchsorted(self.starts, self.at)
        self.n_words = np.diff(self.first)
        self._tables = (_FOLDED, _FOLDED_SECOND) if fold else (_TABLE, _SECOND)
        self._sums: list = [None, None]

    def sums(self, family: int = 0) -> np.ndarray:
        if self._sums[family] is None:
            t = self._tables[family][self.buf] * _power("p", len(self.buf))
            self._sums[family] = np.concatenate((np.zeros(1, U), np.cumsum(t, dtype=U)))
        return self._sums[family]

    def spans(self, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
        """A hash of the bytes of each span; two families are independent."""
        s = self.sums(family)
        h = (s[ends] - s[starts]) * _power("q", len(self.buf) + 1)[starts]
        return mix(h + (ends - starts).astype(U))

    def words(self, family: int = 0) -> np.ndarray:
        return self.spans(self.starts, self.ends, family)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums by document of something given for each byte."""
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return c[self.at[1:]] - c[self.at[:-1]]

    def per_words(self, values: np.ndarray) -> np.ndarray:
        """Sums by document of something given for each word."""
        c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return c[self.first[1:]] - c[self.first[:-1]]

    def code_points(self) -> np.ndarray:
        return self.per_doc((self.buf & 0xC0) != 0x80) - 1

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts with their closing line feeds, and where each text starts among
        them (one more for the end)."""
        b = self.buf
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        out = b[lead].astype(np.uint32)
        wide = np.flatnonzero(out >= 0x80)  # few, mostly
        if len(wide):
            at, first = lead[wide], out[wide]
            size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
            point = first & (np.uint32(0x7F) >> size.astype(np.uint32))
            for j in range(1, 4):
                more = size > j
                point[more] = (point[more] << np.uint32(6)) | (b[at[more] + j] & np.uint32(0x3F))
            out[wide] = point
        return out, np.searchsorted(lead, self.at)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of the windows of k words that stay inside a document."""
        m = len(hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        g = hashes[:m].copy()
        for j in range(1, k):
            g *= U(0x9DDFEA08EB382D69)
            g += hashes[j : j + m]
        inside = np.ones(m, bool)
        for j in range(1, k):
            bad = self.first[1:-1] - j
            inside[bad[(bad >= 0) & (bad < m)]] = False
        at = np.flatnonzero(inside)
        return at, mix(g[at] + U(k))

    def doc_of_words(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def repeated_words(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """By document, the words that lie in a window of k words found twice or more in it."""
        at, g = self.windows(hashes, k)
        if not len(at):
            return np.zeros(self.n, np.int64)
        key = mix(g ^ (self.doc_of_words(at).astype(U) * U(0xD6E8FEB86659FD93)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + k + 1, np.int32)
        hit = at[twice]
        cover[hit] += 1
        cover[hit + k] -= 1
        return self.per_words(np.cumsum(cover)[: len(hashes)] > 0)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines split at line feeds, and the number of words of each."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        c = np.searchsorted(self.starts, ends) - np.searchsorted(self.starts, starts)
        return starts, ends, c

    def duplicate_lines(self) -> np.ndarray:
        """By document, the lines with a word that equal an earlier line of it."""
        starts, ends, words = self.lines()
        keep = words > 0
        starts, ends = starts[keep], ends[keep]
        doc = np.searchsorted(self.at, starts, side="right") - 1
        key = mix(self.spans(starts, ends) ^ (doc.astype(U) * U(0xD6E8FEB86659FD93)))
        unique = np.unique(key, return_index=True)[1]
        return np.bincount(doc, minlength=self.n) - np.bincount(doc[unique], minlength=self.n)
