"""A compressed full-text index over word sequences: the Burrows-Wheeler
transform in a wavelet matrix, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and a count before each."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int32)
        self.ones = int(flags.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class Wavelet:
    """Rank of a symbol in a sequence, by one bit vector per bit of the symbols."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            one = ((seq >> level) & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(len(seq) - self.bits[-1].ones)
            seq = np.concatenate((seq[~one], seq[one]))
        # Where each symbol's run begins after the last level, so that one end needn't be followed.
        self.start = np.zeros(sigma + 1, np.int64)
        at = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1]))) if len(seq) else np.zeros(0, np.int64)
        self.start[seq[at]] = at

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        i = i.astype(np.int64)
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = ((c >> (self.levels - 1 - level)) & 1).astype(bool)
            r = bits.rank(i).astype(np.int64)
            i = np.where(one, zeros + r, i - r)
        return i - self.start[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, by prefix doubling; its last symbol is unique."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    k = text[sa]
    rank = np.empty(n, np.int64)
    rank[sa] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
    h = 1
    while (rank[sa[1:]] == rank[sa[:-1]]).any():
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1 if h < n else 0
        # Only the groups that aren't yet settled are sorted again.
        r = rank[sa]
        tied = np.zeros(n, bool)
        eq = r[1:] == r[:-1]
        tied[1:] |= eq
        tied[:-1] |= eq
        where = np.flatnonzero(tied)
        sub = sa[where]
        key = (rank[sub].astype(np.uint64) << np.uint64(32)) | nxt[sub].astype(np.uint64)
        o = np.argsort(key, kind="stable")
        sub, key = sub[o], key[o]
        sa[where] = sub
        # A group's rank is the place of its first suffix, so settled ranks never change.
        if h == 1:
            first = np.flatnonzero(np.concatenate(([True], ~eq)))
            rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
            key = (rank[sub].astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(new)
        rank[sub] = np.repeat(where[head], np.diff(np.append(head, len(where))))
        h *= 2
    return sa


class FMIndex:
    """Over distinct sequences: ``words`` one after another, ``size`` words each."""

    def __init__(self, words: np.ndarray, size: np.ndarray, depth: int):
        """words: numbers from 0; depth: the length at which matches are told apart."""
        m, n = len(size), len(words) + len(size)
        ends = np.cumsum(size) + np.arange(m)
        text = np.empty(n, np.int64)
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        text[is_end] = np.arange(m)  # each sequence ends in its own symbol
        text[~is_end] = words + m
        sa = suffix_array(text)
        symbol = np.where(is_end, 0, text - m + 1)  # one symbol for all ends, in the transform
        self.sigma = int(symbol.max()) + 1 if n else 1
        bwt = symbol[sa - 1]  # of suffix 0 it is the last end
        self.bwt = Wavelet(bwt, self.sigma)
        counts = np.bincount(symbol, minlength=self.sigma)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.n, self.depth = n, depth
        # Suffixes that share their first ``depth`` words are neighbours: the first and the last of each group.
        common = np.zeros(n, bool)
        if n > 1:
            live = np.arange(1, n)
            for d in range(depth):
                a, b = sa[live - 1] + d, sa[live] + d
                ok = (a < n) & (b < n)
                ok[ok] = (text[a[ok]] == text[b[ok]]) & ~is_end[a[ok]]
                live = live[ok]
                if not len(live):
                    break
            common[live] = True
        first = np.flatnonzero(~common)
        length = np.diff(np.append(first, n))
        self.group_lo = np.repeat(first, length)
        self.group_hi = self.group_lo + np.repeat(length, length)

    def extend(self, c, lo, hi):
        """The interval of c + w, from that of w, by one backward step; c: symbols from 1."""
        base = self.before[c]
        return base + self.bwt.rank(c, lo), base + self.bwt.rank(c, hi)

    def matches(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For every position of the patterns: how often the ``depth`` words from there occur (0: fewer are left, or never).

        All patterns advance together from their ends.  A match that can't be
        extended is begun again one word before the end of what failed, so
        that no window is missed.  A word below 0 isn't in the index.
        """
        start = np.cumsum(size) - size
        out = np.zeros(len(words), np.int64)
        lane = np.flatnonzero(size >= self.depth)
        lo, hi, length = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64), np.zeros(len(size), np.int64)
        at = start + size - 1  # the next word to take
        while len(lane):
            c = words[at[lane]] + 1
            a, b = self.extend(np.maximum(c, 0), lo[lane], hi[lane])
            b = np.where(c > 0, b, a)
            good = b > a
            g = lane[good]
            ga, gb, gl = a[good], b[good], length[g] + 1
            over = gl > self.depth
            ga, gb = np.where(over, self.group_lo[ga], ga), np.where(over, self.group_hi[ga], gb)
            gl = np.minimum(gl, self.depth)
            full = gl == self.depth
            out[at[g[full]]] = (gb - ga)[full]
            lo[g], hi[g], length[g] = ga, gb, gl
            at[g] -= 1
            bad = lane[~good]
            at[bad] = np.where(length[bad] > 0, at[bad] + length[bad] - 1, at[bad] - 1)
            lo[bad], hi[bad], length[bad] = 0, self.n, 0
            # A lane ends when not even all words to its left would make a window.
            lane = lane[(at[lane] >= start[lane]) & (at[lane] - start[lane] + 1 + length[lane] >= self.depth)]
        return out
