"""Levenshtein distances."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np


def trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Without the common prefix, found by bisection, then without the common suffix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[-mid:] == b[-mid:] else (low, mid - 1)
    return (a[:-low], b[:-low]) if low else (a, b)


#: Columns between two looks at the diagonal.
LOOK = 32
#: Words that an alignment looks ahead for the next equal one.
REACH = 4


def distance(a: Sequence, b: Sequence, most: int) -> int:
    """Levenshtein distance of two sequences, or some number above ``most`` if it is larger; bit-parallel over the whole of ``a``.

    Values never fall along a diagonal, so the distance is at least the value where the diagonal of
    the last cell has been reached; unlike sequences are given up early.
    """
    a, b = trimmed(a, b)
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    plus, minus, get = full, 0, where.get  # the bits of the steps down a column by +1 and by -1
    for start in range(0, len(b), LOOK):
        for c in b[start : start + LOOK]:
            eq = get(c, 0)
            x = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ((x | plus) ^ full), plus & x
            eq |= minus
            up, down = (up << 1 | 1) & full, (down << 1) & full
            plus, minus = down | ((eq | up) ^ full), up & eq
        done = min(start + LOOK, len(b))
        seen = (1 << max(done + len(a) - len(b), 0)) - 1
        if seen and done + (plus & seen).bit_count() - (minus & seen).bit_count() > most:
            return most + 1
    return len(b) + plus.bit_count() - minus.bit_count()


def aligned(a: str, b: str, most: int) -> bool:
    """Whether a greedy alignment of the words shows that the distance is at most ``most``; if not, nothing is known.

    Words that differ up to the next equal ones are replaced as a whole, which costs the longer side's characters.
    """
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y) and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p = q = 1
        for far in range(1, REACH + 1):
            if i + far < len(x) and x[i + far] in (near := y[j : j + far + 1]):
                p, q = far, near.index(x[i + far])
                break
            if j + far < len(y) and y[j + far] in (near := x[i : i + far]):
                p, q = near.index(y[j + far]), far
                break
        # with a space behind every word; if both sides have some, the last one stays
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q) - (p > 0 and q > 0)
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j <= most


#: Characters fall into so many symbols: letters and digits of ASCII and the space by themselves, all others by their remainder; the last one fills texts up.
SYMBOLS, PLAIN = 64, 37
#: Pairs whose distances are computed together have so many characters at most, and are so many at least; longer texts go by themselves.
TOGETHER_CHARS, ABREAST, LONGEST = 1 << 19, 20, 8192
_SYMBOL = np.array([ord(c) - 97 if "a" <= c <= "z" else 26 + int(c) if c in "0123456789" else 36 if c == " " else PLAIN + ord(c) % (SYMBOLS - 1 - PLAIN) for c in map(chr, range(128))], np.int64)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and of each its text and its place there."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), size)
    return np.where(codes < 128, _SYMBOL[np.minimum(codes, 127)], PLAIN + codes.astype(np.int64) % (SYMBOLS - 1 - PLAIN)), text, np.arange(len(codes)) - (np.cumsum(size) - size)[text]


#: Three symbols that follow each other fall into so many bins; pairs of which the bins are held at a time.
BINS, HELD = 2048, 1024


def _bins(texts: list[str]) -> np.ndarray:
    """How often each text has threes of symbols of each bin."""
    out, size = np.empty((len(texts), BINS), np.int16), np.cumsum([0, *map(len, texts)])
    start = 0
    while start < len(texts):
        end = max(int(np.searchsorted(size, size[start] + (1 << 16), side="right")) - 1, start + 1)
        symbol, text, _ = _symbols(texts[start:end])
        three = (symbol[2:] * 4099 + symbol[1:-1] * 641 + symbol[:-2] * 67) % BINS + text[2:] * BINS
        counts = np.bincount(three[text[2:] == text[:-2]], minlength=(end - start) * BINS)
        out[start:end] = np.minimum(counts, 32767).reshape(-1, BINS)
        start = end
    return out


def least_distances(a: list[str], b: list[str]) -> np.ndarray:
    """A third of the threes of symbols that one text of a pair has and the other has not, each text in turn: an edit makes and breaks at most three."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), HELD):
        mine = slice(at, at + HELD)
        number: dict = {}
        x, y = (np.array([number.setdefault(t, len(number)) for t in texts[mine]]) for texts in (a, b))
        bins = _bins(list(number))
        for k in range(0, len(x), 64):
            more = bins[x[k : k + 64]] - bins[y[k : k + 64]]
            over = np.maximum(more, 0).sum(1, dtype=np.int64)
            out[at + k : at + k + len(more)] = (np.maximum(over, over - more.sum(1, dtype=np.int64)) + 2) // 3
    return out


def symbol_distances(a: Sequence[str], b: Sequence[str], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of the symbols of pairs of texts that are not empty, many at a time: never above those of the texts.

    With ``most``, of each pair what it may be: larger distances come as some number above it. The
    bit-parallel steps of :func:`distance` in words of 64 bits. A word is a column behind the word
    above it, so all words of all pairs take a step together; those that no path of ``most`` edits
    reaches are left out (a path that leaves the diagonals between the first and the last cell
    must come back), and the row above the first one is taken to rise by one a column, which is a
    path too. Both texts of a pair are filled up alike, to one length of the longer ones. Pairs
    are best given by rising size.
    """
    pairs, one = len(a), np.uint64(1)
    a, b = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True)
    m, n = (np.fromiter(map(len, x), np.int64, pairs) for x in (a, b))
    most = n if most is None else np.asarray(most, np.int64)
    out, lanes, apart, columns = most + 1, np.arange(pairs), n - m, int(n.max())
    words = (columns + 63) // 64
    where = np.zeros((words, pairs, SYMBOLS), np.uint64)
    symbol, text, place = _symbols(list(a))
    np.bitwise_or.at(where.ravel(), ((place // 64) * pairs + text) * SYMBOLS + symbol, one << (place % 64).astype(np.uint64))
    for k in range(words):  # rows from m on
        fill = np.clip(m - 64 * k, 0, 64)
        where[k, :, SYMBOLS - 1] = np.where(fill < 64, ~np.uint64(0) << np.minimum(fill, 63).astype(np.uint64), np.uint64(0))
    symbol, text, place = _symbols(list(b))
    column = np.full((columns, pairs), SYMBOLS - 1, np.int64)
    column[place, text] = symbol
    column += np.arange(pairs) * SYMBOLS
    where, row = where.ravel(), np.arange(words)[:, None] * (pairs * SYMBOLS)
    plus, minus = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    ups, downs = np.ones((words + 1, pairs), np.uint64), np.zeros((words + 1, pairs), np.uint64)  # into each word

    def reach() -> tuple[int, int]:
        """Rows above and below the column's number that are reached."""
        back = np.maximum(most - apart, 0) // 2
        return int((apart + back).max()), int(back.max())

    def risen(word: np.ndarray | int) -> np.ndarray:
        return np.bitwise_count(plus[word]).astype(np.int64) - np.bitwise_count(minus[word])

    def down_to(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The steps down the first rows (1 to 64) of a word of each lane."""
        mask, k = ~np.uint64(0) >> (64 - rows).astype(np.uint64), np.arange(len(w))
        return np.bitwise_count(plus[w, k] & mask).astype(np.int64) - np.bitwise_count(minus[w, k] & mask)

    (above, below), words_of = reach(), np.arange(words)[:, None]
    for s in range(columns + words - 1):
        low, high = max(-((63 + above - s) // 65), s - columns + 1, 0), min((s + below) // 65, words - 1, s)
        here, after = slice(low, high + 1), slice(low + 1, high + 2)
        eq = where.take(column[s - high : s - low + 1][::-1] + row[here])
        p, q, down_in = plus[here], minus[here], downs[here]
        rise = eq | q
        eq |= down_in
        x = eq & p
        x += p
        x ^= p
        x |= eq
        up, down = q | ~(x | p), p & x
        up_out, down_out = up >> np.uint64(63), down >> np.uint64(63)
        up <<= one
        up |= ups[here]
        down <<= one
        down |= down_in
        plus[here], minus[here] = down | ~(rise | up), up & rise
        ups[after], downs[after] = up_out, down_out
        ups[low], downs[low] = 1, 0
        if s % LOOK or s < 2 * LOOK or s >= columns - 1:
            continue
        # the value on the diagonal of the last cell never falls; a word is at column s + 1 - its number
        at, k = s - apart, np.arange(len(lanes))
        w = np.clip(at // 65, low, high)
        steps = risen(here) - (ups[after].astype(np.int64) - downs[after].astype(np.int64))
        tops = np.concatenate([np.zeros((1, len(lanes)), np.int64), np.cumsum(steps, axis=0)])[w - low, k] + risen(slice(0, low)).sum(0) + s - low + 1
        seen = (at // 65 == w) & (at % 65 < 64)
        keep = np.flatnonzero(~seen | (tops + down_to(w, np.clip(at % 65 + 1, 1, 64)) <= most))
        if len(keep) == 0:
            return out
        if len(keep) <= 0.8 * len(lanes):
            lanes, apart, most, column = lanes[keep], apart[keep], most[keep], column[:, keep]
            plus, minus, ups, downs = plus[:, keep], minus[:, keep], ups[:, keep], downs[:, keep]
    end = columns - apart  # the row of the last cell
    total = columns + np.where(64 * words_of + 64 <= end, risen(slice(0, words)), 0).sum(0)
    total += np.where(end % 64 > 0, down_to(np.minimum(end // 64, words - 1), np.maximum(end % 64, 1)), 0)
    out[lanes] = np.minimum(total, most + 1)
    return out


#: What is not a symbol by itself.
_SHARED = re.compile("[^a-z0-9 ]")


def within(a: list[str], b: list[str], share: float) -> list[bool]:
    """Whether the distance of each two texts is at most ``share`` of the longer one's length.

    Most unlike texts are refused by a lower bound. Of the others those that seem near are aligned;
    what that does not accept is compared by symbols, many pairs at a time, and by characters if
    they may share symbols.
    """
    most = [int(share * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    out, asked = [False] * len(most), []
    fit = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if abs(len(x) - len(y)) <= most[k]]
    for k, least in zip(fit, least_distances([a[k] for k in fit], [b[k] for k in fit]).tolist(), strict=True):
        if least > most[k]:
            continue
        x, y = trimmed(a[k], b[k]) if len(a[k]) <= len(b[k]) else trimmed(b[k], a[k])
        if len(y) <= most[k] or 2 * least <= most[k] and aligned(x, y, most[k]):  # more edits than the longer one has are never needed
            out[k] = True
        elif x:
            asked.append((k, x, y, most[k]))
    bounded = sorted((p for p in asked if len(p[2]) <= LONGEST), key=lambda p: len(p[2]))
    left = [p for p in asked if len(p[2]) > LONGEST]
    while bounded:
        many = TOGETHER_CHARS // len(bounded[-1][2])  # the last one is the longest
        some = bounded[-many:]
        del bounded[-many:]
        if len(some) < ABREAST:
            left += some
            continue
        _, x, y, least = zip(*some, strict=True)
        for p, d in zip(some, symbol_distances(x, y, least).tolist(), strict=True):
            if d <= p[3]:
                out[p[0]] = not _SHARED.search(p[1]) and not _SHARED.search(p[2])
                left += [] if out[p[0]] else [p]
    for k, x, y, most_of in left:
        out[k] = distance(x, y, most_of) <= most_of
    return out
