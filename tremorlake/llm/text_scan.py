"""Vectorised scans over blocks of texts: character classes, spans and span hashes.

A block is a handful of texts laid out as one array of code points with a separator
slot after each text, so that one set of numpy calls serves all of them. Blocks hold
about ``BLOCK`` characters, which bounds memory whatever the length of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

BLOCK = 1 << 19
LONG_SPAN = 64  #: characters from which on a span is never told from others by hashes
OTHER, LETTER, NUMBER, SPACE, SEP = 0, 1, 2, 3, 4
# The code points of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
_GAP = re.compile(f"[^{WHITE}][{WHITE}]")
_GAP_BACK = re.compile(f"[{WHITE}][^{WHITE}]")
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{WHITE}]+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start():m.end()]] = cls
    return table


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Block:
    """Texts as one array: ``cp`` code points, ``cls`` classes, ``sep`` the slot after each text."""

    def __init__(self, texts: list[str], lower: bool = False):
        self.text = "\0".join(texts) + "\0"
        self.cp = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        self.sep = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        self.cls = char_classes()[self.cp]
        self.cls[self.sep] = SEP

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Number of the text that holds each position."""
        return np.searchsorted(self.sep, starts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each span, equal for equal spans."""
        n = 1 << int(np.ceil(np.log2(max(len(self.cp), BLOCK, 2))))
        up, down = _powers(n)
        total = np.zeros(len(self.cp) + 1, np.uint64)
        np.cumsum(((self.cp if values is None else values).astype(np.uint64) + np.uint64(1)) * up[: len(self.cp)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
        """Whether each stretch of ``size`` characters from ``a`` on holds the same as that from ``b`` on."""
        order = np.argsort(-size, kind="stable")
        a, b, size = a[order], b[order], size[order]
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k))
            if not np.array_equal(self.cp[a[:n] + k], self.cp[b[:n] + k]):
                return False
        return True

    def kinds(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """``distinct`` of the spans by their characters: hashes tell them apart, a comparison confirms.
        None where hashes of different spans are equal. Meant for short spans."""
        codes, first = distinct(self.hashes(starts, ends))
        head, size = first[codes], ends - starts
        other = np.flatnonzero(head != np.arange(len(head)))
        to = head[other]
        if (size[other] != size[to]).any() or not self.equal(starts[other], starts[to], size[other]):
            return None
        return codes, first


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its value for each row, row where each value comes first)."""
    codes, values = pd.factorize(h)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)) if len(codes) else codes
    return codes, first


def cut_long(text: str, size: int = BLOCK) -> list[str]:
    """Pieces of about ``size`` characters, cut only before white space that follows other text."""
    out, at = [], 0
    while len(text) - at > 2 * size:
        m = _GAP.search(text, at + size)
        if not m:
            break
        out.append(text[at:m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


def first_gap(text: str) -> int:
    """Where white space first follows other text; -1 if nowhere."""
    m = _GAP.search(text)
    return m.start() + 1 if m else -1


def last_gap(text: str) -> int:
    """Where white space last follows other text; -1 if nowhere."""
    m = _GAP_BACK.search(text[::-1])
    return len(text) - m.start() - 1 if m else -1


def grouped(texts: list[str], size: int = BLOCK) -> Iterator[slice]:
    """Slices of consecutive texts that hold about ``size`` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def _contractions(block: Block, start: np.ndarray) -> np.ndarray:
    """Mark 's 't 're 've 'm 'll 'd as spans of their own; True on their apostrophes."""
    cp = block.cp
    marks = np.zeros(len(cp), bool)
    at = np.flatnonzero(cp == 39)
    at = at[start[at]]
    if not len(at):
        return marks
    pad = np.concatenate([cp, [0, 0, 0]])
    one, two = pad[at + 1], pad[at + 2]
    c = lambda x: ord(x)
    short = np.isin(one, [c("s"), c("t"), c("m"), c("d")])
    long = ((one == c("r")) & (two == c("e"))) | ((one == c("v")) & (two == c("e"))) | ((one == c("l")) & (two == c("l")))
    for hit, n in ((at[short], 2), (at[long], 3)):
        start[hit + 1] = False
        start[hit + n] = True
        marks[hit] = True
    return marks


def spans_with_space(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Spans that a leading blank joins: words, numbers, runs of other characters, white space.

    A run of white space before other text gives up its last character, which joins the
    next span if it is a blank and stands alone if not.
    """
    cp, cls = block.cp, block.cls
    prev = np.concatenate([[SEP], cls[:-1]])
    start = cls != prev
    space, follow = cls == SPACE, np.concatenate([cls[1:], [SEP]])
    last = space & (follow != SPACE) & (follow != SEP)
    start |= last
    joined = np.flatnonzero(last & (cp == 32)) + 1
    start[joined] = False
    _contractions(block, start)
    start[block.sep] = True
    return _pairs(block, start)


def spans_without_space(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Words, single numbers and runs of other characters; white space is dropped."""
    cls = block.cls
    start = (cls != np.concatenate([[SEP], cls[:-1]])) | (cls == NUMBER)
    _contractions(block, start)
    start[block.sep] = True
    starts, ends = _pairs(block, start)
    keep = cls[starts] != SPACE
    return starts[keep], ends[keep]


def words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Runs of anything but white space."""
    full = ((block.cls != SPACE) & (block.cls != SEP)).astype(np.int8)
    edge = np.diff(np.concatenate([[0], full, [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pairs(block: Block, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(block.cp))
    keep = block.cls[starts] != SEP
    return starts[keep], ends[keep]


@lru_cache(1)
def lower_points() -> np.ndarray:
    """Lower case of every code point, by itself (the first character where there are several)."""
    table = np.arange(0x110000, dtype=np.uint32)
    every = "".join(map(chr, range(0xD800)))
    table[:0xD800] = np.fromiter((ord(c.lower()[0]) for c in every), np.uint32, 0xD800)
    return table
