"""Runs of repeated words: maximal stretches that keep a period.

Every run holds a Lyndon word of its period's length that is the longest Lyndon word at
its place, in one of the two orders of the alphabet (an order and its reverse). The first
phase of suffix sorting by groups finds these words directly: it orders the positions by
the longest Lyndon word that begins at each, from the greatest down, and a group that is
done extends the nearest lower position before each of its members. It runs once under
each order, in linear time. A root is then extended to both sides by its longest common
extension with the place one period on, read off names of stretches of 2^k words.

Before that, words that no wanted run can hold are left out: inside a run of at least
24 words and three periods, every word lies in a stretch of 16 words that the text holds
twice. The filter only compares hashes, so it can let words in but never
leave one out; everything after it compares words exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches
from tremorlake.llm.text_scan import grouped

WORD = re.compile("[^\x20\x09-\x0D]+")
SHORTEST, TIMES = 24, 3  #: a run holds at least so many words and so many periods
BLOCK_CHARS = 1 << 21  #: characters whose words are sorted together


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


def covered(words: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """Whether each word lies in a stretch that occurs again; true of all words of all runs.

    Take a run of period q and length n >= max(shortest, times * q). A stretch of s words
    beginning at its word k recurs q words on if k <= n - q - s, and q words back if k >= q.
    The first kind covers the words before n - q, the second those from q on. Neither kind
    is empty if s <= shortest * (times - 1) / times, and as n - q >= q they leave no word out.
    """
    seed = 1 << max((shortest * (times - 1) // times).bit_length() - 1, 0)
    n = len(words) - seed + 1
    hit = np.zeros(len(words) + 1, np.int64)
    if n > 1:
        h = words.astype(np.uint64)
        width = 1
        while width < seed:  # hashes of 2, 4, 8, .. words
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> np.uint64(31)))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            width *= 2
        codes, values = pd.factorize(h)
        again = np.flatnonzero(np.bincount(codes, minlength=len(values))[codes] > 1)
        np.add.at(hit, again, 1)
        np.add.at(hit, again + seed, -1)
    return np.cumsum(hit)[:-1] > 0


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word beginning at each position (numbers 0 and up, end lowest).

    Positions lie in groups, ordered by the word they are known to begin with. Groups are
    taken from the greatest down. For each member the nearest position before it in a lower
    group is found; that position's word goes on with the member's word, as often as
    members point to it. So it leaves its group for a new one right behind it, one for each
    number of repeats, more of them higher.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    head = np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]]) if n else np.zeros(0, bool)
    first = np.flatnonzero(head)
    begin = first[np.cumsum(head) - 1] if n else first
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = begin
    sizes = np.zeros(n, np.int64)
    sizes[first] = np.diff(np.append(first, n))
    at, place, group, size = order.tolist(), place.tolist(), group.tolist(), sizes.tolist()
    length, before = [1] * n, [-1] * n
    end = n
    while end:
        low = group[at[end - 1]]
        members = at[low:end]
        end = low
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        step = length[members[0]]
        if len(times) == 1 or min(times.values()) == max(times.values()):
            rounds = [(next(iter(times.values())), list(times))]
        else:
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            rounds = sorted(by_times.items(), reverse=True)
        for k, moved in rounds:
            longer = k * step
            for p in moved:
                length[p] += longer
                g = group[p]
                left = size[g] - 1
                size[g] = left
                last, mine = g + left, place[p]
                other = at[last]
                at[last], at[mine] = p, other
                place[p], place[other] = last, mine
            fresh: dict[int, int] = {}
            for p in moved:
                g = group[p]
                begin_new = fresh.get(g)
                if begin_new is None:
                    begin_new = fresh[g] = g + size[g]
                group[p] = begin_new
                size[begin_new] += 1
    return np.array(length, np.int64)


class Extensions:
    """Longest common extensions of two positions, from names of stretches of 2^k words."""

    def __init__(self, words: np.ndarray):
        """``words`` are numbers from 0 on; no two separators between texts are equal."""
        self.n = len(words)
        self.names = [words]
        while len(self.names[-1]) > 1 << (len(self.names) - 1):
            last, half = self.names[-1].astype(np.int64), 1 << (len(self.names) - 1)
            codes, values = pd.factorize(last[:-half] * (last.max() + 1) + last[half:])
            if len(values) == len(codes):  # no longer stretch occurs twice
                break
            self.names.append(codes.astype(np.int32))

    def _same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names = self.names[k]
        ok = (a >= 0) & (b < len(names))
        return ok & (names[np.where(ok, a, 0)] == names[np.where(ok, b, 0)])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a and b > a on."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            while True:  # the longest names may apply more than once
                step = self._same(k, a, b).astype(np.int64) << k
                a, b, total = a + step, b + step, total + step
                if k < len(self.names) - 1 or not step.any():
                    break
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words up to and with a - 1 and b - 1."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            while True:
                step = self._same(k, a - (1 << k), b - (1 << k)).astype(np.int64) << k
                a, b, total = a - step, b - step, total + step
                if k < len(self.names) - 1 or not step.any():
                    break
        return total


def runs(words: np.ndarray, separator: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``shortest`` words and ``times`` periods, sorted.

    ``words`` are numbers from 0 on; where ``separator`` is set a stretch ends, and the
    numbers there are all different from each other and from any word.
    """
    n = len(words)
    if n < shortest:
        return np.zeros((0, 3), np.int64)
    top = int(words.max()) + 1
    ext, found = Extensions(words), []
    for ranks in (words + 1, top - words):
        period = lyndon_lengths(np.where(separator, 0, ranks).astype(np.int64))
        i = np.arange(n)
        keep = ~separator & (i + period < n)
        i, period = i[keep], period[keep]
        keep = words[i] == words[i + period]
        i, period = i[keep], period[keep]
        if not len(i):
            continue
        start = i - ext.backward(i, i + period)
        length = i + period + ext.forward(i, i + period) - start
        keep = length >= np.maximum(shortest, times * period)
        found.append(np.stack([start[keep], length[keep], period[keep]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def runs_of_texts(words: list[list[str]], shortest: int = SHORTEST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each text, by start and then period."""
    out: list[list[Run]] = [[] for _ in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    table: dict[str, int] = defaultdict(count().__next__)
    flat = np.fromiter(map(table.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    parts, texts, origins, held, marks = [], [], [], 0, len(table)
    for t, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        if b - a < shortest:
            continue
        inside = np.diff(np.concatenate([[0], covered(flat[a:b], shortest, times).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist()):
            if e - s >= shortest:
                parts += [flat[a + s:a + e], np.array([marks])]
                origins.append((held, t, s))
                held, marks = held + e - s + 1, marks + 1
    if not parts:
        return out
    joined = np.concatenate(parts)
    codes, _ = pd.factorize(joined)  # small numbers
    first = np.array([o[0] for o in origins])
    for start, length, period in runs(codes.astype(np.int64), joined >= len(table), shortest, times).tolist():
        at, t, s = origins[int(np.searchsorted(first, start, side="right")) - 1]
        out[t].append(Run(start - at + s, length, period))
    return [sorted(r, key=lambda x: (x.start, x.period)) for r in out]


def collapsed(words: list[str], found: list[Run]) -> list[str]:
    """The words that no run repeats: of each run only the first period stays."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for r in found:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def most_repeated(found: list[Run]) -> Run | None:
    """The run of greatest length / period; of equals the first, then that of least period."""
    best = None
    for r in found:
        if best is None or (r.length * best.period, -r.start, -r.period) > (best.length * r.period, -best.start, -best.period):
            best = r
    return best


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def find_runs(docs: DataFrame, text: str = "text", keep: str = "doc_id", shortest: int = SHORTEST, times: int = TIMES, texts: bool = True) -> DataFrame:
    """(keep, runs, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed) of every row.

    ``runs`` lists (start, length, period) of each run by start, then period; the four
    numbers describe the one with the most periods and are null where there is none.
    ``collapsed`` is the text with one period of each run, its words joined by a blank (left
    out where ``texts`` is false). A null or empty text, or one without words, has no runs
    and collapses to the empty text. Repeated rows are rows of their own; an empty table gives an
    empty result; other columns, whatever their names, play no part. A text is read whole
    by one task, in memory in proportion to its length.
    """
    kind = dict(docs.dtypes)[keep]

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lists, whole = [], [], []
        given = [t or "" for t in batch.column("_text").to_pylist()]
        for part in grouped(given, BLOCK_CHARS):
            words = [WORD.findall(t) for t in given[part]]
            for w, found in zip(words, runs_of_texts(words, shortest, times)):
                best = most_repeated(found)
                left = " ".join(collapsed(w, found))
                whole.append(left)
                lists.append([(r.start, r.length, r.period) for r in found])
                rows.append((len(found), *((best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4),
                             _sha("".join(f"{r.start},{r.length},{r.period}\n" for r in found)), _sha(left)))
        columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows))]
        struct = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in lists], struct)
        extra = [pa.array(whole, pa.string())] if texts else []
        names = [keep, "runs", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["collapsed"] if texts else [])]
        return pa.RecordBatch.from_arrays([batch.column("_key"), listed, *columns, *extra], names=names)

    schema = (f"`{keep}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, n_runs bigint, start bigint, length bigint, period bigint, "
              f"exponent_milli bigint, runs_sha256 string, collapsed_sha256 string" + (", collapsed string" if texts else ""))
    return map_batches(docs.select(F.col(keep).alias("_key"), F.col(text).cast("string").alias("_text")), scan, schema)
