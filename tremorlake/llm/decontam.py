"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edits.

Texts and items are sequences of words (letters and digits, lower case). A window that
holds an item within its edit limit keeps most of the item's word pairs, so windows with
too few known pairs are passed over without loss. What is left is embedded by CGK random
walks: a walk repeats or advances its symbol by a random bit of (symbol, step), so that few
edits become few differing steps. A repeat samples SAMPLES steps of its walk; a window and
an item that agree there are compared by exact edit distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches, stored
from tremorlake.llm.text_scan import LETTER, NUMBER, Block, cut_long, grouped, lower_points

SIMILARITY = 0.8  #: 1 - edits / words of the item
REPEATS, SAMPLES, SEED = 32, 2, 5
BLOCK_ITEMS = 20_000  #: items that travel to the workers at once; more are searched in further passes
OVERLAP = 4096  #: words of a long text that two neighbouring pieces share at least, or twice the longest item
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of runs of letters and digits, case folded."""
    full = ((block.cls == LETTER) | (block.cls == NUMBER)).astype(np.int8)
    edge = np.diff(np.concatenate([[0], full, [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, block.hashes(starts, ends, lower_points()[block.cp])


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return (h[:-1] * _MIX) ^ (h[1:] * np.uint64(0x9E3779B185EBCA87))


def limit(m: int) -> int:
    """Edits that an item of ``m`` words may have."""
    return int(m * (1 - SIMILARITY) + 1e-9)


def horizon(m: int) -> int:
    """Steps of the walk from which samples are drawn: most of an item of ``m`` words."""
    return max(1, 3 * (1 << (m.bit_length() - 1)) // 2)


def walk(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """The CGK walk of each window as (steps, windows) symbols; 0 behind a window's end."""
    at, out = starts.copy(), np.zeros((steps, len(starts)), np.uint64)
    for step in range(steps):
        inside = at < ends
        symbol = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))
        out[step] = symbol
        salt = np.uint64((repeat * 1_000_003 + step * 7919 + SEED) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        bit = ((symbol ^ salt) * _MIX) >> np.uint64(63)
        at = at + (inside & (bit == 1))
    return out


def samples(repeat: int, steps: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, repeat, steps])
    return np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False))


def sampled(path: np.ndarray, repeat: int, steps: int) -> np.ndarray:
    key = np.full(path.shape[1], (repeat << 16) + steps, np.uint64)
    for s in samples(repeat, steps):
        key = (key ^ path[s]) * _MIX
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Items:
    """Benchmark items as one array of word hashes, with their pair filter and LSH keys."""

    ids: list
    h: np.ndarray
    first: np.ndarray
    size: np.ndarray
    pairs: np.ndarray
    marks: np.ndarray  # low bits of the known pairs, to pass over most others at once
    keys: np.ndarray
    key_items: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple]) -> Items:
        ids, hashes = [], []
        for item, text in rows:
            block = Block([text or ""])
            h = word_hashes(block)[2]
            if len(h):
                ids.append(item)
                hashes.append(h)
        size = np.fromiter(map(len, hashes), np.int64, len(hashes))
        first = np.cumsum(size) - size
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        # A pair is known as a pair of some item; an item of one word is known by the word.
        pairs = np.unique(np.concatenate([*[pair_hashes(x) if len(x) > 1 else x for x in hashes], np.zeros(0, np.uint64)]))
        marks = np.zeros(1 << 20, bool)
        marks[pairs & np.uint64(len(marks) - 1)] = True
        keys, owners = [], []
        for steps in sorted({horizon(int(m)) for m in size}):
            mine = np.array([i for i, m in enumerate(size) if horizon(int(m)) == steps])
            for r in range(REPEATS):
                keys.append(sampled(walk(h, first[mine], (first + size)[mine], steps, r), r, steps))
                owners.append(mine)
        key, owner = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        return cls(ids, h, first, size, pairs, marks, key[order], owner[order].astype(np.int64))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are pairs (or single words) of some item."""
        out = self.marks[hashes & np.uint64(len(self.marks) - 1)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.pairs, hashes[maybe]), len(self.pairs) - 1)
        out[maybe] = self.pairs[at] == hashes[maybe]
        return out

    def words(self, i: int) -> list[int]:
        return self.h[self.first[i]:self.first[i] + self.size[i]].tolist()


def _ends(pattern: list[int], text: list[int]) -> list[int]:
    """Least edits between the whole pattern and a part of the text that ends after each word (bit-parallel)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | (1 << i)
    up, down, score, out = full, 0, m, []
    for w in text:
        eq = where.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(d | up)), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        out.append(score)
    return out


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the part of ``text`` nearest to ``pattern``; the earliest of equals."""
    ends = _ends(pattern, text)
    edits = min([len(pattern), *ends])
    if edits == len(pattern):
        return edits, 0, 0
    end = ends.index(edits) + 1
    back = _ends(pattern[::-1], text[:end][::-1])
    return edits, end - back.index(edits) - 1, end


def candidate_starts(items: Items, h: np.ndarray, last: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Window starts that may begin an item: a superset of all true ones.

    ``begin`` and ``last`` bound the text of each word. With at most k edits an item of m words
    keeps m - 1 - 2k pairs inside m + k words, and its first kept pair lies at most 3k words in.
    """
    known = np.zeros(len(h), bool)
    if len(h) > 1:
        known[:-1] = items.known(pair_hashes(h)) & (last[:-1] > np.arange(1, len(h)))
    if (items.size == 1).any():
        known |= items.known(h)
    at = np.flatnonzero(known)
    if not len(at):
        return at
    reach = np.full(len(at), -1, np.int64)
    for m in np.unique(items.size).tolist():
        k = limit(m)
        need = max(1, m - 1 - 2 * k)
        seen = np.searchsorted(at, np.minimum(at + m + k, last[at])) - np.arange(len(at))
        reach = np.where(seen >= need, np.maximum(reach, 3 * k), reach)
    at, reach = at[reach >= 0], reach[reach >= 0]
    low = np.maximum(at - reach, begin[at])
    spread = np.zeros(len(h) + 1, np.int64)
    np.add.at(spread, low, 1)
    np.add.at(spread, at + 1, -1)
    return np.flatnonzero(np.cumsum(spread[:-1]) > 0)


def search_block(items: Items, h: np.ndarray, begin: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, first word, word behind the last, edits) of each place where an item is found."""
    starts = candidate_starts(items, h, last, begin)
    if not len(starts):
        return []
    found_start, found_item = [], []
    classes = sorted({horizon(int(m)) for m in items.size})
    longest = int(items.size.max())
    for r in range(REPEATS):
        path = walk(h, starts, np.minimum(starts + longest, last[starts]), classes[-1], r)
        for steps in classes:
            key = sampled(path, r, steps)
            a, b = np.searchsorted(items.keys, key, side="left"), np.searchsorted(items.keys, key, side="right")
            hit = np.flatnonzero(b > a)
            n = (b - a)[hit]
            found_start.append(np.repeat(starts[hit], n))
            found_item.append(items.key_items[np.repeat(a[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    pairs = np.unique(np.stack([np.concatenate(found_item), np.concatenate(found_start)], axis=1), axis=0)
    out, open_item, low, high = [], -1, 0, 0

    def settle() -> None:
        stretches = [(low, high)] if open_item >= 0 else []
        while stretches:  # the best find, then what lies left and right of it
            left, right = stretches.pop()
            words, text = items.words(open_item), h[left:right].tolist()
            if len(words) - sum(map(set(text).__contains__, words)) > limit(len(words)):
                continue  # each word that is missing costs an edit
            edits, a, b = best_match(words, text)
            if edits <= limit(int(items.size[open_item])):
                out.append((open_item, left + a, left + b, edits))
                stretches += [(left, left + a), (left + b, right)]

    for item, s in pairs.tolist():
        m = int(items.size[item])
        k = limit(m)
        a, b = max(s - k, int(begin[s])), min(s + m + k, int(last[s]))
        if item == open_item and a <= high and begin[s] == begin[low]:
            high = max(high, b)
        else:
            settle()
            open_item, low, high = item, a, b
    settle()
    return out


def _pieces(text: str, items: Items) -> list[tuple[int, str]]:
    """(offset, piece) of a text; pieces of a long text overlap by more than the longest item can reach."""
    parts = cut_long(text)
    out, at = [], 0
    for i, p in enumerate(parts):
        more = parts[i + 1] if i + 1 < len(parts) else ""
        lap = more[: 64 * max(OVERLAP, 2 * int(items.size.max()))] if more else ""
        out.append((at, p + lap))
        at += len(p)
    return out


def find_all(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every find, in that order; finds in overlaps count once."""
    rows = [(i, at, p) for i, t in enumerate(texts) for at, p in (_pieces(t, items) if t else [])]
    got: dict[tuple, tuple] = {}
    for s in grouped([p for _, _, p in rows]):
        part = rows[s]
        block = Block([p for _, _, p in part])
        starts, ends, h = word_hashes(block)
        if not len(h):
            continue
        owner = block.owner(starts)
        edge = np.searchsorted(owner, np.arange(len(part) + 1))
        base = block.sep - np.diff(block.sep, prepend=-1) + 1
        for item, a, b, edits in search_block(items, h, edge[owner], edge[owner + 1]):
            row, offset, _ = part[owner[a]]
            shift = offset - int(base[owner[a]])
            got[row, item, int(starts[a]) + shift] = (int(ends[b - 1]) + shift, edits)
    return [(*k, *got[k]) for k in sorted(got)]


def item_blocks(benchmark: DataFrame) -> list[Items]:
    """The benchmark as blocks of about BLOCK_ITEMS items, each small enough to travel to the workers."""
    items = stored(benchmark.select("item_id", "text").where("text is not null"), "items")
    passes = max(1, -(-items.count() // BLOCK_ITEMS))
    blocks = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text")
        blocks.append(Items.build([(r[0], r[1]) for r in part.collect()]))  # one block: a bounded number of items
    return [b for b in blocks if b.ids]


def hits(docs: DataFrame, benchmark: DataFrame, keep: str = "doc_id") -> DataFrame:
    """(keep, item_id, start, end, edits, similarity): places in whole texts within the edit limit of an item.

    ``start`` and ``end`` are characters. A text with an item at several places gives a row for
    each; overlapping finds of one item give the best. Null texts and items without a word
    match nothing; repeated rows each give their rows.
    """
    kind, item_kind = dict(docs.dtypes)[keep], dict(benchmark.dtypes)["item_id"]
    schema = f"`{keep}` {kind}, item_id {item_kind}, start bigint, end bigint, edits int, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        def run(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch | None:
            rows = find_all(items, batch.column("_text").to_pylist())
            if not rows:
                return None
            return pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array([r[0] for r in rows])), pa.array([items.ids[r[1]] for r in rows]), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int32()), pa.array([1 - r[4] / int(items.size[r[1]]) for r in rows], pa.float64())],
                names=[keep, "item_id", "start", "end", "edits", "similarity"])

        found = found.unionByName(map_batches(docs.select(F.col(keep).alias("_key"), F.col("text").alias("_text")), run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any find, with all their columns; documents with a null text stay."""
    out = docs
    for items in item_blocks(benchmark):
        def run(batch: pa.RecordBatch, items: Items = items, at: int = docs.columns.index("text")) -> pa.RecordBatch:
            hit = {r[0] for r in find_all(items, batch.column(at).to_pylist())}
            return batch.filter(pa.array([i not in hit for i in range(batch.num_rows)]))

        out = map_batches(out, run, out.schema)
    return out
