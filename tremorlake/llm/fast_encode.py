"""Token ids of many texts: the tokenizer meets each distinct span of text once.

The tokenizers used here cut a text into spans (words, numbers, white space) and encode
each span by itself, so the ids of a text are the ids of its spans in order. Spans and
their distinct values come from vectorised scans; only distinct spans reach the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

from tremorlake.llm.text_scan import LETTER, LONG_SPAN, Block, cut_long, grouped, spans_with_space, spans_without_space

MEMO_SPANS = 350_000  #: distinct spans a worker remembers before it starts anew
RUN_WORDS = 500  #: plain words that go to the library in one string


def _plain(text: str) -> str:
    return text


def _folded(text: str) -> str:
    """Composed form, lower case of each character by itself."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "σ".join(p.lower() for p in text.split("Σ"))


class SpanEncoder:
    """Encode texts with a tokenizer file of the byte-level (``with_space``) or word kind."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            setup = json.load(f)
        self.with_space = setup["pre_tokenizer"]["type"] == "ByteLevel"
        self.spans = spans_with_space if self.with_space else spans_without_space
        self.prepare = _folded if setup["normalizer"] else _plain
        self.special = {t["content"]: t["id"] for t in setup["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.library = Tokenizer.from_file(file)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.slots = self.used = 0

    def _ask(self, spans: list[str], alone: bool) -> tuple[list[int], list[int]]:
        """(ids, number of ids of each span). Plain words go in runs, which the library cuts apart again."""
        if alone:
            got = [e.ids for e in self.library.encode_batch(spans, add_special_tokens=False)]
            return [i for ids in got for i in ids], list(map(len, got))
        runs = [spans[i:i + RUN_WORDS] for i in range(0, len(spans), RUN_WORDS)]
        ids, sizes = [], []
        for run, e in zip(runs, self.library.encode_batch([("" if self.with_space else " ").join(r) for r in runs], add_special_tokens=False)):
            ids += e.ids
            sizes += np.bincount(e.word_ids, minlength=len(run)).tolist()
        return ids, sizes

    def _store(self, ids: list[int], sizes: list[int]) -> range:
        """Keep the ids of spans; returns their slots."""
        n, size, flat = self.slots, np.array(sizes, np.int64), np.array(ids, np.uint32)
        while len(self.size) < n + len(size):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.size[n:n + len(size)] = size
        self.start[n:n + len(size)] = self.used + np.cumsum(size) - size
        self.flat[self.used:self.used + len(flat)] = flat
        self.slots, self.used = n + len(size), self.used + len(flat)
        return range(n, self.slots)

    def _learn(self, spans: list[str], plain: np.ndarray) -> None:
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]).tolist()
        cut = int(plain.sum())
        a, b = self._ask([spans[i] for i in order[:cut]], False), self._ask([spans[i] for i in order[cut:]], True)
        self.memo.update(zip([spans[i] for i in order], self._store(a[0] + b[0], a[1] + b[1])))

    def _short(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of short spans. What is remembered is looked up by the span's text."""
        found = block.kinds(starts, ends)
        codes, first = found or (np.arange(len(starts)), np.arange(len(starts)))
        a, b = starts[first], ends[first]
        spans = [block.text[i:j] for i, j in zip(a.tolist(), b.tolist())]
        new = [k for k, span in enumerate(spans) if span not in self.memo]
        if found is None:
            new = list({spans[k]: k for k in new}.values())
        if new:
            a = a[new]
            plain = (block.cp[a] == 32) & (block.cls[a + 1] == LETTER) if self.with_space else block.cls[a] == LETTER
            self._learn([spans[k] for k in new], plain)
        return np.fromiter(map(self.memo.__getitem__, spans), np.int64, len(spans))[codes] if spans else codes.astype(np.int64)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        block = Block(texts)
        starts, ends = self.spans(block)
        if len(self.memo) > MEMO_SPANS:
            self._forget()
        long = ends - starts > LONG_SPAN
        slot = np.empty(len(starts), np.int64)
        slot[~long] = self._short(block, starts[~long], ends[~long])
        kept = self.slots, self.used
        if long.any():
            slot[long] = self._store(*self._ask([block.text[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist())], True))
        size = self.size[slot]
        ends_out = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[slot] - (ends_out - size), size) + np.arange(size.sum())]
        self.slots, self.used = kept
        held = np.bincount(block.owner(starts), weights=size, minlength=len(texts)).astype(np.int64)
        return ids, held

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each). A null text has none."""
        pieces, owner, fixed = [], [], []
        for i, text in enumerate(texts):
            for k, part in enumerate(self.split(text or "")):
                for piece in [part] if k % 2 else cut_long(self.prepare(part)):
                    pieces.append("" if k % 2 else piece)
                    owner.append(i)
                    fixed.append(self.special[part] if k % 2 else -1)
        ids, sizes = [], []
        for s in grouped(pieces):
            got, held = self._block(pieces[s])
            ids.append(got)
            sizes.append(held)
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        size = np.concatenate([*sizes, np.zeros(0, np.int64)])
        mark = np.array(fixed, np.int64)
        if (mark >= 0).any():
            flat = np.insert(flat, (np.cumsum(size) - size)[mark >= 0], mark[mark >= 0].astype(np.uint32))
            size = size + (mark >= 0)
        return flat, np.bincount(np.array(owner, np.int64), weights=size, minlength=len(texts)).astype(np.int64)


@lru_cache(4)
def encoder(file: str) -> SpanEncoder:
    """One encoder for a file and Python worker."""
    return SpanEncoder(file)
