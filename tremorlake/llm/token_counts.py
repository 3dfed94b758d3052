"""Token counts without tokens: byte-pair merging compiled to a deterministic transducer.

The transducer reads the bytes of a span (a word with its leading blank, say). Its state
holds what later bytes can still depend on: the last token at each recent position, as far
back as the longest suffix that begins some token. A transition is annotated with the
change of the token count it causes. States and transitions are compiled when first
reached and are remembered up to a bound.

Texts are read in chunks. A chunk is summarised by its state map: the part before its first
safe cut (whose reading depends on the state on entry), the tokens between its cuts, and
the part behind its last cut. Maps compose associatively, so a long text is a scan over its
chunks' maps, wherever those were made. A cut is safe before white space that follows other
text: no span and no special token reaches across it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import small_batches, stored, tidy, tokenizer_file
from tremorlake.llm.text_scan import LONG_SPAN, Block, cut_long, first_gap, grouped, last_gap, spans_with_space

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
CHUNK = 1 << 18  #: characters of a chunk
MEMO_SPANS, MOST_STATES = 500_000, 300_000  #: what a worker remembers before it starts anew
START = -1


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, all other bytes follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of byte strings; ``merges`` are pairs of byte strings by priority."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        # Tokens that no text yields (their own merging ends elsewhere) never appear.
        self.tokens = {t for t in tokens if len(t) == 1 or self.merge(t) == [t]}
        self.heads = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.step: dict[int, int] = {}  # state << 8 | byte -> next state << 16 | change of the count + 32768
        self.pairs: dict[tuple, tuple] = {}  # one object for equal (token, count)
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self._intern((b"", ((None, 0),)))

    def _intern(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def merge(self, data: bytes) -> list[bytes]:
        """Merging by the rules themselves: the pair of least rank first, leftmost of equals."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _together(self, a: bytes, b: bytes) -> bool:
        """Whether tokens ``a`` and ``b`` may stand side by side."""
        if (a, b) not in self.fits:
            if len(self.fits) > 4 * MOST_STATES:
                self.fits.clear()
            self.fits[a, b] = self.merge(a + b) == [a, b]
        return self.fits[a, b]

    def _compile(self, state: int, byte: int) -> int:
        """The transition from ``state`` on ``byte``: next state and change of the count, packed.

        A state is (recent bytes w, (last token, count) at each of the positions before,
        inside and behind w), counts taken relative to the newest. A token that ends a
        reading is right if it fits the last token where it begins, and just one does.
        """
        w, past = self.states[state]
        w = w + bytes([byte])
        for n in range(len(w), 0, -1):
            token = w[-n:]
            if token in self.tokens:
                before, count = past[len(w) - n]
                if before is None or self._together(before, token):
                    break
        else:
            raise AssertionError("a single byte is always a token")
        change = count + 1
        keep = len(w)
        while keep and w[-keep:] not in self.heads:
            keep -= 1
        past = [*((t, c - change) for t, c in past), (token, 0)][len(past) - keep:]
        state = self._intern((w[len(w) - keep:], tuple(self.pairs.setdefault(p, p) for p in past)))
        return state << 16 | (change + 32768)

    def count(self, data: bytes) -> int:
        """Number of tokens of a span."""
        if len(self.states) > MOST_STATES:
            self._forget()
        step, state, total = self.step, 0, 0
        for byte in data:
            key = state << 8 | byte
            to = step.get(key)
            if to is None:
                to = step[key] = self._compile(state, byte)
            state = to >> 16
            total += (to & 65535) - 32768
        return total


@dataclass
class StateMap:
    """Of a chunk: text before the first safe cut, tokens between, text behind the last cut.
    Without a cut everything is ``head`` and ``tail`` is None."""

    head: str
    count: int = 0
    tail: str | None = None


class Counter:
    """Counts of whole texts with one tokenizer file of the byte-level kind."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            setup = json.load(f)
        letters = byte_letters()
        self.transducer = Transducer([tuple(bytes(letters[c] for c in side) for side in pair) for pair in setup["model"]["merges"]])
        special = [t["content"] for t in setup["added_tokens"]]
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda t: [t]
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, read on its own."""
        pieces, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for k, part in enumerate(self.split(text)):
                if k % 2:
                    total[i] += 1
                else:
                    for piece in cut_long(part):
                        pieces.append(piece)
                        owner.append(i)
        own = np.array(owner, np.int64)
        for s in grouped(pieces):
            block = Block(pieces[s])
            starts, ends = spans_with_space(block)
            if not len(starts):
                continue
            if len(self.memo) > MEMO_SPANS:
                self.memo.clear()
            long, n = ends - starts > LONG_SPAN, np.empty(len(starts), np.int64)
            n[~long] = self._short(block, starts[~long], ends[~long])
            n[long] = [self.transducer.count(block.text[a:b].encode()) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            np.add.at(total, own[s][block.owner(starts)], n)
        return total

    def _short(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of short spans; what is remembered is looked up by the span's text."""
        found = block.kinds(starts, ends)
        codes, first = found or (np.arange(len(starts)), np.arange(len(starts)))
        memo, spans = self.memo, [block.text[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        for span in spans:
            if span not in memo:
                memo[span] = self.transducer.count(span.encode())
        return np.fromiter(map(memo.__getitem__, spans), np.int64, len(spans))[codes]

    def maps(self, chunks: list[str]) -> list[StateMap]:
        cuts = [(first_gap(c), last_gap(c)) for c in chunks]
        inner = self.counts([c[a:b] if a >= 0 else "" for c, (a, b) in zip(chunks, cuts)])
        return [StateMap(c[:a], int(n), c[b:]) if a >= 0 else StateMap(c) for c, (a, b), n in zip(chunks, cuts, inner)]

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of chunk ``a`` followed by chunk ``b``. The seam may hold a cut of its own."""
        seam = (a.head if a.tail is None else a.tail) + b.head
        mid = self.maps([seam])[0]
        if a.tail is None and b.tail is None:
            return mid
        if a.tail is None:
            if mid.tail is None:
                return StateMap(mid.head, b.count, b.tail)
            return StateMap(mid.head, mid.count + int(self.counts([mid.tail])[0]) + b.count, b.tail)
        if b.tail is None:
            if mid.tail is None:
                return StateMap(a.head, a.count, seam)
            return StateMap(a.head, a.count + int(self.counts([mid.head])[0]) + mid.count, mid.tail)
        return StateMap(a.head, a.count + int(self.counts([seam])[0]) + b.count, b.tail)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """All maps composed, pairwise and in order."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else StateMap("")

    def finish(self, maps: list[StateMap]) -> np.ndarray:
        """Tokens of whole texts, from their maps and the start state."""
        ends = self.counts([x for m in maps for x in (m.head, m.tail or "")]).reshape(-1, 2).sum(1)
        return ends + np.array([m.count for m in maps], np.int64)


@lru_cache(4)
def counter(file: str) -> Counter:
    return Counter(file)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, keep: str = "doc_id") -> DataFrame:
    """(keep, n_bytes, n_tokens, over_limit) of every row; a null text has none of either.

    Texts of one chunk are counted where they lie. Longer ones are dealt out by chunk, and
    their maps are composed per row; repeated rows are rows of their own.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[keep]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(keep).alias("_key"), text.alias("_text"), F.octet_length(text).cast("bigint").alias("n_bytes"))

    def short(batches):
        c = counter(tokenizer_file(tokenizer))
        for b in batches:
            n = c.finish(c.maps(b.column("_text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("n_bytes"), pa.array(n)], names=[keep, "n_bytes", "n_tokens"])
            del b
            tidy()

    few = rows.where(F.length("_text") <= CHUNK).mapInArrow(short, f"`{keep}` {kind}, n_bytes bigint, n_tokens bigint")
    many = stored(rows.where(F.length("_text") > CHUNK).withColumn("_row", F.expr("uuid()")), "long")
    chunks = many.select("_row", F.posexplode(F.expr(
        f"transform(sequence(0, int((length(_text) - 1) / {CHUNK})), i -> substring(_text, i * {CHUNK} + 1, {CHUNK}))")).alias("at", "_text"))
    chunks = chunks.repartition("_row", "at")

    def maps(batches):
        c = counter(tokenizer_file(tokenizer))
        for b in batches:
            got = c.maps(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("at"), pa.array([m.head for m in got]), pa.array([m.count for m in got], pa.int64()), pa.array([m.tail for m in got], pa.string())],
                                             names=["_row", "at", "head", "count", "tail"])

    def whole(key, group: pd.DataFrame) -> pd.DataFrame:
        c = counter(tokenizer_file(tokenizer))
        group = group.sort_values("at")
        m = c.scan([StateMap(h, int(n), t) for h, n, t in zip(group["head"], group["count"], group["tail"])])
        return pd.DataFrame({"_row": [key[0]], "n_tokens": c.finish([m])})

    mapped = chunks.mapInArrow(maps, "_row string, at int, head string, count bigint, tail string")
    composed = mapped.groupBy("_row").applyInPandas(whole, "_row string, n_tokens bigint")
    far = many.select(F.col("_key").alias(keep), "n_bytes", "_row").join(composed, "_row").select(keep, "n_bytes", "n_tokens")
    return few.unionByName(far).withColumn("over_limit", F.col("n_tokens") > limit)
