"""Language identification of mixed text: scripts narrow the candidates, Viterbi labels spans.

Each word gets a score per language from letter trigrams and whole words; languages that
do not use the word's script are out. A Viterbi pass with a penalty for each change of
language labels spans, and the language with most letters names the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches, small_batches, stored
from tremorlake.llm.text_scan import LETTER, Block, cut_long, grouped, lower_points, words

FIT_ROWS = 20_000  #: documents with a language used to fit, in the order of a hash of their id
BUCKETS = 1 << 16
SWITCH = 12.0  #: log-odds that a change of language costs
FLOOR = -10.0  #: lowest log-probability of a word, relative to its best language
OUTSIDE = -30.0  #: score of a language that does not use the word's script
SCRIPT_SHARE = 0.002  #: share of its letters from which on a language uses a script
LANE_WORDS = 1 << 20
UNKNOWN = "und"
# First code points of script ranges, in order.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
           (0x0900, "indic"), (0x0E00, "thai-lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
           (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
           (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
           (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFB50, "arabic"),
           (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other")]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(1)
def script_table() -> np.ndarray:
    """Number of the script of every code point."""
    firsts = np.array([f for f, _ in SCRIPTS])
    numbers = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return numbers[np.searchsorted(firsts, np.arange(0x110000), side="right") - 1]


class Scan:
    """Words of a block of texts with hashed trigrams per letter and a hash per word."""

    def __init__(self, texts: list[str]):
        self.block = block = Block(texts)
        self.starts, self.ends = words(block)
        self.owner = block.owner(self.starts)
        self.letter = block.cls == LETTER
        folded = np.where(self.letter, lower_points()[block.cp], 0).astype(np.uint64)
        one = np.concatenate([np.zeros(1, np.uint64), folded[:-1]])
        two = np.concatenate([np.zeros(1, np.uint64), one[:-1]])
        h = (folded * np.uint64(0x9E3779B1) + one * np.uint64(0x85EBCA77C2B2AE3D) + np.where(one > 0, two, 0).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
        self.grams = ((h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(48)).astype(np.int64)
        self.word = (block.hashes(self.starts, self.ends, folded) & np.uint64(BUCKETS - 1)).astype(np.int64) if len(self.starts) else self.starts
        run = np.concatenate([[0], np.cumsum(self.letter)])
        self.letters = run[self.ends] - run[self.starts]

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over each word of a value per letter (rows of ``values`` follow the letters)."""
        if not len(self.starts):
            return np.zeros((0, *values.shape[1:]), values.dtype)
        padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        first = np.concatenate([[0], np.cumsum(self.letters)])[:-1]
        out = np.add.reduceat(padded, first, axis=0)
        out[self.letters == 0] = 0
        return out


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # (BUCKETS, languages) log-probabilities
    words: np.ndarray
    uses: np.ndarray  # (scripts, languages): whether a language uses a script

    def emissions(self, scan: Scan) -> np.ndarray:
        """Log-probability of each language for each word, relative to the best; 0 where nothing tells."""
        at = np.flatnonzero(scan.letter)
        e = scan.per_word(self.grams[scan.grams[at]]) + self.words[scan.word]
        e[scan.letters == 0] = 0
        if len(at):
            n, kinds = len(scan.letters), len(SCRIPT_NAMES)
            of = np.repeat(np.arange(n, dtype=np.int64) * kinds, scan.letters) + script_table()[scan.block.cp[at]]
            allowed = self.uses[np.bincount(of, minlength=n * kinds).reshape(n, kinds).argmax(1)]  # by the script of most of the word's letters
            e = np.where(allowed | ~allowed.any(1, keepdims=True) | (scan.letters == 0)[:, None], np.maximum(e - np.where(allowed, e, -1e9).max(1, keepdims=True), FLOOR), OUTSIDE)
            e[scan.letters == 0] = 0
        return e.astype(np.float32)


def viterbi(e: np.ndarray, lane: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best state of each row of ``e``; rows of one lane lie together and in order.

    All lanes advance together: the longest comes first, so that the lanes still running
    are always a leading slice.
    """
    if not len(e):
        return np.zeros(0, np.int64)
    _, first, size = np.unique(lane, return_index=True, return_counts=True)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    state, scores = np.zeros(len(size), np.int64), e[first].astype(np.float64)
    backs = []
    for t in range(1, steps):
        k = active[t]
        v = scores[:k]
        best = v.argmax(1)
        least = v[np.arange(k), best] - switch
        stay = v >= least[:, None]
        scores[:k] = np.where(stay, v, least[:, None]) + e[first[:k] + t]
        backs.append((stay, best.astype(np.int16)))
    state = scores.argmax(1)
    path = np.zeros(len(e), np.int64)
    for t in range(steps - 1, 0, -1):
        k = active[t]
        path[first[:k] + t] = state[:k]
        stay, best = backs[t - 1]
        state[:k] = np.where(stay[np.arange(k), state[:k]], state[:k], best)
    path[first] = state
    return path


def label(texts: list[str | None], model: Model) -> list[tuple[str, float, list]]:
    """(language, score, spans) of each text; spans are (language, start, end) in characters."""
    n, kinds = len(texts), len(model.languages)
    if not kinds:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    weight, belief = np.zeros((n, kinds)), np.zeros((n, kinds))
    spans: list[list] = [[] for _ in range(n)]
    pieces, owners, offsets = [], [], []
    for i, t in enumerate(texts):
        at = 0
        for p in cut_long(t or ""):
            pieces.append(p)
            owners.append(i)
            offsets.append(at)
            at += len(p)
    owner, offset = np.array(owners, np.int64), np.array(offsets, np.int64)
    for s in grouped(pieces):
        scan = Scan(pieces[s])
        if not len(scan.starts):
            continue
        e = model.emissions(scan)
        path = viterbi(e, scan.owner)
        rows = owner[s][scan.owner]
        soft = np.exp(e[np.arange(len(e)), path] - np.logaddexp.reduce(e, axis=1))
        np.add.at(weight, (rows, path), scan.letters)
        np.add.at(belief, (rows, path), scan.letters * soft)
        begin = scan.block.sep - np.diff(scan.block.sep, prepend=-1) + 1
        edge = np.flatnonzero((np.diff(scan.owner, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
        stop = np.append(edge[1:], len(path)) - 1
        shift = offset[s][scan.owner[edge]] - begin[scan.owner[edge]]
        for row, lang, a, b in zip(rows[edge].tolist(), path[edge].tolist(), (scan.starts[edge] + shift).tolist(), (scan.ends[stop] + shift).tolist()):
            held = spans[row]
            if held and held[-1][0] == model.languages[lang]:
                held[-1] = (held[-1][0], held[-1][1], b)
            else:
                held.append((model.languages[lang], a, b))
    total = weight.sum(1)
    best = weight.argmax(1)
    return [(model.languages[best[i]], float(min(1.0, belief[i, best[i]] / total[i])), spans[i]) if total[i] else (UNKNOWN, 0.0, []) for i in range(n)]


def fit(docs: DataFrame, eligible: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """Learn from documents with a text and a language whose id is ``eligible``; at most ``rows``
    of them, in the order of xxhash64 of the id. Without any, every text is ``und``."""
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    if eligible is not None:
        known = known.where(eligible)
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    sample = stored(known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text").repartition(8), "sample")
    small_batches(docs.sparkSession)
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())

    def counts(batches):
        held = np.zeros((len(languages), 2 * BUCKETS + len(SCRIPT_NAMES)), np.int64)
        for b in batches:
            number = np.array([languages.index(x) for x in b.column("lang").to_pylist()], np.int64)
            texts = b.column("text").to_pylist()
            pieces = [(i, p) for i, t in enumerate(texts) for p in cut_long(t)]
            for s in grouped([p for _, p in pieces]):
                scan = Scan([p for _, p in pieces[s]])
                at = np.flatnonzero(scan.letter)
                of_piece = number[np.array([i for i, _ in pieces[s]], np.int64)]
                lang = of_piece[scan.block.owner(at)]
                word_lang, told = of_piece[scan.owner], scan.letters > 0
                for k in range(len(languages)):
                    held[k, :BUCKETS] += np.bincount(scan.grams[at[lang == k]], minlength=BUCKETS)
                    held[k, BUCKETS:2 * BUCKETS] += np.bincount(scan.word[told & (word_lang == k)], minlength=BUCKETS)
                    held[k, 2 * BUCKETS:] += np.bincount(script_table()[scan.block.cp[at[lang == k]]], minlength=len(SCRIPT_NAMES))
        k, slot = np.nonzero(held)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(slot), pa.array(held[k, slot])], names=["lang", "slot", "n"])

    got = sample.mapInArrow(counts, "lang bigint, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros((len(languages), 2 * BUCKETS + len(SCRIPT_NAMES)))
    held[got.column("lang").to_numpy(), got.column("slot").to_numpy()] = got.column("n").to_numpy()
    grams, whole, scripts = held[:, :BUCKETS], held[:, BUCKETS:2 * BUCKETS], held[:, 2 * BUCKETS:]

    def logs(c: np.ndarray, smooth: float) -> np.ndarray:
        return np.log((c + smooth) / (c.sum(1, keepdims=True) + smooth * BUCKETS)).T.astype(np.float32) if len(languages) else np.zeros((BUCKETS, 0), np.float32)

    uses = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)).T & (scripts.T > 0)
    return Model(languages, logs(grams, 0.5), logs(whole, 0.5), uses)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """The columns ``keep`` (all by default) and, under ``names``, language, score and spans.

    A text that is null or has no letter is ``und`` with score 0 and no spans.
    """
    columns = docs.columns if keep is None else keep
    told = F.col("text").rlike(r"\p{L}")
    held = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], *[] if "text" in columns else [F.col("text").alias("_text")], told.alias("_told"))
    at = columns.index("text") if "text" in columns else len(columns)
    kind = "array<struct<lang:string,start:bigint,end:bigint>>"

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        got = label([t if told else None for t, told in zip(b.column(at).to_pylist(), b.column("_told").to_pylist())], model)
        spans = pa.array([[{"lang": x[0], "start": x[1], "end": x[2]} for x in g[2]] for g in got],
                         pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([*b.columns[:len(columns)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans],
                                          names=[*b.schema.names[:len(columns)], "_l", "_s", "_p"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in held.drop("_text", "_told").schema), f"_l string, _s double, _p {kind}"])
    return map_batches(held, of, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_l").alias(names[0]), F.col("_s").alias(names[1]), F.col("_p").alias(names[2]))
