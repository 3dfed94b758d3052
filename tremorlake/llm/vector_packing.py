"""Packing of examples into sequences under several limits at once.

A sequence has room for tokens, for segments and for tokens that bear loss; an example
takes some of each. The dot-product heuristic fills one sequence after the other with the
example whose demands point most in the direction of the room that is left: the largest
sum over the limits of room times demand, both as shares of the limit, among the examples
that fit. When none fits, one is cut so that it fills the tokens or the loss that is left.
A sequence that another limit closes before it is full is cut back to a power of two,
which needs no padding; what it loses waits for the next one.

Every task packs what it reads, holding a bounded pool of waiting examples, and emits
finished sequences only. What is left of its last sequence, with its ids, meets what other
tasks left, in groups of ``FAN_IN``, level by level; the last rest is cut into powers of two.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import small_batches, stored, tidy, tokenizer_file
from tremorlake.llm.fast_encode import encoder

TOKENIZER, END_ID = "word_bpe_49k.json", 2
POOL_TOKENS, POOL_PIECES = 1 << 20, 1 << 12  #: ids and pieces that wait in a task before sequences are packed
FAN_IN = 64  #: unfinished rests that meet in one group of a level
_LEVEL = 1 << 54
_GROUP = 1 << 30


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most; ``loss`` of None leaves tokens that bear loss unlimited."""

    tokens: int = 4096
    segments: int = 512
    loss: int | None = None


class Piece:
    """Consecutive ids of one document; ``mask`` marks those that bear loss (None: all do)."""

    __slots__ = ("key", "start", "ids", "mask", "doc_tokens")

    def __init__(self, key, start: int, ids: np.ndarray, mask: np.ndarray | None, doc_tokens: int):
        self.key, self.start, self.ids, self.mask, self.doc_tokens = key, start, ids, mask, doc_tokens

    @property
    def loss(self) -> int:
        return len(self.ids) if self.mask is None else int(self.mask.sum())

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of the first ids fit into so many tokens and so much loss."""
        n = min(len(self.ids), tokens)
        return min(n, loss) if self.mask is None else int(np.searchsorted(np.cumsum(self.mask[:n]), loss, side="right"))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        masks = (None, None) if self.mask is None else (self.mask[:n], self.mask[n:])
        return (Piece(self.key, self.start, self.ids[:n], masks[0], self.doc_tokens),
                Piece(self.key, self.start + n, self.ids[n:], masks[1], self.doc_tokens))


class Pool:
    """Waiting pieces, and the sizes of those that the next sequence may take."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.loss_limit = limits.tokens if limits.loss is None else limits.loss
        self.pieces: list[Piece] = []
        self.size, self.loss, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, pieces: list[Piece]) -> None:
        """Let pieces wait; those that fit into no sequence are cut into ones that just do."""
        cut = []
        for piece in pieces:
            while 0 < (n := piece.fitting(self.limits.tokens, self.loss_limit)) < len(piece.ids):
                head, piece = piece.cut(n)
                cut.append(head)
            cut.append(piece)
        pieces = cut
        self.pieces += pieces
        self.size = np.concatenate([self.size, np.fromiter((len(p.ids) for p in pieces), np.int64, len(pieces))])
        self.loss = np.concatenate([self.loss, np.fromiter((p.loss for p in pieces), np.int64, len(pieces))])
        self.tokens += sum(len(p.ids) for p in pieces)

    def take(self, i: int) -> Piece:
        """Piece number i; the last one takes its number."""
        piece, last = self.pieces[i], len(self.pieces) - 1
        self.pieces[i], self.size[i], self.loss[i] = self.pieces[last], self.size[last], self.loss[last]
        self.pieces.pop()
        self.size, self.loss = self.size[:last], self.loss[:last]
        self.tokens -= len(piece.ids)
        return piece

    def choose(self, tokens: int, segments: int, loss: int) -> int:
        """The piece that fits and points most in the direction of the room; -1 if none fits."""
        limit = self.limits
        fits = (self.size <= tokens) & (self.loss <= loss)
        if not fits.any():
            return -1
        score = self.size * (tokens / limit.tokens ** 2) + segments / limit.segments ** 2
        if limit.loss:
            score = score + self.loss * (loss / limit.loss ** 2)
        return int(np.where(fits, score, -1.0).argmax())

    def sequence(self) -> list[Piece]:
        """The pieces of the next sequence; waiting pieces are taken and cut for it."""
        limit, taken = self.limits, []
        tokens, segments, loss = limit.tokens, limit.segments, self.loss_limit
        while self.pieces and tokens and segments:
            i = self.choose(tokens, segments, loss)
            if i >= 0:
                piece = self.take(i)
            else:
                i = int(self.size.argmax())  # the longest loses a part; short ones stay whole for later
                n = self.pieces[i].fitting(tokens, loss)
                if not n:
                    break
                piece, rest = self.take(i).cut(n)
                self.add([rest])
            taken.append(piece)
            tokens, segments, loss = tokens - len(piece.ids), segments - 1, loss - (piece.loss if limit.loss else 0)
        return taken

    def give_back(self, taken: list[Piece], n: int) -> list[Piece]:
        """The first ``n`` ids of a sequence; the others wait again."""
        kept, held = [], 0
        for k, piece in enumerate(taken):
            if held + len(piece.ids) > n:
                head, rest = piece.cut(n - held)
                self.add(([rest] if len(head.ids) else [piece]) + taken[k + 1:])
                return kept + ([head] if len(head.ids) else [])
            kept.append(piece)
            held += len(piece.ids)
        return kept

    def pack(self, tokens: int, pieces: int, last: bool) -> list[list[Piece]]:
        """Finished sequences, until at most so many ids and pieces wait. Where ``last`` is not set, a
        sequence that ends for want of pieces is not finished and goes back."""
        out = []
        while self.tokens > tokens or len(self.pieces) > pieces:
            taken = self.sequence()
            n = sum(len(p.ids) for p in taken)
            if not n:
                raise ValueError("a limit is zero: no id fits into a sequence")
            if n < self.limits.tokens:
                if not last and not self.pieces and len(taken) < self.limits.segments:
                    self.add(taken)
                    break
                taken = self.give_back(taken, 1 << (n.bit_length() - 1))
            out.append(taken)
        return out


def _names(keep: str) -> list[str]:
    return [keep, "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", "n_segments"]


def _finished(sequences: list[list[Piece]], first: int, keep: str) -> dict[str, list]:
    rows = []
    for number, pieces in enumerate(sequences, first):
        offset = 0
        for p in pieces:
            rows.append((p.key, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, p.loss, number, offset, len(pieces)))
            offset += len(p.ids)
    return dict(zip(_names(keep), map(list, zip(*rows)))) if rows else {n: [] for n in _names(keep)}


def _frame(sequences: list[list[Piece]], rest: list[Piece], first: int, keep: str) -> dict[str, list]:
    """Finished pieces, then pieces that still wait: those have no sequence but their ids and mask."""
    out = _finished(sequences, first, keep)
    n = len(out[keep])
    waiting = [(p.key, p.start, len(p.ids), None, p.doc_tokens, p.loss, None, None, None) for p in rest]
    for name, column in zip(_names(keep), zip(*waiting)):
        out[name] += column
    out["_ids"] = [None] * n + [p.ids.tobytes() for p in rest]
    out["_mask"] = [None] * n + [None if p.mask is None else p.mask.tobytes() for p in rest]
    return out


def _schema(keep: str, kind: str) -> str:
    return (f"`{keep}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, `offset` bigint, "
            "n_segments bigint, _ids binary, _mask binary")


def _examples(batch: pa.RecordBatch, codec, end_id: int) -> list[Piece]:
    """The documents of a batch as pieces. Ids of a turn bear loss where its flag is set, the end id where the last turn's is."""
    keys, turns = batch.column("_key").to_pylist(), batch.column("_turns").to_pylist()
    turns = [t or [] for t in turns]
    ids, sizes = codec.encode([t["text"] for ts in turns for t in ts])
    flags = np.array([bool(t["loss"]) for ts in turns for t in ts], bool)
    mask, ends = np.repeat(flags, sizes), np.cumsum(np.concatenate([[0], sizes]))
    first = np.cumsum([0, *map(len, turns)])
    out = []
    for key, a, b in zip(keys, first[:-1].tolist(), first[1:].tolist()):
        x, y = int(ends[a]), int(ends[b])
        own = np.append(ids[x:y], end_id).astype("<u4")
        bears = np.append(mask[x:y], flags[b - 1] if b > a else True)
        out.append(Piece(key, 0, own, None if bears.all() else bears, len(own)))
    return out


def pack(examples: DataFrame, limits: Limits = Limits(), text: str | None = "text", turns: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID,
         keep: str = "doc_id", pool_tokens: int = POOL_TOKENS, fan_in: int = FAN_IN) -> DataFrame:
    """Every piece of every example: (keep, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, n_segments).

    An example is a text, all of whose ids bear loss, or, where ``turns`` names a column
    array<struct<text: string, loss: boolean>>, the ids of its turns in order, those of turns
    flagged ``loss`` bearing loss. The end id follows; it bears loss as the last turn does.
    A null or empty text or list is one end id; a null turn text is empty, a null flag false.
    Repeated rows are packed as often as they occur; an empty table gives an empty result;
    other columns, whatever their names, play no part. Sequences hold at most
    ``limits`` and are full or a power of two long. Ids of sequences are unique, not dense.
    """
    small_batches(examples.sparkSession)
    kind = dict(examples.dtypes)[keep]
    given = F.col(turns) if turns else F.array(F.struct(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(True).alias("loss")))
    rows = examples.select(F.col(keep).alias("_key"), given.alias("_turns"))

    def first_level(batches):
        codec, pool, number = encoder(tokenizer_file(tokenizer)), Pool(limits), TaskContext.get().partitionId() * _GROUP
        def send(sequences, rest):  # noqa: E306
            columns = _frame(sequences, rest, number, keep)
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)
        for batch in batches:
            if not batch.num_rows:
                continue
            target = _target(batch.schema.field("_key").type, keep)
            pool.add(_examples(batch, codec, end_id))
            if pool.tokens > pool_tokens or len(pool.pieces) > POOL_PIECES:
                done = pool.pack(pool_tokens // 2, POOL_PIECES // 2, False)
                yield send(done, [])
                number += len(done)
            tidy()
        if pool.pieces:
            done = pool.pack(0, 0, False)
            yield send(done, pool.pieces)

    def next_level(level: int):
        def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            pool = Pool(limits)
            fields = [group.column(c).to_pylist() for c in (keep, "start", "_ids", "_mask", "doc_tokens")]
            pool.add([Piece(k, s, np.frombuffer(i, "<u4"), None if m is None else np.frombuffer(m, bool), n) for k, s, i, m, n in zip(*fields)])
            done = pool.pack(0, 0, group.column("_last")[0].as_py())
            number, target = key[0].as_py(), _target(group.schema.field(keep).type, keep)
            columns = _frame(done, pool.pieces, level * _LEVEL + number * _GROUP, keep)
            arrays = [pa.array(columns[f.name], f.type) for f in target]
            return pa.Table.from_arrays([*arrays, pa.array([number] * len(arrays[0]), pa.int64())], schema=target.append(pa.field("_part", pa.int64())))
        return merge

    names = _names(keep)
    now = stored(rows.mapInArrow(first_level, _schema(keep, kind)).withColumn("_part", F.spark_partition_id().cast("bigint")), "packed")
    done, level = now.where("sequence_id is not null").select(*[f"`{n}`" for n in names]), 0
    left = now.where("sequence_id is null")
    parts = left.agg(F.max("_part")).first()[0]
    while parts is not None:
        level, groups = level + 1, -(-(parts + 1) // fan_in)
        # A rest is less than one sequence, so a group holds fewer than fan_in sequences' ids.
        met = left.withColumn("_last", F.lit(groups == 1))
        merged = met.groupBy((F.col("_part") % groups).alias("_to")).applyInArrow(next_level(level), _schema(keep, kind) + ", _part bigint")
        now = stored(merged, f"packed-{level}")
        done = done.unionByName(now.where("sequence_id is not null").select(*[f"`{n}`" for n in names]))
        left = now.where("sequence_id is null")
        parts = left.agg(F.max("_part")).first()[0] if groups > 1 else None
    return done


def _target(key: pa.DataType, keep: str) -> pa.Schema:
    return pa.schema([(keep, key), *((n, pa.int64()) for n in _names(keep)[1:]), ("_ids", pa.binary()), ("_mask", pa.binary())])
