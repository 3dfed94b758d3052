"""Token ids as flat binary files with document offsets, read back through memory maps.

A dataset is a folder that driver and executors share, with one pair of files per
partition: ``NAME.ids`` holds the ids of its documents one after the other (unsigned,
little-endian, 16 bits where the tokenizer's vocabulary allows it and 32 elsewhere),
``NAME.idx`` holds two unsigned 64-bit values per document (its
first id counted from the start of the file, its number of ids) and ``NAME.key`` the
documents' ids as signed 64-bit. Partitions are ranges of the document id; where a
partition starts in the whole dataset is a prefix sum over the partitions' totals.
"""

from __future__ import annotations

import os
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.common import small_batches, stored, tidy, tokenizer_file
from tremorlake.llm.fast_encode import encoder
from tremorlake.session import scratch_path, shuffle_width

TOKENIZER, END_ID = "word_bpe_49k.json", 1
NULL_KEY = -(1 << 63)  #: stands for a null document id in the key file
READ_DOCS = 4096  #: documents a reader returns at once
MANIFEST = "part int, name string, width string, docs bigint, ids bigint"


def id_type(vocabulary: int) -> str:
    """The narrowest unsigned type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def local_folder(path: str) -> str:
    """The mounted folder behind a plain or file: path. Memory maps need a mounted folder."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files need a folder that all executors mount, not {path}")
    return url.path


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int | None = END_ID, parts: int | None = None) -> DataFrame:
    """Write ``docs`` in ascending doc_id order and return the manifest: a row for each file.

    A null text has no ids but the end id. Null document ids come first. Equal ids follow
    each other in any order. The manifest comes from committed tasks only, so files left by
    lost or repeated tasks are never read.
    """
    place = local_folder(folder)

    def run(batches):
        codec = encoder(tokenizer_file(tokenizer))
        width = id_type(max(codec.library.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1))
        part = TaskContext.get().partitionId()
        name, docs_written, ids_written = f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0
        os.makedirs(place, exist_ok=True)
        with open(f"{place}/{name}.ids", "wb") as ids, open(f"{place}/{name}.idx", "wb") as idx, open(f"{place}/{name}.key", "wb") as key:
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat, size = codec.encode(batch.column("_text").to_pylist())
                if end_id is not None:
                    flat, size = np.insert(flat, np.cumsum(size), np.uint32(end_id)), size + 1
                ids.write(flat.astype(width).tobytes())
                idx.write(np.stack([ids_written + np.cumsum(size) - size, size], axis=1).astype("<u8").tobytes())
                key.write(batch.column("doc_id").fill_null(NULL_KEY).to_numpy().astype("<i8").tobytes())
                docs_written += len(size)
                ids_written += int(size.sum())
                del batch, flat
                tidy()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "width": [width], "docs": pa.array([docs_written]), "ids": pa.array([ids_written])})

    small_batches(docs.sparkSession)
    width = parts or shuffle_width(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
               .repartitionByRange(width, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()))
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def bases(manifest: DataFrame) -> DataFrame:
    """The manifest (a row for each partition) with ``base``, the ids of all partitions before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.where("docs > 0").withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class TokenFile:
    """One partition's files as memory maps; documents are slices of the map."""

    def __init__(self, folder: str, name: str, width: str):
        self.ids = self._map(f"{folder}/{name}.ids", width)
        self.index = self._map(f"{folder}/{name}.idx", "<u8").reshape(-1, 2)
        self.keys = self._map(f"{folder}/{name}.key", "<i8")

    @staticmethod
    def _map(path: str, kind: str) -> np.ndarray:
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.index)

    def document(self, i: int) -> np.ndarray:
        first, n = self.index[i].tolist()
        return self.ids[first:first + n]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    place = local_folder(folder)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(place, row["name"], row["width"])
                for at in range(0, len(file), READ_DOCS):
                    index = np.asarray(file.index[at:at + READ_DOCS]).astype(np.int64)
                    keys = np.asarray(file.keys[at:at + READ_DOCS])
                    crc = [zlib.crc32(file.document(i).astype("<u4").tobytes()) for i in range(at, at + len(index))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NULL_KEY), pa.array(index[:, 0] + row["base"]), pa.array(index[:, 1]), pa.array(crc, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = stored(bases(manifest), "bases")
    n = max(1, min(placed.count(), 4 * shuffle_width(manifest.sparkSession)))
    return placed.repartitionByRange(n, "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` (by default below the shared scratch folder) and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read(write(docs, folder), folder)
