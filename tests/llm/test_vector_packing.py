"""Vector packing: laws of every result, and ids against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremorlake.llm import queries
from tremorlake.llm import vector_packing as vp


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path("word_bpe_49k.json"))


def expected(library, texts, end=2):
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def check(rows, limits, ids_by_key, masks=None):
    """Each id in exactly one piece, sequences gapless, within all limits, and free of padding."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_key[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_key) == set(ids_by_key)
    for key, held in by_key.items():
        want, at = sorted(a.tobytes() for a in ids_by_key[key]), defaultdict(list)
        copies = len(want)
        for r in held:
            at[r.start, r.length, r.ids_crc32].append(r)
        for a in ids_by_key[key]:  # every document's ids are covered once per copy
            cover = np.zeros(len(a), int)
            for r in held:
                if r.doc_tokens == len(a) and zlib.crc32(a[r.start:r.start + r.length].tobytes()) == r.ids_crc32:
                    cover[r.start:r.start + r.length] += 1
            assert (cover == copies).all() if len(set(want)) == 1 else (cover >= 1).all()
        assert sum(r.length for r in held) == sum(len(a) for a in ids_by_key[key])
        if masks:
            for r in held:
                assert r.loss_tokens == masks[key][r.start:r.start + r.length].sum()
    full = 0
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0, *[r.length for r in held]])[:-1].tolist()
        n = sum(r.length for r in held)
        assert n <= limits.tokens and len(held) <= limits.segments and all(r.n_segments == len(held) for r in held)
        assert limits.loss is None or sum(r.loss_tokens for r in held) <= limits.loss
        assert n == limits.tokens or n & (n - 1) == 0
        full += n == limits.tokens
    return full, len(by_sequence)


@pytest.mark.parametrize("limits,fan_in", [(vp.Limits(64, 8), 2), (vp.Limits(128, 512), 64), (vp.Limits(64, 2), 3)])
def test_texts_are_packed_whole(spark, library, limits, fan_in):
    rng = random.Random(limits.segments)
    texts = [" ".join(rng.choices(["cat", "dogs", "12", "ünï", "!!", "hello"], k=rng.choice([0, 1, 3, 9, 40, 300]))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = vp.pack(df, limits, pool_tokens=400, fan_in=fan_in).collect()
    ids = expected(library, texts)
    full, n = check(got, limits, {i: [a] for i, a in enumerate(ids)})
    if limits.segments > 100:
        assert n - full <= 7  # only the last rest is cut into powers of two
        assert full == sum(map(len, ids)) // limits.tokens


def test_loss_and_segments_bind_together(spark, library):
    rng, rows, masks, ids = random.Random(4), [], {}, {}
    for i in range(120):
        turns = [(" ".join(rng.choices(["why", "because", "so"], k=rng.randint(0, 30))), rng.choice([True, False, None])) for _ in range(rng.randint(0, 5))]
        rows.append((i, turns if i % 17 else None))
        turns = turns if i % 17 else []
        parts = [library.encode(t, add_special_tokens=False).ids for t, _ in turns]
        ids[i] = [np.array([*[x for p in parts for x in p], 2], "<u4")]
        masks[i] = np.array([bool(f) for p, (_, f) in zip(parts, turns) for _ in p] + [bool(turns[-1][1]) if turns else True])
    limits = vp.Limits(100, 5, 30)
    df = spark.createDataFrame(rows, "doc_id bigint, turns array<struct<text: string, loss: boolean>>")
    check(vp.pack(df.repartition(3), limits, turns="turns").collect(), limits, ids, masks)


def test_the_heuristic_follows_the_room():
    pool = vp.Pool(vp.Limits(100, 10, 100))
    piece = lambda n, loss: vp.Piece(n, 0, np.zeros(n, "<u4"), np.arange(n) < loss, n)
    pool.add([piece(50, 0), piece(40, 40), piece(30, 30)])
    assert pool.choose(100, 10, 100) == 1  # much of both
    assert pool.choose(100, 10, 5) == 0  # no room for loss
    assert pool.choose(35, 10, 100) == 2
    assert pool.choose(10, 10, 100) == -1


def test_query_with_odd_rows(spark, odd, nothing, library, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_vector_packing"](spark, str(tmp_path))
    ids = defaultdict(list)
    for r in odd.collect():
        ids[r.doc_id] += expected(library, [r.text])
    full, n = check(got.collect(), vp.Limits(), ids)
    total = sum(len(a) for held in ids.values() for a in held)
    assert full == total // 4096 and n - full == bin(total % 4096).count("1")
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id"]
    assert vp.pack(nothing).collect() == []
    text_ids = odd.select(F.concat(F.lit("k"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("doc_id"), "text")
    assert {r.doc_id for r in vp.pack(text_ids).collect()} == {f"k{'' if k is None else k}" for k in ids}
