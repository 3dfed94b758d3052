"""Packing, token counts and token files against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tremorlake.llm import fast_encode, packing, token_counts, token_files
from tremorlake.llm.text_scan import cut_long

PARTS = ["a", "The", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "²", "é", "ß", "Σ", "İ", "漢字", "<|endoftext|>", "<|startoftext|>", "!!", " ", "　", "́",
         "\x1c", "\x85", "😀", "don't", "\0", "aaaaaaaa", "antidisestablishmentarianism", "=========="]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def ids_of(tokenizer, text, end=None):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids if end is None else [*ids, end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_spans_give_the_library_s_ids(library, name):
    some = [*texts(1500), None]
    flat, size = fast_encode.encoder(path(name)).encode(some)
    ends = np.cumsum(size)
    for t, a, b in zip(some, ends - size, ends):
        assert flat[a:b].tolist() == ids_of(library[name], t).tolist(), t


def test_long_texts_are_cut_safely(library, monkeypatch):
    text = " ".join(texts(300, 5))
    assert "".join(cut_long(text, 50)) == text
    monkeypatch.setattr(fast_encode, "cut_long", lambda t: cut_long(t, 50))
    flat, _ = fast_encode.encoder(path("byte_bpe_50k.json")).encode([text])
    assert flat.tolist() == ids_of(library["byte_bpe_50k.json"], text).tolist()


def test_transducer_counts(library):
    c = token_counts.counter(path("byte_bpe_50k.json"))
    some = texts(1500, 2)
    assert c.finish(c.maps(some)).tolist() == [len(ids_of(library["byte_bpe_50k.json"], t)) for t in some]


def test_state_maps_compose_in_any_order(library):
    c, rng = token_counts.counter(path("byte_bpe_50k.json")), random.Random(3)
    for t in texts(300, 4):
        n = rng.randint(1, 7)
        maps = c.maps([t[i:i + n] for i in range(0, len(t), n)])
        left = token_counts.StateMap("")
        for m in maps:
            left = c.compose(left, m)
        true = len(ids_of(library["byte_bpe_50k.json"], t))
        assert c.finish([c.scan(maps), left]).tolist() == [true, true]


def test_a_small_state_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 20)
    t = token_counts.counter(path("byte_bpe_50k.json")).transducer
    for w in (" something", " antidisestablishment", "😀😀", "=" * 40):
        assert t.count(w.encode()) == len(ids_of(library["byte_bpe_50k.json"], w))


def test_token_counts_of_odd_rows(spark, odd, nothing, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 5000)
    got = Counter(tuple(r) for r in token_counts.count_tokens(odd).collect())
    true = Counter()
    for r in odd.collect():
        n = len(ids_of(library["byte_bpe_50k.json"], r.text))
        true[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    assert got == true
    assert token_counts.count_tokens(nothing).collect() == []


def test_token_files_round_trip(odd, nothing, library):
    rows = [tuple(r) for r in token_files.round_trip(odd).orderBy("start").collect()]
    assert [r[0] for r in rows] == sorted([r.doc_id for r in odd.collect()], key=lambda i: (i is not None, i))
    true = Counter((r.doc_id, len(ids := ids_of(library["word_bpe_49k.json"], r.text, 1)), zlib.crc32(ids.tobytes())) for r in odd.collect())
    assert Counter((a, n, crc) for a, _, n, crc in rows) == true
    at = 0
    for _, start, n, _ in rows:
        assert start == at
        at += n
    assert token_files.round_trip(nothing).collect() == []


def test_files_hold_documents(spark, tmp_path, library):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id bigint, text string")
    folder = f"file://{tmp_path}/tokens"
    for m in token_files.write(docs, folder, parts=3).collect():
        file = token_files.TokenFile(f"{tmp_path}/tokens", m["name"], m["width"])
        assert len(file) == m["docs"]
        for i, key in enumerate(file.keys):
            assert file.document(i).tolist() == ids_of(library["word_bpe_49k.json"], f"text number {key}", 1).tolist()
    with pytest.raises(ValueError):
        token_files.local_folder("hdfs://host/folder")
    assert (token_files.id_type(1 << 16), token_files.id_type((1 << 16) + 1)) == ("<u2", "<u4")


def check_packing(rows, docs, tokenizer, capacity):
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    true = Counter()
    for r in docs:
        ids = ids_of(tokenizer, r.text, 0)
        n = -(-len(ids) // capacity)
        head = len(ids) - (n - 1) * capacity
        cuts = [0, *[head + k * capacity for k in range(n)]]
        for k in range(n):
            true[r.doc_id, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(ids[cuts[k]:cuts[k + 1]].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == true
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_rows(odd, nothing, library):
    check_packing(packing.pack(odd, capacity=64).collect(), odd.collect(), library["byte_bpe_50k.json"], 64)
    assert packing.pack(nothing).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_operators_of_the_genetic_search_keep_the_pieces(seed):
    rng = np.random.default_rng(seed)
    items = Counter(rng.integers(1, 101, 400).tolist())
    a = packing.best_fit(items, [], 100)
    b = packing.mutate(a, items, 100, rng)
    c = packing.crossover(a, b, items, 100, rng)
    for s in (a, b, c, *packing.evolve([a, b, c], items, 100, rng, 4, 8)):
        used = Counter()
        for pattern, n in s:
            assert 0 < sum(pattern) <= 100
            for x in pattern:
                used[x] += n
        assert used == items


def test_best_fit_is_best_fit():
    """One piece at a time into the fullest bin that holds it gives the same fills."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 40, 60).tolist(), reverse=True)
        room = []
        for x in sizes:
            fits = [i for i, r in enumerate(room) if r >= x]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= x
            else:
                room.append(50 - x)
        got = packing.best_fit(Counter(sizes), [], 50)
        assert sorted(50 - sum(p) for p, n in got for _ in range(n)) == sorted(room)


def test_search_beats_or_equals_best_fit(spark):
    items = Counter({45: 20, 30: 15, 25: 25, 20: 30, 35: 20, 10: 3})
    found = packing.search(spark.createDataFrame(list(items.items()), "length bigint, n bigint"), capacity=100)
    assert packing.n_bins(found) <= packing.n_bins(packing.best_fit(items, [], 100))


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [32, 64, 1 << 10, 1 << 11, 1 << 12, 1 << 14])
def test_spans_that_collide_under_every_base(library, size):
    """A word and its mirror image have equal polynomial hashes modulo 2^64 from 2^10 letters on."""
    some = [f"{thue_morse(size)} {thue_morse(size, 'ba')} {thue_morse(size)}", thue_morse(size, "ba"), " " + thue_morse(size)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        flat, held = fast_encode.SpanEncoder(path(name)).encode(some)
        want = [ids_of(library[name], t).tolist() for t in some]
        assert flat.tolist() == [i for ids in want for i in ids] and held.tolist() == list(map(len, want))
    c = token_counts.Counter(path("byte_bpe_50k.json"))
    assert c.finish(c.maps(some)).tolist() == [len(ids_of(library["byte_bpe_50k.json"], t)) for t in some]


def test_equal_hashes_of_different_short_spans(library, monkeypatch):
    """Where hashes fail altogether, spans are still told apart."""
    monkeypatch.setattr(fast_encode.Block, "hashes", lambda self, starts, ends, values=None: np.zeros(len(starts), np.uint64))
    some = texts(200, 8)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        flat, _ = fast_encode.SpanEncoder(path(name)).encode(some)
        assert flat.tolist() == [i for t in some for i in ids_of(library[name], t).tolist()]
    c = token_counts.Counter(path("byte_bpe_50k.json"))
    assert c.counts(some).tolist() == [len(ids_of(library["byte_bpe_50k.json"], t)) for t in some]
