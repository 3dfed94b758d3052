"""Near copies by five-word shingles, against a comparison of all pairs."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tremorlake.llm import near_text


def shingles(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(sets):
    """Place of the first member of each one's group, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if near(sets[i], sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("direct", [8, 1])
def test_near_copies_of_edited_texts_are_found(spark, monkeypatch, direct):
    """Copies with a changed word here and there: most are at 0.8 to 0.95, where fingerprints differ by many bits."""
    monkeypatch.setattr(near_text, "DIRECT", direct)
    rng = random.Random(11)
    texts = []
    for size in (30, 80, 150, 400):
        for _ in range(6):
            base = prose(rng, size).split()
            texts.append(" ".join(base))
            for _ in range(6):
                w = list(base)
                for _ in range(rng.randint(1, max(1, size // 40))):
                    w[rng.randrange(len(w))] = f"other{rng.random()}"
                texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    root = groups(sets)
    loose = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and near(sets[i], sets[j])]
    assert len(loose) > 100
    got = near_text.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))


def test_stage_keeps_one_of_real_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    root = groups([shingles(r.text) for r in rows])
    got = corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in got.collect()) == [rows[i].doc_id for i in sorted(set(root))]


def test_rows_of_one_id_and_without_id(spark):
    a, b, c = "one two three four five six seven", "red green blue white black brown grey", "up down left right in out on off"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (None, a.upper()), (None, c), (None, c), (None, None), (9, "")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in near_text.one_of_each_group(docs).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, c), (9, "")], key=str)
    assert near_text.one_of_each_group(docs.limit(0)).collect() == []


def test_hot_band_values(spark, monkeypatch):
    """Many edits of one text, most of them too far from each other, and a passage in many other texts."""
    made = []
    whole = near_text._links
    monkeypatch.setattr(near_text, "_links", lambda pairs, sets, name: made.append(pairs.distinct().count()) or whole(pairs, sets, name))
    rng = random.Random(3)
    base, passage, texts = prose(rng, 150).split(), prose(rng, 60), []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"other{rng.random()}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 9)} start{i} {passage} end{i} {prose(rng, 9)}" for i in range(300)]
    sets = [shingles(t) for t in texts]
    root = groups(sets)
    assert 50 < len(set(root)) < len(texts) - 50
    got = near_text.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    assert sum(made) < 20 * len(texts)  # all pairs are 319,600


def test_prefix_filter_loses_no_similar_pair(spark):
    """Sets of many sizes from few shingles: every similar pair is a candidate."""
    import numpy as np

    rng, sets = random.Random(6), []
    for _ in range(40):
        base = rng.sample(range(300), rng.randint(1, 120))
        for _ in range(5):
            sets.append(set(base) - set(rng.sample(base, rng.randint(0, max(0, len(base) // 9)))) | set(rng.sample(range(300), rng.randint(0, 9))))
    rows = [(i, bytearray(np.array(sorted(s), "<u8").tobytes())) for i, s in enumerate(sets) if s]
    held = spark.createDataFrame(rows, "node bigint, held binary")
    got = {(r.u, r.v) for r in near_text._sharing(held.selectExpr("node", "node as root"), held).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and near(a, b)}
    assert len(want) > 50 and want <= got


def test_fingerprint_classes_bring_copies_together(spark, monkeypatch):
    """Without any band, long texts with a changed word still meet by their SimHash; short ones that only share it stay apart."""
    monkeypatch.setattr(near_text, "_band_cells", lambda points: points.selectExpr("node as key", "node", "false as leading").limit(0))
    rng = random.Random(5)
    texts = []
    for _ in range(5):
        base = prose(rng, 900).split()
        texts += [" ".join(base), " ".join([*base[:-1], "changed"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    from tremorlake.llm import simhash
    linked = {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()}
    root = groups([shingles(t) for t in texts])
    expected = sorted({i for i, r in enumerate(root) if i == r or (i, r) not in linked})
    assert len(expected) < len(texts)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == expected
