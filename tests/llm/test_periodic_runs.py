"""Periodic runs: Lyndon words and runs against plain definitions, the query against a plain loop."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import periodic_runs as pr
from tremorlake.llm import queries


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences(seed, count=150):
    rng = random.Random(seed)
    for _ in range(count):
        kind, n = rng.randrange(6), rng.randint(0, 70)
        if kind == 0:
            yield [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
        elif kind == 1:
            yield fibonacci(n)
        elif kind == 2:
            yield [bin(i).count("1") % 2 for i in range(n)]
        else:
            out = []
            while len(out) < n:
                root = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
                out += (root * 9)[:rng.randint(1, 9 * len(root))]
            yield out[:n + 20]


def plain_runs(w, shortest, times):
    """All maximal stretches that keep a period, by comparing every word with the one a period on."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, times * q):
                part = w[i:i + length]
                if not any(part[k:] == part[:-k] for k in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_longest_lyndon_words():
    for w in [*sequences(1), [5] * 40, list(range(30)), list(range(30, 0, -1))]:
        want = []
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            want.append(j - i)
        assert pr.lyndon_lengths(np.array(w, np.int64)).tolist() == want, w


@pytest.mark.parametrize("shortest,times", [(24, 3), (2, 2), (6, 2), (5, 4)])
def test_runs_of_texts(shortest, times):
    many = [[f"w{x}" for x in w] for w in sequences(2)] + [[], ["a"], ["a"] * 100, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"], list("abcdefgh") * 3, list("abcdefghi") * 3]
    got = pr.runs_of_texts(many, shortest, times)
    for w, found in zip(many, got):
        assert [(r.start, r.length, r.period) for r in found] == plain_runs(w, shortest, times), w


def test_covered_keeps_every_word_of_a_run():
    for w in sequences(3):
        held = pr.covered(np.array(w, np.int64)) if w else []
        for s, n, _ in plain_runs(w, 24, 3):
            assert held[s:s + n].all()


def test_long_runs_take_linear_time():
    words = ["x"] * 60_000 + ["a", "b", "c"] * 20_000 + [str(x) for x in fibonacci(40_000)]
    found = pr.runs_of_texts([words])[0]
    assert (found[0].start, found[0].length, found[0].period) == (0, 60_000, 1)
    assert any((r.start, r.length, r.period) == (60_000, 60_000, 3) for r in found)


def plain_row(doc_id, text):
    """The contract of the query, step by step."""
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 24, 3)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n_},{q}\n" for s, n_, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_a_plain_loop(spark, odd, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in w), "x") for i, w in enumerate(sequences(4))] + [(i, " \t ".join(rng.choices("abcde", k=rng.randint(0, 150))), "") for i in range(300, 420)]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").unionByName(odd.where(F.length("text") < 9000).select("doc_id", "text", F.lit("x").alias("runs"))) \
        .unionByName(odd.where("text is null").select("doc_id", "text", F.lit("x").alias("runs"))).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(w[1] for w in want)


def test_clashing_columns_and_empty_tables(odd, nothing):
    assert pr.find_runs(nothing).collect() == []
    got = {r.doc_id: r for r in pr.find_runs(odd.where("doc_id in (1, 3)"), text="text").collect()}
    assert got[3].collapsed == "" and got[3].start is None
    assert got[1].collapsed.split() == odd.where("doc_id = 1").first().text.split()
