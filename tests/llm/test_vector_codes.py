"""Vector codes: limbs and distances against Python integers, whole results against a plain loop."""

import hashlib
import math
import random

import numpy as np
import pytest

from tremorlake.llm import vector_codes as vc

INF = float("inf")


@pytest.mark.parametrize("bits", [3, 9, 21, 40, 70, 140])
def test_dot_products_and_nearest_are_exact(bits):
    rng = random.Random(bits)
    make = lambda n: [[rng.randint(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(n)]
    x, y = make(40), make(9)
    y[4] = y[2]  # a tie
    kind = np.int64 if bits < 62 else object
    a, b = np.array(x, kind), np.array(y, kind)
    assert vc.dot_products(a, b, True).tolist() == [[sum(p * q for p, q in zip(r, s)) for s in y] for r in x]
    code, far = vc.nearest(a, b)
    want = [min((sum((p - q) ** 2 for p, q in zip(r, s)), k) for k, s in enumerate(y)) for r in x]
    assert list(zip(far.tolist(), code.tolist())) == want


def test_limbs_stay_exact_over_long_vectors():
    x = np.full((1, 9000), (1 << 20) - 1, np.int64)
    assert vc.dot_products(x, x, True).tolist() == [[9000 * ((1 << 20) - 1) ** 2]]


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract, step by step, in Python integers: rows are (id, vector, label) in order."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v, k: v[k * len(v) // parts:(k + 1) * len(v) // parts]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v, k) for _, v, _ in order[:entries]] for k in range(parts)]
    near = lambda v, k: min((sum((a - b) ** 2 for a, b in zip(cut(v, k), c)), e) for e, c in enumerate(books[k]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, k)[1], []).append(cut(v, k))
            for e, g in groups.items():
                new[k][e] = [sum(c) // len(g) for c in zip(*g)]
        books = new
    found = [(i, [near(v, k) for k in range(parts)], lab) for i, v, lab in kept]
    error = [sum(d for d, _ in n) for _, n, _ in found]
    total = {}
    for (_, _, lab), e in zip(found, error):
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    fit = lambda x: x if x < 1 << 63 else None
    known = {lab: all(e < 1 << 63 for (_, _, o), e in zip(found, error) if o == lab) for lab in total}
    return sorted(((i, "".join("%02x" % e for _, e in n), fit(t), fit(total[lab]) if known[lab] else None, digest) for (i, n, lab), t in zip(found, error)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 3.0e4, 1e12, 1e36])
def test_codes_equal_a_plain_loop(spark, scale):
    rng = random.Random(5)
    vectors = [[float(np.float32(rng.gauss(0, scale))) for _ in range(32)] for _ in range(150)]
    vectors[7] = vectors[3]
    vectors += [None, [*vectors[0][:31], None], [*vectors[0][:31], INF], [*vectors[0][:31], float("nan")], vectors[9], [0.0] * 32, [-0.001] * 32]
    rows = [(None if i in (20, 21) else i // 2 * 2, v, None if i % 3 == 0 else i % 4) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, code int, _key double, label_error string")
    got = vc.code_vectors(df.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(got) == plain(rows)


def test_few_rows_other_widths_and_empty_tables(spark):
    schema = "vec_id bigint, embedding array<double>, label string"
    empty = spark.createDataFrame([], schema)
    assert vc.code_vectors(empty).collect() == []
    assert vc.code_vectors(spark.createDataFrame([(1, None, "a")], schema)).collect() == []
    rows = [(1, [float(i) for i in range(16)], "a"), (2, [1.0] * 16, "a"), (3, [1.0, 2.0], "a"), (4, [], "b")]
    got = {r.vec_id: r for r in vc.code_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].code == "00" * 16 and got[2].code == "01" + "00" + "01" * 14 and got[1].error == 0
    assert got[3].code is None and got[3].error is None and got[3].label_error == got[1].label_error
    assert got[4].code is None and got[4].label_error is None
    assert [tuple(r)[1:4] for r in vc.code_vectors(spark.createDataFrame([(9, [], "b")], schema)).collect()] == [("00" * 16, 0, 0)]


def test_sums_of_hot_labels(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(16)], "hot" if i % 3 else f"l{i}") for i in range(3000)]
    got = vc.code_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"))
    error = {r.vec_id: r.error for r in got.collect()}
    hot = sum(e for i, e in error.items() if i % 3)
    assert all(r.label_error == (hot if r.vec_id % 3 else r.error) for r in got.collect())
