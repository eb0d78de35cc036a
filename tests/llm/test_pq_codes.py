"""Vector codes against plain loops, and the pruned search against full evaluation."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import pq_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=64, rounds=2):
    """(vec_id, code, error, label_error) and the codebooks' digest."""
    kept = [(i, [math.floor(256 * v) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    cut = [[tuple(x[k * w : k * w + w]) for k in range(16)] for _, x, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(16)]

    def best(k, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), n) for n, e in enumerate(books[k]))

    for _ in range(rounds):
        cells = defaultdict(list)
        for c in cut:
            for k in range(16):
                cells[k, best(k, c[k])[1]].append(c[k])
        for (k, n), own in cells.items():
            books[k][n] = tuple(sum(v) // len(own) for v in zip(*own, strict=True))
    found = [[best(k, c[k]) for k in range(16)] for c in cut]
    errors = defaultdict(int)
    for (_, _, label), f in zip(kept, found, strict=True):
        errors[label] += sum(d for d, _ in f)
    out = [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), errors[label]) for (i, _, label), f in zip(kept, found, strict=True)]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()


def rows_of(codes):
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()), key=repr)


def vectors(n, size=32, seed=0, spread=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(spread, size))
    return [(k * 7 % 1009, (centres[k % spread] + 0.2 * rng.normal(size=size)).astype(np.float32).tolist(), None if k % 5 == 0 else k % 3) for k in range(n)]


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit(1), "parts": F.lit("p"), "code": F.lit(None).cast("int")}).repartition(n)


@pytest.mark.parametrize(("n", "size"), [(300, 32), (64, 16), (20, 48), (1, 16)])
def test_against_plain_loops(spark, n, size):
    rows = vectors(n, size)
    codes, books = pq_codes.compress(frame(spark, rows))
    assert (rows_of(codes), pq_codes.books_digest(books)) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(80, 16)
    odd = [(2000, None, 1), (2001, [], 1), (2002, [nan] * 16, 1), (-1, [inf] + [0.0] * 15, 1), (2003, [None] + [0.0] * 15, 1), (-2, [None] * 16, None)]
    short = [(3000, [0.5] * 8, 1), (3001, [0.5] * 32, 1)]
    same = [(4000, [0.25] * 16, 9)] * 400 + [(None, [-0.001] * 16, None)] * 3
    codes, books = pq_codes.compress(frame(spark, rows + odd + short + same))
    assert (rows_of(codes), pq_codes.books_digest(books)) == plain(rows + odd[:1] + odd[2:] + same)
    empty, none = pq_codes.compress(frame(spark, rows).limit(0))
    assert empty.collect() == [] and none.size == 0
    assert pq_codes.compress(frame(spark, odd))[0].collect() == []
    longer_first = [(k, [0.1 * k] * (32 if k % 2 else 16), 0) for k in range(200)]
    codes, books = pq_codes.compress(frame(spark, longer_first))
    assert (rows_of(codes), pq_codes.books_digest(books)) == plain(longer_first[::2])


def test_large_components_stay_exact(spark):
    rows = [(k, [1e30 * (-1) ** (k + j) if j % 5 == 0 else float(k * j) for j in range(16)], 0) for k in range(70)]
    codes, _ = pq_codes.compress(frame(spark, rows))
    assert codes.count() == 70 and codes.where("error < 0").count() == 0


@pytest.mark.parametrize("width", [1, 4, 48])
def test_pruned_search_equals_full_evaluation(width):
    rng = np.random.default_rng(width)
    book = rng.integers(-400, 400, (64, width))
    book[10] = book[3]
    parts = np.concatenate([rng.integers(-400, 400, (500, width)), book, (book[:32] + book[32:]) // 2])
    pivots = pq_codes.chosen_pivots(book, 4)
    far = np.sqrt(pq_codes.square(parts[:, None], pivots[None]).astype(float))
    code, d, evaluated = pq_codes.nearest(parts, far, book, pivots)
    full = pq_codes.square(parts[:, None], book[None])
    assert (code == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    # evenly spread parts of many components are all about as far from each other
    assert evaluated < full.size * (0.7 if width < 16 else 0.9)


def test_query_against_plain_loops(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = pq_codes.op12_vector_codes(spark, sf_dir)
    expected, digest = plain(rows)
    assert rows_of(found) == expected and {r.codebooks_sha256 for r in found.collect()} == {digest}
