"""Exact dedup, n-gram join, substring dedup and embedding dedup against brute force, with their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import components, embedding_dedup, exact_dedup, ngram_join, substring_dedup, words
from tests.llm import brute

DOCS = "doc_id long, text string"


def frame(spark, rows, n=3):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, DOCS).withColumns({"seg": F.lit("x"), "run": F.lit(1.5), "fp1": F.lit(0), "n": F.lit(None).cast("string"), "keep_id": F.lit(3)})
    return df.repartition(n)


def corpus(seed=0, families=12):
    """Texts with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, i = [], 100
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                at = rng.randrange(len(copy) + 1)
                copy[at:at] = passage[: rng.choice([12, 13, 30])]
            i += rng.randrange(1, 5)
            text = rng.choice([" ", "\n", "\t  "]).join(copy)
            rows.append((i, text.upper() if rng.random() < 0.2 else text))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, " "), (8, "a b c"), (9, "x " * 3000), (10, "x " * 2999 + "y")]
    rng.shuffle(rows)
    return rows


def test_words_are_those_of_the_pattern():
    texts = ["", "  ", "a", " b\tc\nd\x0be\x0cf\rg ", "é ü x y", "z" * 10_000 + " q"]
    hashes, first = words.word_hashes([t.encode() for t in texts])
    assert np.diff(first).tolist() == [len(brute.WORD.findall(t)) for t in texts]
    again, _ = words.word_hashes([b"g"])
    assert again[0] == hashes[first[4] - 1]


def test_words_over_chunks(monkeypatch):
    text = " ".join(f"word{k * 37 % 1000}" for k in range(5000)).encode()
    whole, _ = words.word_hashes([text, b"x", text])
    monkeypatch.setattr(words, "CHUNK", 777)
    parts, first = words.word_hashes([text, b"x", text])
    assert (whole == parts).all() and first.tolist() == [0, 5000, 5001, 10001]


def thue_morse(n, a, b):
    return [b if k.bit_count() % 2 else a for k in range(n)]


@pytest.mark.parametrize("way", [0, 1])
def test_hashes_of_regular_texts_differ(way):
    words_ = [b"a" * k for k in range(1, 200)] + [b"a" * k + b"\x05" for k in range(1, 200)] + [b"\x00" * k for k in range(1, 20)]
    words_ += ["".join(thue_morse(n, *pair)).encode() for n in (8, 16, 64, 1024, 2048) for pair in ("ab", "ba")]
    hashes, _ = words.word_hashes(words_, way)
    assert len(np.unique(hashes)) == len(set(words_))
    for n in (5, 7, 13):
        grams = [b" ".join(b"a" if k >> j & 1 else b"b" for j in range(n)) for k in range(1 << n)]
        own, first = words.word_hashes(grams, way)
        assert len(np.unique(words.ngram_hashes(own, n)[first[:-1]])) == 1 << n


REGULAR = [
    [(1, "".join(thue_morse(2048, "a", "b"))), (2, "".join(thue_morse(2048, "b", "a")))],
    [(1, " ".join(thue_morse(2048, "a", "b"))), (2, " ".join(thue_morse(2048, "b", "a"))), (3, " ".join(thue_morse(2048, "a", "c")))],
    [(1, " ".join(["".join(thue_morse(2048, "a", "b"))] * 13)), (2, " ".join(["".join(thue_morse(2048, "b", "a"))] * 13)), (3, " ".join(["z" * 300_000] * 14)), (4, " ".join(["z" * 300_000] * 13))],
    [(1, "x " * 40_000), (2, "x " * 39_999 + "y"), (5, "only" * 100_000), (6, "only" * 100_000)],
]


@pytest.mark.parametrize("rows", REGULAR)
def test_regular_and_very_long_texts(spark, rows):
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect())) == brute.ngram_join(rows)
    assert sorted(map(tuple, substring_dedup.substring_dedup(frame(spark, rows)).collect())) == brute.substring_dedup(rows)


def test_links_are_verified_by_words(monkeypatch):
    a, b = ngram_join.Shown(b" ".join(b"p%d" % k for k in range(40))), ngram_join.Shown(b" ".join(b"q%d" % k for k in range(40)))
    b.hashes, b.places = a.hashes, a.places  # hashes that meet by chance
    assert not a.links(b) and a.links(ngram_join.Shown(a.text))


def test_packed_columns_come_back():
    a = np.array([3, 3, 2**63 + 5, 2**64 - 1], np.uint64)
    b = np.array([-1, 0, 7, 2**62])
    x, y = words.unpack(words.pack(a, b))
    assert (x == a).all() and (y.astype(np.int64) == b).all()
    assert [len(v) for v in words.unpack(words.pack(a[:0], b[:0]))] == [0, 0]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = corpus()
    found = exact_dedup.exact_dedup(frame(spark, rows), keep)
    assert sorted(map(tuple, found.collect())) == brute.exact_dedup(rows, min if keep == "smallest" else max)
    left = exact_dedup.survivors(frame(spark, rows), keep)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in brute.exact_dedup(rows, min if keep == "smallest" else max) if r[3])
    assert left.columns == frame(spark, rows).columns


@pytest.mark.parametrize(("depth", "bits"), [(4, 1), (5, 2), (7, 3)])
def test_rounds_of_the_tree(spark, depth, bits):
    rows = corpus(2)
    found = exact_dedup.cut(exact_dedup.digests(frame(spark, rows, 9)))
    runs = exact_dedup.merged_runs(found, "largest", bits, depth).collect()
    assert len({r.text_sha256 for r in runs}) == len(runs) == len({x[4] for x in brute.exact_dedup(rows)})
    assert all(r.run == (r.digest & (2**64 - 1)) >> (64 - depth) for r in runs)
    assert sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows, 9), "largest", bits, depth).collect())) == brute.exact_dedup(rows)


def test_runs_are_merged_in_sorted_order_without_python(spark):
    found = exact_dedup.exact_dedup(frame(spark, corpus(2)), "largest", 3, 7)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("SortAggregate") >= 4 and "Arrow" not in plan and "Python" not in plan


def test_survivors_keep_any_column(spark):
    rows = [(7, "c", "x"), (7, "c", "y"), (8, "d", "z"), (9, None, "n"), (10, "", "m"), (None, "long " * 50_000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumns({"_sha": F.lit(1), "whole": F.lit("w"), "of_id": F.lit(2.5), "leaf": F.col("_id")})
    left = exact_dedup.survivors(df, "largest")
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r._sha, r.whole, r.of_id, r.leaf == r._id) for r in left.collect()) == sorted((i, 1, "w", 2.5, True) for i in ("7", "8", "10", "None"))


def test_exact_dedup_of_odd_rows(spark):
    found = exact_dedup.exact_dedup(frame(spark, [(None, "a"), (5, "A"), (None, "b"), (7, "c"), (7, "c"), (8, "c")])).collect()
    by = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found)
    assert by == [("5", "5", 2, True), ("7", "7", 3, True), ("7", "7", 3, True), ("8", "7", 3, False), ("None", "5", 2, False), ("None", "None", 1, True)]
    assert exact_dedup.survivors(frame(spark, [(7, "c"), (7, "c"), (8, "c"), (None, "b")])).count() == 2
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="keep must be"):
        exact_dedup.exact_dedup(frame(spark, []), "newest")


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect())) == brute.ngram_join(rows)


@pytest.mark.parametrize("dense", [1, 3])
def test_ngram_join_with_dense_columns(spark, dense):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(40):  # a chain: neighbours link, ends don't
        text = list(base)
        for k in range(0, 3 * (i // 8)):
            text[k * 2 % 60] = f"u{k}_{i // 8}"
        text[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(base[:30] + [f"z{i}_{k}" for k in range(30)])) for i in range(20)]
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows), dense).collect())) == brute.ngram_join(rows)
    more = corpus(3)
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, more), dense).collect())) == brute.ngram_join(more)


def test_ngram_join_of_many_near_copies(spark):
    rng = random.Random(7)
    base = [f"t{k}" for k in range(80)]
    rows = []
    for i in range(90):
        text = list(base)
        text[rng.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(base[:40] + [f"z{i}_{k}" for k in range(40)])) for i in range(70)]
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect())) == brute.ngram_join(rows)


def test_ngram_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F")]
    found = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == [("2", 2, "2"), ("3", 2, "2"), ("3", 2, "2"), ("None", 2, "None")]
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


def test_overlaps_at_the_threshold(spark):
    def text(n):
        return " ".join(f"q{k}" for k in range(n))

    # 6 of 8 shingles is 0.75 exactly, 5 of 7 is below
    rows = [(1, text(12)), (2, text(10)), (3, "p " + text(11)), (4, "p " + text(9))]
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect())) == brute.ngram_join(rows)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, substring_dedup.substring_dedup(frame(spark, rows)).collect())) == brute.substring_dedup(rows)


def test_substring_dedup_at_every_offset(spark):
    passage = [f"p{k}" for k in range(13)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(i)] + passage + [f"b{i}_{k}" for k in range(20 - i)])) for i in range(20)]
    rows += [(50, " ".join(passage[:12])), (51, " ".join(passage))]
    assert sorted(map(tuple, substring_dedup.substring_dedup(frame(spark, rows)).collect())) == brute.substring_dedup(rows)


def test_substring_dedup_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(20))
    found = substring_dedup.substring_dedup(frame(spark, [(None, text), (4, text), (4, text), (9, text), (9, text + " more")])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in found) == [("4", 20, 0), ("4", 20, 0), ("9", 20, 20), ("9", 21, 20), ("None", 20, 0)]
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def vectors(seed=0, dim=24):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (1, 2, None):
        for _ in range(6):
            centre = rng.standard_normal(dim)
            for _ in range(int(rng.integers(1, 12))):
                v = centre + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.13, 0.2])
                i += int(rng.integers(1, 4))
                rows.append((i, [float(x) for x in np.float32(v * rng.choice([0.01, 1.0, 50.0]))], label))
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [nan] + [1.0] * (dim - 1), 1), (1003, [inf] + [1.0] * (dim - 1), 1), (1004, [1.0, None], 1), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [2.0, 4.0], 2)]
    return rows


@pytest.mark.parametrize(("tile", "aim"), [(32_768, 4096), (5, 4096), (32_768, 2), (4, 2)])
def test_embedding_dedup(spark, tile, aim, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SQUARE", 7)
    rows = vectors() + [(2000 + k, [1.0, 2.0, 3.0], 7) for k in range(40)] + [(3000, [1.0, 2.0, 3.1], 7), (3000, [1.0, 2.0, 3.0], 7)]
    rows = sorted(rows, key=repr)
    usable = [(i, v, lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(usable) for b in usable[:k] if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and brute.cosine(a[1], b[1]) >= 0.98]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least = brute.components(count, links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"cell": F.lit(1), "home": F.lit("x")})
    found = embedding_dedup.embedding_dedup(df, tile=tile, aim=aim)
    assert len(links) > 50
    assert sorted(map(tuple, found.collect())) == sorted((i, count[i], least[i], least[i] == i) for i, _, _ in rows)


def test_embedding_dedup_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)]
    found = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, schema)).collect())
    assert found == [("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("None", 0, None, True)]
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = list(zip(order, order[1:], strict=False))[:150] + [(1000, 1001), (1001, 1001)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = brute.components({x for pair in links for x in pair}, links)
    assert found == {i: m for i, m in least.items() if i != m}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_made_to_meet_under_a_fixed_hash(spark):
    first = 'rs18bf38 il5pj3jo xtda514t 3lq2ekeq 9eno6hsj kygg696u il5pj3jo xtda514t 3lq2ekeq o4"`mr75'
    found = ngram_join.ngram_join(spark.createDataFrame([(1, first), (2, first + " more words")], DOCS)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 6, 1), (2, 8, 1)]


def test_shingles_of_one_hash_are_counted_by_their_words():
    text = b"a b c d e f g a b c d e f g h"
    hashes, _ = words.word_hashes([text])
    assert words.count_shingles(text, hashes, 5) == len(brute.shingles(text.decode())) == 8
    assert words.count_shingles(text, np.zeros(15, np.uint64), 5) == 8
    assert words.count_shingles(b"a b", np.zeros(2, np.uint64), 5) == 1
    shown = ngram_join.Shown(text)
    shown.meets = True
    assert shown.links(ngram_join.Shown(text)) and not shown.links(ngram_join.Shown(b"a b c d e x y z"))


def test_keys_change_all_hashes():
    texts = [b"a bc def longerthaneight " + b"z" * 100]
    one, again, other = (words.word_hashes(texts, key=k)[0] for k in ((1, 2), (1, 2), (3, 2)))
    assert (one == again).all() and not (one == other).any() and words.drawn_key() != words.drawn_key()
