"""The manifest against a plain tree, with odd tables and small superblocks."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftline.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def root_and_proofs(nodes):
    """The root, and for each node (before, after) of every level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            proofs[k].append((run[: p % 8], run[p % 8 + 1 :]))
            at[k] = p // 8
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return (nodes or [None])[0], proofs


def plain(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    inner = {x: root_and_proofs([leaf(r, r[1]) for r in trees[x]]) for x in langs}
    root, top = root_and_proofs([inner[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, proof in zip(trees[x], inner[x][1], strict=True):
            path = proof + top[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            node = leaf(r, r[1].translate(_FOLD) if hit else r[1])
            for before, after in path:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r, r[1]), inner[x][0], root, h(*(n for b, a in path for n in [*b, *a])), node, node == root))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()), key=repr)


def corpus(n, langs=("en", "de", None, "", "é", "zz"), seed=1):
    rng = random.Random(seed)
    rows = [(k * 3, rng.choice(["Ab", "c", "É", "", None]) and f"Text {k}" * rng.randrange(3), rng.choice(langs), rng.choice(["s", None]), rng.choice([1, None])) for k in range(n)]
    return rows


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(1), "pos": F.lit("x"), "leaf": F.lit(None).cast("int"), "total": F.lit(0), "node": F.lit("n")}).repartition(n)


@pytest.mark.parametrize(("n", "langs", "levels"), [(0, ("en",), 4), (1, ("en",), 4), (1, (None,), 1), (8, ("en",), 1), (9, ("en",), 1), (65, ("en",), 1), (90, ("en", None), 1), (200, ("en", "de", None, "", "é", "zz"), 4)])
def test_small_trees(spark, n, langs, levels):
    rows = corpus(n, langs)
    assert rows_of(merkle.manifest(frame(spark, rows), levels)) == plain(rows)


def test_superblocks_of_any_size_give_one_result(spark):
    rows = corpus(700, ("en", "en", "en", "de"))
    assert rows_of(merkle.manifest(frame(spark, rows), 1)) == rows_of(merkle.manifest(frame(spark, rows), 2)) == plain(rows)


def test_more_languages_than_a_superblock(spark):
    rows = corpus(150, tuple(f"l{k}" for k in range(70)))
    assert rows_of(merkle.manifest(frame(spark, rows), 1)) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "A" * 300_000, "en", "s", 3), (7, "A" * 300_000, "en", "s", 3), (7, "b", "en", "s", 3), (2**62 + 1, "Ä|:-", "en", "-", -1), (None, "Q", "en", "", 0), (-5, "", "en", None, None)]
    rows += [(9, "same", "fr", "s", 4)] * 300
    got = merkle.manifest(frame(spark, rows))
    assert rows_of(got) == plain(rows)
    assert sorted(r.place for r in got.where("in_lang = 'fr'").collect()) == list(range(300))


def test_a_changed_document_changes_the_root(spark):
    rows = corpus(40)
    other = [(i, "changed" if i == 60 else t, *rest) for i, t, *rest in rows]
    roots = {rows_of(merkle.manifest(frame(spark, r)))[0][3] for r in (rows, rows[::-1], other)}
    assert len(roots) == 2


def test_query_against_a_plain_tree(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = rows_of(merkle.op11_merkle_manifest(spark, sf_dir))
    assert found == plain(rows) and {v for *_, v in found} == {True, False}
