"""Substring deduplication by fixed-block anchors.

A repeat of at least 13 words contains, wherever it starts, a whole block of 7 words of any cutting of the
earlier document into consecutive blocks. So only non-overlapping blocks are indexed, one word position in
seven, and every rolling 7-word window of every document probes them. Hits are anchors: 13-word windows that
contain one are compared with those around the anchors of the other documents, and runs of windows
that agree are the maximal repeats. Each word of a repeat goes unless its document is the first that has it. Windows are
compared by two independent 64-bit hashes of their words (``words.ngram_hashes``; 128 bits together), anchors by 40 bits of one.

Execution: documents are dealt once into segments (``segments.dealt``). Each segment sends the distinct hashes of
its windows, with a flag for those that start a block, to the bucket of their hash, a compressed blob for each
(segment, bucket); buckets tell a segment which of its hashes occur in another segment and are indexed somewhere.
A second exchange of the same shape, over the windows around anchors only, tells each segment the smallest
identifier that has a window. However often a window occurs, a segment sends it once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, even_keys, table
from driftline.llm.segments import Segment, dealt, describe, segments_for
from driftline.llm.words import among, inside_text, ngram_hashes, pack, unpack, word_hashes

WINDOW = 13
#: The longest block that every window of 13 words contains whole, however the blocks lie.
BLOCK = (WINDOW + 1) // 2
#: Bits of the hash that selects anchors; a chance hit is thrown out when its windows are compared.
ANCHOR_BITS = 40
_EMPTY = np.empty(0, np.uint64)


def _by_bucket(sorted_hashes: np.ndarray, bits: int, n: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each non-empty slice of sorted ``bits``-bit hashes, cut into ``n`` ranges."""
    edges = np.array([min((k << bits) // n, (1 << 64) - 1) for k in range(1, n)], np.uint64)
    cuts = [0, *np.searchsorted(sorted_hashes, edges).tolist(), len(sorted_hashes)]
    return [(b, cuts[b], cuts[b + 1]) for b in range(n) if cuts[b + 1] > cuts[b]]


def _anchors(s: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each rolling block: its hash, whether it lies in one text, its text, and whether it is indexed."""
    q = ngram_hashes(s.words, BLOCK) >> np.uint64(64 - ANCHOR_BITS)
    ok = inside_text(s.first, BLOCK, len(q))
    doc = s.doc_of_word()[: len(q)]
    return q, ok, doc, (np.arange(len(q), dtype=np.int32) - s.first.astype(np.int32)[doc]) % BLOCK == 0


def _summary(s: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of a segment, whether each is indexed, and whether two of its texts have it."""
    q, ok, doc, indexed = _anchors(s)
    q, doc, indexed = q[ok], doc[ok], indexed[ok]
    if not len(q):
        return _EMPTY, np.empty(0, bool), np.empty(0, bool)
    order = np.argsort(q)
    h, doc = q[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    flag = np.logical_or.reduceat(indexed[order], start)
    return h[start], flag, np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)


def _rows(**columns: tuple[list, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _found(s: Segment, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows around anchors: their first words and two independent hashes. Answers are places in the summary."""
    q, ok, _, _ = _anchors(s)
    h, flag, several = _summary(s)
    hit_of = flag & several
    for blob in answers:
        hit_of[unpack(blob)[0].astype(np.int64)] = True
    hit = ok & among(h[hit_of], q)
    del q, ok, h, flag, several
    size = max(0, len(s.words) - WINDOW + 1)
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    near = total[WINDOW - BLOCK + 1 : WINDOW - BLOCK + 1 + size] > total[:size]
    at = np.flatnonzero(near & inside_text(s.first, WINDOW, size))
    own = ngram_hashes(s.words, WINDOW)[at]
    return at, own, ngram_hashes(word_hashes(s.texts, 1, s.drawn)[0], WINDOW)[at]


def _runs(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where runs of equal pairs begin."""
    return np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.empty(0, np.int64)


def _firsts(s: Segment, at: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows (both hashes), the smallest identifier of this segment that has each, and each window's place among them."""
    order = np.lexsort((g, h))  # stable, and texts are in the order of their identifiers
    start = _runs(h[order], g[order])
    of = np.empty(len(h), np.int64)
    of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
    return h[order[start]], g[order[start]], s.ids[s.doc_of_word()[at[order[start]]]] if len(h) else np.empty(0, np.int64), of


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes when a window of 13 consecutive words covers it whose sequence of words also starts in a document
    with a smaller identifier; windows are judged on the input. ``kept_sha256`` is the SHA-256 of the words that
    stay, joined by one space.

    A null or empty text has no words. A row with a null identifier is neither searched nor a reference: it keeps
    all its words. Rows that repeat an identifier don't remove each other's words. An empty table gives an empty
    result; other columns are ignored. Texts may be of any length.
    """
    spark = docs.sparkSession
    n = segments_for(docs)
    keys = even_keys(spark, n)
    segs = dealt(docs, False, n)

    def asked_of(t: pa.Table, cuts: list[tuple[int, int, int]], *columns: np.ndarray) -> pa.Table:
        """A segment's sorted columns, a blob for each bucket; ``base`` is the place of the blob's first row in them."""
        size = len(cuts)
        seg = [t["seg"][0].as_py()] * size
        return _rows(bucket=([keys[b] for b, _, _ in cuts], pa.int32()), seg=(seg, pa.int32()), base=([a for _, a, _ in cuts], pa.int64()), blob=([pack(*(c[a:z] for c in columns)) for _, a, z in cuts], pa.binary()))

    def gathered(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The columns of a bucket's blobs, one after the other, and the blob and the place in its segment of each row."""
        parts = [unpack(b) for b in t["blob"].to_pylist()]
        sizes = [len(p[0]) for p in parts]
        who = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        place = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.array(t["base"].to_pylist(), np.int64), sizes)
        return [np.concatenate(c) for c in zip(*parts, strict=True)], who, place

    def answered(t: pa.Table, wanted: np.ndarray, who: np.ndarray, place: np.ndarray, *columns: np.ndarray) -> pa.Table:
        """Tells each segment the places of its rows that are wanted, with columns."""
        at = np.flatnonzero(wanted)
        at = at[np.lexsort((place[at], who[at]))]
        ends = np.searchsorted(who[at], np.arange(t.num_rows + 1))
        back = [(t["seg"][k].as_py(), pack(place[at[a:z]], *(c[at[a:z]] for c in columns))) for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
        return _rows(seg=([k for k, _ in back], pa.int32()), blob=([x for _, x in back], pa.binary()))

    def probes(t: pa.Table) -> pa.Table:
        h, flag, _ = _summary(Segment(t["blob"].to_pylist()))
        return asked_of(t, _by_bucket(h, ANCHOR_BITS, n), h, flag)

    def anchored(t: pa.Table) -> pa.Table:
        (h, flag), who, place = gathered(t)
        order = np.argsort(h, kind="stable")
        h, flag, who, place = h[order], flag[order], who[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        shared = np.repeat((size > 1) & (np.maximum.reduceat(flag, start) > 0), size)
        return answered(t, shared, who, place)

    def windows(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows(bucket=([], pa.int32()), seg=([], pa.int32()), base=([], pa.int64()), blob=([], pa.binary()))
        s = Segment(t["blob"].to_pylist())
        h, g, ids, _ = _firsts(s, *_found(s, answers["blob"].to_pylist()))
        return asked_of(t, _by_bucket(h, 64, n), h, g, ids)

    def first_owners(t: pa.Table) -> pa.Table:
        (h, g, ids), who, place = gathered(t)
        ids = ids.astype(np.int64)
        order = np.lexsort((g, h))
        h, g, ids, who, place = h[order], g[order], ids[order], who[order], place[order]
        start = _runs(h, g)
        least = np.repeat(np.minimum.reduceat(ids, start), np.diff(np.append(start, len(h))))
        return answered(t, least < ids, who, place, least)

    def removal(t: pa.Table, anchors: pa.Table, owners: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows:
            s = Segment(t["blob"].to_pylist())
            at, h, g = _found(s, anchors["blob"].to_pylist())
            doc = s.doc_of_word()
            _, _, own, of = _firsts(s, at, h, g)
            for blob in owners["blob"].to_pylist():
                place, ids = unpack(blob)
                own[place.astype(np.int64)] = np.minimum(own[place.astype(np.int64)], ids.astype(np.int64))
            least = own[of]
            gone = at[s.ids[doc[at]] > least]
            edge = np.zeros(len(s.words) + 1, np.int32)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + WINDOW, -1)
            keep = np.cumsum(edge[:-1]) == 0
            removed = np.add.reduceat((~keep).astype(np.int64), s.first[:-1])
            for k, (i, key, r) in enumerate(zip(s.ids.tolist(), s.keys, removed.tolist(), strict=True)):
                sha = None
                if r:
                    left = compress(s.texts[k].split(), keep[s.first[k] : s.first[k + 1]].tolist())
                    sha = hashlib.sha256(b" ".join(left)).hexdigest()
                out.append((i, *key, r, sha))
        kinds = {"doc_id": pa.int64(), "fp1": pa.int64(), "fp2": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        return pa.table({name: pa.array([x[k] for x in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    tell, ask = "seg int, blob binary", "bucket int, seg int, base long, blob binary"
    anchors = cut(segs.groupBy("seg").applyInArrow(probes, ask).groupBy("bucket").applyInArrow(anchored, tell))
    asked = segs.groupBy("seg").cogroup(anchors.groupBy("seg")).applyInArrow(windows, ask)
    owners = cut(asked.groupBy("bucket").applyInArrow(first_owners, tell))
    # a segment's two kinds of answers travel in one table, told apart by a flag
    told = anchors.withColumn("last", F.lit(False)).unionByName(owners.withColumn("last", F.lit(True)))

    def removal_of(t: pa.Table, both: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        return removal(t, both.filter(pc.invert(both["last"])), both.filter(both["last"]))

    classes = segs.groupBy("seg").cogroup(told.groupBy("seg")).applyInArrow(removal_of, "doc_id long, fp1 long, fp2 long, n_removed long, kept_sha256 string")
    facts = describe(docs, fold_case=False)
    joined = facts.join(classes.withColumn("first_copy", F.lit(True)), ["doc_id", "fp1", "fp2"], "left")
    # a copy of a smaller document loses every word if it has a window at all
    copy_removed = F.when(F.col("n_words") >= WINDOW, F.col("n_words")).otherwise(F.lit(0))
    n_removed = F.when(F.col("first_copy"), F.col("n_removed")).otherwise(copy_removed)
    sha = F.when(F.col("first_copy"), F.coalesce("kept_sha256", "words_sha256")).when(F.col("n_words") >= WINDOW, F.sha2(F.lit(b""), 256)).otherwise(F.col("words_sha256"))
    found = joined.select("doc_id", "n_words", n_removed.alias("n_removed"), sha.alias("kept_sha256"))
    return found.unionByName(_without_id(docs))


def _without_id(docs: DataFrame) -> DataFrame:
    """Rows of a null identifier keep all their words."""
    lone = docs.where(F.col("doc_id").isNull()).select(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    return lone.select(F.lit(None).cast("long").alias("doc_id"), F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.encode(F.array_join("w", " "), "UTF-8"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 13 words or more in ``documents``."""
    return substring_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM w, unnest(range(1, greatest(len(words) - 12, 0) + 1)) AS u(i)
), least AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT win.doc_id, win.i + k AS i FROM win JOIN least USING (g), unnest(range(0, 13)) AS v(k) WHERE win.doc_id > least.m
), lists AS (
  SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id
"""
