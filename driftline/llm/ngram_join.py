"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are distinct texts (classes), columns 5-word shingles. Its blocks: a segment of rows
(``segments.dealt``) against a range of columns (a bucket).

1. Column sums. Segments send the distinct shingles of their rows with counts, a compressed blob for each bucket;
   buckets answer with the sums of the columns that several segments share. A column with one entry adds
   nothing to the product off the diagonal.
2. Row bounds. A row of n shingles links only to rows that share ceil(3n/4) of them at least, so rows with
   fewer shared columns go. In the order of (column sum, hash) two rows that link share one of their first
   n - ceil(3n/4) + 1 columns; only these entries are multiplied.
3. Product. Column blocks are multiplied in their buckets and the counts of row pairs summed over buckets. Pairs
   go whose sizes differ by more than a quarter, whose place in the order leaves too few further columns, or whose
   count, with all that the rest of the rows could add, stays below the overlap that their sizes demand.
   Rows of a dense column (over ``DENSE`` entries) would pair up quadratically: they are first multiplied
   with its first row only, then, where a column has rows of several components, with ``HEADS`` rows of the largest.
   What is left of a dense column are pairs across components, and these are all multiplied.
4. The pairs that remain get their exact overlap from the whole texts, in the segment of the larger identifier: shingles of
   equal hashes are compared word by word, so a link never rests on hashes. Set sizes count distinct 64-bit hashes within a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, even_keys, salted_lookup, table
from driftline.llm.components import connected_components
from driftline.llm.segments import Segment, dealt, describe, pack_texts, segments_for, unpack_texts
from driftline.llm.words import all_shingles, count_shingles, find, pack, shingles, spans, unpack, word_hashes

N = 5
#: Two rows link when NUM * union <= DEN * intersection, that is at a similarity of 0.75.
NUM, DEN = 3, 4
#: Columns with more entries are multiplied by way of their first row.
DENSE = 64
#: Bits of the hash by which column sums are kept; a chance meeting only makes a column look fuller.
COLUMN_BITS = 40
#: Rows of a component that stand for it before all its rows are met.
HEADS = 16
#: Row pairs that a bucket multiplies at once.
PAIRS = 1 << 20
#: Words of 64 bits of the bitmap that a row of a full column has of its shingles.
BITMAP = 8
BITS = [f"bits{k}" for k in range(BITMAP)]


def _tell(**columns: tuple) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _slices(sorted_values: np.ndarray, bits: int, n: int) -> Iterator[tuple[int, slice]]:
    edges = np.array([(k << bits) // n for k in range(1, n)], np.uint64)
    cuts = [0, *np.searchsorted(sorted_values, edges).tolist(), len(sorted_values)]
    return ((b, slice(cuts[b], cuts[b + 1])) for b in range(n) if cuts[b + 1] > cuts[b])


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.concatenate([start, [len(sorted_values)]]))


def _rows_of(s: Segment) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a segment's rows: shingle and row number."""
    sets = [shingles(s.words[a:b], N) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
    entries = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return entries, np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])


def _column_sums(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.sort(entries >> np.uint64(64 - COLUMN_BITS))
    start, size = _groups(q)
    return q[start], size


def _needed(n: np.ndarray) -> np.ndarray:
    """The least number of shingles that a row of ``n`` shares with a row that it links to."""
    return -(-NUM * n // DEN)


def prefix_entries(s: Segment, answers: list[bytes], dense_from: int = DENSE) -> tuple[np.ndarray, ...]:
    """(shingle, id, n, place, dense, has_dense, bitmaps) of the entries that are multiplied; only rows of full columns have a bitmap."""
    entries, row = _rows_of(s)
    every, of_row = entries, row
    q, total = _column_sums(entries)
    total = total.copy()
    for blob in answers:
        known, sums = unpack(blob)
        at = find(q, known)
        total[at[at >= 0]] = sums[at >= 0]
    df = total[find(q, entries >> np.uint64(64 - COLUMN_BITS))] if len(entries) else np.empty(0, np.int64)
    n = np.bincount(row, minlength=len(s.ids))
    shared = np.bincount(row, weights=df > 1, minlength=len(s.ids))
    live = shared >= _needed(n)
    use = live[row]
    entries, row, df = entries[use], row[use], df[use]
    order = np.lexsort((entries, df, row))
    entries, row, df = entries[order], row[order], df[order]
    start, size = _groups(row)
    place = np.arange(len(row)) - np.repeat(start, size)
    inside = (place < (n - _needed(n) + 1)[row]) & (df > 1)
    entries, row, df, place = entries[inside], row[inside], df[inside], place[inside]
    dense = df > dense_from
    has_dense = np.bincount(row, weights=dense, minlength=len(s.ids)) > 0
    marked = np.flatnonzero(has_dense[of_row])
    bits = np.zeros((len(s.ids), BITMAP), np.uint64)
    at = every[marked] % np.uint64(64 * BITMAP)
    np.bitwise_or.at(bits, (of_row[marked], (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return entries, s.ids[row], n[row], place, dense, has_dense[row], bits[row]


def multiply(h: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, dense: np.ndarray, seg: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row pairs of a column block: (a, b, seg_a, seg_b, n_a, n_b, count, can_reach, dense), a < b."""
    order = np.lexsort((ids, h))
    h, ids, n, place, dense, seg = (x[order] for x in (h, ids, n, place, dense, seg))
    start, size = _groups(h)
    for k in np.unique(size[size > 1]):
        i, j = np.triu_indices(k, 1)
        own = start[size == k]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(own), step):
            x = (own[at : at + step, None] + i).ravel()
            y = (own[at : at + step, None] + j).ravel()
            fits = (ids[x] != ids[y]) & (NUM * np.maximum(n[x], n[y]) <= DEN * np.minimum(n[x], n[y]))
            x, y = x[fits], y[fits]
            rest = np.minimum(n[x] - place[x], n[y] - place[y])
            reach = (NUM + DEN) * rest >= NUM * (n[x] + n[y])
            by = np.lexsort((ids[y], ids[x]))
            x, y, reach = x[by], y[by], reach[by]
            new = np.concatenate([[True], (ids[x][1:] != ids[x][:-1]) | (ids[y][1:] != ids[y][:-1])]) if len(x) else np.empty(0, bool)
            at_new = np.flatnonzero(new)
            if len(at_new):
                count = np.diff(np.concatenate([at_new, [len(x)]]))
                x0, y0 = x[at_new], y[at_new]
                yield ids[x0], ids[y0], seg[x0], seg[y0], n[x0], n[y0], count, np.maximum.reduceat(reach, at_new), dense[x0] & dense[y0]


class Shown:
    """A text whose links are verified: its words joined by one space, where each begins and ends, and its shingles."""

    def __init__(self, text: bytes) -> None:
        self.text = b" ".join(text.split())
        self.starts, self.ends = spans(np.frombuffer(self.text, np.uint8)) if self.text else (np.empty(0, np.int64), np.empty(0, np.int64))
        words, _ = word_hashes([self.text])
        self.width = min(N, len(words))
        self.hashes, self.places = np.unique(all_shingles(words, N), return_index=True)
        #: Whether different shingles of the text have one hash.
        self.meets = count_shingles(self.text, words, N) != len(self.hashes)

    def grams(self) -> set[tuple[bytes, ...]]:
        words = self.text.split()
        return {tuple(words[k : k + self.width]) for k in range(len(words) - self.width + 1)}

    def links(self, other: Shown) -> bool:
        """Whether two texts share enough shingles. Those of equal hashes are compared word by word, in runs of both texts."""
        if self.meets or other.meets:
            return self.shares(other)
        at = find(other.hashes, self.hashes)
        mine, theirs = self.places[at >= 0], other.places[at[at >= 0]]
        if (NUM + DEN) * len(mine) < NUM * (len(self.hashes) + len(other.hashes)):
            return False
        order = np.argsort(mine)
        mine, theirs = mine[order], theirs[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(mine) != 1) | (np.diff(theirs) != 1)]))
        last = np.append(first[1:], len(mine)) - 1
        runs = zip(
            self.starts[mine[first]].tolist(), self.ends[mine[last] + self.width - 1].tolist(), other.starts[theirs[first]].tolist(), other.ends[theirs[last] + other.width - 1].tolist(), strict=True
        )
        if self.width == other.width and all(self.text[a:b] == other.text[c:d] for a, b, c, d in runs):
            return True
        return self.shares(other)

    def shares(self, other: Shown) -> bool:
        """Whether two texts share enough shingles, all compared as words."""
        x, y = self.grams(), other.grams()
        return (NUM + DEN) * len(x & y) >= NUM * (len(x) + len(y))


def _exact(segs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b, seg_a, seg_b) that link, by the shingles of their whole texts."""

    def ship(t: pa.Table, wanted: pa.Table) -> pa.Table:
        to: dict[int, set[int]] = {}
        for i, dst in zip(wanted["id"].to_pylist(), wanted["dst"].to_pylist(), strict=True):
            to.setdefault(dst, set()).add(i)
        needed = set().union(*to.values()) if to else set()
        texts: dict[int, list[tuple[tuple[int, int], bytes]]] = {}
        for blob in t["blob"].to_pylist() if needed else []:
            for i, key, text in zip(*unpack_texts(blob), strict=True):
                if i in needed and (key, text) not in texts.setdefault(i, []):
                    texts[i].append((key, text))
        sent = {dst: [(i, *x) for i in sorted(ids) for x in texts.get(i, [])] for dst, ids in to.items()}
        return _tell(seg=(list(sent), pa.int32()), blob=([pack_texts(*map(list, zip(*x, strict=True))) if x else pack_texts([], [], []) for x in sent.values()], pa.binary()))

    def sets(blobs: list[bytes], ids: set[int], into: dict[int, dict[tuple[int, int], Shown]]) -> None:
        for blob in blobs:
            for i, key, text in zip(*unpack_texts(blob), strict=True):
                if i in ids and key not in into.setdefault(i, {}):
                    into[i][key] = Shown(text)

    def overlap(t: pa.Table, asked: pa.Table) -> pa.Table:
        todo = [(a, b) for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True) if a is not None]
        left: dict[int, dict[tuple[int, int], Shown]] = {}
        right: dict[int, dict[tuple[int, int], Shown]] = {}
        sets([x for x in asked["blob"].to_pylist() if x is not None], {a for a, _ in todo}, left)
        sets(t["blob"].to_pylist() if todo else [], {b for _, b in todo}, right)
        linked = []
        for a, b in todo:
            if any(x.links(y) for x in left.get(a, {}).values() for y in right.get(b, {}).values()):
                linked.append((a, b))
        return _tell(a=([a for a, _ in linked], pa.int64()), b=([b for _, b in linked], pa.int64()))

    wanted = pairs.select(F.col("seg_a").alias("seg"), F.col("a").alias("id"), F.col("seg_b").alias("dst")).distinct()
    shipped = segs.groupBy("seg").cogroup(wanted.groupBy("seg")).applyInArrow(ship, "seg int, blob binary")
    none = F.lit(None).cast("long")
    asked = shipped.select("seg", "blob", none.alias("a"), none.alias("b")).unionByName(
        pairs.select(F.col("seg_b").alias("seg"), F.lit(None).cast("binary").alias("blob"), "a", "b").distinct()
    )
    return segs.groupBy("seg").cogroup(asked.groupBy("seg")).applyInArrow(overlap, "a long, b long")


def ngram_join(docs: DataFrame, dense_from: int = DENSE) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, n_shingles, component_id.

    After lower-casing A-Z, a document's set are its distinct 5-word shingles, or its whole sequence of words if
    that is shorter; a null or empty text, or one of white space only, has none and links with nothing. Two
    documents link when 100 * intersection >= 75 * union; ``component_id`` is the smallest identifier reachable
    by links. A row with a null identifier gets its number of shingles and a null component, and links nothing. Rows that
    repeat an identifier share its links. Texts and words may be of any length. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    n = segments_for(docs)
    keys = even_keys(spark, n)
    segs = dealt(docs, True, n)

    def column_sums(t: pa.Table) -> pa.Table:
        q, size = _column_sums(_rows_of(Segment(t["blob"].to_pylist()))[0])
        cuts = list(_slices(q, COLUMN_BITS, n))
        return _tell(bucket=([keys[b] for b, _ in cuts], pa.int32()), seg=([t["seg"][0].as_py()] * len(cuts), pa.int32()), blob=([pack(q[x], size[x]) for _, x in cuts], pa.binary()))

    def total_sums(t: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in t["blob"].to_pylist()]
        q = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts]).astype(np.int64)
        who = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        order = np.argsort(q, kind="stable")
        q, size, who = q[order], size[order], who[order]
        start, times = _groups(q)
        total = np.repeat(np.add.reduceat(size, start), times)
        shared = np.flatnonzero(np.repeat(times > 1, times))
        shared = shared[np.argsort(who[shared], kind="stable")]
        ends = np.searchsorted(who[shared], np.arange(len(parts) + 1))
        back = [(k, shared[a:z]) for k, a, z in zip(range(len(parts)), ends[:-1], ends[1:], strict=True) if z > a]
        back = [(t["seg"][k].as_py(), pack(q[x], total[x])) for k, x in back]
        return _tell(seg=([k for k, _ in back], pa.int32()), blob=([x for _, x in back], pa.binary()))

    def entries(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        if t.num_rows:
            h, ids, size, place, dense, has_dense, bits = prefix_entries(Segment(t["blob"].to_pylist()), answers["blob"].to_pylist(), dense_from)
            for is_dense in (False, True):
                x = np.flatnonzero(dense == is_dense)
                x = x[np.argsort(h[x], kind="stable")]
                for b, cut_ in _slices(h[x], 64, n):
                    y = x[cut_]
                    out.append((keys[b], is_dense, pack(h[y], ids[y], size[y], place[y], has_dense[y], *(bits[y].T if is_dense else ()))))
        seg = [t["seg"][0].as_py()] * len(out) if out else []
        return _tell(bucket=([x[0] for x in out], pa.int32()), seg=(seg, pa.int32()), dense=([x[1] for x in out], pa.bool_()), blob=([x[2] for x in out], pa.binary()))

    pair_schema = "a long, b long, seg_a int, seg_b int, n_a long, n_b long, c long, reach boolean, dense boolean"

    def product(t: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in t["blob"].to_pylist()]
        h, ids, size, place, dense = (np.concatenate([p[k] for p in parts]) for k in range(5))
        seg = np.repeat(np.array(t["seg"].to_pylist(), np.int64), [len(p[0]) for p in parts])
        found = list(multiply(h, ids.astype(np.int64), size.astype(np.int64), place.astype(np.int64), dense > 0, seg))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 7 + [np.empty(0, bool)] * 2
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        names = [x.split()[0] for x in pair_schema.split(", ")]
        return pa.table({k: pa.array(v.astype(np.int32) if t_ == pa.int32() else v, t_) for k, v, t_ in zip(names, columns, kinds, strict=True)})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, blob in zip(batch["seg"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                h, ids, size, place, _, *bits = unpack(blob)
                whole = [pa.array(x.view(np.int64)) for x in (h, ids, size, place, *bits)]
                yield pa.RecordBatch.from_arrays([*whole, pa.array([seg] * len(h), pa.int32())], names=["h", "id", "n", "place", *BITS, "seg"])

    told = segs.groupBy("seg").applyInArrow(column_sums, "bucket int, seg int, blob binary").groupBy("bucket").applyInArrow(total_sums, "seg int, blob binary")
    multiplied = cut(segs.groupBy("seg").cogroup(told.groupBy("seg")).applyInArrow(entries, "bucket int, seg int, dense boolean, blob binary"))
    counted = (
        multiplied.where("NOT dense").drop("dense").groupBy("bucket").applyInArrow(product, pair_schema)
        .groupBy("a", "b", "seg_a", "seg_b", "n_a", "n_b").agg(F.sum("c").alias("c"), F.max("reach").alias("reach"), F.max("dense").alias("dense"))
    )
    # what the columns after the multiplied ones could still add to a pair's count
    rest = F.ceil(F.greatest("n_a", "n_b") * NUM / DEN) - 1
    sparse = counted.where(F.col("dense") | (F.col("reach") & ((NUM + DEN) * (F.col("c") + rest) >= NUM * (F.col("n_a") + F.col("n_b"))))).select("a", "b", "seg_a", "seg_b")
    dense = cut(multiplied.where("dense").select("seg", "blob").mapInArrow(listed, f"h long, id long, n long, place long, {', '.join(f'{b} long' for b in BITS)}, seg int"))

    def fits(n_a: str, n_b: str):
        return NUM * F.greatest(n_a, n_b) <= DEN * F.least(n_a, n_b)

    def could(x: str, y: str):
        """Whether two rows can share enough: each bit that only one has is a shingle at least that the other lacks."""
        only = [reduce(add, (F.bit_count(F.col(f"{p}{b}").bitwiseAND(F.bitwise_not(F.col(f"{q}{b}")))) for b in BITS)) for p, q in ((x, y), (y, x))]
        most = F.least(F.col(f"{x}n") - only[0], F.col(f"{y}n") - only[1])
        return (NUM + DEN) * most >= NUM * (F.col(f"{x}n") + F.col(f"{y}n"))

    row = F.struct("id", "seg", "n", *BITS)
    heads = dense.groupBy("h").agg(F.min(row).alias("head"))
    star = salted_lookup(dense, heads, ["h"], "id").where((F.col("id") != F.col("head.id")) & fits("n", "head.n") & could("", "head."))
    star = star.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.seg").alias("seg_a"), F.col("seg").alias("seg_b"))
    links = cut(_exact(segs, sparse.unionByName(star).distinct()))
    labels = connected_components(links)

    # dense columns whose rows aren't all in one component yet: pairs across components
    def labelled(labels: DataFrame) -> DataFrame:
        return dense.join(labels, dense["id"] == labels["node"], "left").select(dense["*"], F.coalesce("component", "id").alias("comp"))

    def mixed_columns(labels: DataFrame) -> DataFrame:
        """(h, main): the dense columns of several components, and the one that has most rows in each."""
        mixed = labelled(labels).groupBy("h", "comp").agg(F.count(F.lit(1)).alias("size"))
        tops = mixed.groupBy("h").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
        return cut(tops.where("comps > 1").select("h", F.col("top.comp").alias("main")))

    main = mixed_columns(labels)
    if not main.isEmpty():
        # rows outside a column's main component meet a few rows of it first, which joins most of them to it
        drawn = labelled(labels).groupBy("comp", F.pmod(F.xxhash64("id"), F.lit(HEADS)).alias("k")).agg(F.min(row).alias("head"))
        heads = drawn.groupBy(F.col("comp").alias("main")).agg(F.collect_list("head").alias("heads"))
        outside = salted_lookup(labelled(labels), main, ["h"], "id").where("comp != main").select("id", "seg", "n", *BITS, "main").distinct()
        met = salted_lookup(cut(outside), heads, ["main"], "id").select("id", "seg", "n", *BITS, F.explode("heads").alias("y")).where(fits("n", "y.n") & could("", "y."))
        swap = F.col("id") > F.col("y.id")
        met = met.select(
            F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b"),
            F.when(swap, F.col("y.seg")).otherwise(F.col("seg")).alias("seg_a"), F.when(swap, F.col("seg")).otherwise(F.col("y.seg")).alias("seg_b"),
        ).distinct()
        links = cut(links.unionByName(_exact(segs, met)))
        labels = connected_components(links)
        main = mixed_columns(labels)
    if not main.isEmpty():
        here = salted_lookup(labelled(labels), main, ["h"], "id").where("main IS NOT NULL")
        here = cut(here.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")))
        strays = here.where("comp != main").drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        x, y = strays.alias("x"), here.alias("y")
        # a pair of two strays is met from both sides; it counts once, from the smaller identifier
        across = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
        left = 7 * F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= 3 * (F.col("x.n") + F.col("y.n"))
        pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.salt") == F.col("y.salt")) & across & fits("x.n", "y.n") & left & could("x.", "y."))
        first = F.col("x.id") < F.col("y.id")
        pairs = pairs.select(
            F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"),
            F.when(first, F.col("x.seg")).otherwise(F.col("y.seg")).alias("seg_a"), F.when(first, F.col("y.seg")).otherwise(F.col("x.seg")).alias("seg_b"),
        ).distinct()
        labels = connected_components(links.unionByName(_exact(segs, pairs)))

    facts = cut(describe(docs, fold_case=True, n_shingle=N))
    classes = facts.where("n_words > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("first_id"))
    placed = classes.join(labels, classes["first_id"] == labels["node"], "left").select("fp1", "fp2", F.coalesce("component", "first_id").alias("component_id"))
    found = salted_lookup(facts, placed, ["fp1", "fp2"], "doc_id")
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    lone = docs.where(F.col("doc_id").isNull()).select(F.lit(0).cast("long").alias("doc_id"), F.col("text"))
    lone = describe(lone, fold_case=True, n_shingle=N).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(lone)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents`` by 5-word shingles at a Jaccard similarity of 0.75."""
    return ngram_join(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS u(i) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)
), two AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
