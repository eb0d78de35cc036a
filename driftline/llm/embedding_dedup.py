"""Near duplicates of embeddings by a subspace pigeonhole join.

Unit vectors are rotated by a seeded orthogonal matrix and split into blocks of a few dimensions. Two vectors
of cosine c lie at a squared distance of 2 - 2c, the sum of their squared distances in the blocks; so in one block
at least it stays within the block's share of 2 - 2 * threshold, in proportion to its dimensions. Each block is
range-joined by itself under that budget: its first coordinates make a grid whose cells are four radii wide, a vector
is at home in its cell and a guest in those that its radius reaches, and only homes and guests of a cell are compared. The
union over the blocks is verified by the exact cosine; a pair counts in the first block whose budget it meets, so it
is counted once without bringing pairs together.

Execution. Equal vectors of a label are one class with a number of members; classes are dealt once into parts, checkpointed.

1. Each part sends a blob for each cell that it reaches: the classes' numbers and one byte for each coordinate of the block and of
   the first ``WITNESSES`` blocks (rounded to 1/24 of the radius and clipped, with room for both in what follows).
2. In a cell, classes that have a candidate are found: near enough in the block, and not surely within the budget of a witness.
3. Only these classes' whole vectors go to the cell, which verifies in double precision and returns each home's number of
   links and a spanning star of each set that links connect, never pairs.

The grid of a label follows from the label's own size. Cells of more than ``TILE`` classes are cut into tiles of homes
against candidates, each a task's group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, cut_by, even_keys, near_lookup, partitions, salted_lookup, table
from driftline.llm.components import connected_components
from driftline.llm.words import mix64, pack, unpack

BLOCK_DIMS = 8
#: Classes of a cell's tile, at most.
TILE = 32_768
#: Rows and columns that are multiplied at once.
SQUARE = 2048
#: Classes of a cell that the grid aims at.
AIM = 4096
#: Grid coordinates of a block, at most.
GRID = BLOCK_DIMS
#: First blocks whose coordinates go along with all later ones.
WITNESSES = 2
#: Rounding steps in a block's radius.
STEPS = 24
#: Bytes of vectors of a part, about.
PART_BYTES = 1 << 26
#: What rounding may add to a distance between unit vectors.
SLACK = 1e-9
#: Cosines and distances this close to their bounds are worked out again by a plain sum, whatever product they came from.
CLOSE = 1e-11
CELL = ["label", "dim", "block", "cell"]


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """An orthogonal matrix drawn from a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, threshold: float) -> list[tuple[slice, float]]:
    """Each block's dimensions and its squared-distance budget."""
    n = max(1, -(-dim // BLOCK_DIMS))
    edges = [k * dim // n for k in range(n + 1)]
    return [(slice(a, b), (2 - 2 * threshold) * (b - a) / dim + SLACK) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def radius_of(budget: float) -> float:
    """A block's radius; not so small that a cell's number leaves a byte."""
    return max(math.sqrt(budget) + SLACK, 1 / 500)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow or underflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _values(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors from their bytes, of single or double precision."""
    wide = len(blobs[0]) == 8 * dim
    return np.frombuffer(b"".join(blobs), np.float64 if wide else np.float32).reshape(len(blobs), dim)


def _keyed(n_parts: int, keys: list[int], whole: bool):
    """Maps rows (vec_id, label, alone, vec) to the vectors that can link.

    (vec_id, part, key), or with ``whole`` (part, key, label, dim, vec), where a batch's equal vectors are one row. ``key`` is a digest of label and
    vector, and of the identifier where a row stands ``alone`` since its identifier has several vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vec"]
            flat = lists.flatten()
            kind = np.float32 if flat.type == pa.float32() else np.float64
            values = flat.cast(pa.float32() if kind is np.float32 else pa.float64()).to_numpy(zero_copy_only=False).astype(kind)
            sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            found: dict[bytes, tuple] = {}
            rows: list[tuple] = []
            for k, (i, label, alone) in enumerate(zip(batch["vec_id"].to_pylist(), batch["label"].to_pylist(), batch["alone"].to_pylist(), strict=True)):
                own = values[ends[k] - sizes[k] : ends[k]]
                if not len(own) or not np.isfinite(own).all() or not own.any():  # a null component reads as NaN
                    continue
                raw = own.tobytes()
                key = blake2b(b"%d:%d:%d:" % (label, i if alone else 0, alone) + raw, digest_size=16).digest()
                part = keys[int.from_bytes(key[:8], "little") % n_parts]
                if whole:
                    found[key] = (part, key, label, len(own), raw)
                else:
                    rows.append((i, part, key))
            if whole:
                rows, names, kinds = list(found.values()), ["part", "key", "label", "dim", "vec"], [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            else:
                names, kinds = ["vec_id", "part", "key"], [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    return run


def _cells(batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(dim, block, labels, rows, cells, turned, home) of a batch: who is in which cell, at home or, for each move to a neighbour, as a guest."""
    labels, dims, grids = (np.array(batch[c].to_pylist(), np.int64) for c in ("label", "dim", "grid"))
    blobs = batch["vec"].to_pylist()
    wide = np.array([len(b) for b in blobs]) // np.maximum(1, dims)
    for dim, g, w in sorted({(d, g, w) for d, g, w in zip(dims.tolist(), grids.tolist(), wide.tolist(), strict=True)}):
        rows = np.flatnonzero((dims == dim) & (grids == g) & (wide == w))
        turned = unit(_values([blobs[k] for k in rows], dim)) @ rotation(dim)
        for b, (where, budget) in enumerate(blocks_of(dim, threshold)):
            used = min(g, where.stop - where.start)
            x = turned[:, where][:, :used] / (4 * radius_of(budget))
            cell = np.floor(x).astype(np.int64)
            low, high = x - cell <= 0.25, x - cell >= 0.75
            for step in product((0, -1, 1), repeat=used):
                near = np.ones(len(rows), bool)
                code = np.zeros(len(rows), np.int64)
                for k, move in enumerate(step):
                    near &= True if move == 0 else low[:, k] if move < 0 else high[:, k]
                    code = code * 256 + (cell[:, k] + move + 128)
                if near.any():
                    yield dim, b, labels[rows[near]], rows[near], code[near], turned[near], not any(step)


def _groups(*columns: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each combination of values."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    new[:1] = True
    return iter(np.split(order, np.flatnonzero(new)[1:])) if len(order) else iter(())


def _sizes(threshold: float):
    """Maps classes to the sizes of cells: (label, dim, block, cell, homes, others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for dim, b, labels, _, code, _, home in _cells(batch, threshold):
                for at in _groups(labels, code):
                    entry = found.setdefault((int(labels[at[0]]), dim, b, int(code[at[0]])), [0, 0])
                    entry[0] += len(at) if home else 0
                    entry[1] += len(at)
            rows = [(*k, *v) for k, v in found.items()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=[*CELL, "homes", "others"])

    return run


def _rounded(turned: np.ndarray, where: slice, budget: float) -> np.ndarray:
    return np.clip(np.rint(turned[:, where] * (STEPS / radius_of(budget))), -127, 127).astype(np.int8)


def _blobs(threshold: float):
    """Maps classes to blobs for cells: (label, dim, block, cell, part, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, parts = np.array(batch["cid"].to_pylist(), np.int64), batch["part"].to_pylist()
            gathered: dict[tuple, list[tuple[np.ndarray, ...]]] = {}
            for dim, b, labels, rows, code, turned, home in _cells(batch, threshold):
                split = blocks_of(dim, threshold)
                shown = np.hstack([_rounded(turned, *split[k]) for k in (b, *range(min(b, WITNESSES)))])
                for at in _groups(labels, code):
                    key = (int(labels[at[0]]), dim, b, int(code[at[0]]), parts[rows[at[0]]])
                    gathered.setdefault(key, []).append((cids[rows[at]], np.full(len(at), home), shown[at]))
            rows_out = []
            for key, pieces in gathered.items():
                ids, home, shown = (np.concatenate(c) for c in zip(*pieces, strict=True))
                order = np.argsort(ids, kind="stable")
                rows_out.append((*key, pack_cell(ids[order], home[order], shown[order])))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            for at in range(0, len(rows_out), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_out[at : at + 1024]], t) for c, t in enumerate(kinds)], names=[*CELL, "part", "blob"])

    return run


def pack_cell(ids: np.ndarray, home: np.ndarray, shown: np.ndarray) -> bytes:
    """Sorted numbers, flags and rounded coordinates as one blob."""
    head = pack(ids, home)
    return len(head).to_bytes(4, "little") + head + np.ascontiguousarray(shown.T).tobytes()


def unpack_cell(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``pack_cell`` was given; flags as numbers."""
    size = int.from_bytes(blob[:4], "little")
    ids, flags = unpack(blob[4 : 4 + size])
    return ids.astype(np.int64), flags.astype(np.int64), np.frombuffer(blob, np.int8, offset=4 + size).reshape(-1, len(ids)).T


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts blobs of full cells (ni, nj) into tiles: (label, dim, block, cell, i, j, part, blob); flags: 1 home, 2 other."""
    for batch in batches:
        out = []
        for label, dim, block, cell, part, blob, ni, nj in zip(*(batch[c].to_pylist() for c in (*CELL, "part", "blob", "ni", "nj")), strict=True):
            ids, home, shown = unpack_cell(blob)
            hi, oj = ((mix64(ids.astype(np.uint64) + np.uint64(salt)) % np.uint64(n)).astype(np.int64) for salt, n in ((1, ni), (2, nj)))
            for i in range(ni):
                for j in range(nj):
                    flags = ((home > 0) & (hi == i)).astype(np.int64) + 2 * (oj == j)
                    if (use := flags > 0).any():
                        out.append((label, dim, block, cell, i, j, part, pack_cell(ids[use], flags[use], shown[use])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for at in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[at : at + 1024]], t) for c, t in enumerate(kinds)], names=[*CELL, "i", "j", "part", "blob"])


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``p`` to all rows of ``q``."""
    return (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)


def _candidates(threshold: float, tiled: bool):
    """Finds a tile's classes that have a candidate: (part, label, dim, block, cell, i, j, blob of numbers and flags)."""

    def run(t: pa.Table) -> pa.Table:
        at = {c: t[c][0].as_py() for c in (*CELL, "i", "j")}
        read = [unpack_cell(b) for b in t["blob"].to_pylist()]
        ids, flags = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read])
        flags = flags if tiled else flags | 2  # in a cell of one tile all are candidates
        shown = np.concatenate([r[2] for r in read])
        part = np.repeat(np.array(t["part"].to_pylist(), np.int64), [len(r[0]) for r in read])
        split = blocks_of(at["dim"], threshold)
        edges = np.cumsum([0, *(split[k][0].stop - split[k][0].start for k in (at["block"], *range(min(at["block"], WITNESSES))))])
        columns = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        homes, others = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
        wanted = np.zeros(len(ids), np.int64)
        x = shown.astype(np.float32)
        inside = np.stack([(np.abs(shown[:, c]) < 127).all(axis=1) for c in columns])
        for a in range(0, len(homes), SQUARE):
            for b in range(0, len(others), SQUARE):
                h, o = homes[a : a + SQUARE], others[b : b + SQUARE]
                width = columns[0].stop
                near = _squares(x[h, :width], x[o, :width]) <= (STEPS + math.sqrt(width)) ** 2 + 1
                near &= ids[h][:, None] != ids[o][None, :]
                for k, c in enumerate(columns[1:], 1):
                    if near.any():
                        sure = _squares(x[h, c], x[o, c]) < max(0.0, STEPS - math.sqrt(c.stop - c.start) - 0.5) ** 2
                        near &= ~(sure & inside[k][h][:, None] & inside[k][o][None, :])
                wanted[h[near.any(axis=1)]] |= 1
                wanted[o[near.any(axis=0)]] |= 2
        out = []
        some = np.flatnonzero(wanted)
        for rows in _groups(part[some]):
            rows = some[rows]
            rows = rows[np.argsort(ids[rows])]
            out.append((int(part[rows[0]]), pack(ids[rows], wanted[rows])))
        n = len(out)
        return pa.table({
            "part": pa.array([p for p, _ in out], pa.int32()), **{c: pa.array([at[c]] * n, k) for c, k in zip((*CELL, "i", "j"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)},
            "blob": pa.array([b for _, b in out], pa.binary()),
        })

    return run


def _shipped(asked: pa.Table, classes: pa.Table) -> pa.Table:
    """Answers a part's requests with whole vectors: (label, dim, block, cell, i, j, flags and members, identifiers, vectors)."""
    if not asked.num_rows:
        classes = classes.slice(0, 0)
    cids = classes["cid"].to_numpy().astype(np.int64) if classes.num_rows else np.empty(0, np.int64)
    order = np.argsort(cids)
    cids = cids[order]
    rep, members = (classes[c].to_numpy().astype(np.int64)[order] if classes.num_rows else cids for c in ("rep", "members"))
    vec = classes["vec"].combine_chunks() if classes.num_rows else None
    facts, vectors = [], []
    for blob in asked["blob"].to_pylist():
        ids, flags = unpack(blob)
        at = np.searchsorted(cids, ids.astype(np.int64))
        by = at[np.argsort(rep[at], kind="stable")]
        flag_of = dict(zip(ids.tolist(), flags.tolist(), strict=True))
        facts.append(pack(rep[by], members[by], np.array([flag_of[c] for c in cids[by].tolist()], np.int64), cids[by]))
        vectors.append(vec.take(pa.array(order[by])).to_pylist())
    n = len(facts)
    return pa.table({
        **{c: asked[c] if n else pa.array([], k) for c, k in zip((*CELL, "i", "j"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)},
        "facts": pa.array(facts, pa.binary()), "wide": pa.array([len(v[0]) for v in vectors], pa.int32()), "vec": pa.array([b"".join(v) for v in vectors], pa.binary()),
    })


def _spanned(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected to by links a - b."""
    least = np.arange(n)
    while len(a):
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, new[a])
        new = new[new]
        if (new == least).all():
            break
        least = new
    return least


def _verified(threshold: float):
    """Joins one tile by whole vectors: (vec_id, n_links, root)."""

    def run(t: pa.Table) -> pa.Table:
        dim, block = t["dim"][0].as_py(), t["block"][0].as_py()
        facts = [unpack(b) for b in t["facts"].to_pylist()]
        rep, members, flags, cid = (np.concatenate([f[k] for f in facts]).astype(np.int64) for k in range(4))
        x = unit(np.concatenate([np.frombuffer(v, np.float64 if w == 8 * dim else np.float32).reshape(-1, dim).astype(np.float64) for v, w in zip(t["vec"].to_pylist(), t["wide"].to_pylist(), strict=True)]))
        order = np.argsort(rep, kind="stable")
        rep, members, flags, cid, x = rep[order], members[order], flags[order], cid[order], x[order]
        turned = x @ rotation(dim)
        split = blocks_of(dim, threshold)
        homes, others = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
        count = np.zeros(len(rep), np.int64)
        spanning = [np.empty((2, 0), np.int64)]

        def within(k: int, h: np.ndarray, o: np.ndarray) -> np.ndarray:
            where, budget = split[k]
            d = _squares(turned[h, where], turned[o, where])
            found = d <= budget
            for r, c in zip(*np.nonzero(np.abs(d - budget) < CLOSE), strict=True):
                found[r, c] = ((turned[h[r], where] - turned[o[c], where]) ** 2).sum() <= budget
            return found

        for a in range(0, len(homes), SQUARE):
            for b in range(0, len(others), SQUARE):
                h, o = homes[a : a + SQUARE], others[b : b + SQUARE]
                cosine = x[h] @ x[o].T
                links = cosine >= threshold
                links &= rep[h][:, None] != rep[o][None, :]
                for r, c in zip(*np.nonzero(np.abs(cosine - threshold) < CLOSE), strict=True):
                    links[r, c] = (x[h[r]] * x[o[c]]).sum() >= threshold and rep[h[r]] != rep[o[c]]
                if links.any():
                    links &= within(block, h, o)
                    for earlier in range(block):
                        links &= ~within(earlier, h, o)
                    count[h] += links @ members[o]
                    rows, columns = np.nonzero(links)
                    least = _spanned(len(rep), h[rows], o[columns])
                    moved = np.flatnonzero(least != np.arange(len(rep)))
                    spanning.append(np.stack([moved, least[moved]]))
        edges = np.concatenate(spanning, axis=1)
        least = _spanned(len(rep), edges[0], edges[1])
        some, moved = np.flatnonzero(count), np.flatnonzero(rep[least] != rep)
        return pa.table({
            "cid": pa.array([*cid[some].tolist(), *([None] * len(moved))], pa.int64()),
            "vec_id": pa.array([*rep[some].tolist(), *rep[moved].tolist()], pa.int64()),
            "n_links": pa.array([*count[some].tolist(), *([0] * len(moved))], pa.int64()),
            "root": pa.array([*([None] * len(some)), *rep[least[moved]].tolist()], pa.int64()),
        })

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, aim: int = AIM) -> DataFrame:
    """Returns a row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine in double
    precision is ``threshold`` or more. ``n_links`` counts the other vectors linked directly, ``component_id`` is the
    smallest vec_id reachable by links, and ``kept`` says that it is the vector itself.

    A vector that is null, empty, zero, or has null or non-finite components links with nothing, nor does one with a null label
    or a null vec_id (its component is null and it is kept). Rows repeated as a whole count as one vector; different vectors
    under one vec_id don't link with each other and share their links. Vectors may have any length. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec"))
    usable = usable.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    size = usable.agg(F.sum(F.size("vec").cast("long"))).first()[0] or 0
    n = max(partitions(spark), -(-4 * size // PART_BYTES))
    keys = even_keys(spark, n)

    def members_of(rows: DataFrame) -> DataFrame:
        return cut(rows.mapInArrow(_keyed(n, keys, False), "vec_id long, part int, key binary").distinct())

    rows = usable.withColumn("alone", F.lit(False))
    ids = members_of(rows)
    several = cut(ids.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("alone")))
    n_several = several.count()
    if n_several:
        rows = near_lookup(usable, several, ["vec_id"], n_several, "vec").withColumn("alone", F.coalesce("alone", F.lit(False)))
        ids = members_of(rows.select(*usable.columns, "alone"))
    rows = rows.select(*usable.columns, "alone")
    known = ids.groupBy("part", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    dealt = rows.mapInArrow(_keyed(n, keys, True), "part int, key binary, label long, dim int, vec binary")
    both = dealt.unionByName(known, allowMissingColumns=True)
    classes = cut_by(both, n, "part", lambda x: x.groupBy("part", "key").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("label", "dim", "vec", "rep", "members"))).withColumn("cid", F.monotonically_increasing_id()))
    # each grid coordinate leaves about 1 / 2.3 of the candidates; labels go on until their cells are about ``aim``
    grid = F.least(F.floor(F.log(F.col("n") / aim) / math.log(2.3)), F.lit(GRID)).cast("int")
    grids = cut(classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2.3 * aim).select("label", grid.alias("grid")))
    n_grids = grids.count()
    placed = near_lookup(classes, grids, ["label"], n_grids, "cid") if n_grids else classes.withColumn("grid", F.lit(0))
    placed = placed.select("cid", "part", "label", "dim", "vec", F.coalesce("grid", F.lit(0)).alias("grid"))
    sizes = placed.mapInArrow(_sizes(threshold), "label long, dim int, block int, cell long, homes long, others long").groupBy(*CELL).agg(F.sum("homes").alias("homes"), F.sum("others").alias("others"))
    full = cut(sizes.where(F.col("others") > tile).select(*CELL, F.greatest(F.ceil(F.col("homes") / tile), F.lit(1)).cast("int").alias("ni"), F.ceil(F.col("others") / tile).cast("int").alias("nj")))
    n_full = full.count()
    blobs = placed.mapInArrow(_blobs(threshold), "label long, dim int, block int, cell long, part int, blob binary")
    tile_of = [*CELL, "i", "j"]
    if n_full:
        looked = near_lookup(blobs, full, CELL, n_full, "part").withColumns({"ni": F.coalesce("ni", F.lit(1)), "nj": F.coalesce("nj", F.lit(1))})
        blobs = looked.select(*CELL, "part", "blob", "ni", "nj").mapInArrow(_tiled, "label long, dim int, block int, cell long, i int, j int, part int, blob binary")
    else:
        blobs = blobs.withColumns({"i": F.lit(0), "j": F.lit(0)})
    asked = blobs.groupBy(*tile_of).applyInArrow(_candidates(threshold, bool(n_full)), "part int, label long, dim int, block int, cell long, i int, j int, blob binary")
    sent = asked.groupBy("part").cogroup(classes.groupBy("part")).applyInArrow(_shipped, "label long, dim int, block int, cell long, i int, j int, facts binary, wide int, vec binary")
    found = cut(sent.groupBy(*tile_of).applyInArrow(_verified(threshold), "cid long, vec_id long, n_links long, root long"))
    counts = found.where("root IS NULL").groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    labels = connected_components(found.where("root IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    linked = classes.select("key", "cid", "rep", "members").join(counts, "cid", "left").join(labels, F.col("rep") == F.col("node"), "left")
    linked = linked.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("found_id"))
    of_id = salted_lookup(ids.select("vec_id", "key"), linked, ["key"], "vec_id").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("found_id").alias("found_id"))
    return (
        vectors.select(F.col("vec_id")).join(of_id, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("found_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``embeddings`` with equal labels at a cosine of 0.98."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS len
  FROM v
  WHERE label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (a.len * b.len) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), comp AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), deg AS (
  SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a
)
SELECT comp.vec_id, coalesce(deg.n_links, 0) AS n_links, comp.component_id, comp.vec_id = comp.component_id AS kept
FROM comp LEFT JOIN deg USING (vec_id)
"""
