"""Vector code compression: the parts of vectors are coded by the nearest entries of codebooks, found with pivots.

Components become integers, vectors are cut into parts, and each position of a part has a codebook. All distances that decide are
exact squares of integers. To evaluate few of them, each part's distances to ``PIVOTS`` fixed pivots of its position are worked
out once and kept with the part. In each round the pivots' distances to the entries are worked out; the largest difference of the two, over
the pivots, is a lower bound of the distance to an entry (LAESA). Entries are evaluated in the order of their bounds, and a part is done when
the next bound exceeds its best distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, near_lookup, table

#: Equal parts of a vector, entries of a codebook, rounds of improvement, and pivots of each position.
PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
#: Integers that a component is multiplied by.
SCALE = 256
#: Rows that a task works on at once.
BATCH = 2048


def limit(width: int) -> int:
    """The largest integer of a component for which squared distances of vectors of 16 parts, ``width`` components each, are exact."""
    return int((2**61 // (PARTS * width)) ** 0.5) // 2


def whole_numbers(x: np.ndarray, width: int) -> np.ndarray:
    """floor(256 x); what is too large for exact distances (some 2 million for 64 components) counts as the largest that isn't."""
    most = limit(width)
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def chosen_pivots(book: np.ndarray, n: int) -> np.ndarray:
    """Entries that lie far from each other: the first one, then each time the one furthest from those chosen (the first of these)."""
    at = [0]
    near = square(book, book[0])
    while len(at) < min(n, len(book)):
        at.append(int(near.argmax()))
        near = np.minimum(near, square(book, book[at[-1]]))
    return book[at]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each part's nearest entry (the first of equally near ones), its squared distance, and how many distances were evaluated.

    ``to_pivots`` are the parts' distances to the pivots. Bounds are lowered by more than rounding can have added.
    """
    between = np.sqrt(square(book[:, None, :], pivots[None, :, :]).astype(np.float64))
    bound = np.zeros((len(parts), len(book)))
    for k in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, k, None] - between[None, :, k]), out=bound)
    bound -= 1e-9 * (1.0 + to_pivots.max(axis=1, initial=0.0)[:, None] + between.max(initial=0.0))
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(parts), np.iinfo(np.int64).max)
    code = np.full(len(parts), len(book))
    open_, evaluated = np.arange(len(parts)), 0
    for rank in range(len(book)):
        entry = order[open_, rank]
        with np.errstate(invalid="ignore"):
            still = bound[open_, entry] <= np.sqrt(best[open_].astype(np.float64))
        open_, entry = open_[still], entry[still]
        if not len(open_):
            break
        evaluated += len(open_)
        d = square(parts[open_], book[entry])
        better = (d < best[open_]) | ((d == best[open_]) & (entry < code[open_]))
        at = open_[better]
        best[at], code[at] = d[better], entry[better]
    return code, best, evaluated


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of blobs of integers, cut into parts."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), PARTS, width)


def _pivot_distances(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), PARTS, -1)


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label_key, x) of rows whose vector has only finite components and a positive multiple of 16 of them."""
    x = F.col(embedding).cast("array<double>")
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.alias("label_key"), x.alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % PARTS == 0)).where(sound)


def compress(vectors: DataFrame, rounds: int = ROUNDS, n_entries: int = ENTRIES, n_pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors and the codebooks, integers by part, entry and component.

    The codes have a row for each vector that stays: vec_id, code (two hexadecimal digits a part), error and label_error, the sum of the errors of equal
    labels. Left out are vectors that are null, empty or hold null or non-finite components, and those whose number of components
    isn't a multiple of 16 or isn't that of the first vector. The codebooks begin as the parts of the ``n_entries`` smallest vec_ids; null identifiers count as the largest,
    and of rows that share one the smaller vectors come first. There may be fewer rows than entries. Null labels are one label; rows may repeat.
    Other columns are ignored. An empty table gives no codes and empty codebooks. The driver gets the codebooks, 16 x 64 entries, and sums of as many
    cells, whatever the number of vectors. A label_error beyond a long is null. Tasks add up their own rows first, so hot cells and labels are no large groups.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors)
    if not 1 <= n_entries <= 256:
        raise ValueError("a code of two hexadecimal digits has 1 to 256 entries")

    def smallest(rows: DataFrame) -> list[list[float]]:
        return [r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(n_entries).collect()]

    first = smallest(kept)
    if not first:
        none = spark.createDataFrame([], "vec_id long, code string, error long, label_error long")
        return none, np.zeros((PARTS, 0, 0), np.int64)
    size = len(first[0])
    width = size // PARTS
    alike = kept.where(F.size("x") == size)
    if any(len(x) != size for x in first):
        first = smallest(alike)
    books = whole_numbers(np.array(first), width).reshape(-1, PARTS, width).transpose(1, 0, 2).copy()
    pivots = np.stack([chosen_pivots(book, n_pivots) for book in books])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = whole_numbers(part["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size), width)
                own = x.reshape(-1, PARTS, 1, width)
                far = np.sqrt(square(own, pivots[None]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label_key"], pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in far], pa.binary())], names=["vec_id", "label_key", "parts", "far"])

    parts = cut(alike.mapInArrow(measured, "vec_id long, label_key string, parts binary, far binary"))
    for _ in range(rounds):
        books = _improved(parts, books, pivots)
    codes = cut(_coded(parts, books, pivots))
    sums = codes.groupBy("label_key").agg(F.try_sum("error").alias("label_error"))
    n_labels = sums.count()
    return near_lookup(codes, sums, ["label_key"], n_labels, "vec_id").select("vec_id", "code", "error", "label_error"), books


def _assigned(part: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors cut into parts, and for each the codes and squared distances by position."""
    x, far = _vectors(part["parts"], books.shape[2]), _pivot_distances(part["far"])
    found = [nearest(x[:, k], far[:, k], books[k], pivots[k]) for k in range(PARTS)]
    return x, np.stack([c for c, _, _ in found], axis=1), np.stack([d for _, d, _ in found], axis=1)


def _improved(parts: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each used entry becomes the floor of the mean of its parts."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x, code, _ = _assigned(batch.slice(at, BATCH), books, pivots)
                for k in range(PARTS):
                    own = np.zeros(books.shape[1:], np.int64)
                    np.add.at(own, code[:, k], x[:, k])
                    sums[k] += own
                    counts[k] += np.bincount(code[:, k], minlength=books.shape[1])
        used = np.argwhere(counts)
        if len(used):
            columns = [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array([[str(v) for v in sums[k, e]] for k, e in used], pa.list_(pa.string())), pa.array(counts[used[:, 0], used[:, 1]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "total", "n"])

    found = parts.mapInArrow(run, "part int, entry int, total array<string>, n long")
    whole = [F.sum(F.col("total")[j].cast("decimal(38,0)")).cast("string") for j in range(width)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.array(*whole).alias("total"), F.sum("n").alias("n")).collect():
        out[r.part, r.entry] = [int(v) // r.n for v in r.total]
    return out


def _coded(parts: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, label_key, code, error) of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                _, code, d = _assigned(part, books, pivots)
                names = [bytes(row).hex() for row in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label_key"], pa.array(names, pa.string()), pa.array(d.sum(axis=1), pa.int64())], names=["vec_id", "label_key", "code", "error"])

    return parts.mapInArrow(run, "vec_id long, label_key string, code string, error long")


def books_digest(books: np.ndarray) -> str:
    """The digest of all components in decimal, by part, entry and place."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 16 codes of a byte, with their errors and the digest of the codebooks."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def _sql_round(before: str, after: str) -> str:
    """Parts with their nearest entries of ``before``, and the entries after the round."""
    return f"""
near_{before} AS (
  SELECT id, p.part, min(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 1000 + b.entry) AS best
  FROM parts p JOIN {before} b ON b.part = p.part GROUP BY id, p.part
), sums_{before} AS (
  SELECT part, entry, list(floored ORDER BY j) AS c FROM (
    SELECT n.part, best % 1000 AS entry, j, (sum(p.c[j]) - (sum(p.c[j]) % count(*) + count(*)) % count(*)) // count(*) AS floored
    FROM near_{before} n JOIN parts p ON p.id = n.id AND p.part = n.part, unnest(range(1, len(p.c) + 1)) AS u(j) GROUP BY n.part, entry, j) GROUP BY part, entry
), {after} AS (SELECT b.part, b.entry, coalesce(s.c::BIGINT[], b.c) AS c FROM {before} b LEFT JOIN sums_{before} s ON s.part = b.part AND s.entry = b.entry)"""


OP12_SQL = f"""
WITH vectors AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), parts AS MATERIALIZED (
  SELECT id, k AS part, x[k * len(x) // {PARTS} + 1 : (k + 1) * len(x) // {PARTS}] AS c FROM vectors, unnest(range({PARTS})) AS u(k)
), e0 AS (SELECT part, id - 1 AS entry, c FROM parts WHERE id <= {ENTRIES}), {_sql_round("e0", "e1")}, {_sql_round("e1", "e2")}, {_sql_round("e2", "e3")}
, codes AS (
  SELECT id, string_agg(format('{{:02x}}', best % 1000), '' ORDER BY part) AS code, sum(best // 1000)::BIGINT AS error FROM near_e2 GROUP BY id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM e2) AS codebooks_sha256
FROM codes JOIN vectors USING (id)
"""
