"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents are cut into blocks. A source of weight w gives its j-th block (from 1) the release slot
floor((j - 1) / w) and the deadline ceil(j / w). In every slot, earliest deadline first picks among the released
blocks; since the weights add up to one, every block runs inside its window and, as long as no source is
exhausted, each source has had less than one block more or less than w * t after t slots.

Weights are exact fractions a / Q: given ones are read as the decimals that they are written as, and the default weighs a source
by the whole number round(n_docs ** alpha); Q is the sum of the present sources' numerators. The schedule repeats after Q slots, so
min(Q, the slots that the documents need) steps settle it. They are the one part that goes step by step, in one task that holds a
number for each source: a first pass notes the state before each ``CHUNK`` of slots, and the chunks are then filled in side by side.
Each block finds its slot by its number modulo a.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.llm.common import cut, near_lookup, table

BLOCK = 32
#: Slots that one task fills in.
CHUNK = 512
#: Documents of a source that are numbered in one task, about.
BUCKET_ROWS = 5_000


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The smallest whole numbers in the proportions of the given weights, read as decimals."""
    exact = {k: v if isinstance(v, Fraction) else Fraction(Decimal(str(v))) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("weights must not be negative")
    scale = lcm(*(v.denominator for v in exact.values())) if exact else 1
    whole = {k: int(v * scale) for k, v in exact.items()}
    shared = gcd(*whole.values()) or 1
    if sum(whole.values()) // shared >= 10**18:
        raise ValueError("weights must be whole numbers or decimals of fewer digits")
    return {k: v // shared for k, v in whole.items()}


def source_shares(counts: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, source_rank, n_docs, a, q): each source's weight a / q, exactly.

    A source that ``weights`` doesn't name weighs nothing; if no present one weighs anything, all weigh the same. ``counts`` has one
    row for each source.
    """
    if weights is None:
        a = F.greatest(F.lit(1), F.round(F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))).cast("long")
    else:
        named = [x for k, v in whole_weights(weights).items() for x in (F.lit(k), F.lit(v).cast("long"))]
        a = F.coalesce(F.create_map(*named)[F.col("source")] if named else F.lit(None).cast("long"), F.lit(0).cast("long"))
    every = W.partitionBy()
    return (
        counts.withColumn("a", a)
        .withColumn("a", F.when(F.max("a").over(every) > 0, F.col("a")).otherwise(1).cast("long"))
        .withColumn("q", F.sum("a").over(every))
        .withColumn("source_rank", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_first())) - 1).cast("long"))
        .select("source", "source_rank", "n_docs", "a", "q")
    )


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def release(j: Column, a: Column, q: Column) -> Column:
    """The first slot in which block ``j`` may run: floor((j - 1) / w)."""
    return F.call_function("div", _wide(j - 1) * _wide(q), _wide(a))


def deadline(j: Column, a: Column, q: Column) -> Column:
    """The slot before which block ``j`` must have run: ceil(j / w)."""
    return F.call_function("div", _wide(j) * _wide(q) + _wide(a) - 1, _wide(a))


def slots(shares: DataFrame, size: int, chunk: int = CHUNK) -> DataFrame:
    """(source_rank, k, pos): the slot of the k-th block (from 0) of each source in the first ``size`` slots."""

    def entry(who: Column, a: Column, q: Column, had: Column) -> Column:
        return F.struct(deadline(had + 1, a, q).alias("deadline"), who.alias("who"), release(had + 1, a, q).alias("release"), had.alias("had"), a.alias("a"), q.alias("q"))

    def pick(next_: Column, t: Column) -> Column:
        """Of the released blocks the one of the earliest deadline, then of the smallest rank."""
        return F.array_min(F.filter(next_, lambda x: x["release"] <= t))["who"]

    def moved(next_: Column, who: Column) -> Column:
        return F.transform(next_, lambda x: F.when(x["who"] == who, entry(x["who"], x["a"], x["q"], x["had"] + 1)).otherwise(x))

    # a lambda over one element, so that the pick isn't worked out again for each source
    def step(state: Column, t: Column) -> Column:
        return F.transform(F.array(pick(state, t)), lambda who: moved(state, who))[0]

    def noted(state: Column, t: Column) -> Column:
        return F.transform(F.array(pick(state["next"], t)), lambda who: F.struct(moved(state["next"], who).alias("next"), F.concat(state["ran"], F.array(who)).alias("ran")))[0]

    def over_chunk(state: Column, k: Column) -> Column:
        begin = k * chunk
        after = F.aggregate(F.sequence(begin, F.least(begin + chunk, F.lit(size)) - 1), state["next"], step)
        return F.struct(after.alias("next"), F.concat(state["starts"], F.array(state["next"])).alias("starts"))

    zero = F.lit(0).cast("long")
    listed = shares.where("a > 0").select(entry(F.col("source_rank"), F.col("a"), F.col("q"), zero).alias("x")).groupBy().agg(F.sort_array(F.collect_list(F.struct("x.who", "x"))).alias("s"))
    listed = listed.where(F.size("s") > 0).select(F.transform("s", lambda y: y["x"]).alias("next"))
    kind = dict(listed.dtypes)["next"]
    chunks = -(-size // chunk)
    start = F.struct(F.col("next"), F.array().cast(f"array<{kind}>").alias("starts"))
    starts = listed.select(F.posexplode(F.aggregate(F.sequence(F.lit(0), F.lit(max(0, chunks - 1))), start, over_chunk)["starts"]).alias("k", "next")) if size else listed.select(F.lit(0).alias("k"), "next").limit(0)
    begun = cut(starts.repartition(max(1, min(chunks, 1000)), "k"))
    begin = F.col("k") * chunk
    ran = F.aggregate(F.sequence(begin, F.least(begin + chunk, F.lit(size)) - 1), F.struct(F.col("next"), F.array().cast("array<bigint>").alias("ran")), noted)["ran"]
    found = begun.select("next", begin.alias("begin"), F.posexplode(ran).alias("at", "source_rank"))
    # a block's number: those that its source had had before the chunk, and its place among those of the chunk
    had = F.filter("next", lambda x: x["who"] == F.col("source_rank"))[0]["had"]
    k = had + F.row_number().over(W.partitionBy("begin", "source_rank").orderBy("at")) - 1
    return found.select("source_rank", k.cast("long").alias("k"), (F.col("begin") + F.col("at")).cast("long").alias("pos"))


def numbered(docs: DataFrame, shares: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """(doc_id, source, source_rank, n_docs, a, q, rank): each source's documents numbered from 0 in a seeded random order.

    The order is that of an MD5 of seed and identifier. A source is numbered in ranges of it whose number follows
    the source's size, each its own task, and offset by the sizes of the ranges before, so no task holds a whole source.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source_key"), order.alias("order_key"))
    known = shares.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source_key"), "source", "source_rank", "n_docs", "a", "q")
    keyed = near_lookup(keyed, known, ["source_key"], n_sources, "order_key")
    buckets = F.least(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(1 << 30)).cast("long")
    keyed = cut(keyed.withColumn("bucket", F.shiftright(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * buckets, 32)))
    sizes = keyed.groupBy("source_rank", "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(sizes.select("source_rank", "bucket", before.alias("offset")))
    here = F.row_number().over(W.partitionBy("source_rank", "bucket").orderBy("order_key", F.col("doc_id").asc_nulls_first())) - 1
    ranked = near_lookup(keyed.withColumn("here", here), offsets, ["source_rank", "bucket"], offsets.count(), "order_key")
    return ranked.select("doc_id", "source", "source_rank", "n_docs", "a", "q", (F.col("here") + F.col("offset")).alias("rank"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Returns a row for each document: its place in the mixture.

    Columns: doc_id, source, block_no (from 1, within the source), release, deadline and slot of the
    block (slots count blocks from 0), in_block (place within the block), on_target (true while no
    source has run out, that is as long as the deviation from the target weights is bounded by one block).
    The mixture is the order of (slot, in_block). Every document is in it once: the slots of a source that
    has run out are left empty, so the rest goes on in its own proportions. Sources of weight 0 have no windows; their
    blocks take turns after the last slot of the others.

    A null source is a source of its own, known to ``weights`` as nothing. Rows that repeat an identifier keep their own places;
    texts aren't read. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    shares = cut(source_shares(counts, alpha, weights))
    a, q, blocks = F.col("a"), F.col("q"), F.ceil(F.col("n_docs") / block).cast("long")
    weighted = shares.where("a > 0").withColumn("blocks", blocks)
    n_sources, period, needed = shares.agg(F.count(F.lit(1)), F.max("q"), F.max(F.when(a > 0, deadline(blocks + 1, F.greatest(a, F.lit(1)), q)))).first()
    size = min(period or 0, needed or 0)
    steps = cut(slots(shares, size))
    of_block = F.call_function("div", F.col("j"), F.col("a")) * q + F.col("pos")
    # where the last block of each source runs, and where the first that it lacks would have; the first of these ends the guarantee
    ends = weighted.select("source_rank", "a", "q", F.explode(F.array(F.struct((F.col("blocks") - 1).alias("j"), F.lit(False).alias("lacking")), F.struct(F.col("blocks").alias("j"), F.lit(True).alias("lacking")))).alias("e"))
    ends = ends.select("source_rank", "a", "q", "e.j", "e.lacking").withColumn("k", F.col("j") % a).join(steps, ["source_rank", "k"])
    horizon, last = ends.agg(F.min(F.when(F.col("lacking"), of_block)), F.max(F.when(~F.col("lacking"), of_block))).first()
    idle = W.partitionBy(F.col("a") > 0).orderBy("source_rank")
    turns = shares.withColumns({"turn": F.row_number().over(idle) - 1, "idle": F.sum((F.col("a") == 0).cast("long")).over(W.partitionBy())})
    rows = numbered(docs, shares, n_sources, seed).withColumn("j", F.floor(F.col("rank") / block))
    rows = near_lookup(rows.withColumn("k", F.when(a > 0, F.col("j") % F.greatest(a, F.lit(1)))), steps, ["source_rank", "k"], size, "rank")
    rows = near_lookup(rows, turns.select("source_rank", "turn", "idle"), ["source_rank"], n_sources, "rank") if weights is not None else rows.withColumns({"turn": F.lit(0), "idle": F.lit(0)})
    some = F.greatest(a, F.lit(1))
    slot = F.when(a > 0, F.call_function("div", F.col("j"), some) * q + F.col("pos")).otherwise(F.lit(-1 if last is None else last) + 1 + F.col("j") * F.col("idle") + F.col("turn"))
    return rows.withColumn("slot", slot.cast("long")).select(
        "doc_id",
        "source",
        (F.col("j") + 1).alias("block_no"),
        F.when(a > 0, release(F.col("j") + 1, some, q)).alias("release"),
        F.when(a > 0, deadline(F.col("j") + 1, some, q)).alias("deadline"),
        "slot",
        (F.col("rank") % block).alias("in_block"),
        ((a > 0) & (F.col("slot") < F.lit(-1 if horizon is None else horizon))).alias("on_target"),
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` mixed to weights that are the rounded square roots of the sources' sizes."""
    return mix(table(spark, sf_dir, "documents"))


#: Pfair from its definition: every slot is worked out, until each source's blocks and one more have run.
OP9_SQL = """
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n_docs, (count(*) + 31) // 32 AS blocks, CAST(round(sqrt(count(*))) AS BIGINT) AS part FROM documents GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS who, CAST(sum(part) OVER () AS BIGINT) AS whole FROM c
), windows AS (
  SELECT who, j, ((j - 1) * whole) // part AS release, (j * whole + part - 1) // part AS deadline FROM w, unnest(range(1, blocks + 2)) AS u(j)
), size AS (
  SELECT max(deadline) AS slots FROM windows
), lists AS (
  SELECT list({'part': part, 'whole': whole} ORDER BY who) AS s FROM w
), run AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS had, CAST(-1 AS BIGINT) AS who FROM lists WHERE s IS NOT NULL
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, i: h + CASE WHEN i = pick + 1 THEN 1 ELSE 0 END), pick
  FROM (
    SELECT t, had, list_sort(list_filter(list_transform(range(len(had)), lambda i: {
        'deadline': ((had[i + 1] + 1) * s[i + 1].whole + s[i + 1].part - 1) // s[i + 1].part, 'who': i, 'release': (had[i + 1] * s[i + 1].whole) // s[i + 1].part}),
        lambda x: x.release <= t + 1))[1].who AS pick
    FROM run, lists, size WHERE t + 1 < slots
  )
), steps AS (
  SELECT who, t AS slot, row_number() OVER (PARTITION BY who ORDER BY t) AS j FROM run WHERE t >= 0
), horizon AS (
  SELECT min(slot) AS horizon FROM w JOIN steps ON steps.who = w.who AND j = blocks + 1
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) - 1 AS rank FROM documents
), b AS (
  SELECT r.doc_id, r.source, w.who, rank // 32 + 1 AS j, rank % 32 AS in_block FROM r JOIN w ON r.source IS NOT DISTINCT FROM w.source
)
SELECT b.doc_id, b.source, b.j AS block_no, release, deadline, slot, in_block, slot < horizon AS on_target
FROM b JOIN windows ON windows.who = b.who AND windows.j = b.j JOIN steps ON steps.who = b.who AND steps.j = b.j, horizon
"""
