"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a leaf of the tree and has a run: its distinct texts in the order of their digests, each with the
identifier that stays and the number of copies. Runs are merged in binomial rounds. In a round, 2**bits neighbouring runs
exchange slices: each of the group's places takes one range of digests (the next bits of the digest) from all of them, sorts
what it got, and merges equal entries as they follow each other. After the last round place k holds the k-th range of all
digests, merged over all partitions, so no run is ever in one task, and a text that holds a third of all rows
arrives once from each run.

The 64-bit digest orders a run. Entries are taken for one text only if SHA-256 and length agree too; this is verified at every
level, because both are part of the key that is merged. The answers go back to the leaves: each leaf looks its distinct
entries up, and its rows find theirs within the leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import LOWER, UPPER, cut, partitions, table

KEY = ["digest", "text_sha256", "n_bytes"]
#: Places of the last round for each shuffle partition: enough for an even deal.
PLACES = 4


def normalised(text: str = "text") -> Column:
    """The text that is compared: A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, digest, leaf) of each row; the leaf is the partition that holds it."""
    shown = docs.select("doc_id", normalised().alias("shown"))
    hashed = shown.select("doc_id", F.sha2(F.encode("shown", "UTF-8"), 256).alias("text_sha256"), F.octet_length("shown").alias("n_bytes"))
    return hashed.withColumns({"digest": F.xxhash64("text_sha256"), "leaf": F.spark_partition_id()})


def merge(entries: DataFrame, keep: str) -> DataFrame:
    """Merges the equal entries of each run. ``stays`` is compared as a whole, so sorted runs are merged in their order."""
    best = F.min if keep == "smallest" else F.max
    return entries.groupBy("run", *KEY).agg(best("stays").alias("stays"), F.sum("group_size").alias("group_size"))


def exchange(runs: DataFrame, done: int, bits: int) -> DataFrame:
    """Says which place of its group takes each entry: the group's number, then the first ``done + bits`` bits of the digest."""
    level = done + bits
    slice_ = F.shiftrightunsigned("digest", 64 - level)
    return runs.withColumn("run", F.shiftleft(F.shiftright("run", level), level) + slice_)


def merged_runs(found: DataFrame, keep: str, fan_in_bits: int, depth: int) -> DataFrame:
    """(run, digest, text_sha256, n_bytes, stays, group_size): the last round's runs, one entry for each text.

    ``depth`` is the number of bits of the places; it must cover the number of leaves.
    """
    n = partitions(found.sparkSession)
    # a null identifier stays only where there is no other
    rank = F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()
    runs = found.select(F.col("leaf").cast("long").alias("run"), *KEY, F.struct(rank.alias("rank"), "doc_id").alias("stays"), F.lit(1).cast("long").alias("group_size"))
    # the leaf's own run is the sorted partial aggregation on this side of the first exchange
    runs = merge(exchange(runs, 0, min(fan_in_bits, depth)), keep)
    for done in range(fan_in_bits, depth, fan_in_bits):
        sliced = exchange(runs, done, min(fan_in_bits, depth - done))
        runs = merge(sliced.repartition(n, "run").sortWithinPartitions("run", *KEY), keep)
    return runs


def exact_dedup(docs: DataFrame, keep: str = "smallest", fan_in_bits: int = 3, depth: int | None = None) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; ``keep`` says whether the
    smallest or the largest identifier stays. A null text counts as empty; texts of any length are read whole and
    only their digests travel. A null identifier stays only if its group has no other; then keep_id is null and kept is true.
    Rows that repeat an identifier and its text count as copies, and all rows of the identifier that stays are kept. An
    empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    found = cut(digests(docs))
    leaves = (found.agg(F.max("leaf")).first()[0] or 0) + 1
    if depth is None:
        depth = (PLACES * partitions(docs.sparkSession) - 1).bit_length()
    depth = max(1, depth, (leaves - 1).bit_length())
    runs = merged_runs(found, keep, fan_in_bits, depth)
    asked = found.select("leaf", *KEY).distinct()
    answers = asked.join(runs.drop("run"), KEY).select("leaf", *KEY, F.col("stays.doc_id").alias("keep_id"), "group_size")
    return (
        found.join(answers, ["leaf", *KEY])
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def survivors(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row for each distinct text of ``docs``, that of the identifier that stays, with all its columns, whatever their names.

    Null and empty texts are one text; of rows that are equal in identifier and text one stays.
    """
    found = exact_dedup(docs, keep).where("kept").select("doc_id", "text_sha256").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("of_id"), F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("of_text"))
    same = (packed["of_text"] == found["text_sha256"]) & packed["of_id"].eqNullSafe(found["doc_id"])
    return packed.join(found, same, "left_semi").dropDuplicates(["of_text", "of_id"]).select("whole.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of ``documents``; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
