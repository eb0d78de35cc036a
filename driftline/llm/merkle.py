"""A Merkle manifest of a dataset: every document's leaf, the root of its language, the root of all, and proofs.

Leaves stand in an order and are combined eight by eight, level by level, until one node is left: the root of a tree. The
roots of the languages are the leaves of the last tree. ``4096`` consecutive leaves (four levels) are a superblock.

On the way up each superblock is reduced to its node, and the nodes are positioned in superblocks of their own, until a tree has
one node. On the way down the leaves of a superblock are cogrouped with the nodes outside of it that its proofs need, which are
handed on from the superblock above it: one task finishes the reduction, joins proofs and folds. A superblock has 4,096 rows at
most and needs seven nodes for each level above it, so the largest group is bounded, whatever the sizes of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.llm.common import LOWER, UPPER, cut, near_lookup, partitions, table

#: Nodes that are combined at once, and levels of a superblock.
FAN, LEVELS = 8, 4
PATH = "array<struct<before:string,after:string>>"
#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(joined: str) -> str:
    return sha256(joined.encode()).hexdigest()


def levels_to_root(n: int) -> int:
    """Levels between ``n`` leaves and their root."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from ``nodes`` up to what is left after so many levels."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest("".join(last[k : k + FAN])) for k in range(0, len(last), FAN)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and behind a node in its run, level by level, joined."""
    path = []
    for nodes in levels[:-1]:
        first = at // FAN * FAN
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])))
        at //= FAN
    return path


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields, each with its length in bytes; a missing one is a dash."""
    return F.sha2(F.concat(*(_field(fields[k]) for k in FIELDS)), 256)


def tampered_text() -> Column:
    """The text with A-Z in lower case where 3 divides the checksum of the identifier; the text itself elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered) of every row. ``tree`` is the language behind an equals sign, or empty for none."""
    fields = {k: F.col(k) for k in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(*FIELDS).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(fields).alias("leaf"), leaf_of(fields | {"text": tampered_text()}).alias("tampered"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, each row's place in its ``tree`` by ``order``, from 0, and ``total``, the size of the tree.

    Rows are put in order over all partitions, so that a large tree is many tasks; rows that are equal in ``order`` are dealt by a number of
    their own. Each partition's rows of a tree are counted, and the counts summed up; no task holds a whole tree.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = cut(numbered.repartitionByRange(partitions(spark), "tree", *order, "_row").sortWithinPartitions("tree", *order, "_row").drop("_row"))
    at = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = W.partitionBy("tree").orderBy("_part")
    sums = counts.select("tree", "_part", (F.sum("_n").over(own) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy("tree")).alias("total"))
    sums = cut(sums)
    return near_lookup(at, sums, ["tree", "_part"], sums.count(), "_at").withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def blocks_above(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, node, total) of the superblocks of nodes (tree, pos, node, total)."""
    size = FAN**levels

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows["total"].iloc[0])
        up = min(levels, levels_to_root(total))
        node = reduced(rows.sort_values("pos")["node"].tolist(), up)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "node": [node], "total": [-(-total // size)]})

    keyed = nodes.select("tree", F.floor(F.col("pos") / size).alias("block"), "pos", "node", "total")
    return keyed.groupBy("tree", "block").applyInPandas(run, "tree string, pos long, node string, total long")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes, their superblocks, those of the superblocks, and so on, until each tree has one."""
    out = [nodes.select("tree", "pos", "node", "total")]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(cut(blocks_above(out[-1], levels)))
    return out


def _paths(rows: pd.DataFrame, outer: pd.DataFrame, levels: int) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Each node of a superblock with its siblings up to the last root, those outside of it included."""
    above = [(s["before"], s["after"]) for s in outer["path"].iloc[0]]
    nodes = rows["node"].tolist()
    inner = reduced(nodes, min(levels, levels_to_root(int(rows["total"].iloc[0]))))
    for at, node in enumerate(nodes):
        yield node, siblings(inner, at) + above


def paths_below(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, path) of nodes: a superblock's nodes are cogrouped with the path of the superblock, ``outer`` (tree, pos, path)."""
    size = FAN**levels

    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        found = [[{"before": b, "after": a} for b, a in path] for _, path in _paths(rows, above, levels)]
        return pd.DataFrame({"tree": rows["tree"].to_numpy(), "pos": rows["pos"].to_numpy(), "path": found})

    left = nodes.select("tree", F.floor(F.col("pos") / size).alias("block"), "pos", "node", "total").groupBy("tree", "block")
    right = outer.select("tree", F.col("pos").alias("block"), "path").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(run, f"tree string, pos long, path {PATH}")


def descend(rounds: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """The paths of the superblocks of the first of ``rounds``, from those of the trees' roots, ``outer`` (tree, pos, path)."""
    for nodes in reversed(rounds[1:-1]):
        outer = cut(paths_below(nodes, outer, levels))
    return outer


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang and place.

    Needs the columns doc_id, source, lang, n_chars and text; others are ignored, whatever their names. Any of these five may be null: a
    null language is a tree of its own, null identifiers come first in their tree, and a null one isn't tampered with. Rows that share an
    identifier are ordered by their leaves; equal rows have places side by side. Texts are read once, whole, where they lie; only digests
    travel. An empty table gives an empty result.
    """
    rows = placed(cut(leaves_of(docs)), ["doc_id", "leaf"])
    rows = cut(rows)
    size = FAN**levels
    trees = climb(rows.withColumnRenamed("leaf", "node"), levels)
    # the roots of the trees are the leaves of the last one
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), F.col("node").alias("subroot"))
    top = cut(placed(roots, ["lang_tree"]))
    last = climb(top.withColumnRenamed("subroot", "node"), levels)
    nothing = F.array().cast(PATH)
    paths = paths_below(last[0], descend(last, last[-1].select("tree", "pos", nothing.alias("path")), levels), levels)
    root = last[-1].select("tree", F.col("node").alias("root"))
    known = top.join(paths, ["tree", "pos"]).join(root, "tree").select(F.col("lang_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    known = cut(known)
    outer = descend(trees, known.select("tree", "pos", "path"), levels).join(known.select("tree", "subroot", "root"), "tree")

    def run(key: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
        proofs, folds = [], []
        for (_, path), tampered in zip(_paths(own, above, levels), own["tampered"], strict=True):
            proofs.append(digest("".join(b + a for b, a in path)))
            folds.append(folded(tampered, path))
        out = own[["doc_id", "tree", "pos"]].assign(leaf=own["node"], subroot=subroot, root=root, proof_sha256=proofs, folded_root=folds)
        return out.assign(verified=[f == root for f in folds])

    left = rows.select("tree", F.floor(F.col("pos") / size).alias("block"), "pos", F.col("doc_id").cast("string").alias("doc_id"), F.col("leaf").alias("node"), "tampered", "total").groupBy("tree", "block")
    right = outer.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    found = left.cogroup(right).applyInPandas(run, "doc_id string, tree string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", lang.alias("in_lang"), F.col("pos").alias("place"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, with the proof of each document and what a tampered text folds to."""
    return manifest(table(spark, sf_dir, "documents"))


def _sql_leaf(text: str) -> str:
    fields = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, b:
         list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("text")} AS leaf,
         CASE WHEN crc % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_sql_leaf("text")} END AS tampered, lang
  FROM crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS node, total FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8 FROM nodes WHERE total > 1 GROUP BY tree, level, pos // 8
), tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, node, count(*) OVER () AS total, tree FROM nodes WHERE total = 1
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8, NULL FROM tops WHERE total > 1 GROUP BY level, pos // 8
), runs AS (
  SELECT tree, level, pos // 8 AS run, list(node ORDER BY pos) AS own FROM nodes WHERE total > 1 GROUP BY ALL
  UNION ALL
  SELECT '#', level, pos // 8, list(node ORDER BY pos) FROM tops WHERE total > 1 GROUP BY ALL
), inner_folds AS (
  SELECT tree, pos AS id, 0 AS level, pos, tampered AS node, '' AS proof FROM placed
  UNION ALL
  SELECT f.tree, id, f.level + 1, f.pos // 8, sha256(array_to_string(own[:f.pos % 8], '') || node || array_to_string(own[f.pos % 8 + 2:], '')),
         proof || array_to_string(own[:f.pos % 8], '') || array_to_string(own[f.pos % 8 + 2:], '')
  FROM inner_folds f JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 8
), outer_folds AS (
  SELECT x.tree, id, 0 AS level, t.pos, arg_max(x.node, x.level) AS node, arg_max(proof, x.level) AS proof
  FROM inner_folds x JOIN tops t ON t.level = 0 AND t.tree = x.tree GROUP BY x.tree, id, t.pos
  UNION ALL
  SELECT f.tree, id, f.level + 1, f.pos // 8, sha256(array_to_string(own[:f.pos % 8], '') || node || array_to_string(own[f.pos % 8 + 2:], '')),
         proof || array_to_string(own[:f.pos % 8], '') || array_to_string(own[f.pos % 8 + 2:], '')
  FROM outer_folds f JOIN runs r ON r.tree = '#' AND r.level = f.level AND r.run = f.pos // 8
), ends AS (
  SELECT tree, id, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM outer_folds GROUP BY tree, id
)
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.node AS verified, lang AS in_lang, p.pos AS place
FROM placed p JOIN ends e ON e.tree = p.tree AND e.id = p.pos JOIN nodes s ON s.tree = p.tree AND s.total = 1, (FROM tops WHERE total = 1) r
"""
