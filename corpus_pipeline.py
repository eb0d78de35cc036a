"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Toxic documents go, then exact copies (the largest identifier of each text stays), then near copies (one document of each group
of linked ones stays). What is left is put in the order of a mixture of its sources, and encoded.

All stages but the last return the columns of ``docs``, whatever columns it has besides doc_id, text and source, and whatever
these are named. They take rows as they come: null identifiers and null or empty texts, rows that repeat each other or only an
identifier, texts of any length, and empty tables, which give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from driftline.llm.common import cut, remove, salted_lookup, shared_dir, table
from driftline.session import ship_package


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain, fitted on the labelled ones among them, doesn't call toxic.

    A null or empty text isn't toxic. Each row is judged by its own text; without labels all rows stay.
    """
    ship_package(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest identifier; null and empty texts are one text.

    A null identifier stays where its text has no other; of rows equal in identifier and text one stays.
    """
    return exact_dedup.survivors(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, that of the smallest identifier.

    Rows are told apart by numbers of their own, so rows that share an identifier are linked by their own texts only. A null
    identifier counts as the largest; among rows that share the smallest one, any stays. Texts without a word are linked
    with nothing and all stay.
    """
    ship_package(spark)
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("whole")))
    rows = numbered.select(F.col("row").alias("doc_id"), F.col("whole.text").alias("text"))
    groups = ngram_join.ngram_join(rows).select(F.col("doc_id").alias("row"), "component_id")
    named = cut(numbered.select("row", F.col("whole.doc_id").alias("id")).join(groups, "row"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("stays"))
    gone = salted_lookup(named, first, ["component_id"], "row").where("row != stays").select("row")
    return numbered.join(gone, "row", "left_anti").select("whole.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the files and rows of the written table in the order of the mixture.

    Rows that share an identifier, or have none, have the first of their places. A null source is a source of its own.
    """
    place = mixing.mix(docs).groupBy("doc_id").agg(F.min(F.struct("slot", "in_block")).alias("place"))
    place = cut(place)
    unnamed = place.where("doc_id IS NULL").select("place.slot", "place.in_block").first()
    last = F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(("slot", "in_block"), unnamed or (0, 0), strict=True)))
    packed = docs.select(F.col("doc_id").alias("of_id"), F.struct(*docs.columns).alias("whole"))
    named = place.where("doc_id IS NOT NULL").select("doc_id", F.struct(*(F.col(f"place.{n}").cast("long").alias(n) for n in ("slot", "in_block"))).alias("place"))
    placed = packed.join(named, packed["of_id"] == named["doc_id"], "left").select(F.coalesce("place", last).alias("place"), "whole")
    return placed.repartitionByRange("place").sortWithinPartitions("place").select("whole.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the check that they decode to its text; null texts have null ids."""
    ship_package(spark)
    return pieces.encode(docs, pieces.read_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The first and the last stage are a fitted model and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written to the shared folder and read again.

    A stage's table is deleted when the next one's is written, so the folder holds two at most; the last table stays for the result.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
    return docs
