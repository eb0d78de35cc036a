"""Language identification in two steps: the family, then the language within it.

Texts are lower-cased and described by the shares of their byte trigrams, hashed into ``DIMS`` columns. Linear support
vector machines, one for each family against the rest, find the language's family. Within it, one machine for each pair
of its languages votes (one versus one); the language with most votes wins, then the one with the larger sum of margins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.llm.common import cut, table
from driftline.llm.learning import fit_svm, sample_key, sigmoid

#: Columns of the hashed trigram shares.
DIMS = 4096
#: Documents that the machines are fitted on, at most: as many of each language, or all that it has.
SAMPLE = 4_000
UNKNOWN = "und"
#: Families of common languages. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_BATCH_BYTES = 1 << 22


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"only {lang}")


def trigram_shares(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of whole texts."""
    out = np.zeros((len(texts), DIMS), np.float32)
    parts = [b" " + " ".join(t.lower().split()).encode("utf-8", "replace") + b" " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return out
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        n = b - a - 2
        if n > 0:
            out[k] = np.sqrt(np.bincount(code[a : a + n], minlength=DIMS) / n)
    return out


@dataclass
class Identifier:
    """Families with their languages, a machine for each family, and one for each pair of a family's languages."""

    families: list[tuple[str, list[str]]]
    of_family: list[tuple[np.ndarray, float]]
    of_pair: dict[tuple[str, str], tuple[np.ndarray, float]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score between 0 and 1 for each row."""
        margin = np.stack([x @ w + b for w, b in self.of_family], axis=1) if len(self.families) > 1 else np.full((len(x), 1), 8.0)
        chosen = margin.argmax(axis=1)
        surest = sigmoid(2 * margin)
        score = surest[np.arange(len(x)), chosen] / surest.sum(axis=1)
        langs = np.empty(len(x), object)
        for k, (_, names) in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            if not len(rows):
                continue
            votes, sums, sure = (np.zeros((len(rows), len(names))) for _ in range(3))
            for i, j in combinations(range(len(names)), 2):
                w, b = self.of_pair[names[i], names[j]]
                m = x[rows] @ w + b
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                sure[:, i] += sigmoid(2 * m)
                sure[:, j] += sigmoid(-2 * m)
            best = np.lexsort((sums, votes), axis=1)[:, -1] if len(names) > 1 else np.zeros(len(rows), np.int64)
            langs[rows] = np.array(names, object)[best]
            if len(names) > 1:
                score[rows] *= sure[np.arange(len(rows)), best] / (len(names) - 1)
        return langs.tolist(), np.clip(score, 0, 1)


def machine(x: np.ndarray, y: np.ndarray, among: list[str], first: list[str]) -> tuple[np.ndarray, float]:
    """The machine that tells rows of the ``first`` languages from those of the others ``among`` which it is; both sides weigh the same."""
    rows = np.flatnonzero(np.isin(y, among))
    own = np.isin(y[rows], first)
    weight = np.where(own, 0.5 / max(1, own.sum()), 0.5 / max(1, (~own).sum())) * len(rows)
    return fit_svm(x[rows].astype(np.float64), np.where(own, 1.0, -1.0), weight)


def fit(langs: list[str], solved: Callable[[list[tuple[list[str], list[str]]]], list[tuple[np.ndarray, float]]]) -> Identifier:
    """Fits the machines; ``solved`` gives those of tasks (among, first), in their order."""
    names: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        names.setdefault(family_of(lang), []).append(lang)
    families = sorted(names.items())
    pairs = [pair for _, members in families for pair in combinations(members, 2)]
    whole = [(sorted(set(langs)), members) for _, members in families] if len(families) > 1 else []
    found = solved(whole + [(list(pair), [pair[0]]) for pair in pairs])
    return Identifier(families, found[: len(whole)], dict(zip(pairs, found[len(whole) :], strict=True)))


def held_out():
    """Whether a document is held out: crc32 of its identifier as text, modulo 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def chosen_rows(known: DataFrame, size: int) -> DataFrame:
    """Of each language the first ``size`` / number of languages identifiers in the order of their hashes, ``size`` at most in all.

    Only identifiers that are sure to be among them, by the share that each language needs, and some more are put in order; where a language falls short, again with a larger share.
    """
    keyed = cut(known.select("doc_id", "lang", sample_key().alias("k")).distinct())
    counts = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(size) / F.count(F.lit(1)).over(W.partitionBy()))))
    counts = cut(counts.withColumn("at", F.row_number().over(W.orderBy("lang"))).where(F.col("at") <= size).drop("at"))
    wanted = counts.agg(F.sum(F.least("n", "quota"))).first()[0] or 0
    share, factor = F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / 2**32, 2
    while True:
        likely = keyed.join(F.broadcast(counts), "lang").where(share * F.col("n") <= factor * F.col("quota") + 200)
        found = cut(likely.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("k", "doc_id"))).where("at <= quota").select("lang", "doc_id"))
        if found.count() >= wanted:
            return found
        factor *= 16


def train(docs: DataFrame, size: int = SAMPLE) -> Identifier:
    """Learns from text and lang of at most ``size`` documents that aren't held out and have both, as many of each language.

    The trigram shares of this sample, 16 kB a document, are broadcast, and each machine is fitted by a task of its own. Of rows that share identifier and language
    the one whose text has the smallest digest counts.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = known.join(F.broadcast(chosen_rows(known, size)), ["lang", "doc_id"])  # at most ``size`` rows
    rows = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], pa.array([v.tobytes() for v in trigram_shares(part["text"].to_pylist())], pa.binary())], names=["doc_id", "lang", "x"])

    got = rows.mapInArrow(described, "doc_id long, lang string, x binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    langs, blobs = got["lang"].to_pylist(), got["x"].to_pylist()
    del got
    held = spark.sparkContext.broadcast((np.array(langs, object), blobs))

    def solved(tasks: list[tuple[list[str], list[str]]]) -> list[tuple[np.ndarray, float]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch["id"].to_pylist():
                    y, own = held.value
                    w, b = machine(np.frombuffer(b"".join(own), np.float32).reshape(-1, DIMS), y, *tasks[k])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([float(b)], pa.float64())], names=["k", "w", "b"])

        if not tasks:
            return []
        out = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "k long, w binary, b double").collect()
        return [(np.frombuffer(r.w), r.b) for r in sorted(out, key=lambda r: r.k)]

    found = fit(langs, solved)
    held.destroy()
    return found


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the text is read for a prediction, whole, of any length. A null text or one without a letter is ``und`` with score 0, and so is
    every text if nothing could be learned. Null identifiers count as not held out. Repeated rows give equal rows, an empty table
    an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            texts = batch["text"]
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and len(part) < 512 and size < _BATCH_BYTES:
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                good = [k for k, t in enumerate(part) if any(map(str.isalpha, t))] if identifier.families else []
                langs, scores = [UNKNOWN] * len(part), [0.0] * len(part)
                if good:
                    found, sure = identifier.predict(trigram_shares([part[k] for k in good]))
                    for k, lang, s in zip(good, found, sure.tolist(), strict=True):
                        langs[k], scores[k] = lang, s
                here = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([here["doc_id"], here["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
