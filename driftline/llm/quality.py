"""Document quality by co-training two views.

One classifier sees the text's content (its words, hashed, and counts of form), the other only the page's metadata (source,
language, stated length). Both start from the same labelled sample. In each round, each view labels the documents of an
unlabelled pool that it is most confident about, and these join the training rows of the other view. Of the labelled rows
that no round has seen, one half calibrates the views, and a logistic combination of their calibrated log-odds is fitted
on the other half; it scores all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table
from driftline.llm.learning import bounded_sample, fit_logistic, fit_platt, fold_of, sigmoid

#: Labelled and unlabelled documents that the models are fitted on, at most each: parameters of ``train``.
SAMPLE = 6_000
POOL = 6_000
ROUNDS = 4
#: The penalty of the views' weights, whose features are many for a small sample.
VIEW_L2 = 20.0
#: Columns of the hashed words.
WORDS = 128
#: Pseudo-labels of each class that a view gives the other in a round, at most, and how sure it must be.
GIVEN = 300
SURE = 0.95
#: One labelled row in so many is kept for calibration.
CALIBRATION = 4
SOURCES, LANGS, LENGTHS = 32, 16, 12
META = ("source", "lang", "n_chars")
_SYMBOLS = frozenset("#$%&*|@^~<>=_\\/{}[]")


def text_features(text: str | None) -> list[float]:
    """What a whole text looks like; a null or empty text is all zeros."""
    text = text or ""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [0.0] * (18 + WORDS)
    counts = Counter(words)
    stripped = [x.strip(".,;:!?\"'()") for x in words]
    lines = text.split("\n")
    kinds = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ascii_ = np.bincount(kinds[kinds < 128], minlength=128)
    symbols = sum(int(ascii_[ord(c)]) for c in _SYMBOLS)
    share = np.array(list(counts.values())) / w
    return [
        np.log1p(n),
        np.log1p(w),
        sum(map(len, words)) / w,
        max(map(len, words)) / 100.0,
        sum(x.isupper() and len(x) > 1 for x in stripped) / w,
        int(ascii_[65:91].sum()) / n,
        int(ascii_[48:58].sum()) / n,
        symbols / n,
        int(ascii_[33]) / w,
        int(ascii_[124]) / w,
        (int(ascii_[46]) + int(ascii_[44])) / w,
        len(counts) / w,
        float(share.max()),
        -float((share * np.log(share)).sum()) / np.log(w + 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(lines) / w,
        1 - len(set(lines)) / len(lines),
        sum(len(x) <= 3 for x in stripped) / w,
        *_word_shares(counts, w),
    ]


def _word_shares(counts: Counter, total: int) -> list[float]:
    """Square roots of the shares of hashed words in lower case."""
    out = [0.0] * WORDS
    for word, n in counts.items():
        out[zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS] += n
    return [(x / total) ** 0.5 for x in out]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """One-hot hashed source and language, one-hot length class, and the log of the stated length."""
    out = [0.0] * (SOURCES + LANGS + LENGTHS + 1)
    if source is not None:
        out[zlib.crc32(source.encode()) % SOURCES] = 1.0
    if lang is not None:
        out[SOURCES + zlib.crc32(lang.encode()) % LANGS] = 1.0
    if n_chars is not None:
        size = float(np.log1p(max(0, n_chars)))
        out[SOURCES + LANGS + min(LENGTHS - 1, int(size))] = 1.0
        out[-1] = size
    return out


@dataclass
class Views:
    """The two linear models, the slope and offset that calibrate each, and the combination of both."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    scales: tuple[tuple[float, float], tuple[float, float]]
    joint: tuple[np.ndarray, float]

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of each view and of both."""
        odds = [s * (x @ w + b) + o for x, (w, b), (s, o) in zip((x_text, x_meta), (self.text, self.meta), self.scales, strict=True)]
        w, b = self.joint
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(np.stack(odds, axis=1) @ w + b)


def co_train(x_text: np.ndarray, x_meta: np.ndarray, y: np.ndarray, held: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, given_most: int = GIVEN) -> Views:
    """Fits the views on the rows that aren't ``held`` and the pool, calibrates them on every other held row and combines them on the rest."""
    seen = ~held if (~held).any() and held.any() else np.ones(len(y), bool)
    extra: list[dict[int, float]] = [{}, {}]  # pool rows and pseudo-labels that each view was given
    models: list[tuple[np.ndarray, float]] = []
    for k in range(ROUNDS + 1):
        models = []
        for x, pool, given in ((x_text, pool_text, extra[0]), (x_meta, pool_meta, extra[1])):
            rows = np.vstack([x[seen], pool[list(given)]]) if given else x[seen]
            models.append(fit_logistic(rows, np.concatenate([y[seen], list(given.values())]), l2=VIEW_L2))
        if k == ROUNDS or not len(pool_text):
            break
        for view, (pool, other) in enumerate(((pool_text, 1), (pool_meta, 0))):
            w, b = models[view]
            p = sigmoid(pool @ w + b)
            order = np.argsort(p, kind="stable")
            fresh = [int(r) for r in order if int(r) not in extra[other]]
            for r in [r for r in fresh if p[r] <= 1 - SURE][:given_most]:
                extra[other][r] = 0.0
            for r in [r for r in reversed(fresh) if p[r] >= SURE][:given_most]:
                extra[other][r] = 1.0
    judge = held if held.any() and (~held).any() else np.ones(len(y), bool)
    margins = [x[judge] @ w + b for x, (w, b) in zip((x_text, x_meta), models, strict=True)]
    truth, even = y[judge], np.arange(int(judge.sum())) % 2 == 0
    parts = (even, ~even) if len(np.unique(truth[even])) > 1 and len(np.unique(truth[~even])) > 1 else (even | True, even | True)
    scales = tuple(fit_platt(m[parts[0]], truth[parts[0]]) for m in margins)
    odds = np.stack([s * m + o for m, (s, o) in zip(margins, scales, strict=True)], axis=1)
    joint = fit_logistic(odds[parts[1]], truth[parts[1]], l2=1e-2) if len(np.unique(truth)) > 1 else (np.array([1.0, 0.0]), 0.0)
    return Views(models[0], models[1], scales, joint)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [text_features(t.as_py()) for t in batch["text"]]
        meta = [meta_features(*x) for x in zip(*(batch[c].to_pylist() for c in META), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(text, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.float64()))], names=["doc_id", "quality", "t", "m"])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, pool_size: int = POOL, given: int = GIVEN) -> Views:
    """Co-trains on at most ``size`` labelled and ``pool_size`` unlabelled documents; without labels every score is 0.5.

    ``given`` bounds the pseudo-labels of each class that a view gives the other in a round. Of rows that share an identifier the one with the smallest features counts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    pool = bounded_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().join(known, "doc_id", "left_anti"), pool_size)
    chosen = bounded_sample(known, size).unionByName(pool.withColumn("quality", F.lit(None).cast("int")))
    rows = _rows(docs).join(F.broadcast(chosen), "doc_id")
    found = rows.mapInArrow(_described, "doc_id long, quality int, t array<double>, m array<double>")
    one = found.groupBy("doc_id").agg(F.min(F.struct("t", "m", "quality")).alias("x"))  # at most size + pool_size rows
    got = one.select("doc_id", "x.quality", "x.t", "x.m").toArrow().sort_by("doc_id")
    n_text, n_meta = len(text_features(None)), len(meta_features(None, None, None))
    x_text = np.array(got["t"].to_pylist(), float).reshape(-1, n_text)
    x_meta = np.array(got["m"].to_pylist(), float).reshape(-1, n_meta)
    quality = np.array([np.nan if q is None else float(q) for q in got["quality"].to_pylist()])
    held = np.array([fold_of(i, CALIBRATION) == 0 for i in got["doc_id"].to_pylist()], bool)
    has = ~np.isnan(quality)
    if not has.any():
        return Views((np.zeros(n_text), 0.0), (np.zeros(n_meta), 0.0), ((1.0, 0.0), (1.0, 0.0)), (np.zeros(2), 0.0))
    return co_train(x_text[has], x_meta[has], quality[has], held[has], x_text[~has], x_meta[~has], given)


def score(docs: DataFrame, views: Views) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, p_text, p_meta, quality_score, kept.

    ``quality_score`` combines both calibrated views; ``kept`` is quality_score >= 0.5. Texts are read whole, of any length. Null texts and null metadata have features of
    their own, an empty text those of no words. Null and repeated identifiers are kept as they are; an empty table gives an empty result; further columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = np.array([text_features(t.as_py()) for t in batch["text"]], float)
                meta = np.array([meta_features(*x) for x in zip(*(batch[c].to_pylist() for c in META), strict=True)], float)
                p_text, p_meta, p = views.scores(text, meta)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p_text), pa.array(p_meta), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "p_text", "p_meta", "quality_score", "kept"])

    return _rows(docs).mapInArrow(run, "doc_id long, p_text double, p_meta double, quality_score double, kept boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of ``documents`` by views co-trained on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
