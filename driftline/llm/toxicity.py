"""Toxicity by a classifier chain.

Labelled categories are predicted one after the other, each by a logistic regression that also gets the probabilities of
the categories before it. In training these earlier probabilities are out of fold: they come from models of which no part, neither
the terms nor the weights, has seen the row's fold, so later links learn how far they can be trusted. The final model of a
category is fitted on all rows of the sample, with the out-of-fold probabilities of the earlier ones as input.

A link knows terms: words and beginnings of words whose odds among the category's rows are many times those in other rows, copies of
a text counting once. Its inputs are the presence of each term, how many different words have one, and how often they occur.

The given table labels whether a text is of low quality and whether it is toxic, so its chain is ``junk`` -> ``toxic``; ``train``
takes any number of labelled categories in their order.

Execution: the labelled sample, bounded by a parameter, is packed in tasks into hashed words (some 3 kB a document) and broadcast;
the folds of each category are fitted by tasks, two in each. The driver holds the packed sample and the fitted links, nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, table
from driftline.llm.learning import bounded_sample, fit_logistic, fold_of, sigmoid, within_bytes
from driftline.llm.words import STEP, among, find

#: Labelled documents that the models are fitted on, at most.
SAMPLE = 12_000
#: Terms that a link knows, at most.
TERMS = 512
#: Bytes of the sample's packed words, 16 for each different word of a document (documents have some 3 kB): the second bound of the sample.
SAMPLE_BYTES = 128 << 20
#: How many times as likely a term must be in a category's texts.
ODDS = 20
FOLDS = 5
CATEGORIES = ("junk", "toxic")
_WORD = re.compile(r"\w+")


@dataclass
class Link:
    """One category's terms (hash to column), weights and intercept."""

    terms: dict[int, int]
    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.intercept)


@dataclass
class Chain:
    """The categories in their order, and a link for each."""

    categories: tuple[str, ...]
    links: list[Link]

    def probabilities(self, texts: list[str | None], known: dict[str, tuple[tuple[int, int], ...]]) -> np.ndarray:
        """A row for each text and a column for each category. ``known`` remembers words that were looked up."""
        counted = [Counter(_WORD.findall((t or "").lower())) for t in texts]
        inputs = [np.zeros((len(texts), len(link.terms) + 3)) for link in self.links]
        for row, words in enumerate(counted):
            for w, n in words.items():
                hits = known.get(w)
                if hits is None:
                    if len(known) > 200_000:
                        known.clear()
                    hits = known[w] = tuple((k, link.terms[x]) for k, link in enumerate(self.links) for x in keys_of(w) if x in link.terms)
                if hits:
                    for k, column in hits:
                        inputs[k][row, column] = 1
                    for k in {k for k, _ in hits}:
                        inputs[k][row, -3] += 1
                        inputs[k][row, -2] += n
        sizes = np.array([sum(words.values()) for words in counted])
        out = np.zeros((len(texts), 0))
        for link, x in zip(self.links, inputs, strict=True):
            out = np.hstack([out, link.probability(np.hstack([_scaled(x, sizes), out]))[:, None]])
        return out


def _scaled(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Turns the last two columns, of which one holds the occurrences, into their logarithm and their share in a hundred words."""
    x[:, -1] = 100 * x[:, -2] / np.maximum(1, sizes)
    x[:, -2] = np.log1p(x[:, -2])
    return x


def word_key(word: str) -> int:
    """A 32-bit hash of a word; 0 stands for none."""
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) or 1


def keys_of(word: str) -> list[int]:
    """A word's keys: the word itself and its first four and five characters, by which inflected forms are known."""
    return [word_key(word), *(word_key("^" + word[:n]) for n in (4, 5) if len(word) > n)]


@dataclass
class Sample:
    """The labelled rows: folds, labels (NaN where there is none), sizes, and the distinct words of each row.

    ``keys`` has three keys for each word (0 for none), ``count`` its occurrences, and ``row`` the row that it is in.
    """

    fold: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    row: np.ndarray
    keys: np.ndarray
    count: np.ndarray

    def groups(self) -> np.ndarray:
        """A number for each row that near copies mostly share: the smallest hash of its words."""
        least = np.full(len(self.fold), 2**32, np.int64)
        np.minimum.at(least, self.row, self.keys[:, 0].astype(np.int64))
        return np.unique(least, return_inverse=True)[1]

    def features(self, terms: dict[int, int]) -> np.ndarray:
        """Presence of each term, different words with one, logarithm of their occurrences, occurrences in a hundred words."""
        x = np.zeros((len(self.fold), len(terms) + 3))
        known = np.array(sorted(terms), np.uint32)
        columns = np.array([terms[k] for k in known.tolist()], np.int64)
        some = np.zeros(len(self.row), bool)
        for k in range(3):
            at = find(known, self.keys[:, k])
            hit = at >= 0
            x[self.row[hit], columns[at[hit]]] = 1
            some |= hit
        x[:, -3] = np.bincount(self.row[some], minlength=len(x))
        x[:, -2] = np.bincount(self.row[some], weights=self.count[some], minlength=len(x))
        return _scaled(x, self.sizes)


def learn_terms(sample: Sample, y: np.ndarray, rows: np.ndarray, size: int) -> dict[int, int]:
    """The terms of a category by the given rows: keys many times as frequent in its texts, copies of a text counting once."""
    group = sample.groups().astype(np.uint64)

    def entries(wanted: np.ndarray, wanted_keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys of the rows that are wanted (of those given), in how many groups each occurs, and the number of groups."""
        parts = [np.empty(0, np.uint64)]
        for at in range(0, len(sample.row), STEP):  # no second copy of the sample
            rows_ = sample.row[at : at + STEP]
            inside = wanted[rows_]
            keys = sample.keys[at : at + STEP][inside].ravel()
            kept = keys > 0 if wanted_keys is None else among(wanted_keys, keys)
            parts.append(np.unique(keys[kept].astype(np.uint64) << np.uint64(32) | group[np.repeat(rows_[inside], 3)[kept]]))
        pairs = np.unique(np.concatenate(parts))
        found, count = np.unique(pairs >> np.uint64(32), return_counts=True)
        return found.astype(np.uint32), count, len(np.unique(group[wanted]))

    bad, times, n_bad = entries(rows & (y == 1), None)
    least = max(2, min(4, n_bad // 20))
    bad, times = bad[times >= least], times[times >= least]
    good, good_times, n_good = entries(rows & (y == 0), bad)
    other = np.zeros(len(bad))
    other[np.searchsorted(bad, good)] = good_times
    odds = (times + 0.5) / (n_bad + 1) * (n_good + 1) / (other + 0.5)
    order = [k for k in np.lexsort((bad, -odds, -times)) if odds[k] >= ODDS][:size]
    return {int(bad[k]): at for at, k in enumerate(order)}


def fit_link(sample: Sample, category: int, earlier: np.ndarray, rows: np.ndarray, size: int) -> tuple[Link, np.ndarray]:
    """A category's link by the given rows, and its inputs for all rows of the sample; ``earlier``: probabilities of the links before."""
    y = sample.labels[:, category]
    rows = rows & ~np.isnan(y)
    terms = learn_terms(sample, y, rows, size)
    x = np.hstack([sample.features(terms), earlier])
    if not rows.any():  # nothing is known, so no text is of the category
        return Link(terms, np.zeros(x.shape[1]), -8.0), x
    return Link(terms, *fit_logistic(x[rows], y[rows])), x


def fit_chain(spark: SparkSession, sample: Sample, categories: tuple[str, ...], size: int) -> Chain:
    """Fits the links in their order; the folds of each are tasks."""
    held = spark.sparkContext.broadcast(sample)
    earlier = np.zeros((len(sample.fold), 0))
    links: list[Link] = []
    for category in range(len(categories)):

        def fitted(batches: Iterator[pa.RecordBatch], category: int = category, earlier: np.ndarray = earlier) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch["id"].to_pylist():
                    known = held.value
                    link, x = fit_link(known, category, earlier, known.fold != k, size)
                    p = link.probability(x[known.fold == k]) if k < FOLDS else np.empty(0)
                    whole = k == FOLDS
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k], pa.int64()), pa.array([p.tobytes()], pa.binary()), pa.array([list(link.terms) if whole else []], pa.list_(pa.int64())),
                            pa.array([link.weights.tobytes() if whole else b""], pa.binary()), pa.array([link.intercept], pa.float64()),
                        ],
                        names=["k", "p", "terms", "weights", "intercept"],
                    )

        out = spark.range(0, FOLDS + 1, 1, (FOLDS + 2) // 2).mapInArrow(fitted, "k long, p binary, terms array<long>, weights binary, intercept double").collect()
        held_out = np.zeros(len(sample.fold))
        for r in out:
            if r.k < FOLDS:
                held_out[sample.fold == r.k] = np.frombuffer(r.p)
            else:
                links.append(Link({t: at for at, t in enumerate(r.terms)}, np.frombuffer(r.weights), r.intercept))
        earlier = np.hstack([earlier, held_out[:, None]])
    held.destroy()
    return Chain(categories, links)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, labels, size, words): of each text its number of words and, for each distinct one, three keys and its occurrences."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            sizes, blobs = [], []
            for t in part["text"]:
                counts = Counter(_WORD.findall(t.as_py().lower()))
                keys = [(*(*keys_of(w), 0, 0)[:3], min(n, 2**32 - 1)) for w, n in counts.items()]
                sizes.append(sum(counts.values()))
                blobs.append(np.array(keys, np.uint32).reshape(-1, 4).tobytes())
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["labels"], pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "labels", "size", "words"])


def sampled(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], size: int) -> Sample:
    """The first ``size`` labelled documents with a text, in the order of a hash of their identifiers, as long as their packed words are ``SAMPLE_BYTES`` at most.

    Of rows that share an identifier the one whose text has the smallest digest counts.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.col(c).cast("int")).alias(c) for c in categories))
    known = known.where(F.coalesce(*categories).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.array(*(F.col(c).cast("double") for c in categories)).alias("labels"))
    chosen = bounded_sample(known, size)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "labels").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))  # at most ``size`` rows
    whole = cut(rows.mapInArrow(packed, "doc_id long, labels array<double>, size long, words binary"))
    kept = within_bytes(whole.withColumn("bytes", F.octet_length("words").cast("long")), "bytes", SAMPLE_BYTES).drop("bytes")
    got = kept.toArrow().sort_by("doc_id").combine_chunks()
    n = got.num_rows
    words = got["words"].combine_chunks() if n else pa.array([], pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int32)
    flat = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32).reshape(-1, 4) if n and ends[-1] > ends[0] else np.empty((0, 4), np.uint32)
    fold = np.array([fold_of(i, FOLDS) for i in got["doc_id"].to_pylist()], np.int64)
    y = np.array([[np.nan if v is None else v for v in r] for r in got["labels"].to_pylist()], float).reshape(n, len(categories))
    return Sample(fold, y, got["size"].to_numpy().astype(np.int64), np.repeat(np.arange(n, dtype=np.int32), np.diff(ends) // 16), flat[:, :3].copy(), flat[:, 3].copy())


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] | None = None, size: int = SAMPLE, terms: int = TERMS) -> Chain:
    """Learns a chain from at most ``size`` labelled documents with a text; without any, no text is of any category.

    ``labels`` has doc_id and a 0/1 column for each of ``categories``, null where unknown; a document that is labelled several times is of
    a category if any row says so. By default the categories are those of the given table: junk (quality 0), then toxic.
    """
    if categories is None:
        categories = CATEGORIES
        labels = labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("junk"), "toxic")
    return fit_chain(docs.sparkSession, sampled(docs, labels, categories, size), categories, terms)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, p_<category> for each category, toxic, kept.

    ``toxic`` says that the last category's probability is 0.5 or more, ``kept`` is its opposite. Whole texts are read, of any length. A
    null or empty text has no terms. Null and repeated identifiers are kept as they are, repeated rows give equal rows; an empty
    table gives an empty result; other columns are ignored.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[tuple[int, int], ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = chain.probabilities(part["text"].to_pylist(), known)
                toxic = p[:, -1] >= 0.5
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(p[:, k]) for k in range(len(names))), pa.array(toxic), pa.array(~toxic)], names=["doc_id", *names, "toxic", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names), "toxic boolean", "kept boolean"]))


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[tuple[int, int], ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(chain.probabilities(part["text"].to_pylist(), known)[:, -1] < 0.5))

    return docs.select(*columns).mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents`` by a chain fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
