"""Documents dealt once into segments, so that repeated passes over their texts cost no further shuffle.

A segment holds texts as compressed blobs. Texts with the same sequence of words (by BLAKE2b of 128 bits) are one class; each
class is in one segment, once, under its smallest identifier. The number of segments follows the bytes of the texts. Map tasks drop the repeats that they see before the
shuffle, so a class that holds a third of all rows reaches its segment once for each batch of rows. The dealt
table is checkpointed in the shared folder with its partitioning; operators then group it by segment next to
whatever other segments or columns of n-grams have answered.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut_by, even_keys, partitions
from driftline.llm.words import Key, count_shingles, drawn_key, fold, text_key, word_hashes

#: Rows of a batch of documents that a map task handles at once, by the bytes of their texts.
BATCH_BYTES = 1 << 23
#: Bytes of text of a segment, about; a task holds one segment.
SEGMENT_BYTES = 1 << 26


def in_batches(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Identifiers and texts (UTF-8, null as empty) of a batch, some megabytes at a time; no row of a null identifier."""
    ids, texts, size = [], [], 0
    column = batch.column("text").cast(pa.binary())
    for i, t in zip(batch.column("doc_id").to_pylist(), column, strict=True):
        if i is None:
            continue
        text = t.as_py() or b""
        ids.append(i)
        texts.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pack_texts(ids: list[int], keys: list[tuple[int, int]], texts: list[bytes], drawn: Key = (0, 0)) -> bytes:
    """Identifiers, keys and texts as one compressed blob, with the key that the job has drawn for its hashes."""
    n = len(ids)
    head = np.empty((4, n), np.int64)
    head[0], head[3] = ids, [len(t) for t in texts]
    head[1:3] = np.array(keys, np.int64).reshape(n, 2).T
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<QQq", *drawn, n) + head.tobytes() + b"".join(texts))


_HEAD = struct.calcsize("<QQq")


def unpack_texts(blob: bytes) -> tuple[list[int], list[tuple[int, int]], list[bytes]]:
    """The identifiers, keys and texts that ``pack_texts`` was given."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<QQq", raw)[2]
    head = np.frombuffer(raw, np.int64, 4 * n, _HEAD).reshape(4, n)
    ends = np.cumsum(head[3]) + _HEAD + 32 * n
    starts = [_HEAD + 32 * n, *ends[:-1].tolist()] if n else []
    return head[0].tolist(), list(zip(head[1].tolist(), head[2].tolist(), strict=True)), [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


def drawn_of(blob: bytes) -> Key:
    """The drawn key that ``pack_texts`` was given."""
    return struct.unpack("<QQ", zstandard.ZstdDecompressor().stream_reader(blob).read(16))


class Segment:
    """The texts of one segment, one for each class, in the order of their identifiers."""

    def __init__(self, blobs: list[bytes]) -> None:
        best: dict[tuple[int, int], tuple[int, bytes]] = {}
        for blob in blobs:
            for i, key, t in zip(*unpack_texts(blob), strict=True):
                if key not in best or i < best[key][0]:
                    best[key] = (i, t)
        kept = sorted(((i, t, key) for key, (i, t) in best.items()), key=lambda x: x[:2])
        self.keys = [x[2] for x in kept]
        self.ids = np.array([x[0] for x in kept], np.int64)
        self.texts = [x[1] for x in kept]
        self.drawn = drawn_of(blobs[0]) if blobs else (0, 0)
        self.words, self.first = word_hashes(self.texts, key=self.drawn)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))


def describe(docs: DataFrame, fold_case: bool, n_shingle: int = 5) -> DataFrame:
    """(doc_id, fp1, fp2, n_words, n_shingles, words_sha256) of each row that has an identifier.

    ``fp1`` and ``fp2`` identify the sequence of words; ``words_sha256`` is the SHA-256 of the words joined by
    one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in in_batches(batch):
                if fold_case:
                    texts = [fold(t) for t in texts]
                    words, first = word_hashes(texts)
                    counts = np.diff(first).tolist()
                    sets = [count_shingles(t, words[a:b], n_shingle) for t, a, b in zip(texts, first[:-1], first[1:], strict=True)]
                    keys = [text_key(t) for t in texts]
                    shas = [""] * len(ids)
                else:
                    sets, counts, keys, shas = [0] * len(ids), [], [], []
                    for t in texts:
                        own = t.split()
                        shown = b" ".join(own)
                        counts.append(len(own))
                        keys.append(text_key(shown))
                        shas.append(hashlib.sha256(shown).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(counts, pa.int64()), pa.array(sets, pa.int64()), pa.array(shas, pa.string())],
                    names=["doc_id", "fp1", "fp2", "n_words", "n_shingles", "words_sha256"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp1 long, fp2 long, n_words long, n_shingles long, words_sha256 string")


def segments_for(docs: DataFrame) -> int:
    """The number of segments: it follows the bytes of the texts, and there are at least as many as shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // SEGMENT_BYTES))


def dealt(docs: DataFrame, fold_case: bool, n: int) -> DataFrame:
    """(seg, blob): the classes of ``docs`` that have a word, dealt by class into ``n`` segments and checkpointed, with a key drawn for their hashes."""
    drawn = drawn_key()
    keys = even_keys(docs.sparkSession, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in in_batches(batch):
                shown = [fold(t) for t in texts] if fold_case else texts
                best: dict[tuple[int, int], int] = {}
                for k, i in enumerate(ids):
                    if shown[k] and not shown[k].isspace():
                        key = text_key(shown[k])
                        if key not in best or i < ids[best[key]]:
                            best[key] = k
                to: dict[int, list[tuple[tuple[int, int], int]]] = {}
                for key, k in best.items():
                    to.setdefault(key[1] % n, []).append((key, k))
                segs = sorted(to)
                blobs = [pack_texts([ids[k] for _, k in to[s]], [key for key, _ in to[s]], [shown[k] for _, k in to[s]], drawn) for s in segs]
                yield pa.RecordBatch.from_arrays([pa.array([keys[s] for s in segs], pa.int32()), pa.array(blobs, pa.binary())], names=["seg", "blob"])

    packed = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "seg int, blob binary")
    return cut_by(packed, n, "seg")
