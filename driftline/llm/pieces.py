"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE model is applied as its library does: symbols start as characters, and an agenda of neighbouring pairs whose
joint piece exists is worked off by score, then from left to right. With dropout, each candidate that comes up is
skipped if a hash of (seed, doc_id, the word's place in the document, the candidate's number) falls below the rate.
So every occurrence of a word draws for itself, a seed gives the same segmentation on every run and machine, and
another seed another one. At rate 0 the result is the library's own. No piece of such a model holds a space or a line
break after another character, so a text can be cut before runs of spaces and line breaks, and its words be segmented
by themselves.

Execution: the words of some megabytes of text are segmented side by side. Each distinct word is segmented once without
dropout, which also gives the number of candidates that come up; occurrences that skip none of these share the result.
The others are worked off together, one candidate of every word at a time (``_lockstep``); words of more than ``LONG``
characters have an agenda of their own in a heap (``_by_heap``).

Characters without a piece become bytes; a literal U+2581, which the model uses for spaces, does too, so decoding gives
back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table
from driftline.llm.words import mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
#: Bytes of text that are encoded at once; a longer text is cut before spaces.
BATCH_BYTES = 1 << 21
#: Words of more characters keep their agenda in a heap.
LONG = 64
#: Words that are worked off side by side.
ROWS = 8192
SPACE = "▁"
_NONE = np.int32(2**31 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Symbols are piece ids; a character without a piece is this and its code point.
_CHARACTER = 1 << 19


class PieceCodec:
    """A BPE model of the SentencePiece library with byte fallback."""

    def __init__(self, model: bytes, rate: float = RATE, seed: int = 0) -> None:
        from sentencepiece import SentencePieceProcessor

        if not 0 <= rate < 1:
            raise ValueError("rate must be at least 0 and less than 1")
        sp = SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        ids: dict[str, int] = {}
        scores = np.zeros(n)
        self.bytes = np.zeros(256, np.int32)
        shown = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                shown[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if re.search(rf"[^{SPACE}]{SPACE}|\n", piece):
                    raise ValueError("pieces that go on after a word aren't supported")
                ids[piece] = i
                scores[i] = -sp.get_score(i)
                shown[i] = piece.replace(SPACE, " ").encode()
        self.table = pa.array(shown, pa.binary())
        self.limit = np.uint64(int(rate * 2**53))
        self.seed = np.uint64(xxhash.xxh64_intdigest(b"merge-dropout", seed & (2**64 - 1)))
        # pieces of one score come up from left to right, so they share a rank
        _, rank = np.unique(scores, return_inverse=True)
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(_CHARACTER)
        for piece, i in ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.symbol[ord(piece)] = i
        self.symbol[32] = ids.get(SPACE, _CHARACTER + 32)

        def symbol_of(part: str) -> int | None:
            return ids.get(part, int(self.symbol[ord(" " if part == SPACE else part)]) if len(part) == 1 else None)

        found = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = symbol_of(piece[:k]), symbol_of(piece[k:])
                if left is not None and right is not None:
                    found[left << 21 | right] = (int(rank[i]), i)
        self._hash_pairs(found)

    def _hash_pairs(self, found: dict[int, tuple[int, int]]) -> None:
        """Lays the joinable pairs out in a sparse table with linear probing."""
        self.bits = max(8, (len(found) * 12).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.joint = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        keys = np.array(list(found), np.int64)
        values = np.array(list(found.values()), np.int32).reshape(-1, 2)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            _, first = np.unique(np.where(free, at[left], -1 - left), return_index=True)
            took = left[first][free[first]]
            self.keys[at[took]], self.ranks[at[took]], self.joint[at[took]] = keys[took], values[took, 0], values[took, 1]
            left = np.setdiff1d(left, took)
            at[left] = np.where(self.keys[at[left]] >= 0, (at[left] + 1) & (size - 1), at[left])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table; its rank there is ``_NONE`` if it can't be joined."""
        keys = left.astype(np.int64) << 21 | right
        at = self._slot(keys)
        there = self.keys[at]
        off = np.flatnonzero((there != keys) & (there >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            there = self.keys[at[off]]
            off = off[(there != keys[off]) & (there >= 0)]
        return at

    def skipped(self, draws: np.ndarray, number: np.ndarray | int) -> np.ndarray:
        """Whether the candidates of these numbers are skipped by words of these draws."""
        return (mix64(draws + (np.atleast_1d(number).astype(np.uint64) + np.uint64(1)) * _STEP) >> np.uint64(11)) < self.limit

    def draws(self, doc_id: int | None, places: np.ndarray) -> np.ndarray:
        """What the words at these places of a document draw by."""
        own = np.uint64(xxhash.xxh64_intdigest(str(doc_id)))
        with np.errstate(over="ignore"):
            return mix64(places.astype(np.uint64) * _PLACE + (own ^ self.seed))

    def _lockstep(self, symbols: np.ndarray, length: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Works words off side by side: their symbols at the end (-1 where joined), and how many candidates came up.

        ``symbols`` has a row for each word, filled up with -1; without ``draws`` nothing is skipped.
        """
        n, width = symbols.shape
        done, came_up = symbols.copy(), np.zeros(n, np.int64)
        if width < 2:
            return done, came_up
        rows = np.arange(n)
        s = symbols
        ranks = np.full((n, width), _NONE, np.int32)
        inside = np.arange(width - 1) < (length - 1)[:, None]
        ranks[:, :-1][inside] = self.ranks[self.pair(s[:, :-1][inside], s[:, 1:][inside])]
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        count = np.zeros(n, np.int64)
        while len(rows):
            here = np.arange(len(rows))
            p = ranks.argmin(axis=1)
            live = ranks[here, p] != _NONE
            if not live.all():
                gone = ~live
                done[rows[gone]], came_up[rows[gone]] = s[gone], count[gone]
                rows, s, ranks, after, before, count, p, length = (x[live] for x in (rows, s, ranks, after, before, count, p, length))
                draws = None if draws is None else draws[live]
                here = np.arange(len(rows))
            if draws is not None:
                skip = self.skipped(draws, count)
                count += 1
                ranks[here[skip], p[skip]] = _NONE
                here, p = here[~skip], p[~skip]
            else:
                count += 1
            q = after[here, p].astype(np.int64)
            r = after[here, q].astype(np.int64)
            new = self.joint[self.pair(s[here, p], s[here, q])]
            s[here, p], s[here, q] = new, -1
            ranks[here, p], ranks[here, q] = _NONE, _NONE
            after[here, p] = r
            more = np.flatnonzero(r < length[here])
            i, at, right = here[more], p[more], r[more]
            before[i, right] = at
            ranks[i, at] = self.ranks[self.pair(new[more], s[i, right])]
            left = before[here, p].astype(np.int64)
            more = np.flatnonzero(left >= 0)
            i, at = here[more], left[more]
            ranks[i, at] = self.ranks[self.pair(s[i, at], new[more])]
        return done, came_up

    def _by_heap(self, word: np.ndarray, draw: np.ndarray | None) -> np.ndarray:
        """The same for one long word, by an agenda in a heap; entries whose symbols have changed are passed over."""
        s, n = word.tolist(), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def candidates(left: list[int], right: list[int], places: list[int]) -> list[tuple[int, int, int, int, int]]:
            at = self.pair(np.array(left, np.int64), np.array(right, np.int64))
            return [(x, k, a, b, j) for x, k, a, b, j in zip(self.ranks[at].tolist(), places, left, right, self.joint[at].tolist(), strict=True) if x != _NONE]

        agenda = candidates(s[:-1], s[1:], list(range(n - 1)))
        heapify(agenda)
        number, skips, known = 0, np.empty(0, bool), 0
        while agenda:
            _, k, a, b, joint = heappop(agenda)
            r = after[k]
            if s[k] != a or r >= n or s[r] != b:
                continue
            if draw is not None:
                if number == known:
                    skips, known = self.skipped(draw, np.arange(number, number + 1024)), number + 1024
                number += 1
                if skips[number - 1 - known + 1024]:
                    continue
            s[k], s[r] = joint, -1
            r = after[k] = after[r]
            pairs = []
            if r < n:
                before[r] = k
                pairs.append((joint, s[r], k))
            if before[k] >= 0:
                pairs.append((s[before[k]], joint, before[k]))
            if pairs:
                for x in candidates(*map(list, zip(*pairs, strict=True))):
                    heappush(agenda, x)
        return np.array([x for x in s if x >= 0], np.int64)

    def _ids(self, symbols: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of symbols in order, and how many each of ``n`` rows has; characters become bytes."""
        odd = np.flatnonzero(symbols >= _CHARACTER)
        if not len(odd):
            return symbols.astype(np.int32), np.bincount(rows, minlength=n)
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        coded = [self.bytes[list(chr(k - _CHARACTER).encode())] for k in kinds.tolist()]
        times = np.ones(len(symbols), np.int64)
        times[odd] = np.array([len(x) for x in coded])[which]
        out = np.repeat(symbols.astype(np.int32), times)
        start = np.cumsum(times) - times
        width = max(map(len, coded))
        padded = np.stack([np.pad(x, (0, width - len(x))) for x in coded])[which]
        for k in range(width):
            has = times[odd] > k
            out[start[odd][has] + k] = padded[has, k]
        return out, np.bincount(rows, weights=times, minlength=n).astype(np.int64)

    def _segmented(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments words given by places in ``flat`` symbols: ids one after the other, each word's first and number of ids, candidates."""
        n = len(start)
        first, size, came_up = (np.zeros(n, np.int64) for _ in range(3))
        parts, total = [], 0
        order = np.argsort(length, kind="stable")
        order = order[length[order] <= LONG]
        for k in range(0, len(order), ROWS):
            rows = order[k : k + ROWS]
            width = int(length[rows[-1]])
            column = np.arange(width)
            inside = column < length[rows][:, None]
            symbols = np.where(inside, flat[np.minimum(start[rows][:, None] + column, max(0, len(flat) - 1))], -1) if width else np.empty((len(rows), 0), np.int32)
            done, count = self._lockstep(symbols, length[rows], None if draws is None else draws[rows])
            row, col = np.nonzero(done >= 0)
            ids, sizes = self._ids(done[row, col], row, len(rows))
            came_up[rows], size[rows], first[rows] = count, sizes, total + np.cumsum(sizes) - sizes
            parts.append(ids)
            total += len(ids)
        for k in np.flatnonzero(length > LONG).tolist():
            left = self._by_heap(flat[start[k] : start[k] + length[k]], None if draws is None else draws[k : k + 1])
            ids, sizes = self._ids(left, np.zeros(len(left), np.int64), 1)
            came_up[k], size[k], first[k] = length[k], sizes[0], total
            parts.append(ids)
            total += len(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), first, size, came_up

    def encode_parts(self, parts: list[str], doc_ids: list[int | None], places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of texts one after the other, how many ids each has, and how many words.

        ``places`` says how many words of the same document came before a text, if it is a later part of one.
        """
        texts = pa.array(parts, pa.string())
        # a token that starts with a line break had no space before it, any other had one
        tokens = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = tokens.offsets.to_numpy().astype(np.int64)
        coded = tokens.values.dictionary_encode()
        index, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        text_of = np.repeat(np.arange(len(parts)), np.diff(offsets))
        sizes = pc.utf8_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
        breaks = pc.starts_with(known, "\n").to_numpy(zero_copy_only=False)
        # a run of empty tokens is a run of spaces before the next token, or a word of its own
        void = (sizes == 0)[index]
        last = np.zeros(len(index), bool)
        last[offsets[1:] - 1] = True
        run = np.zeros(len(index), np.int64)
        if void.any():
            ends = np.flatnonzero(void & (last | np.append(~void[1:], True)))
            begins = np.flatnonzero(void & np.concatenate([[True], ~void[:-1] | last[:-1]]))
            run[ends] = ends - begins + 1
        alone = void & (run > 0) & (last | np.append(breaks[index[1:]] & ~void[1:], True))
        spaces = np.where(alone, run, np.where(breaks[index], 0, 1))
        led = np.flatnonzero(~void & ~breaks[index])
        led = led[(led > 0) & void[led - 1] & ~last[led - 1]]
        spaces[led] += run[led - 1]
        keep = np.flatnonzero(~void | alone)
        empty = np.array([not p for p in parts], bool)
        keep = keep[~empty[text_of[keep]]]
        index, spaces, text_of = index[keep], spaces[keep], text_of[keep]
        words_of = np.bincount(text_of, minlength=len(parts))
        begin = np.cumsum(words_of) - words_of
        place = np.arange(len(index)) - np.repeat(begin, words_of) + np.repeat(np.array(places, np.int64), words_of)
        # distinct words with their spaces
        key = index * (int(spaces.max(initial=0)) + 1) + spaces
        kinds, word = np.unique(key, return_inverse=True)
        first_at = np.zeros(len(kinds), np.int64)
        first_at[word] = np.arange(len(word))
        points = np.frombuffer("".join(known.to_pylist()).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        kind_index, kind_spaces = index[first_at], spaces[first_at]
        own = sizes[kind_index]
        length = own + kind_spaces
        start = np.cumsum(length) - length
        flat = np.full(int(length.sum()), self.symbol[32], np.int32)
        moved = np.repeat(start + kind_spaces - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        flat[moved] = self.symbol[points[np.repeat(starts[kind_index] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]]
        if not self.limit:
            ids, first, size, _ = self._segmented(flat, start, length, None)
            first, size = first[word], size[word]
        else:
            draws = np.concatenate([np.empty(0, np.uint64), *(self.draws(i, place[a : a + n]) for i, a, n in zip(doc_ids, begin.tolist(), words_of.tolist(), strict=True) if n)])
            short = length <= LONG
            at = np.flatnonzero(short)
            base, base_first, base_size, came_up = self._segmented(flat, start[at], length[at], None)
            full_first, full_size, full_count = (np.zeros(len(length), np.int64) for _ in range(3))
            full_first[at], full_size[at], full_count[at] = base_first, base_size, came_up
            candidates = full_count[word]
            alike = short[word]
            left = np.flatnonzero(alike & (candidates > 0))
            number = 0
            while len(left):
                skip = self.skipped(draws[left], number)
                alike[left[skip]] = False
                number += 1
                left = left[~skip & (candidates[left] > number)]
            other = np.flatnonzero(~alike)
            drawn, drawn_first, drawn_size, _ = self._segmented(flat, start[word[other]], length[word[other]], draws[other])
            first, size = full_first[word], full_size[word]
            first[other], size[other] = drawn_first + len(base), drawn_size
            ids = np.concatenate([base, drawn])
        out = ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return out, np.bincount(text_of, weights=size, minlength=len(parts)).astype(np.int64), words_of

    def encode(self, text: str, doc_id: int | None = 0) -> np.ndarray:
        """The piece ids of a text."""
        out, places = [], 0
        for part in parts_of(text):
            ids, _, n = self.encode_parts([part], [doc_id], [places])
            out.append(ids)
            places += int(n[0])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text that was encoded."""
        return self.joined(np.asarray(ids, np.int64)).decode()[1:]

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces one after the other."""
        found = self.table.take(pa.array(ids, pa.int32()))
        if not len(found):
            return b""
        ends = np.frombuffer(found.buffers()[1], np.int32)
        return found.buffers()[2].to_pybytes()[ends[found.offset] : ends[found.offset + len(found)]]

    def piece_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The number of bytes of each piece."""
        if not hasattr(self, "_sizes"):
            self._sizes = pc.binary_length(self.table).to_numpy(zero_copy_only=False).astype(np.int64)
        return self._sizes[ids]


def parts_of(text: str, size: int = BATCH_BYTES // 2) -> list[str]:
    """A text cut before single spaces into parts of about ``size`` characters; encoded, a part begins with its space again."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (text[cut - 1] == " " or text[cut + 1 : cut + 2] in (" ", "")):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


@lru_cache(maxsize=4)
def _codec(model: bytes, rate: float, seed: int) -> PieceCodec:
    return PieceCodec(model, rate, seed)


def read_model(path: str = MODEL) -> bytes:
    """The bytes of a model file of the driver; tasks get them with their code."""
    with open(path, "rb") as f:
        return f.read()


def _in_parts(ids: list[int | None], texts: list[str | None]) -> Iterator[tuple[list[int | None], list[list[str] | None]]]:
    """Rows of some megabytes of text, each cut into parts; a long text comes alone."""
    held: tuple[list, list] = ([], [])
    size = 0
    for i, t in zip(ids, texts, strict=True):
        n = len(t or "")
        if held[0] and size + n > BATCH_BYTES:
            yield held
            held, size = ([], []), 0
        held[0].append(i)
        held[1].append(None if t is None else parts_of(t) if n > BATCH_BYTES else [t])
        size += n
    if held[0]:
        yield held


def encode(docs: DataFrame, model: bytes, rate: float = RATE, seed: int = 0) -> DataFrame:
    """Returns a row for each row of ``docs``: doc_id, token_ids array<int>, n_tokens, lossless.

    ``lossless`` says that decoding the ids gave back the text; it was checked for every row. A null text has null ids and
    no tokens, an empty text an empty list; both are lossless. A null doc_id is kept and draws as one of its own. Repeated rows
    give equal rows. A text may be of any length: it is encoded in parts of about a megabyte, and only its ids are held whole.
    An empty table gives an empty result; other columns are ignored.
    """

    def rows_of(codec: PieceCodec, ids: list[int | None], rows: list[list[str] | None]) -> pa.RecordBatch:
        tokens, counts, lossless = [], [], []
        if len(rows) == 1 or all(r is None or len(r) == 1 for r in rows):
            parts = [p for r in rows if r is not None for p in r]
            owner = [k for k, r in enumerate(rows) if r is not None for _ in r]
            places, at = [0] * len(parts), 0
            if len(rows) == 1 and len(parts) > 1:  # a long text: part by part
                found = []
                for p in parts:
                    one, _, n = codec.encode_parts([p], ids, [at])
                    at += int(n[0])
                    ok = codec.joined(one) == (" " + p).encode() if p else not len(one)
                    found.append((one, ok))
                tokens, counts, lossless = [x for x, _ in found], [sum(len(x) for x, _ in found)], [all(ok for _, ok in found)]
            else:
                flat, sizes, _ = codec.encode_parts(parts, [ids[k] for k in owner], places) if parts else (np.empty(0, np.int32), np.empty(0, np.int64), None)
                back = codec.joined(flat)
                width = np.concatenate([[0], np.cumsum(codec.piece_bytes(flat))])
                ends = width[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                counts, lossless = [0] * len(rows), [True] * len(rows)
                for k, p, a, z, n in zip(owner, parts, ends[:-1], ends[1:], sizes.tolist(), strict=True):
                    counts[k] = n
                    lossless[k] = back[a:z] == (b" " + p.encode() if p else b"")
                tokens = [flat]
        offsets = np.cumsum([0, *counts])
        missing = pa.array([r is None for r in rows])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *tokens]), pa.int32()), mask=missing)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(counts, pa.int64()), pa.array(lossless, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "lossless"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, rate, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for ids, rows in _in_parts(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    yield rows_of(codec, ids, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, lossless boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids); null ids give a null text, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, 0.0, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else codec.decode(x) for x in part["token_ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` encoded with merge-dropout at a rate of 0.1, each decoded again and compared."""
    return encode(table(spark, sf_dir, "documents"), read_model())
