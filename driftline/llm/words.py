"""Words of many texts at once: numpy kernels that run inside Spark tasks.

Words are the maximal runs of bytes other than the six ASCII white-space bytes, which is what
``[^\\x20\\x09-\\x0D]+`` finds in the decoded text, since no byte of a longer UTF-8 sequence is ASCII.

Hashes are chains of bijective mixing steps: no sums of powers, so texts of regular structure don't meet. Words of up to
eight bytes have one step, words of more than ``LONG`` bytes and whole texts are hashed by BLAKE2b. A key, which a job draws
for itself, goes into every step of a word, so nobody can prepare texts whose hashes meet. What is decided by hashes is said where they are used.
"""

from __future__ import annotations

import struct
from hashlib import blake2b
from secrets import token_bytes

import numpy as np
import zstandard

#: Bytes of text that are hashed at once; bounds the temporary arrays whatever the length of a text.
CHUNK = 1 << 21
#: Words that are worked on at once where temporary arrays would pile up.
STEP = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD, _LEFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WAYS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)
#: The bits of a word's last lane, by the number of its bytes.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed by BLAKE2b.
LONG = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift-multiply) over 64-bit integers."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def fold(text: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return text.translate(_FOLD)


def digest(data: bytes, key: tuple[int, int] | None = None) -> tuple[int, int]:
    """BLAKE2b of 128 bits as two unsigned integers."""
    found = blake2b(data, digest_size=16, key=b"" if key is None else struct.pack("<QQ", *key)).digest()
    return int.from_bytes(found[:8], "little"), int.from_bytes(found[8:], "little")


def text_key(text: bytes) -> tuple[int, int]:
    """Two signed 64-bit integers, BLAKE2b of the words joined by one space: the key of a sequence of words."""
    a, b = digest(b" ".join(text.split()))
    return a - (1 << 63), b - (1 << 63)


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a buffer."""
    edge = np.flatnonzero(np.diff(SPACE[buf], prepend=True, append=True))
    return edge[::2], edge[1::2]


#: Two numbers of 64 bits.
Key = tuple[int, int]


def drawn_key() -> Key:
    """A key that can't be foreseen."""
    return int.from_bytes(token_bytes(8)), int.from_bytes(token_bytes(8))


def _hashed(raw: bytes, starts: np.ndarray, ends: np.ndarray, way: int, key: Key) -> np.ndarray:
    """A hash of each word: its lanes of eight bytes, one mixing step after the other; ``way`` chooses between independent ones."""
    first, later = mix64(np.array(key, np.uint64) + _WAYS[way])
    lanes = np.ndarray(len(raw) + 1, "<u8", raw + b"\0" * 8, strides=(1,))
    size = ends - starts
    short = size < 8
    h = lanes[starts] & _LANE[np.minimum(size, 8)]
    h[short] |= size[short].astype(np.uint64) << np.uint64(56)
    h[~short] ^= _ODD
    h = mix64(h + first)
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    k = 8
    while len(rest):
        lane = lanes[starts[rest] + k] & _LANE[np.minimum(size[rest] - k, 8)]
        h[rest] = mix64(h[rest] * _LEFT + (lane ^ later))
        k += 8
        ended = size[rest] <= k
        done = rest[ended]
        h[done] = mix64(h[done] ^ size[done].astype(np.uint64))
        rest = rest[~ended]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = digest(raw[starts[i] : ends[i]], key)[way]
    return h


def word_hashes(texts: list[bytes], way: int = 0, key: Key = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of ``texts``, in order, and each text's first word (one more at the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    hashes, first, at, before = [], np.zeros(len(offsets), np.int64), 0, 0
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        while end < len(buf) and not SPACE[buf[end - 1]]:
            rest = np.flatnonzero(SPACE[buf[end : end + 4096]])
            end += int(rest[0]) + 1 if len(rest) else min(4096, len(buf) - end)
        s, e = spans(buf[at:end])
        hashes.append(_hashed(joined[at:end], s, e, way, key))
        a, z = np.searchsorted(offsets, [at, end])
        first[a:z] = before + np.searchsorted(s, offsets[a:z] - at)
        at, before = end, before + len(s)
    first[np.searchsorted(offsets, len(buf)) :] = before
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), first


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _LEFT
    x += right
    return mix64(x)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive entries of ``words``; the caller skips those that cross texts.

    Runs of 2, 4, 8 ... entries are mixed from halves, and ``n`` entries from the two longest that cover them.
    """
    out = np.empty(max(0, len(words) - n + 1), np.uint64)
    for at in range(0, len(out), STEP):
        level, k = words[at : at + STEP + n - 1], 1
        size = len(level) - n + 1
        while 2 * k <= n:
            level, k = _joined(level[:-k], level[k:]), 2 * k
        out[at : at + size] = _joined(level[:size], level[n - k : n - k + size])
    return out


def inside_text(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the first ``size`` windows of ``n`` words lie in one text."""
    ok = np.zeros(size + n + 1, np.int32)
    lengths = np.diff(first)
    long = lengths >= n
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[:-1][long] + lengths[long] - n + 1, -1)
    return np.cumsum(ok[:size]) > 0


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct ``n``-word shingles of one text; its whole sequence if it has fewer words."""
    return np.unique(all_shingles(words, n))


def all_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-word shingles of one text in their order; its whole sequence if it has fewer words."""
    if not len(words):
        return np.empty(0, np.uint64)
    return ngram_hashes(words, min(n, len(words))) + np.uint64(max(0, n - len(words)))


def count_shingles(text: bytes, words: np.ndarray, n: int) -> int:
    """The number of distinct ``n``-word shingles of a text whose words have these hashes: where hashes are equal, the words are compared."""
    hashes = all_shingles(words, n)
    distinct, of, times = np.unique(hashes, return_inverse=True, return_counts=True)
    if len(distinct) == len(hashes):
        return len(hashes)
    shown, width = text.split(), min(n, len(words))
    again = np.flatnonzero(times[of] > 1).tolist()
    return int((times == 1).sum()) + len({tuple(shown[k : k + width]) for k in again})


def pack(*columns: np.ndarray) -> bytes:
    """Compresses integer columns of one length, the first sorted (it is stored as differences)."""
    parts = [np.array([len(columns), len(columns[0])], np.int64).tobytes()]
    for k, column in enumerate(columns):
        wide = column.astype(np.uint64)
        if k == 0 and len(wide):
            wide[1:] = np.diff(column.astype(np.uint64))
        parts.append(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns that ``pack`` was given, as unsigned 64-bit integers."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(raw, np.int64, 2)
    planes = np.frombuffer(raw, np.uint8, int(k * n * 8), 16).reshape(int(k), 8, int(n))
    columns = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    if n:
        columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in ``sorted_values``; -1 where it isn't there."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted value is in ``sorted_values``."""
    out = np.zeros(len(wanted), bool)
    for k in range(0, len(wanted) if len(sorted_values) else 0, STEP):
        out[k : k + STEP] = find(sorted_values, wanted[k : k + STEP]) >= 0
    return out
