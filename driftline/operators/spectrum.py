"""The spectrum of a series that is too long for a task: Fourier transforms of many tasks, in four steps.

A transform of any length n is a convolution with a chirp (Bluestein), here by transforms of a power of two, L = R x C points. Point j = j1 C + j2 stands in row j1 and column j2 of
a matrix. Columns are transformed, twiddled, dealt anew by rows, and rows transformed: that is the transform, and the same way back is its inverse. Tasks hold bands of
columns or of rows of about ``BAND`` points, and hand each other blocks where two bands cross. The powers need two such exchanges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a band.
BAND = 1 << 20


def shape_of(n: int) -> tuple[int, int]:
    """Rows and columns of the matrix for a series of ``n`` points."""
    bits = (2 * n - 2).bit_length()
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def widths(n: int, band: int) -> tuple[int, int]:
    """How many rows a band of rows has, and how many columns a band of columns."""
    r, c = shape_of(n)
    return max(1, min(r, band // c)), max(1, min(c, band // r))


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi j^2 / n); squares are reduced as whole numbers, so long series lose nothing."""
    return np.exp(1j * np.pi * ((j * j) % (2 * n)) / n)


def _twiddles(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    r, c = shape_of(n)
    return np.exp(-2j * np.pi * ((rows[:, None] * columns[None]) % (r * c)) / (r * c))


def _band(at: int, width: int, size: int) -> np.ndarray:
    return np.arange(at * width, min(size, (at + 1) * width), dtype=np.int64)


def _blocks(name: str, n: int, at: int, matrices: list[np.ndarray], width: int, axis: int) -> pa.Table:
    """The parts of matrices along an axis, one row for each band there."""
    bands = range(-(-matrices[0].shape[axis] // width))
    cut = [slice(k * width, (k + 1) * width) for k in bands]
    blobs = [b"".join(np.ascontiguousarray(m[s] if axis == 0 else m[:, s]).tobytes() for m in matrices) for s in cut]
    return pa.table({"series_id": [name] * len(blobs), "n": pa.array([n] * len(blobs), pa.int64()), "to": pa.array(list(bands), pa.int32()), "from": pa.array([at] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def long_powers(rows: DataFrame, band: int = BAND) -> DataFrame:
    """(series_id, k, period, power) of series (series_id, cpos, n, x): x without its mean, by place from 0 to n - 1, none missing.

    Bins are k = 1 to n / 2. A task holds some four matrices of ``band`` complex points, and one line of the matrix at least: 16,384 for 10^8 points.
    """
    block = "series_id string, n long, to int, from int, blob binary"

    def columns(key: tuple[pa.Scalar, ...], points: pa.Table) -> pa.Table:
        name, at, n = key[0].as_py(), key[1].as_py(), points["n"][0].as_py()
        r, c = shape_of(n)
        own = _band(at, widths(n, band)[1], c)
        j, x = points["cpos"].to_numpy(), points["x"].to_numpy()
        y = np.zeros((r, len(own)), np.complex128)
        y[j // c, j % c - own[0]] = x * np.conj(_chirp(j, n))
        place = np.arange(r)[:, None] * c + own[None]
        back = np.minimum(place, r * c - place)  # the chirp reaches as far before 0 as behind it
        h = np.where(back < n, _chirp(np.minimum(back, n), n), 0)
        twiddles = _twiddles(np.arange(r), own, n)
        return _blocks(name, n, at, [np.fft.fft(y, axis=0) * twiddles, np.fft.fft(h, axis=0) * twiddles], widths(n, band)[0], 0)

    def gathered(blocks: pa.Table, at: int, axis: int, count: int) -> list[np.ndarray]:
        """Matrices put together from the blocks of all bands across."""
        n = blocks["n"][0].as_py()
        shape, width = shape_of(n), widths(n, band)
        own = len(_band(at, width[1 - axis], shape[1 - axis]))
        out = [np.empty((shape[0], own) if axis == 0 else (own, shape[1]), np.complex128) for _ in range(count)]
        for k, blob in zip(blocks["from"].to_pylist(), blocks["blob"], strict=True):
            s = slice(k * width[axis], (k + 1) * width[axis])
            flat = np.frombuffer(blob.as_buffer(), np.complex128).reshape(count, -1)
            for m, part in zip(out, flat, strict=True):
                if axis == 0:
                    m[s] = part.reshape(-1, own)
                else:
                    m[:, s] = part.reshape(own, -1)
        return out

    def across(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        name, at, n = key[0].as_py(), key[1].as_py(), blocks["n"][0].as_py()
        y, h = gathered(blocks, at, 1, 2)
        z = np.fft.ifft(np.fft.fft(y, axis=1) * np.fft.fft(h, axis=1), axis=1)
        z *= np.conj(_twiddles(_band(at, widths(n, band)[0], shape_of(n)[0]), np.arange(shape_of(n)[1]), n))
        return _blocks(name, n, at, [z], widths(n, band)[1], 1)

    def powers(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        name, at, n = key[0].as_py(), key[1].as_py(), blocks["n"][0].as_py()
        r, c = shape_of(n)
        (z,) = gathered(blocks, at, 0, 1)
        k = (np.arange(r)[:, None] * c + _band(at, widths(n, band)[1], c)[None]).ravel()
        kept = (k >= 1) & (k <= n // 2)
        k, power = k[kept], np.abs(np.fft.ifft(z, axis=0).ravel()[kept]) ** 2
        return pa.table({"series_id": pa.array([name]).take(pa.array(np.zeros(len(k), np.int8))), "k": k, "period": n / k, "power": power})

    bits = F.length(F.bin(2 * F.col("n") - 2))  # as in shape_of and widths
    one, down = F.lit(1).cast("long"), F.floor(bits / 2).cast("int")
    r, c = F.call_function("shiftleft", one, down), F.call_function("shiftleft", one, bits - down)
    width = F.greatest(one, F.least(c, F.floor(F.lit(band) / r)))
    placed = rows.withColumn("band", F.floor((F.col("cpos") % c) / width).cast("int"))
    first = placed.select("series_id", "band", "cpos", "n", "x").groupBy("series_id", "band").applyInArrow(columns, block)
    second = first.groupBy("series_id", "to").applyInArrow(across, block)
    return second.groupBy("series_id", "to").applyInArrow(powers, "series_id string, k long, period double, power double")
