"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second 0 of every synthetic time axis.
ORIGIN = "2026-01-01 00:00:00"
#: How far from the labelled interval a prediction may lie.
TOLERANCE = 100
#: Fixed value: the pattern of a raw corpus file's name.
FILE_PATTERN = r"^(\d+)_UCR_Anomaly_(.+)_(\d+)_(\d+)_(\d+)\.txt$"


def numeric(text: Column) -> Column:
    """A double; what isn't a number, and NaN, become null, so that there is one marker for missing values."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def axis_time(pos: Column) -> Column:
    """The time of a position on a one-second axis."""
    return F.timestamp_add("SECOND", pos, F.lit(ORIGIN).cast("timestamp_ntz"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def midpoint_time(start: Column, end: Column) -> Column:
    """The middle of a window, rounded down to a second."""
    return F.timestamp_add("SECOND", F.floor(seconds_between(start, end) / 2), start)


def window_size_for(period: Column, least: int = 50) -> Column:
    """Two periods, ``least`` at least."""
    return F.greatest(F.lit(least), 2 * period).cast("int")


def stride_for(window_size: Column) -> Column:
    """A quarter of a window; a half is rounded to the even number."""
    return F.greatest(F.lit(1), F.bround(window_size * 0.25).cast("int"))


def is_correct(index: Column, start: Column, end: Column) -> Column:
    return F.coalesce(index.between(start - TOLERANCE, end + TOLERANCE), F.lit(False)).cast("int")


def safe_name(name: Column) -> Column:
    """A name that is safe in a path; ``unknown`` if nothing is left of it."""
    cleaned = F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown"))


def dataset_folder(dataset_id: Column, dataset_name: Column) -> Column:
    return F.format_string("ucr_%03d_%s", dataset_id, safe_name(dataset_name))


def decoded_file_name(encoded: Column) -> Column:
    """Spark's percent-encoded file name as it is on disk; a plus sign stays one."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def file_field(file_name: Column, k: int) -> Column:
    """The k-th field of a raw file's name; an error if the name isn't of their form."""
    wrong = F.raise_error(F.concat(F.lit("not the name of a corpus file: "), file_name))
    return F.when(file_name.rlike(FILE_PATTERN), F.regexp_extract(file_name, FILE_PATTERN, k)).otherwise(wrong.cast("string"))


def order_fault(order: Column) -> Column:
    """Why an array of numbers isn't a model order, null where it is one: ``length``, or ``value`` if any isn't a whole number from 0 on."""
    whole = F.forall(order, lambda x: F.coalesce((x >= 0) & (x == F.floor(x)), F.lit(False)))
    return F.when(F.coalesce(F.size(order), F.lit(0)) != 3, F.lit("length")).when(~whole, F.lit("value"))


def unit_noise(seed: Column, pos: Column) -> Column:
    """A standard normal number that depends on seed and position only (Box and Muller, on halves of an MD5)."""
    digest = F.md5(F.concat(seed.cast("string"), F.lit(":"), pos.cast("string")))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    v = F.conv(F.substring(digest, 9, 8), 16, 10).cast("double") / 4294967296.0
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def run_name(order: tuple[int, int, int], mode: str, method: str, window_size: int, stride: int, base: str | None = None, single: bool = False) -> str:
    """The name of a run's outputs."""
    part = f"raw-w{window_size}-s{stride}" if mode == "raw" else method
    model = "".join(map(str, order))
    return f"simulation_period-{part}_arima{model}" if single else f"{base or 'ucr'}_preproc-{part}_arima{model}"
