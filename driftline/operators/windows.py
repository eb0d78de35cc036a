"""Trailing windows: which window a row belongs to is arithmetic in its position, never a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.sources.series import compact


def _sized(series: DataFrame, settings: DataFrame, on_short: str) -> DataFrame:
    """The rows that have a value, numbered, with their series' number of these (m), window size (w) and stride (s)."""
    if on_short not in ("error", "skip"):
        raise ValueError("on_short must be 'error' or 'skip'")
    rows = compact(series if "branch" in series.columns else series.withColumn("branch", F.lit("raw")))
    sizes = settings.select("series_id", F.col("window_size").cast("long").alias("w"), F.col("stride").cast("long").alias("s"))
    rows = rows.join(sizes, "series_id")
    m, w = F.col("m"), F.col("w")
    short = F.raise_error(F.concat(F.lit("shorter than its window: series "), F.col("series_id")))
    return rows.where(m >= w) if on_short == "skip" else rows.withColumn("w", F.when(m < w, short.cast("long")).otherwise(w))


def window_members(series: DataFrame, settings: DataFrame, on_short: str = "error") -> DataFrame:
    """(series_id, branch, window_no, window_end_pos, cpos, pos, time, value): each row once for each window that covers it.

    Windows have ``window_size`` rows that aren't missing and end every ``stride`` rows; the last one ends at the last row.
    A series shorter than its window is an error, or left out with ``on_short="skip"``.
    """
    rows = _sized(series, settings, on_short)
    c, m, w, s = (F.col(x) for x in ("cpos", "m", "w", "s"))
    last = F.floor((m - w) / s)
    low, high = F.greatest(F.lit(0), F.floor((c - w + s) / s)), F.least(F.floor(c / s), last)
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("window_no"), (i * s + w - 1).alias("window_end_pos")))).otherwise(F.array().cast("array<struct<window_no:bigint,window_end_pos:bigint>>"))
    extra = F.when((c >= m - w) & ((m - w) % s != 0), F.array(F.struct((last + 1).alias("window_no"), (m - 1).alias("window_end_pos")))).otherwise(F.array().cast("array<struct<window_no:bigint,window_end_pos:bigint>>"))
    return rows.select("series_id", "branch", F.inline(F.concat(regular, extra)), "cpos", "pos", "time", "value")


#: Windows' lengths that a block of positions has, so that an eighth of the rows at most is in two blocks.
LENGTHS = 8


def position_blocks(series: DataFrame, settings: DataFrame, on_short: str = "error") -> DataFrame:
    """(series_id, branch, block, w, windows, points): series cut into blocks, each with all rows of the windows that end in it.

    A block has the rows of ``LENGTHS`` windows and, in front of them, those that its first windows reach back to: the rows are shuffled 1 + 1 / ``LENGTHS`` times, whatever the stride. ``points`` are
    (cpos, pos, time, value) in order, ``windows`` (window_no, window_end_pos, offset), the offset being where a window begins among the points. Windows are those of ``window_members``.

    Blocks are dealt to a fixed number of partitions: their fits cost far more than their bytes tell adaptive planning, which would put many into one task.
    """
    rows = _sized(series, settings, on_short)
    c, m, w, s = (F.col(x) for x in ("cpos", "m", "w", "s"))
    size = LENGTHS * w
    home = F.floor(c / size)
    # the next block's first windows reach back w - 1 rows, if it has rows
    after = F.when((c >= (home + 1) * size - w + 1) & ((home + 1) * size < m), home + 1).otherwise(home)
    rows = rows.withColumn("block", F.explode(F.sequence(home, after)))
    begin, end = F.col("block") * size, F.least((F.col("block") + 1) * size, m)
    low = F.greatest(F.lit(0), F.ceil((begin - w + 1) / s))
    high = F.least(F.floor((m - w) / s), F.floor((end - w) / s))
    extra = (end == m) & ((m - w) % s != 0)
    rows = rows.where((low <= high) | extra)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(n, "series_id", "branch", "block").groupBy("series_id", "branch", "block", "w", "s", "m")
    packed = grouped.agg(F.sort_array(F.collect_list(F.struct("cpos", "pos", "time", "value"))).alias("points"))
    none = F.array().cast("array<bigint>")
    numbers = F.concat(F.when(low <= high, F.sequence(low, high)).otherwise(none), F.when(extra, F.array(F.floor((m - w) / s) + 1)).otherwise(none))
    first = F.element_at("points", 1)["cpos"]

    def window(i: Column) -> Column:
        ends = F.least(i * s + w - 1, m - 1)
        return F.struct(i.alias("window_no"), ends.alias("window_end_pos"), (ends - w + 1 - first).cast("int").alias("offset"))

    return packed.select("series_id", "branch", "block", F.col("w").cast("int").alias("w"), F.transform(numbers, window).alias("windows"), "points")


def trailing_windows(series: DataFrame, settings: DataFrame, on_short: str = "error") -> DataFrame:
    """(series_id, branch, window_no, window_end_pos, window_start, window_end, points): a row for each window, a slice of its block."""
    cut = position_blocks(series, settings, on_short).select("series_id", "branch", "w", "points", F.explode("windows").alias("x"))
    own = cut.select("series_id", "branch", "x.window_no", "x.window_end_pos", F.slice("points", F.col("x.offset") + 1, F.col("w")).alias("points"))
    return own.select("series_id", "branch", "window_no", "window_end_pos", F.element_at("points", 1)["time"].alias("window_start"), F.element_at("points", -1)["time"].alias("window_end"), "points")
