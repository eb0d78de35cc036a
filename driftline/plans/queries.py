"""The registered queries over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalar import dataset_folder, numeric, order_fault, run_name, safe_name
from driftline.operators import augment, evaluate, periods, preprocess, scoring, windows, zoom
from driftline.plans import fixtures as fx
from driftline.plans.corpus import compare_runs, prepare_corpus, prepared, read_runs, write_metrics, write_run, write_summary, write_window_results
from driftline.plans.scoring import Parameters, corpus_metrics, scored_corpus, single_series
from driftline.sources import corpus
from driftline.session import checkpointed, shared_folder
from driftline.sources.headers import file_headers, missing_columns
from driftline.sources.naming import read_manifest, write_named
from driftline.sources.series import compact, read_labels, read_periods, read_series

Query = Callable[[SparkSession, str], DataFrame]
SHORT = {"window_size": 50, "stride": 12}


def shown(df: DataFrame, **digits: int) -> DataFrame:
    """Times as text, whole numbers as bigint, and doubles rounded as told."""
    def cell(name: str, kind: str):
        if name in digits:
            return F.round(name, digits[name])
        if kind.startswith("timestamp"):
            return F.col(name).cast("string")
        return F.col(name).cast("bigint") if kind in ("int", "tinyint", "smallint") else F.col(name)

    return df.select(*(cell(n, k).alias(n) for n, k in df.dtypes))


def series_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fx.event_series(spark, sf_dir))


def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    text = F.when(pos % 29 == 0, F.lit("bad")).when(pos % 31 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    rows = fx.event_series(spark, sf_dir).withColumn("value", numeric(text))
    return rows.where("value IS NOT NULL").select("series_id", "pos", "value")


def compact_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(fx.gappy_series(spark, sf_dir), 100).select("series_id", "pos", "cpos", "m")


def text_series_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of each series as a text of numbers, some lines long, decoded again."""
    day = F.floor(F.col("pos") / 500)
    rows = fx.event_series(spark, sf_dir).groupBy("series_id", day.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    cells = F.transform("v", lambda x: F.concat(x["value"].cast("string"), F.when(x["pos"] % 7 == 0, F.lit(" \n")).otherwise(F.lit("  "))))
    files = rows.select(F.concat("series_id", F.lit("/"), F.col("part").cast("string")).alias("file_name"), F.array_join(cells, "").alias("content"))
    return shown(corpus.decode_values(files))


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.file_metadata(fx.part_files(spark, sf_dir))
    return shown(found.withColumns({"folder": dataset_folder(F.col("dataset_id"), F.col("dataset_name")), "safe": safe_name(F.col("dataset_name"))}))


def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = corpus.last_of_name(fx.part_categories(spark, sf_dir))
    return corpus.with_category(fx.part_files(spark, sf_dir).select("file_name"), categories)


def labelled_series_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.event_series(spark, sf_dir)
    labels = fx.event_labels(series).where("series_id != 'view'")
    return corpus.labelled_only(series, labels).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def dataset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.event_series(spark, sf_dir)
    first = corpus.first_datasets(series.select("series_id").distinct(), 3, "series_id")
    return series.join(first, "series_id", "left_semi").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def point_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.event_series(spark, sf_dir)
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    late = F.col("series_id") == "view"
    catalog = sizes.select("series_id", F.when(late, F.lit(-5)).otherwise(F.expr("n div 2")).alias("anomaly_start"), F.when(late, F.lit(7)).otherwise(F.col("n") + 50).alias("anomaly_end"), F.concat(F.lit("kind "), F.col("series_id")).alias("category"))
    return shown(evaluate.point_labels(series, catalog))


def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(periods.acf(fx.seasonal_series(spark, sf_dir), block=256), acf=6)


def period_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(periods.autocorr_periods(fx.seasonal_series(spark, sf_dir)))


def period_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aperiodic series have no period by autocorrelation."""
    return shown(periods.autocorr_periods(fx.event_series(spark, sf_dir)))


def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each bin in the power of the whole spectrum."""
    bins = periods.periodogram(fx.seasonal_series(spark, sf_dir))
    total = bins.groupBy("series_id").agg(F.sum("power").alias("total"))
    return bins.join(total, "series_id").select("series_id", "k", F.round("period", 6).alias("period"), F.round(F.col("power") / F.col("total"), 8).alias("share"))


def period_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(periods.fft_periods(fx.seasonal_series(spark, sf_dir)))


def series_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.guards(fx.gappy_series(spark, sf_dir))
    return shown(found, mean=6, std=6)


def window_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(preprocess.window_settings(fx.seasonal_series(spark, sf_dir)))


def seasonal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.seasonal_series(spark, sf_dir)
    return shown(preprocess.seasonal_diff(series, preprocess.window_settings(series)), value=6)


def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.gappy_series(spark, sf_dir)
    found = windows.trailing_windows(series, fx.fixed_settings(series))
    return shown(found.select("series_id", "window_no", "window_end_pos", "window_start", "window_end", F.size("points").alias("n"), F.element_at("points", 1)["pos"].alias("first_pos"), F.element_at("points", -1)["pos"].alias("last_pos")))


def window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.event_series(spark, sf_dir)
    found = windows.window_members(series, fx.fixed_settings(series, 50, 70))
    return found.select("series_id", "window_no", "window_end_pos", "pos")


def _score(order: tuple[int, int, int], digits: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = fx.event_series(spark, sf_dir)
        found = scoring.scores(scoring.score_series(series, fx.fixed_settings(series), order))
        return shown(found.drop("branch", "converged"), sigma2=digits)

    query.__doc__ = f"Scores of windows of 50 every 12 rows by a model of order {order}."
    return query


def _residual(order: tuple[int, int, int], burn: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = fx.gappy_series(spark, sf_dir)
        found = scoring.residual_series(scoring.score_series(series, fx.fixed_settings(series), order, burn=burn), series)
        return shown(found.drop("branch"), residual=6)

    query.__doc__ = f"Mean residuals over windows of a model of order {order}{', without the first of each' * burn}."
    return query


def both_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.seasonal_series(spark, sf_dir)
    settings = preprocess.window_settings(series)
    both = preprocess.branches(series, settings, ("both",))
    return shown(scoring.scores(scoring.score_series(both, settings, (0, 0, 0))).drop("converged"), sigma2=4)


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    series = fx.event_series(spark, sf_dir)
    scored = scoring.scores(scoring.score_series(series, fx.fixed_settings(series), (0, 1, 0)))
    return series, fx.event_labels(series), scored


def window_label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels, scored = _scored(spark, sf_dir)
    return shown(scoring.overlaps(scored, labels).select("series_id", "window_no", "actual_anomaly"))


def window_train_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels, scored = _scored(spark, sf_dir)
    return shown(scoring.train_flags(scored, labels).select("series_id", "window_no", "is_train"))


def window_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels, scored = _scored(spark, sf_dir)
    return shown(scoring.window_results(scored, labels.where("series_id != 'view'")).drop("branch", "converged"), sigma2=4)


def anomaly_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.anomaly_bounds(fx.event_labels(fx.event_series(spark, sf_dir))))


def localisation_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, labels, scored = _scored(spark, sf_dir)
    return shown(evaluate.localisation(scoring.window_results(scored, labels), evaluate.anomaly_bounds(labels), series), ucr_prediction_score=4)


def _metrics(order: tuple[int, int, int]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = checkpointed(fx.seasonal_series(spark, sf_dir))  # read by most steps of the plan
        return shown(corpus_metrics(series, fx.event_labels(series), fx.event_catalog(series), Parameters(order=order, **SHORT)), ucr_prediction_score=4)

    query.__doc__ = f"The whole scoring plan with a model of order {order}: a row of metrics for each series."
    return query


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window results of the series ``error`` without labels, order (1, 0, 1)."""
    series = fx.seasonal_series(spark, sf_dir).where("series_id = 'error'")
    return shown(single_series(series, None, Parameters(order=(1, 0, 1), **SHORT))[0], sigma2=4)


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.category_summary(fx.order_metrics(spark, sf_dir)), ucr_accuracy=8)


def overall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.overall_summary(fx.order_metrics(spark, sf_dir)), ucr_accuracy=8)


def prepared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.prepared_counts(category_lookup(spark, sf_dir))


def zoom_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, labels, scored = _scored(spark, sf_dir)
    bounds = zoom.zoom_bounds(series, evaluate.anomaly_bounds(labels), 100)
    return shown(zoom.zoom_scores(scoring.window_results(scored, labels), bounds).select("series_id", "window_no", "window_end", "is_best_in_zoom"))


def variance_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.event_series(spark, sf_dir)
    bursts = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select("series_id", F.expr("n div 2").alias("start"), F.expr("n div 10").alias("duration"))
    return shown(augment.variance_burst(series, bursts, 3.0, 7), value=6)


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' names next to the number of points that each would score."""
    series = fx.event_series(spark, sf_dir)
    names = [run_name((1, 1, 1), "seasonal_diff", "autocorr", 200, 50), run_name((1, 0, 1), "raw", "fft", 200, 50, "mine"), run_name((1, 0, 1), "seasonal_diff", "fft", 200, 50, single=True)]
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points")).select("series_id", F.explode(F.array(*map(F.lit, names))).alias("run_name"), "n_points")


def period_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of the series against the one that is in them."""
    series = fx.seasonal_series(spark, sf_dir)
    found = preprocess.window_settings(series).withColumn("dataset_idx", F.col("series_id"))
    curated = found.select("dataset_idx", F.lit(fx.PERIOD).alias("period"))
    return shown(evaluate.period_accuracy(found.select("dataset_idx", "estimated_period"), curated))


def corpus_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series as a raw file, prepared: its labelled rows and folder."""
    rows = fx.event_series(spark, sf_dir).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"), F.count(F.lit(1)).alias("n"))
    name = F.format_string("%03d_UCR_Anomaly_%s_%d_%d_%d.txt", F.ascii("series_id"), F.col("series_id"), F.expr("n div 4"), F.expr("n div 2"), F.col("n") + 9)
    files = rows.select(name.alias("file_name"), F.array_join(F.transform("v", lambda x: x["value"].cast("string")), "\n").alias("content"))
    categories = files.select(F.col("file_name").alias("name"), F.lit("kind a").alias("category")).where("name LIKE '%error%'")
    catalog, series, labels = prepared(files, categories)
    counted = series.join(labels, ["series_id", "pos"]).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"), F.sum("is_anomaly").alias("n_anomaly"), F.round(F.sum("value"), 4).alias("total"))
    return shown(catalog.select("series_id", "folder", "category").join(counted, "series_id"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _named(path: str) -> Column:
    """The series that a file's path names as ``series=<name>``."""
    return F.regexp_extract(path, r"series=([^/]+)/", 1)


def csv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series written as a CSV file with cells that aren't numbers, and read again."""
    cell = F.when(F.col("pos") % 29 == 0, F.lit("bad")).when(F.col("pos") % 31 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    out = _folder(spark, "series")
    rows = fx.event_series(spark, sf_dir).select(F.col("series_id").alias("series"), "time", cell.alias("value"))
    write_named(rows, ["series"], ["time"], out, lambda v: f"series={v['series']}/data.csv")
    return shown(read_series(spark, out).withColumn("series_id", _named("series_id")))


def csv_series_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series written as a CSV file and read again, where any cell that isn't a number would be an error."""
    out = _folder(spark, "series")
    rows = fx.event_series(spark, sf_dir).select(F.col("series_id").alias("series"), "time", "value")
    write_named(rows, ["series"], ["time"], out, lambda v: f"series={v['series']}/data.csv")
    return shown(read_series(spark, out, coerce=False).withColumn("series_id", _named("series_id")))


def csv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each series written as a CSV file and read again."""
    out = _folder(spark, "labels")
    rows = fx.event_labels(fx.event_series(spark, sf_dir)).select(F.col("series_id").alias("series"), "time", "is_anomaly", "anomaly_type", "is_train")
    write_named(rows, ["series"], ["time"], out, lambda v: f"series={v['series']}/labels.csv")
    return shown(read_labels(spark, out).withColumn("series_id", _named("series_id")))


def csv_labels_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as CSV files whose columns are in another order, and fewer, in some files; read by each file's own header."""
    out = _folder(spark, "labels")
    rows = checkpointed(fx.event_labels(fx.event_series(spark, sf_dir)).withColumnRenamed("series_id", "series"))
    for part, columns in (("series IN ('view', 'click')", ["is_train", "anomaly_type", "is_anomaly"]), ("series = 'error'", ["is_anomaly"]), ("series NOT IN ('view', 'click', 'error')", ["is_anomaly", "anomaly_type", "is_train"])):
        write_named(rows.where(part).select("series", "time", *columns), ["series"], ["time"], out, lambda v: f"series={v['series']}/labels.csv")
    return shown(read_labels(spark, out).select(_named("series_id").alias("series_id"), "pos", "time", "is_anomaly", "anomaly_type", "is_train"))


def corpus_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared corpus of CSV files, most of which have a fault of some kind, scored with what is wrong left out: the status of each, with the metric of those scored."""
    out = _folder(spark, "faulty")
    fx.faulty_corpus(spark, sf_dir, out)
    series, labels, found = corpus.read_prepared_status(spark, out)
    metrics, status = scored_corpus(series, labels, found, Parameters(order=(0, 1, 0), mode="raw", on_error="skip", **SHORT), found)
    of_metric = metrics.select("category", "dataset_name", "n_windows", "ucr_prediction_index", "ucr_prediction_score", "ucr_correct")
    return shown(status.join(of_metric, ["category", "dataset_name"], "left").drop("series_id"), ucr_prediction_score=4)


def sink_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of metrics written as a file for each category, and the rows that are read again, though the session asks for files of 100 rows."""
    out = _folder(spark, "metrics")
    limit = "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        write_metrics(fx.order_metrics(spark, sf_dir), out)
    finally:
        spark.conf.set(limit, before)
    read = spark.read.csv(f"{out}/*/*_evaluation.csv", header=True).groupBy(F.url_decode(F.col("_metadata.file_name")).alias("file")).agg(F.count(F.lit(1)).alias("n_read"))
    manifest = read_manifest(spark, out).withColumn("file", F.substring_index("name", "/", -1))
    return manifest.join(read, "file", "left").select("name", "n_rows", "n_read")


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs in one table, of which the second replaces an earlier one of its name, and the comparison of the first two."""
    out = _folder(spark, "runs")
    metrics = fx.order_metrics(spark, sf_dir)
    key = F.substring("dataset_name", 4, 20).cast("long")
    write_run(metrics, out, "first")
    write_run(metrics.withColumn("ucr_correct", F.lit(1)), out, "second")
    write_run(metrics.limit(0), out, "empty")
    write_run(metrics.where(key % 5 != 0).withColumn("ucr_correct", (key % 2 == 0).cast("int")), out, "second")
    return shown(compare_runs(read_runs(spark, out), "first", "second"), accuracy_change=8)


def _raw_corpus(spark: SparkSession, sf_dir: str) -> str:
    """A folder of raw corpus files, one for each series."""
    rows = fx.event_series(spark, sf_dir)
    sizes = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.format_string("%03d_UCR_Anomaly_%s_%d_%d_%d.txt", F.ascii("series_id"), F.col("series_id"), F.expr("n div 4"), F.expr("n div 2"), F.col("n") + 9)
    named = rows.join(sizes.select("series_id", name.alias("file")), "series_id").select("file", "pos", F.col("value").cast("string").alias("value"))
    # a line for each number; lines are written in the order of positions
    parts = named.groupBy("file", F.floor(F.col("pos") / 1000).alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    lines = parts.select("file", F.col("part").alias("at"), F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("value"))
    out = _folder(spark, "raw")
    write_named(lines.select("file", "at", "value"), ["file"], ["at"], out, lambda v: v["file"], kind="text")
    return out


def raw_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files, one for each series, read, decoded and described by their names."""
    files = corpus.read_raw_files(spark, _raw_corpus(spark, sf_dir))
    known = corpus.file_metadata(files).select("file_name", "dataset_name", "train_end", "anomaly_start", "anomaly_end")
    return shown(corpus.decode_values(files).withColumnRenamed("series_id", "file_name").join(known, "file_name").drop("file_name"))


def raw_corpus_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files, those of two series as one line each, read in ranges of bytes."""
    rows = checkpointed(fx.event_series(spark, sf_dir).select(F.concat(F.lit("001_UCR_Anomaly_"), "series_id", F.lit("_1_2_3.txt")).alias("file"), F.col("pos").alias("at"), F.col("value").cast("string").alias("value")))
    out, flat = _folder(spark, "raw"), F.col("file").rlike("view|click")
    write_named(rows.where(~flat), ["file"], ["at"], out, lambda v: v["file"], kind="text")
    write_named(rows.where(flat), ["file"], ["at"], out, lambda v: v["file"], kind="text", line_end="  ")
    found = corpus.read_raw_values(spark, out)
    return shown(found.withColumn("file_name", corpus.file_field(F.col("file_name"), 2)))


def _prepared(layout: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw, out = _raw_corpus(spark, sf_dir), _folder(spark, "prepared")
        kinds = fx.event_series(spark, sf_dir).select("series_id").distinct().where("series_id = 'error'")
        sizes = fx.event_series(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).join(kinds, "series_id")
        name = F.format_string("%03d_UCR_Anomaly_%s_%d_%d_%d.txt", F.ascii("series_id"), F.col("series_id"), F.expr("n div 4"), F.expr("n div 2"), F.col("n") + 9)
        sizes.select(name.alias("name"), F.lit("kind a").alias("anomaly_type_2")).coalesce(1).write.csv(f"{raw}-categories", sep=";", header=True)
        prepare_corpus(spark, raw, f"{raw}-categories", out, layout=layout)
        series, labels = corpus.read_prepared(spark, out)
        rows = series.select("category", "dataset_name", "pos", "time", "value").join(labels.select("category", "dataset_name", "pos", "is_anomaly", "anomaly_type"), ["category", "dataset_name", "pos"])
        return shown(rows)

    query.__doc__ = f"A raw corpus prepared, written as {layout} and read again."
    return query


def category_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category map written as a CSV file and read again; of rows of one name the last one counts."""
    out = _folder(spark, "categories")
    fx.part_categories(spark, sf_dir).orderBy("line_no", "name").select("name", "anomaly_type_2").coalesce(1).write.csv(out, sep=";", header=True)
    return corpus.read_category_map(spark, out)


def order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two to four numbers from the parts, some negative or fractions, and what is wrong with each."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    numbers = F.array(size % 3, F.when(k % 7 == 0, -size).otherwise(size % 2), F.when(k % 5 == 0, size / 4).otherwise(F.lit(1.0)), F.lit(0.0))
    order = F.slice(numbers, 1, F.when(k % 11 == 0, 2).when(k % 13 == 0, 4).otherwise(3))
    return fx.table(spark, sf_dir, "part").select(k.alias("p_partkey"), order_fault(order).alias("fault"))


def category_map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category maps, one for each brand, with other headers: those that lack a column, and which."""
    out = _folder(spark, "maps")
    rows = checkpointed(fx.part_categories(spark, sf_dir).select(F.col("anomaly_type_2").alias("brand"), "name").where("brand LIKE 'Brand%'"))
    for part, columns in (("brand < 'Brand#2'", ["name", "other"]), ("brand >= 'Brand#2' AND brand < 'Brand#4'", ["anomaly_type_2", "name"]), ("brand >= 'Brand#4'", ["kind", "other"])):
        own = rows.where(part)
        if not own.isEmpty():
            write_named(own.select("brand", *(F.col("name").alias(c) for c in columns)), ["brand"], ["brand"], out, lambda v: f"brand={v['brand'].replace('#', '-')}/types.csv")
    found = missing_columns(file_headers(spark, out), corpus.MAP_COLUMNS)
    return found.select(F.regexp_extract("file_path", r"brand=([^/]+)/", 1).alias("brand"), F.array_join("missing", ", ").alias("missing"))


def period_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of curated periods written as a CSV file and read again."""
    out = _folder(spark, "periods")
    remark = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
    fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dataset_idx"), F.col("p_size").alias("period"), remark.alias("remarks")).write.csv(out, header=True)
    return shown(read_periods(spark, out))


def window_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window results written by category and dataset, and read again."""
    series, labels, scored = _scored(spark, sf_dir)
    out = _folder(spark, "windows")
    found = scoring.window_results(scored, labels).join(fx.event_catalog(series), "series_id")
    write_window_results(found, out)
    read = spark.read.csv(out, header=True, schema="time string, window_start timestamp_ntz, window_end timestamp_ntz, sigma2 double, actual_anomaly long, predicted_anomaly long, category string, dataset_name string")
    return shown(read.select("category", "dataset_name", "window_start", "window_end", "sigma2", "actual_anomaly", "predicted_anomaly"), sigma2=4)


def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as a file for each category, and read again with the category that a file's name says."""
    out = _folder(spark, "metrics")
    write_metrics(fx.order_metrics(spark, sf_dir), out)
    read = spark.read.csv(f"{out}/*/*_evaluation.csv", header=True, schema="category string, dataset_name string, ucr_correct long")
    return read.select("dataset_name", "ucr_correct", "category", F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_evaluation\.csv$", 1)).alias("file_category"))


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written as one file of a given name, and read again."""
    out = f"{_folder(spark, 'summary')}/overall_evaluation.csv"
    write_summary(fx.order_metrics(spark, sf_dir), out)
    return shown(spark.read.csv(out, header=True, schema="category string, n_datasets long, n_correct long, ucr_accuracy double"), ucr_accuracy=8)


def single_series_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric of series scored without a corpus, raw, by a model of order (0, 1, 0)."""
    series = fx.event_series(spark, sf_dir)
    found = single_series(series, fx.event_labels(series), Parameters(order=(0, 1, 0), mode="raw", **SHORT))[1]
    return shown(found, ucr_prediction_score=4)


QUERIES: dict[str, Query] = {
    "series_positions": series_positions,
    "numeric_coercion": numeric_coercion,
    "compact_positions": compact_positions,
    "text_series_decode": text_series_decode,
    "file_metadata": file_metadata,
    "category_lookup": category_lookup,
    "labelled_series_only": labelled_series_only,
    "dataset_limit": dataset_limit,
    "point_labels": point_labels,
    "acf": acf,
    "period_autocorr": period_autocorr,
    "period_none": period_none,
    "periodogram": periodogram,
    "period_fft": period_fft,
    "series_guards": series_guards,
    "window_settings": window_settings,
    "seasonal_diff": seasonal_diff,
    "trailing_windows": trailing_windows,
    "window_members": window_members,
    "score_000": _score((0, 0, 0), 4),
    "score_010": _score((0, 1, 0), 4),
    "score_020": _score((0, 2, 0), 8),
    "score_110": _score((1, 1, 0), 2),
    "score_111": _score((1, 1, 1), 2),
    "score_101": _score((1, 0, 1), 2),
    "residual_mean_000": _residual((0, 0, 0)),
    "residual_mean_010": _residual((0, 1, 0)),
    "residual_mean_020_burn": _residual((0, 2, 0), burn=True),
    "both_branches": both_branches,
    "window_label_overlap": window_label_overlap,
    "window_train_flag": window_train_flag,
    "window_results": window_results,
    "anomaly_bounds": anomaly_bounds,
    "localisation_metric": localisation_metric,
    "pipeline_metrics": _metrics((1, 1, 1)),
    "pipeline_metrics_010": _metrics((0, 1, 0)),
    "single_series": single,
    "category_summary": category_summary,
    "overall_summary": overall_summary,
    "prepared_counts": prepared_counts,
    "zoom_slice": zoom_slice,
    "variance_burst": variance_burst,
    "run_name": run_names,
    "period_accuracy": period_accuracy,
    "corpus_prepare": corpus_prepare,
    "csv_series": csv_series,
    "csv_series_strict": csv_series_strict,
    "csv_labels": csv_labels,
    "csv_labels_by_header": csv_labels_by_header,
    "corpus_skip": corpus_skip,
    "sink_manifest": sink_manifest,
    "run_table": run_table,
    "raw_corpus_files": raw_corpus_files,
    "raw_corpus_ranges": raw_corpus_ranges,
    "prepared_corpus_csv": _prepared("csv"),
    "prepared_corpus_parquet": _prepared("parquet"),
    "category_file": category_file,
    "period_file": period_file,
    "order_faults": order_faults,
    "category_map_columns": category_map_columns,
    "window_result_files": window_result_files,
    "metric_files": metric_files,
    "summary_file": summary_file,
    "single_series_metric": single_series_metric,
}
