"""DuckDB SQL that checks the registered queries on the same tables."""

from __future__ import annotations

EV = """ev AS (
  SELECT event_type AS series_id, pos, TIMESTAMP '2026-01-01' + to_seconds(pos) AS time, value
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events)
), sizes AS (
  SELECT series_id, count(*) AS n FROM ev GROUP BY series_id
)"""

SEASONAL = f"""{EV}, sea AS (
  SELECT series_id, pos, time, value + 200 * sin(2 * pi() * (pos % 24) / 24) AS value FROM ev
)"""

GAPS = f"""{EV}, gap AS (
  SELECT series_id, pos, time, CASE WHEN pos % 17 <> 3 THEN value END AS value FROM ev
), com AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS cpos, count(*) OVER (PARTITION BY series_id) AS m
  FROM gap WHERE value IS NOT NULL
)"""

LABELS = """lab AS (
  SELECT series_id, pos, time, CASE WHEN pos BETWEEN n // 2 AND n // 2 + n // 10 - 1 THEN 1 ELSE 0 END AS is_anomaly,
         CASE WHEN pos < n // 4 THEN 1 ELSE 0 END AS is_train
  FROM ev JOIN sizes USING (series_id)
)"""


def windows(source: str, size: str = "50", stride: str = "12") -> str:
    """CTEs: the windows of ``source`` (series_id, cpos, m, ...), and their rows."""
    return f"""dims AS (
  SELECT series_id, any_value(m) AS m, any_value({size}) AS w, any_value({stride}) AS s FROM {source} GROUP BY series_id
), win AS (
  SELECT series_id, w, i AS window_no, i * s + w - 1 AS window_end_pos FROM dims, unnest(range(0, (m - w) // s + 1)) AS u(i)
  UNION ALL
  SELECT series_id, w, (m - w) // s + 1, m - 1 FROM dims WHERE (m - w) % s <> 0
), mem AS (
  SELECT win.series_id, win.window_no, win.window_end_pos, x.cpos, x.pos, x.time, x.value,
         lag(x.value, 1) OVER b AS v1, lag(x.value, 2) OVER b AS v2
  FROM win JOIN {source} x ON x.series_id = win.series_id AND x.cpos BETWEEN window_end_pos - w + 1 AND window_end_pos
  WINDOW b AS (PARTITION BY win.series_id, win.window_no ORDER BY x.cpos)
)"""


EVW = f"{EV}, com AS (SELECT *, pos AS cpos, count(*) OVER (PARTITION BY series_id) AS m FROM ev), {windows('com')}"

ACF = """acf AS (
  SELECT a.series_id, g.lag, round(sum(a.x * b.x) / any_value(a.ss), 12) AS r, any_value(a.longest) AS longest
  FROM (
    SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS x,
           count(*) OVER (PARTITION BY series_id) * var_pop(value) OVER (PARTITION BY series_id) AS ss,
           least(count(*) OVER (PARTITION BY series_id) // 4, 1000) AS longest
    FROM {0}
  ) a, unnest(range(0, a.longest + 1)) AS g(lag)
  JOIN (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS x FROM {0}) b
    ON b.series_id = a.series_id AND b.pos = a.pos + g.lag
  GROUP BY a.series_id, g.lag
), peaks AS (
  SELECT *, CASE WHEN lag > 2 AND lag < longest AND r > lag(r) OVER o AND r >= lead(r) OVER o THEN 1 ELSE 0 END AS peak
  FROM acf WINDOW o AS (PARTITION BY series_id ORDER BY lag)
), best AS (
  SELECT * FROM peaks WHERE lag >= 2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY peak DESC, r DESC, lag) = 1
), per AS (
  SELECT sizes.series_id, CASE WHEN r >= 0.3 THEN lag END AS estimated_period FROM sizes LEFT JOIN best USING (series_id)
)"""

DFT = """bins AS (
  SELECT x.series_id, k, any_value(n) AS n, any_value(n) / k AS period,
         pow(sum(value * cos(2 * pi() * ((k * pos) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((k * pos) % n) / n)), 2) AS power
  FROM (SELECT sea.series_id, pos, n, value - avg(value) OVER (PARTITION BY sea.series_id) AS value FROM sea JOIN sizes ON sizes.series_id = sea.series_id) x,
       unnest(range(1, x.n // 2 + 1)) AS u(k)
  GROUP BY x.series_id, k
)"""

SETTINGS = """sett AS (
  SELECT series_id, estimated_period, estimated_period IS NOT NULL AS seasonal_adjustment,
         coalesce(greatest(50, 2 * estimated_period), {0}) AS window_size,
         coalesce(greatest(1, CAST(round_even(0.25 * greatest(50, 2 * estimated_period), 0) AS BIGINT)), {1}) AS stride
  FROM per
)"""

DIFF = """dif AS (
  SELECT sea.series_id, sea.pos, sea.time, CASE WHEN estimated_period IS NULL THEN sea.value ELSE sea.value - b.value END AS value
  FROM sea JOIN per ON per.series_id = sea.series_id
  LEFT JOIN sea b ON b.series_id = sea.series_id AND b.pos = sea.pos - estimated_period
)"""

SCORE_010 = """score AS (
  SELECT series_id, window_no, min(time) AS window_start, max(time) AS window_end, avg(pow(value - v1, 2)) AS sigma2 FROM mem GROUP BY 1, 2
)"""

RESULTS = f"""{EVW}, {LABELS}, {SCORE_010}, res AS (
  SELECT score.*, CASE WHEN EXISTS (SELECT 1 FROM lab WHERE lab.series_id = score.series_id AND is_anomaly = 1 AND time BETWEEN window_start AND window_end) THEN 1 ELSE 0 END AS actual_anomaly,
         CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY sigma2 DESC, window_no) = 1 THEN 1 ELSE 0 END AS predicted_anomaly
  FROM score
)"""

METRIC = """found AS (
  SELECT b.series_id, b.n_points, b.n_windows, a.anomaly_start, a.anomaly_end, b.sigma2,
         date_diff('second', TIMESTAMP '2026-01-01', window_start) + date_diff('second', window_start, window_end) // 2 AS index
  FROM best_window b JOIN (
    SELECT series_id, min(pos) AS anomaly_start, max(pos) AS anomaly_end FROM lab WHERE is_anomaly = 1 GROUP BY series_id
  ) a USING (series_id)
)"""

CATEGORIES = """files AS (
  SELECT *, format('{:03d}_UCR_Anomaly_{}+{}_{}_{}_{}.txt', p_partkey, p_name, p_brand, p_size * 10, p_size * 20, p_size * 30) AS file_name FROM part
), found AS (
  SELECT file_name, CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 3 <> 0 THEN p_type ELSE 'unknown' END AS category FROM files
)"""

HITS = "hits AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS ucr_correct FROM orders)"


def _score(expression: str, digits: int) -> str:
    return f"WITH {EVW} SELECT series_id, window_no, CAST(min(time) AS VARCHAR) AS window_start, CAST(max(time) AS VARCHAR) AS window_end, round({expression}, {digits}) AS sigma2 FROM mem GROUP BY series_id, window_no"


#: The exact likelihood of an autoregression of order one on m differences has its maximum at the middle root of a cubic.
_CUBIC = f"""WITH {EVW}, dd AS (
  SELECT series_id, window_no, time, cpos, value - v1 AS x, v1 - v2 AS y,
         row_number() OVER (PARTITION BY series_id, window_no ORDER BY cpos) AS k, count(*) OVER (PARTITION BY series_id, window_no) AS w
  FROM mem
), t AS (
  SELECT series_id, window_no, min(time) AS ws, max(time) AS we, any_value(w) - 1 AS m, sum(x * x) AS c, sum(x * y) AS b,
         sum(x * x) - sum(CASE WHEN k = 2 OR k = w THEN x * x END) AS a
  FROM dd GROUP BY 1, 2
), u AS (
  SELECT *, -b * (m - 2) / (a * (m - 1)) AS p2, -(a * m + c) / (a * (m - 1)) AS p1, b * m / (a * (m - 1)) AS p0 FROM t
), v AS (
  SELECT *, p1 - p2 * p2 / 3 AS p, 2 * p2 * p2 * p2 / 27 - p2 * p1 / 3 + p0 AS q FROM u
), z AS (
  SELECT *, 2 * sqrt(-p / 3) * cos(acos(greatest(-1, least(1, 3 * q / (2 * p) * sqrt(-3 / p)))) / 3 - 2 * pi() / 3) - p2 / 3 AS phi FROM v
)
SELECT series_id, window_no, CAST(ws AS VARCHAR) AS window_start, CAST(we AS VARCHAR) AS window_end, round((c - 2 * b * phi + a * phi * phi) / m, 2) AS sigma2 FROM z"""


def _residual(expression: str) -> str:
    return f"""WITH {GAPS}, {windows('com')}, r AS (
  SELECT series_id, pos, {expression} AS r FROM (SELECT *, avg(value) OVER (PARTITION BY series_id, window_no) AS mean FROM mem)
), a AS (
  SELECT series_id, pos, avg(r) AS residual FROM r GROUP BY series_id, pos
)
SELECT gap.series_id, gap.pos, CAST(gap.time AS VARCHAR) AS time, round(residual, 6) AS residual FROM gap LEFT JOIN a ON a.series_id = gap.series_id AND a.pos = gap.pos"""


_PREPARED = f"""WITH {EV}, f AS (
  SELECT ev.*, n, format('ucr_{{:03d}}_{{}}', ascii(ev.series_id), ev.series_id) AS dataset_name, pos BETWEEN n // 2 AND n - 1 AS inside FROM ev JOIN sizes ON sizes.series_id = ev.series_id
)
SELECT CASE WHEN series_id = 'error' THEN 'kind_a' ELSE 'unknown' END AS category, dataset_name, pos, CAST(time AS VARCHAR) AS time, value, CAST(inside AS BIGINT) AS is_anomaly,
       CASE WHEN NOT inside THEN 'normal' WHEN series_id = 'error' THEN 'kind a' ELSE 'unknown' END AS anomaly_type FROM f"""

SQL: dict[str, str] = {
    "series_positions": f"WITH {EV} SELECT series_id, pos, CAST(time AS VARCHAR) AS time, value FROM ev",
    "numeric_coercion": f"""WITH {EV}, t AS (
  SELECT series_id, pos, try_cast(CASE WHEN pos % 29 = 0 THEN 'bad' WHEN pos % 31 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM ev
) SELECT series_id, pos, value FROM t WHERE value IS NOT NULL AND NOT isnan(value)""",
    "compact_positions": f"WITH {GAPS} SELECT series_id, pos, cpos, m FROM com",
    "text_series_decode": f"""WITH {EV} SELECT series_id || '/' || CAST(pos // 500 AS VARCHAR) AS series_id, pos % 500 AS pos,
  CAST(TIMESTAMP '2026-01-01' + to_seconds(pos % 500) AS VARCHAR) AS time, value FROM ev""",
    "file_metadata": f"""WITH {CATEGORIES} SELECT file_name, p_partkey AS dataset_id, p_name || '+' || p_brand AS dataset_name,
  CAST(p_size * 10 AS BIGINT) AS train_end, CAST(p_size * 20 AS BIGINT) AS anomaly_start, CAST(p_size * 30 AS BIGINT) AS anomaly_end,
  format('ucr_{{:03d}}_{{}}', p_partkey, regexp_replace(p_name || '+' || p_brand, '[^A-Za-z0-9_.-]+', '_', 'g')) AS folder,
  regexp_replace(p_name || '+' || p_brand, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM files""",
    "category_lookup": f"WITH {CATEGORIES} SELECT file_name, category FROM found",
    "labelled_series_only": f"WITH {EV} SELECT series_id, count(*) AS n, round(sum(value), 4) AS total FROM ev WHERE series_id <> 'view' GROUP BY series_id",
    "dataset_limit": f"WITH {EV} SELECT series_id, n FROM sizes ORDER BY series_id LIMIT 3",
    "point_labels": f"""WITH {EV}, b AS (
  SELECT ev.*, n, CASE WHEN ev.series_id = 'view' THEN -5 ELSE n // 2 END AS s, CASE WHEN ev.series_id = 'view' THEN 7 ELSE n + 50 END AS e FROM ev JOIN sizes ON sizes.series_id = ev.series_id
), f AS (SELECT *, pos BETWEEN greatest(s, 0) AND least(e, n - 1) AS inside FROM b)
SELECT series_id, pos, CAST(time AS VARCHAR) AS time, CAST(inside AS BIGINT) AS is_anomaly, CASE WHEN inside THEN 'kind ' || series_id ELSE 'normal' END AS anomaly_type FROM f""",
    "acf": f"WITH {SEASONAL}, {ACF.format('sea')} SELECT series_id, lag, round(r, 6) AS acf FROM acf",
    "period_autocorr": f"WITH {SEASONAL}, {ACF.format('sea')} SELECT series_id, estimated_period FROM per",
    "period_none": f"WITH {EV}, {ACF.format('ev')} SELECT series_id, estimated_period FROM per",
    "periodogram": f"""WITH {SEASONAL}, {DFT} SELECT series_id, k, round(period, 6) AS period, round(power / total, 8) AS share
FROM (SELECT *, sum(power) OVER (PARTITION BY series_id) AS total FROM bins)""",
    "period_fft": f"""WITH {SEASONAL}, {DFT}, valid AS (
  SELECT *, least(n // 4, 1000) AS longest FROM bins WHERE period >= 2 AND period <= least(n // 4, 1000)
), top AS (
  SELECT series_id, max(power) AS power, median(power) AS middle, arg_max(period, power) AS period, any_value(longest) AS longest FROM valid GROUP BY series_id
)
SELECT sizes.series_id, CASE WHEN power / middle >= 3 AND round_even(period, 0) BETWEEN 2 AND longest THEN CAST(round_even(period, 0) AS BIGINT) END AS estimated_period
FROM sizes LEFT JOIN top ON top.series_id = sizes.series_id""",
    "series_guards": f"""WITH {GAPS}, g AS (
  SELECT series_id, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, coalesce(bool_and(isfinite(value)), true) AS finite FROM gap GROUP BY series_id
)
SELECT series_id, n, round(mean, 6) AS mean, round(std, 6) AS std, finite, greatest(2, least(n // 4, 1000)) AS max_period,
       n >= 8 AND finite AND std > 0 AND greatest(2, least(n // 4, 1000)) > 2 AS usable FROM g""",
    "window_settings": f"""WITH {SEASONAL}, {ACF.format('sea')}, {SETTINGS.format(200, 50)}
SELECT series_id, 'seasonal_diff' AS preprocessing_mode, 'autocorr' AS period_method, estimated_period, seasonal_adjustment, window_size, stride FROM sett""",
    "seasonal_diff": f"WITH {SEASONAL}, {ACF.format('sea')}, {DIFF} SELECT series_id, pos, CAST(time AS VARCHAR) AS time, round(value, 6) AS value FROM dif",
    "trailing_windows": f"""WITH {GAPS}, {windows('com')}
SELECT series_id, window_no, window_end_pos, CAST(min(time) AS VARCHAR) AS window_start, CAST(max(time) AS VARCHAR) AS window_end, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos
FROM mem GROUP BY series_id, window_no, window_end_pos""",
    "window_members": f"""WITH {EV}, com AS (SELECT *, pos AS cpos, count(*) OVER (PARTITION BY series_id) AS m FROM ev), {windows('com', '50', '70')}
SELECT series_id, window_no, window_end_pos, pos FROM mem""",
    "score_000": _score("var_pop(value)", 4),
    "score_010": _score("avg(pow(value - v1, 2))", 4),
    "score_020": _score("avg(pow(value - 2 * v1 + v2, 2))", 8),
    "score_110": _CUBIC,
    "residual_mean_000": _residual("value - mean"),
    "residual_mean_010": _residual("value - coalesce(v1, 0)"),
    "residual_mean_020_burn": _residual("value - 2 * v1 + v2"),
    "both_branches": f"""WITH {SEASONAL}, {ACF.format('sea')}, {SETTINGS.format(200, 50)}, {DIFF}, both_ AS (
  SELECT series_id || '|raw' AS series_id, pos, time, value FROM sea
  UNION ALL SELECT dif.series_id || '|transformed', pos, time, value FROM dif JOIN sett ON sett.series_id = dif.series_id WHERE seasonal_adjustment
), com AS (
  SELECT b.*, window_size, stride, row_number() OVER (PARTITION BY b.series_id ORDER BY pos) - 1 AS cpos, count(*) OVER (PARTITION BY b.series_id) AS m
  FROM both_ b JOIN sett ON sett.series_id = split_part(b.series_id, '|', 1) WHERE value IS NOT NULL
), {windows('com', 'window_size', 'stride')}
SELECT split_part(series_id, '|', 1) AS series_id, split_part(series_id, '|', 2) AS branch, window_no, CAST(min(time) AS VARCHAR) AS window_start, CAST(max(time) AS VARCHAR) AS window_end, round(var_pop(value), 4) AS sigma2
FROM mem GROUP BY mem.series_id, window_no""",
    "window_label_overlap": f"WITH {RESULTS} SELECT series_id, window_no, CAST(actual_anomaly AS BIGINT) AS actual_anomaly FROM res",
    "window_train_flag": f"""WITH {RESULTS}, last AS (SELECT series_id, max(time) AS t FROM lab WHERE is_train = 1 GROUP BY series_id)
SELECT res.series_id, window_no, CAST(window_end <= t AS BIGINT) AS is_train FROM res JOIN last ON last.series_id = res.series_id""",
    "window_results": f"""WITH {RESULTS} SELECT series_id, window_no, CAST(window_end AS VARCHAR) AS time, CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end,
  round(sigma2, 4) AS sigma2, CAST(CASE WHEN series_id = 'view' THEN 0 ELSE actual_anomaly END AS BIGINT) AS actual_anomaly, CAST(predicted_anomaly AS BIGINT) AS predicted_anomaly FROM res""",
    "anomaly_bounds": f"""WITH {EV}, {LABELS} SELECT series_id, CAST(sum(is_anomaly) AS BIGINT) AS n_anomaly, min(pos) FILTER (WHERE is_anomaly = 1) AS anomaly_start, max(pos) FILTER (WHERE is_anomaly = 1) AS anomaly_end,
  CAST(min(time) FILTER (WHERE is_anomaly = 1) AS VARCHAR) AS first_time, CAST(max(time) FILTER (WHERE is_anomaly = 1) AS VARCHAR) AS last_time FROM lab GROUP BY series_id""",
    "localisation_metric": f"""WITH {RESULTS}, best_window AS (SELECT *, 0 AS n_points, 0 AS n_windows FROM res WHERE predicted_anomaly = 1), {METRIC}
SELECT series_id, index AS ucr_prediction_index, round(sigma2, 4) AS ucr_prediction_score, anomaly_start - 100 AS ucr_correct_start, anomaly_end + 100 AS ucr_correct_end,
       CAST(index BETWEEN anomaly_start - 100 AND anomaly_end + 100 AS BIGINT) AS ucr_correct FROM found""",
    "pipeline_metrics_010": f"""WITH {SEASONAL}, {LABELS}, {ACF.format('sea')}, {SETTINGS.format(50, 12)}, {DIFF}, com AS (
  SELECT dif.*, window_size, stride, row_number() OVER (PARTITION BY dif.series_id ORDER BY pos) - 1 AS cpos, count(*) OVER (PARTITION BY dif.series_id) AS m
  FROM dif JOIN sett ON sett.series_id = dif.series_id WHERE value IS NOT NULL
), {windows('com', 'window_size', 'stride')}, {SCORE_010}, best_window AS (
  SELECT score.*, n AS n_points, count(*) OVER (PARTITION BY score.series_id) AS n_windows FROM score JOIN sizes ON sizes.series_id = score.series_id
  QUALIFY row_number() OVER (PARTITION BY score.series_id ORDER BY sigma2 DESC, window_no) = 1
), {METRIC}, named AS (
  SELECT *, CASE WHEN series_id IN ('view', 'click') THEN 'page' WHEN series_id = 'error' THEN 'fault' ELSE 'other' END AS category, 'ev_' || series_id AS dataset_name FROM found
)
SELECT 'seasonal_diff' AS preprocessing_mode, category, dataset_name, 'by_category/' || category || '/' || dataset_name || '/timeseries.csv' AS timeseries_path,
       'by_category/' || category || '/' || dataset_name || '/labels.csv' AS labels_path,
       'results/ucr_preproc-autocorr_arima010/' || category || '/' || dataset_name || '_sigma2_values.csv' AS sigma2_path, CAST(NULL AS VARCHAR) AS figure_path,
       'autocorr' AS period_method, estimated_period, seasonal_adjustment, window_size, stride, '(0, 1, 0)' AS "order", n_points, n_windows, anomaly_start, anomaly_end,
       index AS ucr_prediction_index, round(sigma2, 4) AS ucr_prediction_score, anomaly_start - 100 AS ucr_correct_start, anomaly_end + 100 AS ucr_correct_end,
       CAST(index BETWEEN anomaly_start - 100 AND anomaly_end + 100 AS BIGINT) AS ucr_correct
FROM named JOIN sett ON sett.series_id = named.series_id""",
    "category_summary": f"WITH {HITS} SELECT category, count(*) AS n_datasets, CAST(sum(ucr_correct) AS BIGINT) AS n_correct, round(avg(ucr_correct), 8) AS ucr_accuracy FROM hits GROUP BY category",
    "overall_summary": f"""WITH {HITS} SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS n_datasets, CAST(sum(ucr_correct) AS BIGINT) AS n_correct,
  round(avg(ucr_correct), 8) AS ucr_accuracy FROM hits GROUP BY ROLLUP (category)""",
    "prepared_counts": f"WITH {CATEGORIES} SELECT category, count(*) AS n_datasets FROM found GROUP BY category",
    "zoom_slice": f"""WITH {RESULTS}, b AS (
  SELECT series_id, min(pos) FILTER (WHERE is_anomaly = 1) AS a, max(pos) FILTER (WHERE is_anomaly = 1) AS z, count(*) AS n FROM lab GROUP BY series_id
), t AS (
  SELECT series_id, TIMESTAMP '2026-01-01' + to_seconds(greatest(0, a - 100)) AS t0, TIMESTAMP '2026-01-01' + to_seconds(least(n - 1, z + 100)) AS t1 FROM b
)
SELECT res.series_id, window_no, CAST(window_end AS VARCHAR) AS window_end, CAST(predicted_anomaly AS BIGINT) AS is_best_in_zoom FROM res JOIN t ON t.series_id = res.series_id WHERE window_end BETWEEN t0 AND t1""",
    "variance_burst": f"""WITH {EV}, z AS (
  SELECT ev.*, n, stddev_samp(value) OVER (PARTITION BY ev.series_id) AS std, md5('7:' || pos) AS d FROM ev JOIN sizes ON sizes.series_id = ev.series_id
), y AS (
  SELECT *, pos BETWEEN n // 2 AND n // 2 + n // 10 - 1 AS inside,
         sqrt(-2 * ln((CAST('0x' || substr(d, 1, 8) AS BIGINT) + 1) / 4294967297.0)) * cos(2 * pi() * (CAST('0x' || substr(d, 9, 8) AS BIGINT) / 4294967296.0)) AS noise FROM z
)
SELECT series_id, pos, CAST(time AS VARCHAR) AS time, round(CASE WHEN inside THEN value + noise * 3 * std ELSE value END, 6) AS value, CAST(inside AS BIGINT) AS is_anomaly,
       CASE WHEN inside THEN 'variance_burst' ELSE 'normal' END AS anomaly_type FROM y""",
    "run_name": f"""WITH {EV} SELECT series_id, run_name, n AS n_points
FROM sizes, unnest(['ucr_preproc-autocorr_arima111', 'mine_preproc-raw-w200-s50_arima101', 'simulation_period-fft_arima101']) AS u(run_name)""",
    "period_accuracy": f"""WITH {SEASONAL}, {ACF.format('sea')}
SELECT series_id AS dataset_idx, CAST(24 AS BIGINT) AS period, estimated_period, CAST(coalesce(abs(estimated_period / 24 - 1) <= 0.1, false) AS BIGINT) AS is_match,
       CAST(coalesce(abs(greatest(estimated_period / 24, 24 / estimated_period) - round(greatest(estimated_period / 24, 24 / estimated_period))) <= 0.1, false) AS BIGINT) AS is_multiple FROM per""",
    "corpus_prepare": f"""WITH {EV}, f AS (SELECT series_id, n, format('ucr_{{:03d}}_{{}}', ascii(series_id), series_id) AS name FROM sizes)
SELECT name AS series_id, CASE WHEN f.series_id = 'error' THEN 'kind_a' ELSE 'unknown' END AS folder, CASE WHEN f.series_id = 'error' THEN 'kind a' ELSE 'unknown' END AS category,
       any_value(n) AS n_points, CAST(count(*) FILTER (WHERE pos BETWEEN n // 2 AND n - 1) AS BIGINT) AS n_anomaly, round(sum(value), 4) AS total
FROM f JOIN ev ON ev.series_id = f.series_id GROUP BY name, f.series_id""",
    "csv_series": f"""WITH {EV}, t AS (
  SELECT series_id, pos, time, try_cast(CASE WHEN pos % 29 = 0 THEN 'bad' WHEN pos % 31 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM ev
) SELECT series_id, pos, CAST(time AS VARCHAR) AS time, CASE WHEN NOT isnan(value) THEN value END AS value FROM t""",
    "csv_series_strict": f"WITH {EV} SELECT series_id, pos, CAST(time AS VARCHAR) AS time, value FROM ev",
    "csv_labels": f"""WITH {EV}, {LABELS} SELECT series_id, pos, CAST(time AS VARCHAR) AS time, CAST(is_anomaly AS BIGINT) AS is_anomaly,
  CASE WHEN is_anomaly = 1 THEN 'burst' ELSE 'normal' END AS anomaly_type, CAST(is_train AS BIGINT) AS is_train FROM lab""",
    "raw_corpus_files": f"""WITH {EV} SELECT pos, CAST(time AS VARCHAR) AS time, value, ev.series_id AS dataset_name, n // 4 AS train_end, n // 2 AS anomaly_start, n + 9 AS anomaly_end
FROM ev JOIN sizes ON sizes.series_id = ev.series_id""",
    "prepared_corpus_csv": _PREPARED,
    "prepared_corpus_parquet": _PREPARED,
    "category_file": f"WITH {CATEGORIES} SELECT file_name AS name, category FROM found WHERE category <> 'unknown'",
    "period_file": "SELECT CAST(p_partkey AS BIGINT) AS dataset_idx, CAST(p_size AS BIGINT) AS period, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS remarks FROM part",
    "window_result_files": f"""WITH {RESULTS} SELECT CASE WHEN series_id IN ('view', 'click') THEN 'page' WHEN series_id = 'error' THEN 'fault' ELSE 'other' END AS category, 'ev_' || series_id AS dataset_name,
  CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end, round(sigma2, 4) AS sigma2, CAST(actual_anomaly AS BIGINT) AS actual_anomaly, CAST(predicted_anomaly AS BIGINT) AS predicted_anomaly FROM res""",
    "metric_files": f"""SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS category, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'nan') AS file_category,
  'ds_' || o_orderkey AS dataset_name, CAST(o_orderkey % 3 = 0 AS BIGINT) AS ucr_correct FROM orders""",
}
SQL["summary_file"] = SQL["overall_summary"]
SQL["single_series_metric"] = SQL["localisation_metric"]
SQL["csv_labels_by_header"] = f"""WITH {EV}, {LABELS} SELECT series_id, pos, CAST(time AS VARCHAR) AS time, CAST(is_anomaly AS BIGINT) AS is_anomaly,
  CASE WHEN series_id <> 'error' THEN CASE WHEN is_anomaly = 1 THEN 'burst' ELSE 'normal' END END AS anomaly_type, CASE WHEN series_id <> 'error' THEN CAST(is_train AS BIGINT) END AS is_train FROM lab"""
SQL["corpus_skip"] = f"""WITH {RESULTS}, best_window AS (
  SELECT *, 0 AS n_points, count(*) OVER (PARTITION BY series_id) AS n_windows FROM res QUALIFY predicted_anomaly = 1
), {METRIC}, faults AS (
  SELECT fault AS category, series_id AS dataset_name FROM sizes, unnest(['none', 'value_columns', 'time', 'no_labels', 'no_is_anomaly', 'no_labelled_row', 'short', 'labels_number']) AS u(fault)
)
SELECT category, dataset_name, CASE WHEN category = 'none' THEN 'scored' ELSE 'skipped' END AS status, CASE WHEN category <> 'none' THEN category END AS reason, n_windows,
       index AS ucr_prediction_index, round(sigma2, 4) AS ucr_prediction_score, CAST(index BETWEEN anomaly_start - 100 AND anomaly_end + 100 AS BIGINT) AS ucr_correct
FROM faults LEFT JOIN found ON category = 'none' AND series_id = dataset_name"""
SQL["sink_manifest"] = """WITH m AS (SELECT coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'nan') AS c FROM orders)
SELECT c || '/' || c || '_evaluation.csv' AS name, count(*) AS n_rows, count(*) AS n_read FROM m GROUP BY c"""
SQL["run_table"] = """WITH r AS (
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS category, CAST(o_orderkey % 3 = 0 AS INT) AS a, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 2 = 0 AS INT) END AS b FROM orders
)
SELECT category, count(b) AS n_both, count(*) - count(b) AS n_first_only, CAST(0 AS BIGINT) AS n_second_only, count(*) FILTER (a = 1 AND b = 1) AS both_right, count(*) FILTER (a = 1 AND b = 0) AS first_right,
       count(*) FILTER (a = 0 AND b = 1) AS second_right, count(*) FILTER (a = 0 AND b = 0) AS neither_right, round(avg(b - a), 8) AS accuracy_change FROM r GROUP BY category"""
SQL["raw_corpus_ranges"] = f"WITH {EV} SELECT series_id AS file_name, pos, CAST(time AS VARCHAR) AS time, value FROM ev"
SQL["order_faults"] = """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'length'
  WHEN p_partkey % 7 = 0 AND p_size > 0 OR p_partkey % 5 = 0 AND p_size % 4 <> 0 THEN 'value' END AS fault FROM part"""
SQL["category_map_columns"] = """SELECT DISTINCT replace(p_brand, '#', '-') AS brand, CASE WHEN p_brand < 'Brand#2' THEN 'anomaly_type_2' ELSE 'anomaly_type_2, name' END AS missing
FROM part WHERE p_partkey % 5 = 0 AND (p_brand < 'Brand#2' OR p_brand >= 'Brand#4')"""
