"""Files of given names: two steps, a manifest, and what stops a publication."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftline.plans import corpus as plans
from driftline.sources import naming


@pytest.fixture
def rows(spark):
    return spark.range(1000).select((F.col("id") % 3).cast("string").alias("key"), "id", F.concat(F.lit('a "b",\n'), F.col("id")).alias("text"))


def files_of(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.csv"))


def test_no_row_is_lost_whatever_the_session_says(spark, rows, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        found = naming.write_named(rows, ["key"], ["id"], str(tmp_path), lambda v: f"{v['key']}/x.csv")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert files_of(tmp_path) == ["0/x.csv", "1/x.csv", "2/x.csv"]
    assert sorted((f.name, f.n_rows) for f in found) == [("0/x.csv", 334), ("1/x.csv", 333), ("2/x.csv", 333)]
    assert spark.read.csv(str(tmp_path / "*" / "*.csv"), header=True, multiLine=True).count() == 1000
    manifest = naming.read_manifest(spark, str(tmp_path)).collect()
    assert sum(r.n_rows for r in manifest) == 1000 and {r.n_bytes for r in manifest} == {(tmp_path / f).stat().st_size for f in files_of(tmp_path)}
    assert naming.missing_files(spark, str(tmp_path)) == []
    (tmp_path / "1" / "x.csv").write_text("cut short")
    assert naming.missing_files(spark, str(tmp_path)) == ["1/x.csv"]


def test_a_name_met_twice_leaves_everything_as_it_was(spark, rows, tmp_path):
    (tmp_path / "same.csv").write_text("old")
    with pytest.raises(ValueError, match=r"two files would be called .*same\.csv"):
        naming.write_named(rows, ["key"], ["id"], str(tmp_path), lambda v: "same.csv")
    assert files_of(tmp_path) == ["same.csv"] and (tmp_path / "same.csv").read_text() == "old"
    assert [p.name for p in tmp_path.iterdir()] == ["same.csv"]


def test_published_again(spark, rows, tmp_path):
    for n in (1000, 10):
        naming.write_named(rows.where(F.col("id") < n), ["key"], ["id"], str(tmp_path), lambda v: f"{v['key']}.csv")
        assert naming.read_manifest(spark, str(tmp_path)).agg(F.sum("n_rows")).first()[0] == n
        assert spark.read.csv(str(tmp_path / "*.csv"), header=True, multiLine=True).count() == n
    assert naming.write_named(rows.limit(0), ["key"], ["id"], str(tmp_path / "none"), lambda v: f"{v['key']}.csv") == []


def test_keys_with_odd_characters(spark, tmp_path):
    rows = spark.createDataFrame([("a/b=c %d é", 1), ("x", 2)], "key string, id long")
    found = naming.write_named(rows, ["key"], ["id"], str(tmp_path / "with space"), lambda v: f"{v['key'].replace('/', '_')}.csv")
    assert sorted((f.name, f.n_rows) for f in found) == [("a_b=c %d é.csv", 1), ("x.csv", 1)]


def test_summary_and_metrics_keep_manifests(spark, tmp_path):
    metrics = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), (None, "z", 1)], "category string, dataset_name string, ucr_correct int")
    plans.write_metrics(metrics, str(tmp_path / "m"))
    assert {(r.name, r.n_rows) for r in naming.read_manifest(spark, str(tmp_path / "m")).collect()} == {("a/a_evaluation.csv", 2), ("nan/nan_evaluation.csv", 1)}
    plans.write_summary(metrics, str(tmp_path / "m" / "all.csv"))
    assert [(r.name, r.n_rows) for r in naming.read_manifest(spark, str(tmp_path / "m"), "all.csv").collect()] == [("all.csv", 3)]


def test_runs_replace_each_other_by_name(spark, tmp_path):
    columns = "category string, dataset_name string, ucr_correct int"
    first = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), (None, "z", 1)], columns)
    second = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "w", 0)], columns)
    for run, rows in (("one", second), ("one", first), ("007", second)):
        plans.write_run(rows, str(tmp_path / "runs"), run)
    runs = plans.read_runs(spark, str(tmp_path / "runs"))
    assert {(r.run_name, r["count"]) for r in runs.groupBy("run_name").count().collect()} == {("one", 3), ("007", 3)}
    found = {r.category: tuple(r)[1:] for r in plans.compare_runs(runs, "one", "007").collect()}
    assert found == {"a": (2, 0, 0, 1, 0, 1, 0, 0.5), "b": (0, 0, 1, 0, 0, 0, 0, None), None: (0, 1, 0, 0, 0, 0, 0, None)}


def test_a_key_is_one_file_where_a_join_on_it_becomes_a_broadcast(spark, tmp_path):
    large = spark.range(0, 200_000, 1, 4).select((F.col("id") % 3).cast("string").alias("id_of"), "id", F.md5(F.col("id").cast("string")).alias("text"))
    sizes = large.groupBy("id_of").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        found = naming.write_named(large.join(sizes, "id_of").select(F.col("id_of").alias("key"), "id", "text", "n"), ["key"], ["id"], str(tmp_path), lambda v: f"{v['key']}/x.csv")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert sorted((f.name, f.n_rows) for f in found) == [("0/x.csv", 66_667), ("1/x.csv", 66_667), ("2/x.csv", 66_666)]
    for name in files_of(tmp_path):
        own = [int(line.split(",")[0]) for line in (tmp_path / name).read_text().splitlines()[1:]]
        assert own == sorted(own)


def test_rows_are_counted_whatever_is_quoted(spark, tmp_path, monkeypatch):
    texts = {"plain": "a", "comma": "a,b", "quote": 'a "b" c', "odd": 'a "b', "line": "a\nb", "lines": '"a\n\nb"\n', "slash": 'a\\"\n,b', "blank": ""}
    rows = spark.createDataFrame([(k, n, t) for k, t in texts.items() for n in range(3)], "key string, id int, text string")
    found = naming.write_named(rows, ["key"], ["id"], str(tmp_path), lambda v: f"{v['key']}.csv")
    assert {f.name: f.n_rows for f in found} == {f"{k}.csv": 3 for k in texts}
    parsed, real = [], type(spark.read).csv
    monkeypatch.setattr(type(spark.read), "csv", lambda self, path, *a, **b: parsed.append(path) or real(self, path, *a, **b))
    naming.write_named(rows.where("key IN ('plain', 'comma', 'blank')"), ["key"], ["id"], str(tmp_path / "no breaks"), lambda v: f"{v['key']}.csv")
    assert parsed == []
