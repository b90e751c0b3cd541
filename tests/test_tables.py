"""Scans, declared types, narrowing, cache and logs."""

import pytest
from pyspark.sql import types as T

from creditloom.modeling import logs
from creditloom.sources import tables as io
from creditloom.sources.schemas import TABLES, column_type


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / f"{name}.csv").write_text(text)


def test_missing_table_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.scan_table(spark, "bureau", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        io.LOADERS["application_train"](spark, str(tmp_path))


def test_csv_is_typed_without_inference(spark, tmp_path):
    write(tmp_path, "bureau",
          "SK_ID_CURR,SK_ID_BUREAU,DAYS_CREDIT_ENDDATE,AMT_CREDIT_SUM,AMT_ANNUITY,CREDIT_TYPE\n"
          '1,10,-153.0,5.5,XNA,"a, b"\n2,11,,oops,7,c\n')
    df = io.scan_table(spark, "bureau", str(tmp_path), lenient=True)
    kinds = {f.name: f.dataType for f in df.schema}
    assert kinds["SK_ID_CURR"] == T.LongType() and kinds["DAYS_CREDIT_ENDDATE"] == T.IntegerType()
    assert kinds["AMT_ANNUITY"] == T.StringType()
    rows = [tuple(r) for r in df.orderBy("SK_ID_CURR").collect()]
    assert rows == [(1, 10, -153, 5.5, "XNA", "a, b"), (2, 11, None, None, "7", "c")]
    rejected = io.rejected_values(spark, "bureau", str(tmp_path)).collect()
    assert [tuple(r) for r in rejected] == [("AMT_CREDIT_SUM", 1)]
    with pytest.raises(Exception, match="AMT_CREDIT_SUM is not a number: oops"):
        io.scan_table(spark, "bureau", str(tmp_path)).collect()
    inferred = io.scan_table(spark, "bureau", str(tmp_path), infer=True)
    assert dict(inferred.dtypes)["AMT_ANNUITY"] == "string"


def test_fractions_in_integer_columns(spark, tmp_path):
    write(tmp_path, "bureau", "SK_ID_CURR,DAYS_CREDIT_ENDDATE\n1,3.7\n2,-8.0\n3,\n")
    df = io.scan_table(spark, "bureau", str(tmp_path), lenient=True)
    assert [r[1] for r in df.orderBy("SK_ID_CURR").collect()] == [None, -8, None]
    assert io.rejected_values(spark, "bureau", str(tmp_path)).first()["n"] == 1


def test_type_rules():
    assert column_type("application_train", "AMT_REQ_CREDIT_BUREAU_MON") == T.IntegerType()
    assert column_type("application_train", "FLAG_OWN_CAR") == T.StringType()
    assert column_type("application_train", "APARTMENTS_AVG") == T.DoubleType()
    assert column_type("previous_application", "AMT_ANNUITY") == T.DoubleType()
    assert set(io.LOADERS) == set(TABLES)


def test_narrowing(spark):
    schema = "a long, b long, c long, d long, e double, f long, s string"
    df = spark.createDataFrame(
        [(-128, 128, 40000, 2**31, 0.1, None, "x"), (127, 1, 2, 3, None, None, "x")], schema
    )
    assert dict(io.narrow_types(df).dtypes) == {
        "a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "bigint",
        "s": "string",
    }
    report = {r["column"]: r["narrow_type"] for r in io.type_report(df).collect()}
    assert report == {
        "a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "bigint",
        "s": "string",
    }


def test_partial_read(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert io.partial_read(df, ["b"], 1).columns == ["b"]
    assert io.partial_read(df, rows=0).count() == 0


def test_cache_is_reused_and_rebuilt(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert io.parquet_cache(spark, "t", build, str(tmp_path)).count() == 1
    assert io.parquet_cache(spark, "t", build, str(tmp_path)).count() == 1
    assert io.parquet_cache(spark, "t", build, str(tmp_path), overwrite=True).count() == 2


def test_logs_append_and_merge(spark, tmp_path):
    path = f"{tmp_path}/runs"
    logs.append_run(spark, path, "one, two", [0.7, 0.8], 12, {"depth": 6})
    logs.append_run(spark, path, "b", [0.6], 3, {})
    rows = {r["name"]: r for r in logs.read_runs(spark, path).collect()}
    assert rows["one, two"]["mean_auc"] == 0.75 and rows["one, two"]["std_auc"] == 0.05
    assert rows["one, two"]["params"] == '{"depth": 6}' and rows["b"]["n_features"] == 3

    entries = spark.createDataFrame(
        [("a", 0.7, "old"), ("b", 0.8, "0.9"), ("", 0.1, "kept")],
        "message string, cv_score double, public_score string",
    )
    later = spark.createDataFrame(
        [(1, "a", "x", "1"), (2, "a", "0.75", "0.74"), (3, "", "no", "no")],
        "seq int, description string, public_score string, private_score string",
    )
    merged = logs.score_merge(entries, later, "seq")
    got = {r["message"]: (r["public_score"], r["private_score"]) for r in merged.collect()}
    assert got == {"a": ("0.75", "0.74"), "b": ("0.9", ""), "": ("kept", "")}
    gaps = {r["message"]: r["gap"] for r in logs.score_gap(merged).collect()}
    assert gaps == {"a": pytest.approx(0.05), "b": pytest.approx(0.1)}


def test_csv_keeps_empty_texts_apart_from_nulls(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, 'a "b", c'), (None, " x "), (5, "\\N")]
    io.write_csv(spark.createDataFrame(rows, "n int, s string"), f"{tmp_path}/t")
    assert {tuple(r) for r in io.read_csv(spark, f"{tmp_path}/t", "n int, s string").collect()} == set(rows)


def test_appending_a_run_again_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/runs"
    for score in (0.7, 0.9):
        assert logs.append_run(spark, path, "a", [score], 1, {}, run_id="first") == "first"
    logs.append_run(spark, path, "a", [0.8], 1, {})
    rows = logs.read_runs(spark, path)
    assert sorted(r["mean_auc"] for r in rows.collect()) == [0.7, 0.8]
    assert dict(rows.dtypes)["logged_at"] == "timestamp"
    with pytest.raises(ValueError):
        logs.append_run(spark, path, "a", [0.7], 1, {}, run_id="../x")


def test_drivers_append_side_by_side(spark, tmp_path):
    from creditloom.session import in_threads

    path = f"{tmp_path}/submissions"
    tasks = [lambda i=i: logs.append_submission(spark, path, f"m{i % 4}", 0.5, i, run_id=f"r{i % 4}") for i in range(8)]
    in_threads(spark, tasks, 8)
    found = logs.read_submissions(spark, path).collect()
    assert sorted(r["message"] for r in found) == ["m0", "m1", "m2", "m3"]
    assert {r["public_score"] for r in found} == {""}
