import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.operators.bars import build_bars
from barloom.schema import require_columns, schema_report
from barloom import session
from barloom.session import materialize, workspace
from barloom.sources import (
    broken_entries,
    latest_months,
    list_months,
    month_range_label,
    normalize_ticks,
    read_csv,
    read_json,
    read_ledger,
    read_ticks,
    unreadable_files,
    unreadable_months,
    write_csv,
    write_json,
    write_ticks,
)


@pytest.fixture(scope="module")
def ticks(make_ticks):
    rows = []
    for month in (11, 12):
        for i in range(40):
            at = datetime(2023, month, 1) + timedelta(hours=7 * i)
            rows.append(("A" if i % 4 else "B", at, i, 1.5, 1.0, 2.0, 3.0))
    rows.append(("A", datetime(2024, 1, 2), 99, 1.5, 1.0, 2.0, 3.0))
    return make_ticks(rows)


def test_partitioned_archive_round_trip(spark, ticks, tmp_path):
    folder = str(tmp_path / "archive")
    write_ticks(ticks, folder)
    names = list_months(spark, folder)
    assert names == ["month=2023-11", "month=2023-12", "month=2024-01"]
    assert month_range_label(names) == "2023-11 -> 2024-01"
    assert read_ticks(spark, folder).count() == 81
    latest = read_ticks(spark, folder, months=2)
    assert latest.count() == 41
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_writing_one_month_leaves_the_others(spark, ticks, tmp_path):
    folder = str(tmp_path / "archive")
    write_ticks(ticks, folder)
    write_ticks(ticks.where("timestamp < '2023-12-01'").limit(5), folder)
    got = {r["month"]: r["count"] for r in read_ticks(spark, folder).groupBy("month").count().collect()}
    assert got == {"2023-11": 5, "2023-12": 40, "2024-01": 1}


def test_flat_month_files(spark, ticks, tmp_path):
    flat = ticks.drop("symbol", "seq").coalesce(1)
    for month, end in (("2023-11", "2023-12-01"), ("2023-12", "2024-01-01")):
        out = tmp_path / "stage" / month
        flat.where(f"timestamp < '{end}'").write.parquet(str(out))
        part = next(out.glob("part-*.parquet"))
        (tmp_path / "flat").mkdir(exist_ok=True)
        part.rename(tmp_path / "flat" / f"{month}.parquet")
    folder = str(tmp_path / "flat")
    assert list_months(spark, folder) == ["2023-11.parquet", "2023-12.parquet"]
    with pytest.raises(ValueError, match="symbol"):
        read_ticks(spark, folder)
    latest = read_ticks(spark, folder, months=1, symbol="eur/usd")
    assert latest.count() == 80 and {r["symbol"] for r in latest.collect()} == {"EURUSD"}
    assert build_bars(latest, "1d").count() > 1 and latest.select("seq").distinct().count() == 80
    (tmp_path / "flat" / "2023-10.parquet").write_bytes(b"not parquet")
    assert read_ticks(spark, folder, skip_corrupt=True, symbol="A").count() == 120


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_ticks(spark, str(tmp_path))


def test_latest_months_of_a_table(ticks):
    keyed = ticks.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    assert latest_months(keyed, 2).count() == 41 and latest_months(keyed, None).count() == 81


def test_vendor_columns(spark):
    row = (1.0, 1.1, 3.0, 2.0, datetime(2024, 1, 1))
    df = spark.createDataFrame([row], "bidPrice double, askPrice double, bidVolume double, askVolume double, timestamp timestamp_ntz")
    out = normalize_ticks(df)
    assert out.columns == ["timestamp", "ask", "bid", "ask_volume", "bid_volume"]
    assert dict(out.dtypes)["timestamp"] == "timestamp"
    assert tuple(out.first())[1:] == (1.1, 1.0, 2.0, 3.0)


def test_required_columns(ticks):
    assert require_columns(ticks) is ticks
    with pytest.raises(ValueError, match="bid"):
        require_columns(ticks.drop("bid"))
    report = schema_report(ticks.withColumn("bid", F.nullif("bid", F.lit(1.0)))).orderBy("position").collect()
    assert [r["column"] for r in report if r["required"]] == ["timestamp", "ask", "bid", "ask_volume", "bid_volume"]
    assert {r["rows"] for r in report} == {81} and [r["nulls"] for r in report if r["nulls"]] == [81]


def test_csv_and_json(spark, tmp_path):
    df = spark.sql("SELECT 'A' AS symbol, map('k', 1.5D) AS m, struct(1 AS a, CAST(NULL AS INT) AS b) AS s")
    write_csv(df.select("symbol"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["symbol"] == "A"
    write_json(df, str(tmp_path / "json"))
    text = next(Path(tmp_path / "json").glob("part-*.json")).read_text()
    assert json.loads(text) == {"symbol": "A", "m": {"k": 1.5}, "s": {"a": 1, "b": None}}


def test_ledger_file(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert read_ledger(spark, path).count() == 0
    entry = {"symbol": "A", "month": "2024-01", "rows": 5, "missing_hours": 0, "confirmed_absent": 0}
    Path(path).write_text(json.dumps(entry) + "\n{broken\n")
    assert [r["month"] for r in read_ledger(spark, path).collect()] == ["2024-01"]


def test_work_tables_live_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert workspace(spark).startswith(root or "")
    df = materialize(spark.range(3).toDF("x"), "probe")
    assert df.count() == 3 and workspace(spark) in df.inputFiles()[0].replace("file://", "")


def test_tables_go_with_their_scope(spark):
    outside = materialize(spark.range(3).toDF("x"), "probe")
    with session.work_scope(spark) as path:
        inside = materialize(spark.range(2).toDF("x"), "probe")
        assert path in inside.inputFiles()[0].replace("file://", "") and inside.count() == 2
    assert not session.file_names(spark, path) and outside.count() == 3


def test_dropped_work_folders_are_not_used_again(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "_root", lambda _: str(tmp_path))
    before = workspace(spark)
    materialize(spark.range(3).toDF("x"), "probe")
    session.drop_workspace(spark)
    assert not list(tmp_path.iterdir()) and workspace(spark) != before


def test_private_work_folder_for_local_sessions_only():
    class Conf:
        def get(self, key, default):
            return default

    def fake(master, folder=None):
        context = type("Context", (), {"applicationId": "app-" + master, "master": master, "getCheckpointDir": lambda self: folder})
        return type("Spark", (), {"conf": Conf(), "sparkContext": context()})()

    assert workspace(fake("local[4]")) == workspace(fake("local[4]"))
    assert workspace(fake("yarn", "hdfs://shared/")).startswith("hdfs://shared/barloom-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="share"):
            workspace(fake(master))


def test_bars_are_cut_in_utc_under_any_session_zone(spark, ticks):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        month = build_bars(ticks, "1mo").orderBy("bar_start").selectExpr("unix_seconds(bar_start) s").first()["s"]
        assert month == int(datetime(2023, 11, 1, tzinfo=timezone.utc).timestamp())
    finally:
        session.prepare_session(spark)


def test_csv_gives_the_same_values_back(spark, tmp_path):
    schema = "i int, text string, x double, at timestamp, none string"
    at = datetime(2024, 1, 2, 3, 4, 5, 678901)
    texts = [None, "", " a ", 'say "x"', ',"', "\\", '\\"', "it's\ttab", "NaN", "null", '""', "é "]
    numbers = [None, float("nan"), float("inf"), float("-inf"), 0.1, -1e-300, 1e300, 0.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(i, t, x, at if i % 2 else None, None) for i, (t, x) in enumerate(zip(texts, numbers))]
    df = spark.createDataFrame(rows, schema)
    write_csv(df, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), schema).orderBy("i").collect()
    assert [r["text"] for r in back] == texts
    assert [repr(r["x"]) for r in back] == [repr(x) for x in numbers]
    assert [r["at"] for r in back] == [r["at"] for r in df.orderBy("i").collect()]
    assert {r["none"] for r in back} == {None}
    empty = str(tmp_path / "empty")
    write_csv(df.limit(0), empty)
    assert read_csv(spark, empty, df.schema).count() == 0


def test_csv_with_line_breaks_and_rows_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "i int, text string")
    write_csv(df, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), "i int, text string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == [(1, "a\nb"), (2, "c")]
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, str(tmp_path / "csv"), "i int, text int").collect()


def test_broken_documents_are_told_from_absent_fields(spark, tmp_path):
    lines = ['{"a": 1, "m": {"x": {"n": 2}}}', '{"a": null}', '{"a": 1, "m"', '{"a": "one"}', "", "  "]
    (tmp_path / "docs").write_text("\n".join(lines) + "\n")
    found = read_json(spark, str(tmp_path / "docs"), "a int, m map<string, struct<n: int>>").collect()
    good = [r.asDict(recursive=True) for r in found if r["_corrupt"] is None]
    assert sorted(good, key=str) == sorted([{"a": 1, "m": {"x": {"n": 2}}, "_corrupt": None}, {"a": None, "m": None, "_corrupt": None}], key=str)
    assert {r["_corrupt"] for r in found} - {None} == set(lines[2:4])


def test_broken_ledger_entries_are_named(spark, tmp_path):
    (tmp_path / "ledger").write_text('{"symbol": "A", "month": "2024-01", "rows": 5}\n{broken\n{"symbol": "A", "rows": 1}\n')
    assert read_ledger(spark, str(tmp_path / "ledger")).count() == 1
    entries = {r["entry"] for r in broken_entries(spark, str(tmp_path / "ledger")).collect()}
    assert entries == {"{broken", '{"symbol":"A","rows":1}'}


def test_unreadable_months_are_named(spark, ticks, tmp_path):
    folder = str(tmp_path / "archive")
    write_ticks(ticks, folder)
    months = [n.removeprefix("month=") for n in list_months(spark, folder)]
    assert unreadable_months(spark, folder).count() == 0
    extra = Path(folder, f"month={months[0]}", "extra.parquet")
    extra.write_text("not parquet")
    found = unreadable_files(spark, folder).collect()
    assert [(r["month"], r["file"].split("/")[-1]) for r in found] == [(months[0], "extra.parquet")]
    assert read_ticks(spark, folder, skip_corrupt=True).count() == ticks.count()


def test_month_limits_reach_the_partition_filters(spark, ticks, tmp_path):
    folder = str(tmp_path / "archive")
    write_ticks(ticks, folder)
    plan = read_ticks(spark, folder, months=1)._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
