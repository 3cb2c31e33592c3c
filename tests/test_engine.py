import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from orderlens import catalog
from orderlens.functions import arima, cleaning, ets, fits
from orderlens.operators import boosted, events, features, forecasts, holidays, ingest, models, reconcile, reports, selection, series
from orderlens.plans import batch, order_lines, reconciled
from orderlens.sources import loading, store, workbook_source, xlsx
from orderlens.streaming import daily

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def day(n):
    return dt.date(2026, 1, n)


def test_numbers(spark):
    want = {"12": 12.0, "12.5": 12.5, "1,234.50": 1234.5, " 1 234.5 ": 1234.5, "$1,234.5": 1234.5, "12 lbs": 12.0, "(1,000)": -1000.0, "(-5)": 5.0, "1e5": 15.0, "−5": 5.0}
    bad = {"": "blank", "  ": "blank", "N/A": "blank", "-": "blank", "abc": "unparseable", ".": "unparseable", "-.": "unparseable", "1.2.3": "unparseable", "--5": "unparseable", "5-": "unparseable", None: "missing"}
    found = spark.createDataFrame([(x,) for x in [*want, *bad]], "raw string").select("raw", cleaning.parse_number(F.col("raw")).alias("n")).collect()
    for r in found:
        assert (r["n"]["value"], r["n"]["reason"]) == ((want[r["raw"]], None) if r["raw"] in want else (None, bad[r["raw"]])), r["raw"]


def test_headers_and_ids(spark):
    assert {cleaning.header_token(h) for h in ("Mat.avail.dt", " MAT_AVAIL_DT ", "mat avail dt")} == {"matavaildt"}
    found = spark.createDataFrame([("38.0",), ("38.5",), ("AB  402517",), (" ",), (None,)], "raw string").select(cleaning.clean_id(F.col("raw")))
    assert [r[0] for r in found.collect()] == ["38", "38.5", "AB 402517", None, None]


def test_numeric_columns(spark):
    """Numbers of numeric columns are taken as they are, and whole ids never turn to powers of ten."""
    df = spark.createDataFrame([(12_000_000.0, 12_000_000.0), (123_456_789.5, 38.0), (0.0005, 38.5), (1e-5, -7.0), (-5.0, 1e15), (float("nan"), float("nan")), (None, None)], "x double, id double")
    found = rows(df.select("x", cleaning.parse_number(F.col("x")).alias("n"), cleaning.clean_id(F.col("id")).alias("id")).select("n.value", "n.reason", "id"))
    assert found == [(12_000_000.0, None, "12000000"), (123_456_789.5, None, "38"), (0.0005, None, "38.5"), (1e-5, None, "-7"), (-5.0, None, "1000000000000000"), (None, "missing", None), (None, "missing", None)]
    other = df.limit(1).select(*(cleaning.parse_number(F.lit(v).cast(t))["value"] for v, t in (("12000000.25", "decimal(20,4)"), ("9007199254740993", "bigint"), ("-3", "tinyint"), ("2.5e7", "float"))), cleaning.clean_id(F.lit(12_000_000).cast("bigint")), cleaning.clean_id(F.lit("1E3")))
    assert rows(other) == [(12_000_000.25, 9007199254740992.0, -3.0, 2.5e7, "12000000", "1E3")]


def test_segments_with_null_keys_are_in_the_total_only(spark):
    df = spark.createDataFrame([("a", "g", day(1), 1.0), (None, "g", day(1), 2.0)], "customer string, material_group string, date date, net_pounds double")
    found = rows(series.daily_with_overall(df, ["customer", "material_group"]).orderBy("overall"))
    assert found == [("a", "g", day(1), 1.0, 0), ("__OVERALL__", "__OVERALL__", day(1), 3.0, 1)]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([("24H1", "a", 1.0), ("24H2", "a", 1.0), ("24H1", "b", 1.0)], "sheet string, order_no string, net_pounds double")
    assert rows(ingest.count_exact_duplicates(df)) == [(3, 1)]
    assert sorted(rows(ingest.drop_exact_duplicates(df))) == [("24H1", "a", 1.0), ("24H1", "b", 1.0)]


def test_gaps(spark):
    daily = spark.createDataFrame([("k", day(1), 10.0), ("k", day(4), 40.0)], "k string, date date, y double")
    full = series.dense(daily, ["k"])
    assert [r["y"] for r in series.fill_gaps(full, ["k"], "linear").orderBy("date").collect()] == [10.0, 20.0, 30.0, 40.0]
    assert series.fill_gaps(full, ["k"], "keep").count() == 2
    with pytest.raises(ValueError):
        series.fill_gaps(full, ["k"], "other")


def test_zero_fill_reaches_as_of_and_drops_future_keys(spark):
    daily = spark.createDataFrame([("k", day(1), 10.0), ("f", day(9), 1.0)], "k string, date date, y double")
    assert [r["y"] for r in series.zero_filled(daily, ["k"], "2026-01-04").orderBy("date").collect()] == [10.0, 0.0, 0.0, 0.0]


def test_events(spark):
    merged = events.merge_events(spark.createDataFrame([(day(1), None), (day(1), 10.0), (day(1), 15.0)], "date date, uplift_pct double"))
    assert rows(merged) == [(day(1), 15.0)]
    ramped = events.ramp(spark.createDataFrame([("k", day(3), 20.0)], "k string, date date, resolved_pct double"), ["k"]).orderBy("date")
    assert [round(100 * (1 + r["share"]), 6) for r in ramped.collect()] == [105.0, 110.0, 120.0, 110.0, 105.0]
    apart = spark.range(1).select(events.day_of_year_distance(F.lit(dt.date(2025, 12, 30)), F.lit(dt.date(2026, 1, 2)))).first()[0]
    assert apart == 3


def test_windows_and_two_point_rule(spark):
    counts = spark.createDataFrame([(100,), (73,), (1000,)], "n long").select(forecasts.window_count(F.col("n"), 14))
    assert [r[0] for r in counts.collect()] == [2, 0, 8]
    for best, want in ((18.1, "Seasonal Naive"), (18.0, "Other")):
        df = spark.createDataFrame([("k", "Seasonal Naive", 20.0, 1.0, 1.0), ("k", "Other", best, 1.0, 1.0)], "k string, model string, wape double, mae double, abs_pct_bias double")
        assert selection.recommend(df, ["k"]).first()["recommended"] == want


@pytest.mark.parametrize(("gap", "weights", "rooms", "want"), [(10, (1, 1), (100, 100), (5, 5)), (10, (1, 1), (2, 100), (2, 8)), (10, (1, 1), (2, 3), (2, 3)), (-10, (3, 1), (100, 100), (-7.5, -2.5)), (0.8, (1, 1), (9, 9), (0, 0))])
def test_water_fill(spark, gap, weights, rooms, want):
    df = spark.createDataFrame([("g", i, float(gap), float(w), float(r)) for i, (w, r) in enumerate(zip(weights, rooms, strict=True))], "g string, i int, gap double, weight double, room double")
    assert [round(r["alloc"], 9) for r in reconcile.water_fill(df, "g").orderBy("i").collect()] == [float(x) for x in want]


def test_holidays(spark):
    assert holidays.easter(2026) == dt.date(2026, 4, 5)
    assert holidays.nth_weekday(2026, 11, 3, 4) == dt.date(2026, 11, 26)
    assert holidays.last_weekday(2026, 5, 0) == dt.date(2026, 5, 25)
    found = holidays.calendar(spark, dt.date(2020, 1, 1), dt.date(2025, 12, 31))
    assert found.select("slot").distinct().count() == 33
    assert found.count() == found.select("date").distinct().count()


def test_fits_report_failures(spark):
    short = spark.createDataFrame([("k", day(n), float(n)) for n in range(1, 11)], "k string, date date, y double")
    found = models.fit_panel(short, ["k"], 3).collect()
    assert {r["model"] for r in found} == set(models.NAMES)
    assert all(r["status"].startswith("skipped") for r in found)


def test_store_and_workbook(spark, tmp_path):
    one = spark.createDataFrame([("a", "g", 1.0)], "customer string, material_group string, v double")
    store.write_run(one, str(tmp_path / "runs"), "2026-01-01")
    store.write_run(one.withColumn("v", F.lit(2.0)), str(tmp_path / "runs"), "2026-01-02")
    store.write_run(one.withColumn("v", F.lit(3.0)), str(tmp_path / "runs"), "2026-01-02")
    runs = store.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(r["v"] for r in runs.collect()) == [1.0, 3.0]
    assert store.latest_run(runs).first()["v"] == 3.0
    xlsx.write_workbook(str(tmp_path / "b.xlsx"), {"24H1": (["Mat.avail.dt", "Net Pounds"], [["2024-01-02", 5.5], [None, "x<y"]]), "empty": (["a"], [])})
    book = xlsx.read_workbook(str(tmp_path / "b.xlsx"))
    assert book["24H1"][1] == ["2024-01-02", "5.5"]
    assert book["empty"][1] == ["no data"]
    assert xlsx.sheet_frames(spark, str(tmp_path / "b.xlsx"))["24H1"].count() == 2


def test_reconciled_invariants(spark):
    out = catalog.reconcile_weekly(spark, SMALL)
    assert out.where("final < model_final - 1e-9").isEmpty()
    assert not out.isEmpty()


def test_history_of_lines_with_null_keys(spark):
    lines = spark.createDataFrame([(day(1), 2.0, "c", "m"), (day(1), 3.0, "c", "m"), (day(1), 5.0, None, "m"), (day(2), 7.0, "c", None), (day(3), 1.0, "d", "n")], "date date, net_pounds double, customer string, material_no string")
    past = reconciled.prepare(lines, day(3), day(5))
    assert past.keys == ["customer", "material_no"]
    assert rows(past.daily.orderBy("customer").drop("date")) == [("c", "m", 5.0), ("d", "n", 1.0)]
    assert rows(past.total.orderBy("date").select("y")) == [(10.0,), (7.0,), (1.0,)]
    assert rows(past.material_rows.where("material_no = 'm'").orderBy("date").select("y")) == [(10.0,), (0.0,), (0.0,)]
    one = past.work.part("run").keep(past.daily, "daily")
    assert one.count() == 2
    past.work.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(one.inputFiles()[0]).count()


def test_factor_of_the_finest_level_with_evidence(spark):
    days = spark.createDataFrame([(day(1), "a"), (day(2), "b"), (day(3), "c")], "date date, slot string")
    series_ = spark.createDataFrame([("k", day(n)) for n in range(1, 5)], "k string, date date")
    own = spark.createDataFrame([("k", "a", 2.0)], "k string, slot string, factor double")
    company = spark.createDataFrame([("a", 3.0), ("b", 1.5)], "slot string, factor double")
    found = holidays.with_factor(series_, days, [(own, ["k"]), (company, [])]).orderBy("date")
    assert [r["factor"] for r in found.collect()] == [2.0, 1.5, 1.0, 1.0]


def test_wide_forecast_and_reasons(spark):
    out = spark.createDataFrame([("k", day(1), "Regular", True, 3.0, 13.04, 20.0, 20.0), ("k", day(2), "Regular", True, 0.0, 5.0, 0.0, 5.0)], "k string, date date, demand_class string, has_model boolean, adj double, model_final double, backlog double, final double")
    assert rows(reports.wide_forecast(out, ["k"], ["2026-01-01", "2026-01-02", "2026-01-03"])) == [("k", 20.0, 5.0, None)]
    first, second = reconcile.daily_reasons(out, ["k"]).orderBy("date").collect()
    assert (first["parts"], first["reason"]) == ("20 + 0 = 20", "Regular series; booked 20 lb; increased by 3 lb; backlog exceeds the model by 7 lb")
    assert second["reason"] == "Regular series; no reconciliation needed"


def test_workbook_group_titles(tmp_path):
    path = str(tmp_path / "g.xlsx")
    xlsx.write_workbook(path, {"Reasoning": (["k", "class", "adj", "final"], [["a", "New", 1.0, 2.0]])}, {"Reasoning": [("Combination", 2), ("2026-01-01", 2)]})
    assert xlsx.read_workbook(path)["Reasoning"] == [["Combination", None, "2026-01-01"], ["k", "class", "adj", "final"], ["a", "New", "1.0", "2.0"]]
    with zipfile.ZipFile(path) as book:
        assert b'<mergeCell ref="A1:B1"/><mergeCell ref="C1:D1"/>' in book.read("xl/worksheets/sheet1.xml")


def test_days(spark):
    from orderlens import samples

    found = spark.createDataFrame([(x,) for x, _ in samples.DAYS], "raw string").select(cleaning.parse_day(F.col("raw"))).collect()
    assert [r[0] and str(r[0]) for r in found] == [d for _, d in samples.DAYS]


def orders(rows):
    """A sheet's header and rows as an export holds them."""
    return (["Mat.avail.dt", "Net Pounds", "Customer Name", "ReMat No", "ReMat Name", "Ship Pt", "Material Group", "Order#"], rows)


def workbook(path):
    a = ["2024-01-02", "1,000 lbs", "Acme", "38.0", "Flour", None, "Dry", 1]
    b = ["1/3/2024", 5.5, "Acme", 39, None, None, "Dry", 2]
    xlsx.write_workbook(path, {"24HY2": orders([a, ["soon", 1, "x", 1, None, None, "Dry", 3]]), "24 H1": orders([a, b, ["2024-01-04", "n/a", "x", 1, None, None, "Dry", 4]]), "Notes": (["x"], [["y"]]), "25H1": (["x"], [["y"]])})


def test_load_workbook(spark, tmp_path):
    path = str(tmp_path / "orders.xlsx")
    workbook(path)
    found = loading.load_workbook(spark, path, reconciled=True)
    got = sorted((r["sheet"], str(r["date"]), r["net_pounds"], r["customer"], r["material_no"], r["material_name"]) for r in found.rows.collect())
    assert got == [("24 H1", "2024-01-02", 1000.0, "Acme", "38", "Flour"), ("24 H1", "2024-01-03", 5.5, "Acme", "39", None)]
    assert "plant" not in found.rows.columns
    assert (found.ignored, found.skipped) == (["Notes"], ["25H1"])
    assert rows(found.duplicates) == [(3, 1)]
    report = {r["sheet"]: (r["rows_loaded"], r["bad_dates"], r["bad_pounds"], r["rows_valid"]) for r in found.report.collect()}
    assert report == {"24 H1": (3, 0, 1, 2), "24HY2": (2, 1, 0, 1)}
    assert loading.load_workbook(spark, path, reconciled=True, deduplicate=False).rows.count() == 3
    assert set(loading.load_workbook(spark, path).rows.columns) >= {"customer", "material_group"}
    with pytest.raises(ValueError, match="half-year"):
        loading.load_orders({"Notes": spark.range(1)}, {})


def test_date_cells_of_a_workbook(tmp_path):
    path = str(tmp_path / "d.xlsx")
    xlsx.write_workbook(path, {"24H1": (["Mat.avail.dt", "n"], [[45292, 45292], [45292.5, 1]])})
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n) for n in book.namelist()}
    sheet = "xl/worksheets/sheet1.xml"
    parts[sheet] = parts[sheet].replace(b'<row><c s="2"', b'<row><c s="1"')
    with zipfile.ZipFile(path, "w") as book:
        for n, data in {**parts, "xl/styles.xml": styles.encode()}.items():
            book.writestr(n, data)
    assert xlsx.read_workbook(path)["24H1"][1:] == [["2024-01-01", "45292"], ["2024-01-01 12:00:00", "1"]]


def test_workbooks_as_a_source(spark, tmp_path):
    """A task for each sheet of a folder of workbooks; by sheet name under the header's names."""
    for k in range(2):
        xlsx.write_workbook(str(tmp_path / f"b{k}.xlsx"), {"24H1": (["a", None, "a"], [[k, "x", 1e-7], [None, "y<", dt.date(2024, 2, 29)]]), f"only{k}": (["z"], [[1]])})
    workbook_source.register(spark)
    every = spark.read.format("orderlens_xlsx").load(str(tmp_path))
    assert every.rdd.getNumPartitions() == 4
    assert sorted((r["sheet"], r["row"], *r["cells"]) for r in every.where("workbook like '%b1.xlsx'").collect()) == [("24H1", 1, "a", None, "a"), ("24H1", 2, "1", "x", "0.0000001"), ("24H1", 3, None, "y<", "2024-02-29"), ("only1", 1, "z"), ("only1", 2, "1")]
    one = spark.read.format("orderlens_xlsx").option("sheet", "24H1").load(f"file://{tmp_path}")
    assert one.columns == ["a", "column1", "a.1"] and one.count() == 4
    assert rows(one.where("column1 = 'x'").orderBy("a").select("`a.1`", "a")) == [("0.0000001", "0"), ("0.0000001", "1")]
    frames = xlsx.sheet_frames(spark, str(tmp_path / "b0.xlsx"))
    assert list(frames) == ["24H1", "only0"] and rows(frames["only0"]) == [("1",)]
    with pytest.raises(Exception, match="no workbook has a sheet"):
        spark.read.format("orderlens_xlsx").option("sheet", "none").load(str(tmp_path))


def test_styled_sheets_written_by_tasks(spark, tmp_path):
    """Many rows without collect; fills, number formats, dates and frozen rows in the workbook's XML."""
    path = str(tmp_path / "big.xlsx")
    frame = spark.range(30_000).repartitionByRange(5, "id").select("id", F.when(F.col("id") % 2 == 0, "Forecast").otherwise("Actual").alias("type"), (F.col("id") / 3).alias("v"), F.expr("date_add(date'2024-01-01', cast(id % 100 as int))").alias("day")).sortWithinPartitions("id")
    look = xlsx.Look({"v": "#,##0.0"}, ("type", "Forecast", "FFF2CC"), (1, 1), {"id": 24})
    xlsx.write_frames(path, {"big": frame, "none": frame.where("false"), "plain": frame.limit(1)}, looks={"big": look})
    book = xlsx.read_workbook(path)
    assert [r[0] for r in book["big"][1:]] == [str(i) for i in range(30_000)] and book["big"][5][3] == "2024-01-05"
    assert book["none"][1][0] == "no data" and len(book["plain"]) == 2
    with zipfile.ZipFile(path) as archive:
        sheet, styles = archive.read("xl/worksheets/sheet1.xml").decode(), archive.read("xl/styles.xml").decode()
    assert 'formatCode="#,##0.0"' in styles and 'rgb="FFFFF2CC"' in styles and "<b/>" in styles
    assert '<pane xSplit="1" ySplit="1"' in sheet and '<col min="1" max="1" width="24"' in sheet
    shared = xlsx._Styles([look])
    assert f'<c s="{shared.of("#,##0.0", "FFF2CC")}"><v>0.0</v>' in sheet and f'<c s="{shared.of("#,##0.0", "")}"><v>0.3333333333333333</v>' in sheet
    with pytest.raises(ValueError, match="too many rows"):
        xlsx.write_frames(str(tmp_path / "over.xlsx"), {"over": spark.range(xlsx.MOST_ROWS + 1)})


def test_event_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Uplift %,High production date,note\n,2026-10-31,a\n15,10/31/2026,b\nx,2026-11-01,c\n5,soon,d\n")
    found = loading.read_events(spark, f"file://{tmp_path}/e.csv")
    assert sorted(rows(found), key=str) == sorted([(dt.date(2026, 10, 31), None), (dt.date(2026, 11, 1), None)], key=str) or found.count() == 3
    (tmp_path / "f.csv").write_text("uplift_pct,High_Production_Date\n,2026-10-31\n15,10/31/2026\nx,2026-11-01\n5,soon\n")
    assert sorted(rows(loading.read_events(spark, f"file://{tmp_path}/f.csv")), key=str) == sorted([(dt.date(2026, 10, 31), None), (dt.date(2026, 10, 31), 15.0), (dt.date(2026, 11, 1), None)], key=str)
    assert loading.event_rows(spark.createDataFrame([("a",)], "x string")).count() == 0


def test_uplift_of_a_segment_without_past_events(spark):
    future = spark.createDataFrame([(day(5), 30.0), (day(9), None)], "date date, uplift_pct double")
    nothing = spark.createDataFrame([], "k string, event_date date, variance_pct double")
    found = events.resolve_uplifts(future, nothing, ["k"], segments=spark.createDataFrame([("new",)], "k string")).orderBy("date").collect()
    assert [(r["resolved_pct"], r["method"], r["breakdown"]) for r in found] == [(30.0, "explicit", []), (20.0, "flat_default", [])]
    past = spark.createDataFrame([("k", dt.date(2025, 1, 7), 10.0), ("k", dt.date(2024, 1, 9), 30.0), ("k", dt.date(2024, 6, 1), 80.0)], "k string, event_date date, variance_pct double")
    near = events.resolve_uplifts(future.where("uplift_pct is null"), past, ["k"]).first()
    assert (near["resolved_pct"], near["method"]) == (20.0, "analog_average")
    assert [(r["event_date"], r["variance_pct"]) for r in near["breakdown"]] == [(dt.date(2024, 1, 9), 30.0), (dt.date(2025, 1, 7), 10.0)]


def test_segments_names_and_starts(spark):
    lines = spark.createDataFrame([("b", "g", day(2), "1", None), ("a", "h", day(1), "1", "late"), ("a", "g", day(1), "1", "first"), (None, "g", day(1), "2", None)], "customer string, material_group string, date date, material_no string, material_name string")
    assert rows(series.segments(lines, ["customer", "material_group"], 2).orderBy("place")) == [("__OVERALL__", "__OVERALL__", 0), ("a", "g", 1), ("a", "h", 2)]
    named = series.with_names(lines.select("material_no").distinct(), series.first_names(lines))
    assert dict(rows(named.select("material_no", "material_name"))) == {"1": "first", "2": "2"}
    assert series.forecast_start(dt.date(2026, 1, 1)) == dt.date(2026, 1, 2)
    assert series.forecast_start(dt.date(2026, 1, 1), True) == dt.date(2026, 1, 4)
    assert series.forecast_start(dt.date(2026, 1, 3), True) == dt.date(2026, 1, 4)


def test_parent_factor_falls_to_the_company(spark):
    days = spark.createDataFrame([(day(2), "s", "s|1", day(2), day(2), 1)], "date date, slot string, block string, block_first date, block_last date, block_days int")
    quiet = spark.createDataFrame([("k", "m", day(n), 0.0) for n in range(1, 31)], "k string, material_no string, date date, y double")
    company = spark.createDataFrame([("s", 2.0)], "slot string, factor double")
    material = spark.createDataFrame([("other", "s", 3.0)], "material_no string, slot string, factor double")
    busy = quiet.withColumn("y", F.lit(1.0))
    found = holidays.estimate(busy, ["k", "material_no"], days, 4.0, [(material, ["material_no"]), (company, [])]).first()
    # One day at the baseline's level against a parent of 2: trust is (1/3) / (1/3 + 4), and the baseline was freed of the factor.
    assert 1.5 < found["factor"] < 2.0
    alone = holidays.estimate(busy, ["k", "material_no"], days, 4.0, [(material, ["material_no"])]).first()
    assert abs(alone["factor"] - 1.0) < 0.02


def test_holiday_texts(spark):
    profile = spark.createDataFrame([("a", "x", 1.5, 2.0), ("a", "y", 0.8, 0.5), ("a", "z", 1.05, 3.0), ("b", "x", 1.01, 1.0)], "k string, slot string, factor double, n_obs double")
    every = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "k string, has_model boolean")
    none = "No material holiday effects (all within +/-10%)"
    assert dict(rows(holidays.summary_text(profile, ["k"], every))) == {"a": "x x1.50 (own); y x0.80 (borrowed)", "b": none, "c": "n/a (no model)", "d": none}


def test_features_agree_with_the_window_plan(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    y, first = rng.random(60) * 10, dt.date(2026, 1, 1)
    dates = [first + dt.timedelta(k) for k in range(60)]
    frame = spark.createDataFrame([("k", d, float(v)) for d, v in zip(dates, y, strict=True)], "k string, date date, y double")
    want = features.feature_matrix(frame, ["k"], ["2026-02-01"]).orderBy("date").drop("k", "date", "y").toPandas().to_numpy(float)
    found = fits.features(y, np.array(dates, "datetime64[D]"), np.array(["2026-02-01"], "datetime64[D]"))
    assert found.shape == (60, 21)
    np.testing.assert_allclose(found, want, rtol=1e-9, atol=1e-9)


def test_fits_on_known_series():
    import numpy as np

    t = np.arange(400)
    days = np.datetime64("2024-01-01") + t
    weekly = 100 + 10.0 * (t % 7)
    for name in ("Seasonal Naive", "AutoARIMA", "AutoETS", "HistGradientBoosting"):
        point, _ = models.outcomes(name, [weekly], [days], 14, np.array([], "datetime64[D]"))[0]
        assert np.abs(point - (100 + 10.0 * ((400 + np.arange(14)) % 7))).max() < 3, name
    assert fits.seasonal_naive(weekly, 9)[0].tolist() == weekly[[393, 394, 395, 396, 397, 398, 399, 393, 394]].tolist()


def test_smoothing_recovers_planted_forms():
    """Series of known form and parameters, fitted side by side with shorter ones."""
    import numpy as np

    rng = np.random.default_rng(1)
    season = np.array([3.0, 1, -2, 4, 0, -5, -1]) * 4
    forms = {f.name: f for f in ets.FORMS}
    planted = [("ANN", (0.3, 0, 0, 1)), ("ANA", (0.2, 0, 0.1, 1)), ("AAN", (0.5, 0.1, 0, 1)), ("AAdA", (0.4, 0.2, 0.1, 0.9)), ("MNM", (0.3, 0, 0.2, 1)), ("MNN", (0.6, 0, 0, 1))]
    series = []
    for name, parameters in planted:
        form = forms[name]
        parts = 1 + season / 80 if form.season == "M" else season if form.season == "A" else np.zeros(7)
        series.append(ets.simulate(form, parameters, 1200, 200.0, 0.1 if form.trend else 0.0, parts, rng.normal(0, 0.05 if form.relative else 5.0, 1200)))
    found = ets.fit_many([*series, series[0][-200:], series[1][:10]], 14)
    for (name, parameters), fit in zip(planted, found, strict=False):
        assert fit.form == name
        used = [k for k, on in enumerate((True, forms[name].trend, forms[name].season != "N", forms[name].damped)) if on]
        assert all(abs(fit.parameters[k] - parameters[k]) < 0.08 for k in used), (name, fit.parameters)
    assert found[6] is not None and found[7] is None
    alone = ets.fit_many([series[0][-200:]], 14)[0]
    assert np.allclose(alone.point, found[6].point, rtol=1e-3) and alone.form == found[6].form
    # A recursion by hand: the last states of fixed parameters.
    y = np.array([10.0, 12, 9, 14, 11, 13, 10, 12, 15, 11, 9, 12, 13, 14, 10, 11])
    lanes = ets.lanes_of([y], [[ets.FORMS.index(forms["AAdN"])]])
    states = ets.smooth(lanes, np.array([[0.3], [0.1], [0.0], [0.9]]))[1]
    level, slope, squares = lanes.level[0], lanes.slope[0], 0.0
    for v in y:
        e = v - level - 0.9 * slope
        level, slope, squares = level + 0.9 * slope + 0.3 * e, 0.9 * slope + 0.1 * e, squares + e * e
    assert np.allclose([states["level"][0], states["slope"][0], states["squares"][0]], [level, slope, squares])


def test_arima_likelihood_is_exact():
    """The filter's likelihood against the density of a multivariate normal."""
    import numpy as np

    rng = np.random.default_rng(3)
    for ar, ma in (([0.6], [0.5]), ([0.5, -0.3], []), ([], [0.4, 0.2]), ([0.3] + [0.0] * 5 + [0.5, -0.15], [])):
        w = arima.simulate(ar, ma, 50, rng.normal(size=400))
        size = max(len(ar), len(ma) + 1)
        phi, theta = np.zeros(size), np.zeros(size)
        phi[: len(ar)], theta[0], theta[1 : len(ma) + 1] = ar, 1, ma
        weights = arima._weights(phi, theta, 0, 0, 600)
        covariance = np.array([(weights[: 600 - k] * weights[k:]).sum() for k in range(50)])[np.abs(np.subtract.outer(np.arange(50), np.arange(50)))]
        square = w @ np.linalg.solve(covariance, w)
        lanes = arima.Lanes(w[:, None], np.zeros(1, int), np.zeros(1, int), np.zeros((4, 1), int), np.zeros(1))
        assert arima.kalman(lanes, phi[:, None], theta[:, None])[0][0] == pytest.approx(50 * np.log(square / 50) + np.linalg.slogdet(covariance)[1], abs=1e-4)


def test_arima_finds_planted_orders():
    import numpy as np

    rng = np.random.default_rng(2)
    planted = {"ar": ([0.7], [], 0, 0), "both": ([0.6], [0.5], 0, 0), "walk": ([], [-0.5], 1, 0), "weekly ar": ([0.5] + [0.0] * 5 + [0.6, -0.3], [], 0, 0), "weekly": ([0.4], [0.0] * 6 + [-0.6], 0, 1), "two": ([0.5, -0.4], [], 0, 0)}
    series = [arima.simulate(a, m, 1200, rng.normal(0, 3, 1500), d, s) + 50 for a, m, d, s in planted.values()]
    found = dict(zip(planted, arima.fit_many([*series, series[0][:10]], 14), strict=False))
    want = {"ar": ((1, 0, 0, 0), (0, 0)), "both": ((1, 1, 0, 0), (0, 0)), "walk": ((0, 1, 0, 0), (1, 0)), "weekly ar": ((1, 0, 1, 0), (0, 0)), "weekly": ((1, 0, 0, 1), (0, 1)), "two": ((2, 0, 0, 0), (0, 0))}
    assert {k: f.differences for k, f in found.items()} == {k: v[1] for k, v in want.items()}
    same = sum(found[k].orders == v[0] for k, v in want.items())
    assert same >= 5, {k: f.orders for k, f in found.items()}
    # Differences are undone: forecasts go on from the last day, and their deviations grow where there is a unit root.
    assert abs(found["walk"].point[0] - series[2][-1]) < 15 and found["walk"].spread[-1] > 1.5 * found["walk"].spread[0]
    assert np.abs(found["weekly"].point[:7] - series[4][-7:]).max() < 15
    assert arima.fit_many([series[0][:10]], 14) == [None]


def test_boosted_panel(spark):
    """Features of the next day agree with the window plan, and one model of several series follows their weeks."""
    first = dt.date(2025, 1, 1)
    size = {"a": 10.0, "b": 1000.0, "c": 3.0}
    shape = [1.0, 2.0, 3.0, 2.0, 1.0, 0.5, 0.5]
    data = [(k, first + dt.timedelta(i), v * shape[i % 7]) for k, v in size.items() for i in range(20 if k == "c" else 150)]
    panel = spark.createDataFrame(data, "k string, date date, y double")
    whole = {r["k"]: r for r in features.feature_matrix(panel, ["k"]).where("(k = 'c' and date = '2025-01-20') or (k <> 'c' and date = '2025-05-30')").collect()}
    before = panel.where("(k = 'c' and date < '2025-01-20') or (k <> 'c' and date < '2025-05-30')").groupBy("k").agg(F.max("date").alias("day"), F.array_sort(F.collect_list(F.struct("date", "y"))).alias("v"))
    told = before.select("k", *(c.alias(n) for n, c in boosted.next_features(F.col("v.y"), F.date_add("day", 1)).items())).collect()
    for r in told:
        for n in boosted.NAMES[:-1]:
            want = whole[r["k"]][n]
            assert r[n] == (want if want is None else pytest.approx(want, rel=1e-6, abs=1e-6)), n
    found = boosted.forecast(boosted.train(panel, ["k"], rounds=10), panel, ["k"], 7).orderBy("k", "date").collect()
    assert [r["date"] for r in found if r["k"] == "a"] == [first + dt.timedelta(150 + i) for i in range(7)]
    for k, n in (("a", 150), ("b", 150), ("c", 20)):
        assert [r["yhat"] for r in found if r["k"] == k] == pytest.approx([size[k] * shape[(n + i) % 7] for i in range(7)], rel=0.35)


def test_stored_forecasts_need_three_weeks(spark):
    first = dt.date(2026, 1, 1)
    lines = [(k, "g", first + dt.timedelta(i), 10.0 + i % 7) for k, n in (("short", 20), ("enough", 21)) for i in range(40 - n, 40)]
    df = spark.createDataFrame(lines, "customer string, material_group string, date date, net_pounds double")
    found = batch.run(df, dt.date(2026, 2, 9), 7, series.segments(df, batch.KEYS), ["Seasonal Naive", "AutoETS"])
    summary = {r["customer"]: (r["status"], r["error_message"]) for r in found["segment_summary"].collect()}
    assert summary["short"] == ("error", "skipped: needs 21 observations") and summary["enough"] == ("ok", None)
    assert {r["customer"] for r in found["segment_forecasts"].select("customer").distinct().collect()} == {"enough", "__OVERALL__"}


def test_backtests_count_failures(spark):
    long = [("long", dt.date(2026, 1, 1) + dt.timedelta(k), float(k % 7)) for k in range(100)]
    short = [("short", dt.date(2026, 1, 1) + dt.timedelta(k), 1.0) for k in range(30)]
    panel = spark.createDataFrame(long + short, "k string, date date, y double")
    names = ["Seasonal Naive", "HistGradientBoosting", "Chronos-2"]
    tests = models.backtest_panel(panel, ["k"], 14, names)
    assert tests.select("k").distinct().count() == 1
    naive = tests.where("model = 'Seasonal Naive'").collect()
    assert {r["window"] for r in naive} == {1, 2} and all(r["y"] == r["yhat"] for r in naive)
    measures = forecasts.metrics(tests.where("error is null"), spark.createDataFrame([("long", 1.0)], "k string, scale double"), ["k"])
    found = {(r["k"], r["model"]): r for r in models.roll_up(tests, measures, ["k"], names, panel).collect()}
    assert (found["long", "Seasonal Naive"]["skipped"], found["long", "Seasonal Naive"]["n_success_windows"]) == (False, 2)
    assert found["long", "Chronos-2"]["skip_reason"].startswith("every window failed: pretrained")
    assert found["short", "Seasonal Naive"]["skip_reason"] == "not enough history for the horizon"
    fake = spark.createDataFrame([(k, "m", w, "bad" if w <= e else None, 0.1) for k, e in (("a", 1), ("b", 2)) for w in range(1, 6)], "k string, model string, window bigint, error string, seconds double")
    empty = measures.limit(0)
    assert {r["k"]: r["skip_reason"] for r in models.roll_up(fake, empty, ["k"], ["m"], fake).collect()} == {"a": None, "b": "2 of 5 windows failed"}


def test_skipped_models_are_not_chosen(spark):
    board = spark.createDataFrame([("a", "Seasonal Naive", 20.0, False), ("a", "X", 5.0, True), ("a", "Y", 15.0, False), ("b", "X", 5.0, True)], "k string, model string, wape double, skipped boolean").withColumns({"mae": F.lit(1.0), "abs_pct_bias": F.lit(1.0)})
    found = {r["k"]: (r["recommended"], r["best_model"]) for r in selection.recommend(board, ["k"]).collect()}
    assert found == {"a": ("Y", "Y"), "b": ("None", None)}
    assert [r["model"] for r in selection.leaderboard(board, ["k"]).where("k = 'a'").orderBy("rank").collect()] == ["Y", "Seasonal Naive", "X"]
    assert [r["best_model_by_wape"] for r in selection.best_by_wape(board, ["k"]).collect()] == ["Y"]


def test_batch_run_and_rerun(spark, tmp_path):
    first = dt.date(2026, 1, 1)
    lines = [("a", "g", first + dt.timedelta(k), 10.0 + k % 7) for k in range(100)] + [("late", "g", dt.date(2026, 4, 15), 5.0)]
    df = spark.createDataFrame(lines, "customer string, material_group string, date date, net_pounds double")
    folder, as_of = f"file://{tmp_path}/store", dt.date(2026, 4, 10)
    assert batch.run_batch(df, folder, as_of, "2026-04-10", horizon=7, names=["Seasonal Naive", "AutoETS"]) == {"ok": 2, "skipped": 1}
    assert batch.run_batch(df, folder, as_of, "2026-04-10", horizon=7) == {}
    assert batch.run_batch(df, folder, as_of, "2026-04-11", horizon=7, limit=1, names=["Seasonal Naive"]) == {"ok": 2}
    summary = store.read_table(spark, folder, "segment_summary")
    assert sorted(rows(summary.groupBy("run_date").count())) == [("2026-04-10", 3), ("2026-04-11", 2)]
    late = summary.where("customer = 'late'").first()
    assert (late["status"], late["error_message"], late["backlog_days"]) == ("skipped", "no historical data", 1)
    ahead = store.read_table(spark, folder, "segment_forecasts").where("run_date = '2026-04-10' and customer = 'a'").orderBy("forecast_date").collect()
    assert [r["seasonal_naive"] for r in ahead] == [10.0 + k % 7 for k in range(100, 107)]
    assert batch.export_overall(spark, folder, "2026-04-10", str(tmp_path / "o.xlsx"))
    book = xlsx.read_workbook(str(tmp_path / "o.xlsx"))
    assert list(book) == ["Overall Forecast", "Backtest Accuracy"] and len(book["Overall Forecast"]) == 8


def test_a_run_is_committed_whole_or_not_at_all(spark, tmp_path):
    """A run that dies between its tables leaves nothing for readers; its segments are offered again."""
    folder = f"file://{tmp_path}/runs"
    kept = store.Store(spark, folder)
    one = spark.createDataFrame([("a", "g", 1.0), ("b", "g", 1.0)], "customer string, material_group string, v double")
    dies = one.withColumn("v", F.raise_error(F.lit("killed")).cast("double"))
    assert kept.table("summary") is None and kept.manifest() == (0, {})
    with pytest.raises(Exception, match="killed"):
        kept.commit({"summary": one, "metrics": dies}, "2026-01-01")
    assert kept.versions() == [] and kept.table("summary") is None
    assert kept.commit({"summary": one, "metrics": one}, "2026-01-01") == 1
    with pytest.raises(Exception, match="killed"):
        kept.commit({"summary": one, "metrics": dies}, "2026-01-02")
    assert rows(store.not_done(one, kept.table("summary"), "2026-01-02").select("customer").orderBy("customer")) == [("a",), ("b",)]
    # A rename that never came: staged folders and a stray manifest are not read, and vacuum removes them.
    assert kept.vacuum() == 4
    assert kept.commit({"summary": one.where("customer = 'a'").withColumn("v", F.lit(2.0))}, "2026-01-01") == 2
    assert sorted(rows(kept.table("summary").select("customer", "v"))) == [("a", 2.0), ("b", 1.0)]
    assert sorted(rows(kept.table("summary", 1).select("customer", "v"))) == [("a", 1.0), ("b", 1.0)]
    assert kept.vacuum() == 2 and kept.versions() == [2]
    assert sorted(rows(kept.table("metrics").select("customer", "run_date"))) == [("a", "2026-01-01"), ("b", "2026-01-01")]


def test_commits_side_by_side(spark, tmp_path, monkeypatch):
    """A commit whose number is taken meanwhile reads the newer manifest; neither run's rows are lost."""
    kept = store.Store(spark, f"file://{tmp_path}/runs")
    one = spark.createDataFrame([("a", "g", 1.0)], "customer string, material_group string, v double")
    other, put, raced = one.withColumn("customer", F.lit("b")), kept._put, []

    def late(version, tables):
        if not raced:
            raced.append(store.Store(spark, kept.folder).commit({"summary": other}, "2026-01-01"))
        return put(version, tables)

    monkeypatch.setattr(kept, "_put", late)
    assert kept.commit({"summary": one}, "2026-01-01") == 2 and raced == [1]
    assert sorted(r["customer"] for r in kept.table("summary").collect()) == ["a", "b"]


def test_reconciled_run_to_a_workbook(spark, tmp_path):
    first = dt.date(2025, 1, 1)
    sheet = [[str(first + dt.timedelta(k)), 10 + k % 7 + 3 * c, f"c{c}", 100 + c, None, None, "x", k] for k in range(140) for c in range(2)]
    sheet += [["2025-05-25", 900, "c0", 100, None, None, "x", 1], ["2025-01-01", 5, "gone", 7, "Old", None, "x", 2]]
    path, out = str(tmp_path / "in.xlsx"), str(tmp_path / "out.xlsx")
    xlsx.write_workbook(path, {"25H1": orders(sheet)})
    reconciled.main(["--workbook", path, "--out", out, "--as-of", "2025-05-20", "--horizon", "7", "--weekly-start-date", "2025-05-25", "--backtest"], spark)
    book = xlsx.read_workbook(out)
    assert list(book) == ["Forecast", "Overall Forecast (Weekly)", "Reconciliation", "Reconciliation (Weekly)", "Holiday Effects", "Reasoning", "Backtest"]
    header, *body = book["Forecast"]
    assert header[:2] == ["customer", "material_no"] and len(body) == 3
    booked = dict(zip(header, body[0], strict=True))["2025-05-25"]
    assert float(booked) == 900.0
    assert [r[0] for r in book["Backtest"][1:]] == sorted(r[0] for r in book["Backtest"][1:]) and len(book["Backtest"]) == 9
    assert any("dormant" in str(x) for x in book["Reasoning"][-1])


def test_csv_out(spark, tmp_path):
    xlsx.write_csv(spark.createDataFrame([("a", 1.5), (None, 2.0)], "k string, v double"), f"file://{tmp_path}/csv")
    back = spark.read.csv(f"file://{tmp_path}/csv", header=True)
    assert sorted(rows(back), key=str) == sorted([("a", "1.5"), (None, "2.0")], key=str)


def test_stream_of_daily_totals(spark, tmp_path):
    events_ = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 23:00:00", "a", 2.0), ("2024-01-09 00:00:00", "a", 5.0)], "ts string, event_type string, value double")
    events_.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events_.schema).parquet(f"{tmp_path}/events")
    query = daily.daily_totals(stream).writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(str(r["date"]), r["n"], r["value"]) for r in spark.table("totals").collect()] == [("2024-01-01", 2, 3.0)]


def test_days_with_years_beyond_a_timestamp(spark):
    """A year that no timestamp holds is no day, and no error."""
    rows = spark.createDataFrame([("+123456789-01-05",), ("1/2/+123456789",), ("2024-01-05",), ("5-jan-24",)], "raw string")
    assert [str(r[0]) for r in rows.select(cleaning.parse_day(F.col("raw"))).collect()] == ["None", "None", "2024-01-05", "2024-01-05"]


def test_numbers_bind_their_text_once(spark):
    """The text is cleaned once for the value and the reason, not again for every use."""
    plan = spark.createDataFrame([("1,5",)], "raw string").withColumn("n", cleaning.parse_number(F.col("raw"))).select("n.value", "n.reason")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 3


def test_committed_runs_commit_a_written_table(spark, monkeypatch):
    """The runs are made once; no commit makes them from the order lines again."""
    plans, commit = [], store.Store.commit

    def kept(self, tables, *rest):
        plans.append(tables["runs"]._jdf.queryExecution().optimizedPlan().toString())
        return commit(self, tables, *rest)

    monkeypatch.setattr(store.Store, "commit", kept)
    catalog.committed_runs(spark, "/root/testdata/sf0.001").count()
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_order_lines_are_dealt_twice_at_most(spark):
    """Lines meet whole orders, then parts, and no join carries their timestamps."""

    def joins(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        return [*([node] if node.nodeName() == "Join" else []), *(j for child in below for j in joins(child))]

    plan = order_lines.material_lines(spark, SMALL).groupBy("customer", "material_no", "date").agg(F.sum("net_pounds"))._jdf.queryExecution().optimizedPlan()
    over = [j for j in joins(plan) if "l_quantity" in j.output().mkString(" ")]
    assert len(over) == 2 and not any("l_shipdate" in j.output().mkString(" ") for j in over)


def test_order_lines_of_repeated_and_missing_keys(spark, tmp_path):
    """Every pair of a line and an order, customer and part of its keys is a row; lines without one of them are none."""
    stamp = dt.datetime(2001, 7, 1, 23, 59)
    tables = {
        "lineitem": ([(1, 1, 1, 1.0, stamp), (1, 1, 1, 1.0, stamp), (2, 1, 1, 2.0, None), (3, 1, 1, 4.0, stamp), (4, 9, 1, 8.0, stamp), (None, 1, 1, 16.0, stamp), (5, 1, None, 32.0, stamp)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp_ntz"),
        "orders": ([(1, 1, stamp), (1, 2, stamp), (2, 1, None), (3, 9, stamp), (4, 1, stamp), (None, 1, stamp), (5, None, stamp)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "customer": ([(1, "a"), (2, None), (2, "BUILDING")], "c_custkey long, c_mktsegment string"),
        "part": ([(1, "t", "b")], "p_partkey long, p_type string, p_brand string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = rows(order_lines.material_lines(spark, str(tmp_path)).select("sheet", "date", "net_pounds", "customer", "material_no", "plant", "order_no", "doc_dt"))
    first = [("01H2", stamp.date(), 1.0, c, m, "1", 1, stamp.date()) for c, m in (("a", "b"), (None, "b"), ("BUILDING", "t")) for _ in range(2)]
    assert sorted(found, key=str) == sorted([*first, (None, None, 2.0, "a", "b", "1", 2, None)], key=str)
