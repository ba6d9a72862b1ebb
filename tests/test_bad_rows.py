"""One degenerate row must not end the job: it gets nulls (or is left out, where that is the rule) and the good rows stay as they are."""
import pytest
from pyspark.sql import functions as F

from curvekit.operators import atrisk, axis, checks, clean, quality
from curvekit.sources import files

CAL = "image_id int, x_0_pixel int, x_max_pixel int, y_0_pixel int, y_100_pixel int, time_min double, time_max double, survival_min double, survival_max double"


@pytest.fixture
def calibration(spark):
    return spark.createDataFrame([(1, 10, 110, 200, 100, 0.0, 10.0, 0.0, 1.0), (2, 10, 10, 100, 100, 5.0, 5.0, 0.0, 1.0)], CAL)


def test_flat_axes(spark, calibration):
    points = spark.createDataFrame([(1, 60, 150), (2, 60, 150)], "image_id int, x int, y int")
    got = {r["image_id"]: (r["t"], r["s"]) for r in axis.px_to_data(points, calibration).collect()}
    assert got == {1: (5.0, 0.5), 2: (None, None)}
    data = spark.createDataFrame([(1, 5.0, 0.5), (2, 5.0, 0.5)], "image_id int, t double, s double")
    assert {r["image_id"]: r["px"] for r in axis.data_to_px(data, calibration).collect()} == {1: 60, 2: None}
    assert {r["image_id"]: r["px"] for r in checks.to_pixels(data, calibration).collect()} == {1: 60, 2: None}


def test_empty_plot_rectangle(spark):
    bounds = spark.createDataFrame([(1, 0, 0, 100, 50, 0.0, 10.0), (2, 0, 0, 0, 50, 0.0, 10.0)], "image_id int, px int, py int, pw int, ph int, time_min double, time_max double")
    traced = spark.createDataFrame([(1, 5), (1, 90), (2, 0), (2, 3)], "image_id int, x int")
    got = {r["image_id"]: (r["expanded"], r["time_max"]) for r in axis.expand_bounds(bounds, traced).collect()}
    assert got == {1: (False, 10.0), 2: (False, 10.0)}


def test_repeated_x(spark):
    traced = spark.createDataFrame([(1, 1, 10), (1, 3, 20), (1, 3, 20), (1, 4, 30)], "curve_id int, x int, y int")
    got = sorted((r["x"], r["y"], r["present"]) for r in clean.fill_linear(traced).collect())
    assert got == [(1, 10.0, True), (2, 15.0, False), (3, 20.0, True), (3, 20.0, True), (4, 30.0, True)]


def test_time_range_of_zero(spark):
    points = spark.createDataFrame([(1, -2.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 1.0), (2, 1.0, 0.0), (2, 10.0, 0.0)], "curve_id int, t double, s double")
    found = {(r["curve_id"], r["issue_type"]) for r in quality.all_issues(points).collect()}
    assert {(2, "early_zero"), (1, "negative_time")} <= found
    assert {r["curve_id"] for r in quality.early_zero(points).collect()} == {1, 2}


def test_number_of_too_many_digits(spark):
    rows = spark.createDataFrame([(1, 1, ["A", "12", "9"]), (2, 1, ["B", "1" * 30, "7"])], "image_id int, row_y int, words array<string>")
    got = {r["image_id"]: r["values"] for r in atrisk.parse_data_rows(rows).collect()}
    assert got == {1: [12, 9], 2: [7]}


def test_row_without_cells(spark):
    rows = spark.createDataFrame([(1, 0, ["", "0", "6"]), (1, 1, ["A", "5", "3"]), (1, 2, [])], "table_id int, row_no int, cells array<string>")
    assert sorted((r["grp"], r["t"], r["n"]) for r in files.parse_grid(rows).collect()) == [("A", 0.0, 5), ("A", 6.0, 3)]


def test_undecodable_picture(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no picture")
    images = files.read_images(spark, str(tmp_path))
    assert [r["readable"] for r in images.collect()] == [False]
    assert files.read_pixels(images).count() == 0
    assert images.filter(F.col("readable")).count() == 0
