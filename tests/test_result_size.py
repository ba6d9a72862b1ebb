"""Grids are made stretch by stretch, so that files of them stay small; no row is lost or changed by that."""
import pytest
from pyspark.sql import functions as F

from curvekit.operators import clean


def written(df, path) -> tuple[int, int]:
    df.write.parquet(str(path))
    return sum(p.stat().st_size for p in path.glob("*.parquet")), df.sparkSession.read.parquet(str(path)).count()


def test_grid_takes_few_bytes_a_row(spark, tmp_path):
    """Times and columns took about two bytes a row, as each curve counted up from its start."""
    ends = spark.range(64).select((F.col("id") % 32).alias("curve_id"), (F.floor(F.col("id") / 32) * 20000).alias("x")).repartition(1)
    size, rows = written(clean.resample(ends.select("curve_id", F.col("x").cast("double").alias("t"), F.lit(0.5).alias("s"))), tmp_path / "t")
    assert rows == 32 * 40001 and size < rows / 2
    size, rows = written(clean.fill_linear(ends.select("curve_id", "x", F.lit(7.0).alias("y"))), tmp_path / "x")
    assert rows == 32 * 20001 and size < rows / 2


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_stretches_leave_no_number_out(spark, kind):
    w = clean.STRETCH
    ranges = [(0, 0), (-1, 0), (w - 1, w), (-w, -w), (-3 * w - 5, 2 * w + 1), (5, 4), (None, 3), (3, None), (w, 2 * w - 1), (w, 2 * w), (10 ** 9, 10 ** 9 + 3)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], f"id int, lo {kind}, hi {kind}").repartition(2)
    got = clean.by_stretch(rows, ["id"], "lo", "hi", "k")
    assert sorted((r["id"], r["k"]) for r in got.collect()) == [(i, k) for i, (a, b) in enumerate(ranges) if None not in (a, b) for k in range(a, b + 1)]


def test_filled_columns_keep_their_kind(spark):
    for kind in ("int", "bigint"):
        rows = spark.createDataFrame([(1, -300, 2.0), (1, 300, 8.0), (1, 300, 9.0), (2, 5, 1.0), (2, None, 4.0)], f"curve_id int, x {kind}, y double")
        out = clean.fill_linear(rows)
        assert dict(out.dtypes)["x"] == kind and out.columns == ["curve_id", "x", "y", "present"]
        got = sorted(map(tuple, out.collect()))
        assert got[:-3] == [(1, x, 2 + 6 * ((x + 300) / 600), x == -300) for x in range(-300, 300)]
        assert got[-3:] == [(1, 300, 8.0, True), (1, 300, 9.0, True), (2, 5, 1.0, True)]
