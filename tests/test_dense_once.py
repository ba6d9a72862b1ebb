"""The dense comparison works out its points and the mask once, however many of its parts are read, and a report adds no more."""
from pyspark.sql import functions as F

from curvekit.operators import checks, reports


def counted(df, column, seen):
    """`df` with a column that counts the rows worked out."""

    def tell(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(tell, df.schema[column].dataType).asNondeterministic()(column))


def test_points_and_mask_are_read_once(spark):
    values = [(1, k, float(t), s) for k in (1, 2) for t, s in ((0, 1.0), (20, 0.9), (50, 0.4), (80, 0.35))]
    points = spark.createDataFrame(values, "image_id long, curve_id long, t double, s double")
    cal = spark.createDataFrame([(1, 0, 90, 100, 0, 0.0, 90.0), (2, 5, 5, 100, 0, 0.0, 90.0)], "image_id long, x_0_pixel int, x_max_pixel int, y_0_pixel int, y_100_pixel int, time_min double, time_max double")
    cells = [(1, x, y) for x in range(90) for y in (3, 30)] + [(1, 50, y) for y in range(10, 60)] + [(1, 0, 100), (2, 1, 1)]
    mask = spark.createDataFrame(cells, "image_id long, x int, y int")
    read, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    match = checks.dense_match(counted(points, "s", read), cal, counted(mask, "y", seen), close_open=True)
    got = {name: sorted(map(tuple, part.collect())) for name, part in match.items()}
    assert [q[:3] for q in got["summary"]] == [(1, 1, 45), (1, 2, 45)]
    assert [q[:3] for q in got["missing_steps"]] == [(1, 1, 20.0), (1, 2, 20.0)]
    assert reports.dense_report(match).count() > 20
    assert (read.value, seen.value) == (len(values), len(cells))
