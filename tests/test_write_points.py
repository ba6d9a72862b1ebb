"""Files of curves: written by all cores, about one per curve, a long curve by several tasks."""
import glob

from pyspark.sql import functions as F

from curvekit.sources import files


def written(spark, points, path):
    files.write_points(points, path)
    back = spark.read.schema("Time DOUBLE, Survival DOUBLE, curve_id INT").option("header", "true").csv(path)
    assert sorted(map(tuple, back.select("curve_id", "Time", "Survival").collect())) == sorted(map(tuple, points.collect()))
    return glob.glob(f"{path}/curve_id=*/*.csv")


def test_files_per_curve(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    points = spark.range(0, 1600, 1, 8).select((F.col("id") % 40).alias("curve_id"), F.col("id").cast("double").alias("t"), (1 / (F.col("id") + 1)).alias("s"))
    found = written(spark, points, str(tmp_path / "many"))
    assert 40 <= len(found) <= 40 + 2 * cores  # it was a file per curve and input split
    long = spark.range(0, 4000, 1, 1).select(F.lit(7).alias("curve_id"), F.col("id").cast("double").alias("t"), F.lit(0.5).alias("s"))
    assert len(written(spark, long, str(tmp_path / "long"))) > 1
