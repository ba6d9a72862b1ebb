"""Looking for hot keys does not run the steps before it again, and cells of a curve share one shuffle with its windows."""
import pytest
from pyspark.sql import functions as F

from curvekit import ordered
from curvekit.operators import clean
from curvekit.queries import QUERIES, views


@pytest.fixture
def probing(spark):
    spark.conf.set("curvekit.probeBytes", "0")
    yield spark
    spark.conf.unset("curvekit.probeBytes")
    spark.conf.unset("curvekit.slabRows")


def test_chain_is_run_once(probing):
    """The points were made three times: for the result, and to count what was left of them before two of its steps."""
    made = probing.sparkContext.accumulator(0)

    def value(i):
        made.add(1)
        return 1 - i / 400

    rows = probing.range(300).select((F.col("id") % 3).alias("curve_id"), (F.col("id") / 3).alias("t"), F.udf(value, "double")("id").alias("s"))
    chain = clean.drop_flat(clean.monotone_drop(rows, start=None), counted=rows)
    assert clean.resample(chain, counted=rows).count() == 3 * 200
    assert made.value == 300


def test_traced_cells_are_dealt_once(probing, capsys):
    """They were dealt by curve and column, counted, and dealt by curve."""
    QUERIES["k15_fill_linear"](probing, "/root/testdata/sf0.001").explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_hot_keys_are_still_found(probing):
    cells = probing.range(100).select(F.when(F.col("id") < 90, 1).otherwise(F.col("id")).alias("curve_id"), F.col("id").alias("x"), F.col("id").cast("double").alias("y"))
    probing.conf.set("curvekit.slabRows", "7")
    assert ordered.by_key(cells, "curve_id") is cells
    assert ordered.Ordered(cells, "curve_id", "x", counted=cells)._hot is not None
    filled = clean.fill_linear(cells, counted=cells)
    assert sorted(map(tuple, filled.collect())) == sorted((1 if i < 90 else i, i, float(i), True) for i in range(100))
    few = cells.where(F.col("x") < 5)
    assert ordered.Ordered(few, "curve_id", "x", counted=cells)._hot is None
    assert views.traced(probing, "/root/testdata/sf0.001").groupBy("curve_id", "x").count().where("count > 1").isEmpty()
