"""The driver tables seen as our relations, in Spark and as SQL common table expressions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordered import by_key
from .base import table

MONTH = "((year(l_shipdate) - 1995) * 12 + month(l_shipdate))"
DAY = "((year(l_shipdate) - 1995) * 372 + (month(l_shipdate) - 1) * 31 + day(l_shipdate))"

NOISY = """noisy AS (SELECT user_id AS curve_id, round(event_id * 1e-2, 3) AS t,
    greatest(0e0, 1e0 - event_id * 5e-5 - value / 1e3) AS s FROM events)"""
REMAINING = f"""remaining AS (SELECT l_suppkey AS curve_id, CAST(d AS DOUBLE) AS t,
    1e0 - sum(q) OVER (PARTITION BY l_suppkey ORDER BY d) / sum(q) OVER (PARTITION BY l_suppkey) AS s
    FROM (SELECT l_suppkey, {DAY} AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) u)"""
MANY = f"""many AS (SELECT l_suppkey AS curve_id, CAST({MONTH} AS DOUBLE) AS t,
    1e0 - {MONTH} * 8e-3 - l_discount - l_quantity * 1e-4 AS s FROM lineitem)"""
PAIR = f"""pair AS (SELECT l_linenumber AS image_id, l_returnflag AS style, CAST({MONTH} AS DOUBLE) AS t,
    round(1e0 - avg(l_discount) * 5, 9) AS s FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3)"""
TRACED = """traced AS (SELECT user_id AS curve_id, CAST(event_id // 20 AS INTEGER) AS x,
    min(floor(event_id * 1e-2 + value * 4e-1)) AS y FROM events GROUP BY 1, 2)"""


def noisy(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("curve_id"), F.round(F.col("event_id") * 1e-2, 3).alias("t"),
                    F.greatest(F.lit(0.0), 1.0 - F.col("event_id") * 5e-5 - F.col("value") / 1e3).alias("s"))


def remaining(spark, sf) -> DataFrame:
    """Remaining share of quantity by ship day, per supplier."""
    from ..ordered import Ordered
    days = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("curve_id"), F.expr(DAY).cast("double").alias("t"))
            .agg(F.sum("l_quantity").alias("q")))
    o = Ordered(days, "curve_id", "t").running(_c=("sum", "q")).total(_q=F.sum("q"))
    return o.df.select("curve_id", "t", (1.0 - F.col("_c") / F.col("_q")).alias("s"))


def many(spark, sf) -> DataFrame:
    """Many values per time: one per lineitem and ship month."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("curve_id"), F.expr(MONTH).cast("double").alias("t"),
        F.expr(f"1.0D - {MONTH} * 8e-3D - l_discount - l_quantity * 1e-4D").alias("s"))


def pair(spark, sf) -> DataFrame:
    """Two curves per image on a shared grid."""
    return (table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
            .groupBy(F.col("l_linenumber").alias("image_id"), F.col("l_returnflag").alias("style"),
                     F.expr(MONTH).cast("double").alias("t"))
            .agg(F.round(1.0 - F.avg("l_discount") * 5, 9).alias("s")))


def traced(spark, sf) -> DataFrame:
    """Pixel curves with gaps: a column per 20 events, y falling down the picture with noise."""
    cells = table(spark, sf, "events").select(F.col("user_id").alias("curve_id"), F.expr("cast(event_id div 20 as int)").alias("x"),
                                              F.floor(F.col("event_id") * 1e-2 + F.col("value") * 4e-1).cast("double").alias("y"))
    return by_key(cells, "curve_id").groupBy("curve_id", "x").agg(F.min("y").alias("y"))
