"""Pixel rasters made from the driver tables: 25 pictures of months x quantities, coloured by part, order and supplier."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pixels as p
from . import views as v
from .base import table

CELLS = f"""cells0 AS (SELECT l_suppkey % 25 AS image_id, CAST({v.MONTH} AS INTEGER) AS x, CAST(l_quantity AS INTEGER) AS y,
    CAST(l_partkey * 37 % 256 AS INTEGER) AS a, CAST(l_orderkey * 11 % 256 AS INTEGER) AS c, CAST(l_suppkey * 53 % 256 AS INTEGER) AS d,
    CAST(round(l_tax * 100) AS INTEGER) AS k FROM lineitem),
px0 AS (SELECT image_id, x, y, min(CASE WHEN k = 2 THEN a % 70 ELSE a END) AS b, min(CASE WHEN k = 2 THEN a % 70 WHEN k < 2 THEN a ELSE c END) AS g,
    min(CASE WHEN k = 2 THEN a % 70 WHEN k < 2 THEN a ELSE d END) AS r FROM cells0 GROUP BY 1, 2, 3)"""
PIXELS = CELLS + """,
px1 AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px0),
px2 AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE (d * CAST(round_even(1044480e0 / greatest(v, 1), 0) AS INTEGER) + 2048) // 4096 END AS s,
    CAST(floor((CASE WHEN d = 0 THEN 0 ELSE (CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END)
    * CAST(round_even(737280e0 / (6 * greatest(d, 1)), 0) AS INTEGER) END + 2048) / 4096e0) AS INTEGER) AS h0 FROM px1),
pixels AS (SELECT image_id, x, y, b, g, r, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h, CAST(s AS INTEGER) AS s, v,
    CAST((b * 3735 + g * 19235 + r * 9798 + 16384) // 32768 AS INTEGER) AS gray FROM px2)"""
IMAGES = "images AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(90 + n_nationkey % 3 * 20 AS INTEGER) AS width, CAST(51 + n_nationkey % 5 * 25 AS INTEGER) AS height FROM nation)"
BOUNDS = "bounds AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(5 + n_nationkey % 4 AS INTEGER) AS px, 3 AS py, 70 AS pw, 40 AS ph FROM nation)"


def raw(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a, c, d = ((F.col(k) * m % 256).cast("int") for k, m in (("l_partkey", 37), ("l_orderkey", 11), ("l_suppkey", 53)))
    k = F.round(F.col("l_tax") * 100).cast("int")
    return li.groupBy((F.col("l_suppkey") % 25).alias("image_id"), F.expr(v.MONTH).cast("int").alias("x"), F.col("l_quantity").cast("int").alias("y")).agg(
        F.min(F.when(k == 2, a % 70).otherwise(a)).alias("b"), F.min(F.when(k == 2, a % 70).when(k < 2, a).otherwise(c)).alias("g"),
        F.min(F.when(k == 2, a % 70).when(k < 2, a).otherwise(d)).alias("r"))


def pixels(spark, sf) -> DataFrame:
    return p.with_hsv(raw(spark, sf))


def images(spark, sf) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.cast("bigint").alias("image_id"), (90 + n % 3 * 20).cast("int").alias("width"), (51 + n % 5 * 25).cast("int").alias("height"))


def bounds(spark, sf) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.cast("bigint").alias("image_id"), (5 + n % 4).cast("int").alias("px"),
                                             *[F.lit(q).alias(k) for k, q in (("py", 3), ("pw", 70), ("ph", 40))])
