"""Registry of queries: `@query(name, sql)` on a function (spark, sf_dir) -> DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def round_doubles(df: DataFrame, places: int | None = 6) -> DataFrame:
    """Round double columns: sums of doubles depend on the order of addition in their last digits."""
    if places is None:
        return df
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, rounded: str = "", places: int | None = 6):
    """Register a query. `rounded` names the double columns of the SQL, which are rounded as in Spark;
    with places=None both sides do the same arithmetic and nothing is rounded."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf: round_doubles(fn(spark, sf), places)
        if sql is not None:
            text = sql.strip()
            if rounded:
                cols = ", ".join(f"round({c}, {places}) + 0e0 AS {c}" for c in rounded.split())
                text = f"SELECT * REPLACE ({cols}) FROM ({text}) AS q_"
            ORACLES[name] = text
        return fn

    return wrap
