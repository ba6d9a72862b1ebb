"""Queries whose SQL once left results to rounding, to the order of addition or to a fixed reach."""
import random
from functools import reduce
from operator import add

import duckdb

import __spark_entry__ as entry
from compare import rows
from curvekit.operators import masks
from curvekit.queries import joins as qj
from curvekit.queries import runs as qr


def save(con, folder, **tables):
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")


def test_spots_on_a_whole_row(spark, tmp_path):
    """The mean price is exactly on a row of the picture while the sum of doubles falls short of it, or passes it, by the order of the rows."""
    rng = random.Random(5)
    cents = []
    while len(cents) < 20:
        group = [rng.randrange(10000, 90000) for _ in range(10)]
        group.append(11 * 50000 - sum(group))
        if group[-1] > 0 and reduce(add, [c / 100 for c in group]) / 11 / 500 < 1:
            cents.append(group)
    values = ", ".join(f"({i}, {c / 100})" for i, group in enumerate(cents) for c in group)
    con = duckdb.connect()
    save(con, tmp_path, lineitem=f"SELECT CAST(k AS BIGINT) AS l_suppkey, CAST(p AS DOUBLE) AS l_extendedprice, TIMESTAMP '1995-03-05 00:00:00' AS l_shipdate FROM (VALUES {values}) v(k, p)",
         supplier="SELECT CAST(k AS BIGINT) AS s_suppkey, 3 AS s_nationkey FROM range(20) r(k)")
    got = {q["curve_id"]: q["py"] for q in qj.spots(spark, str(tmp_path)).collect()}
    assert got == {k: 1 for k in range(20)}
    assert dict(con.execute(f"WITH {qj.EXACT_SPOTS} SELECT curve_id, py FROM spots").fetchall()) == got


def test_skeleton_of_wide_cells(spark):
    """Cells farther than nine steps from the outside are told apart."""
    cells = [(1, x, y) for x in range(31) for y in range(27)] + [(2, x, y) for x in range(12) for y in range(12) if (x * y) % 7]
    con = duckdb.connect()
    sql = f"WITH cells AS (SELECT * FROM (VALUES {', '.join(map(str, cells))}) v(image_id, x, y)), {qr.STEPS} SELECT image_id, x, y FROM ds a WHERE NOT EXISTS (SELECT 1 FROM ds b WHERE b.image_id = a.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.d > a.d)"
    assert qr.STEPS in entry.oracle_sql()["m04_skeleton"] and con.execute(f"SELECT max(d) FROM ({sql.split(' SELECT image_id, x, y FROM ds a')[0]} SELECT d FROM ds)").fetchall() == [(14,)]
    mask = spark.createDataFrame(cells, "image_id long, x int, y int")
    assert rows(["image_id", "x", "y"], [tuple(q) for q in masks.skeleton(mask).collect()]) == rows(["image_id", "x", "y"], con.execute(sql).fetchall())


def test_waypoints_with_half_cents(spark, tmp_path):
    con = duckdb.connect()
    save(con, tmp_path, customer="SELECT CAST(k AS BIGINT) AS c_custkey, CAST(k % 25 AS INTEGER) AS c_nationkey, (k * 10 + 5) / 10e0 AS c_acctbal, 'x' AS c_mktsegment, 'n' AS c_name FROM range(2000, 4000) r(k)")
    df = entry.queries()["t12_parse_waypoints"](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()["t12_parse_waypoints"])
    assert rows(df.columns, [tuple(q) for q in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())
