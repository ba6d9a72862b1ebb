"""Run registered queries against their SQL: python tests/compare.py [-s SF] [--skew] [name prefixes...]."""
from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("curvekit-tests")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())


def oracle(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return sorted((str(k), str(plain(x))) for k, x in v.items())
    return v if not isinstance(v, bool) else str(v)


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([plain(r[i]) for i in at] for r in data), key=repr)


SQL_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return f"rows {len(got)}", took, bool(got)
    cur = con.execute(sql)
    cols, types = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    notes = []
    mine = {c: SQL_TYPE.get(t, t) for c, t in df.dtypes}
    theirs = dict(zip(cols, types))
    if sorted(mine) != sorted(theirs):
        return f"columns {sorted(mine)} / {sorted(theirs)}", took, False
    for c in mine:
        if mine[c] != theirs[c] and mine[c] in SQL_TYPE.values():
            notes.append(f"type {c}: {mine[c]} / {theirs[c]}")
    a, b = rows(df.columns, got), rows(cols, want)
    if a != b:
        in_a, in_b = {repr(r) for r in a}, {repr(r) for r in b}
        only_a, only_b = sorted(in_a - in_b)[:3], sorted(in_b - in_a)[:3]
        notes.append(f"{len(a)} / {len(b)} rows; spark only {only_a}; sql only {only_b}; cols {sorted(cols)}")
    return "; ".join(notes) or f"same {len(a)}", took, not notes and bool(a)


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["-s"]:
        sf, argv = f"/root/testdata/sf{argv[1]}", argv[2:]
    skew, argv = "--skew" in argv, [a for a in argv if a != "--skew"]
    import __spark_entry__ as e
    spark, con = session(), oracle(sf)
    spark.sparkContext.setLogLevel("ERROR")
    if skew:  # every key above 40 rows counts as hot
        spark.conf.set("curvekit.probeBytes", "0")
        spark.conf.set("curvekit.slabRows", "40")
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            note, took, ok = check(spark, con, name, q[name], o.get(name), sf)
        except Exception as ex:  # report and go on with the next query
            note, took, ok = f"{type(ex).__name__}: {str(ex)[:900]}", 0.0, False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {took:.2f}s {note[:1500]}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
