"""The one ordered fold: rows whose treatment depends on the decision made at earlier rows of the same key.

Rows are hash-partitioned by key, sorted inside the partitions and streamed through a small step function in
Arrow batches, so a task holds one batch and one state, never a whole key. Hot keys (see `ordered`) are cut into
slabs that run in parallel from guessed states; a slab whose incoming state turns out different from the guess is
run again until all states agree. That is exact for any step, and most steps forget their start after a few rows.
"""
from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import _slab_of, hot_slabs
from .runtime import as_list, attach, cut_lineage


def _runner(key_idx, slab_idx, names, step, finish, start, carries, last, to_arrow, summary):
    """Arrow-batch mapper that folds each (key, slab) group of a sorted partition."""
    nkey = len(key_idx)

    def group_end(group, state, out):
        if summary:
            out.append(group[0] + (group[1], pickle.dumps(state)))
        elif finish is not None and (last is None or group in last):
            out.extend(group[0] + r for r in finish(state))

    def run(batches):
        group, state, out = None, start, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows = zip(*cols)
            for row in rows:
                g = (tuple(row[i] for i in key_idx), row[slab_idx] if slab_idx is not None else None)
                if g != group:
                    if group is not None:
                        group_end(group, state, out)
                    group, state = g, carries.get(g, start)
                state, made = step(state, dict(zip(names, row[nkey:])))
                if made and not summary:
                    key = g[0]
                    out.extend(key + m for m in made)
                if len(out) >= 8192:
                    yield _batch(out, to_arrow)
                    out = []
        if group is not None:
            group_end(group, state, out)
        if out:
            yield _batch(out, to_arrow)

    return run


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fold(df: DataFrame, keys, order, step, start, out: str, finish=None) -> DataFrame:
    """Fold `df` per key in `order`.

    step(state, row) -> (state, list of output tuples); finish(state) -> output tuples at the end of the key.
    `out` is the DDL of the output tuples; the key columns come first in the result. States are small tuples.
    """
    keys, order = as_list(keys), as_list(order)
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    df = df.select(*keys, *rest)
    out_schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(out).fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_out = to_arrow_schema(out_schema)
    n = len(keys)
    hot = hot_slabs(df, keys, order[0])
    if hot is None:
        run = _runner(range(n), None, rest, step, finish, start, {}, None, arrow_out, False)
        return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)

    slabbed = (attach(df, hot, keys, hint=True).withColumn("_slab", _slab_of(order[0])).drop("_outer", "_inner"))
    slabbed = cut_lineage(slabbed.select(*keys, *rest, "_slab"))
    names = rest + ["_slab"]

    def prepared(part):
        return part.repartition(*keys, "_slab").sortWithinPartitions(*keys, "_slab", *order)

    hot_keys = F.broadcast(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys]))
    on = [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]
    hot_rows = slabbed.join(hot_keys, on, "left_semi")
    sum_schema = T.StructType([df.schema[k] for k in keys]
                              + [T.StructField("_slab", T.IntegerType()), T.StructField("_state", T.BinaryType())])
    sum_arrow = to_arrow_schema(sum_schema)
    present = hot_rows.select(*keys, "_slab").distinct().collect()
    groups: dict = {}
    for r in present:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r["_slab"])
    ranked = {k: sorted(v) for k, v in groups.items()}
    carries = {(k, s): start for k, v in ranked.items() for s in v}
    ends: dict = {}
    todo = set(carries)
    while todo:
        wanted = spark.createDataFrame(
            [k + (s,) for k, s in sorted(todo, key=repr)],
            T.StructType([df.schema[k] for k in keys] + [T.StructField("_slab", T.IntegerType())]))
        part = hot_rows.join(F.broadcast(wanted.select(*[F.col(c).alias(f"__w_{c}") for c in wanted.columns])),
                             [F.col(c).eqNullSafe(F.col(f"__w_{c}")) for c in keys + ["_slab"]], "left_semi")
        run = _runner(range(n), n + len(rest), names, step, finish, start, dict(carries), None, sum_arrow, True)
        for r in prepared(part).mapInArrow(run, sum_schema).collect():
            ends[(tuple(r[k] for k in keys), r["_slab"])] = pickle.loads(bytes(r["_state"]))
        todo = set()
        for k, slabs in ranked.items():
            for before, here in zip(slabs, slabs[1:]):
                if ends[(k, before)] != carries[(k, here)]:
                    carries[(k, here)] = ends[(k, before)]
                    todo.add((k, here))
    last = {(k, v[-1]) for k, v in ranked.items()}
    run_hot = _runner(range(n), n + len(rest), names, step, finish, start, carries, last, arrow_out, False)
    run_cold = _runner(range(n), None, rest, step, finish, start, {}, None, arrow_out, False)
    cold_rows = slabbed.join(hot_keys, on, "left_anti").drop("_slab")
    cold = cold_rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run_cold, out_schema)
    return prepared(hot_rows).mapInArrow(run_hot, out_schema).unionByName(cold)
