"""Components over tile borders against a flood fill."""
import random

import pytest

from curvekit.operators import runs


def flood(cells: set, conn: int) -> dict:
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (conn == 8 or not dx or not dy)]
    label = {}
    for y, x in sorted((y, x) for x, y in cells):
        todo = [(x, y)] if (x, y) not in label else []
        while todo:
            at = todo.pop()
            if at in cells and at not in label:
                label[at] = (y << 31) + x
                todo += [(at[0] + dx, at[1] + dy) for dx, dy in near]
    return label


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("tile", [1, 3, 512])
def test_against_flood_fill(spark, conn, tile):
    """Null keys, repeated cells, long runs, and runs that end on tile borders."""
    draw = random.Random(tile * 10 + conn)
    pictures = {None: {(x, 0) for x in range(20)} | {(19, y) for y in range(9)}, 1: {(x, y) for x in range(17) for y in range(13) if draw.random() < 0.45}, 2: {(5, 5)}}
    rows = [(k, x, y, "other") for k, cells in pictures.items() for x, y in cells] + [(1, *min(pictures[1]), "again")]
    found = runs.connected_components(spark.createDataFrame(rows, "image_id int, x int, y int, a string"), conn, tile=tile)
    got = {}
    for r in found.collect():
        assert (r["x"], r["y"]) not in got.setdefault(r["image_id"], {})
        got[r["image_id"]][r["x"], r["y"]] = r["comp_id"]
    assert got == {k: flood(cells, conn) for k, cells in pictures.items()}


def test_empty_mask(spark):
    assert runs.connected_components(spark.createDataFrame([], "image_id int, x int, y int")).count() == 0
