"""Sides of a join that grow with the tables are never broadcast, however small Spark thinks they are."""
import pytest

import __spark_entry__ as entry
from curvekit.operators import atrisk as r

SF = "/root/testdata/sf0.001"
NAMES = ["r01_classify_rows", "r02_parse_data_rows", "r04_time_points", "r05_assemble_cells", "r17_merge_token_passes", "r18_table_region", "w21_group_tokens_by_row"]


@pytest.mark.parametrize("name", NAMES)
def test_no_broadcast(spark, name, capsys):
    entry.queries()[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_table_region_by_rows_of_pixels(spark):
    """The box of a region is that of its dark cells below the plot's lower part, whichever row they are in."""
    pixels = spark.createDataFrame([(1, x, y, 0) for x, y in ((40, 60), (220, 90), (130, 160), (5, 10), (250, 44))] + [(1, 255, 150, 220), (2, 9, 100, 0)], "image_id long, x int, y int, gray int")
    tokens = spark.createDataFrame([(1, w, float(x), 62.0) for x, w in ((60, "Number"), (100, "at"), (130, "risk"))], "image_id long, text string, center_x double, center_y double")
    images = spark.createDataFrame([(1, 300, 200, 0, 60), (2, 300, 200, 0, 60)], "image_id long, width int, height int, py int, ph int")
    got = [tuple(q) for q in r.table_region(pixels, tokens, images, images).collect()]
    assert got == [(1, 16, 48, 229, 125, True, False)]
