"""Answers are read once: neither per point nor again for a test of rows."""
import re

from curvekit.functions import text as x

ANSWERS = [(1, 1, "CURVE: a\nTIME: 0 | SURVIVAL: 100\nTIME: ? | SURVIVAL: 3\nTIME: 2, SURVIVAL: 90\nTIME: 4 | SURVIVAL: 0.7\nCONFIDENCE: 80/100"),
           (1, 2, "CURVE: b\nTIME: none\nCONFIDENCE: 10%"), (1, 3, "TIME: 1 | SURVIVAL: 95\nCONFIDENCE: 0.6"), (2, 1, "nothing")]


def test_points_of_answers(spark):
    df = spark.createDataFrame(ANSWERS, "image_id long, curve long, text string")
    got = sorted(map(tuple, x.parse_points_response(df.where("image_id = 1"), "curve").collect()))
    assert got == [(1, "a", 0, 0.0, 1.0, 0.8), (1, "a", 2, 2.0, 0.9, 0.8), (1, "a", 3, 4.0, 0.7, 0.8), (3, "", 0, 1.0, 0.95, 0.6)]
    curves = sorted(map(tuple, x.model_points_to_curves(df).collect()))
    # the curve without a readable point has no part in the mean
    assert curves == [(1, 1, 0.0, 1.0, 0.7), (1, 1, 2.0, 0.9, 0.7), (1, 1, 4.0, 0.7, 0.7), (1, 3, 0.0, 1.0, 0.7), (1, 3, 1.0, 0.95, 0.7)]


def test_no_reading_above_the_points(spark, capsys):
    df = spark.createDataFrame(ANSWERS, "image_id long, curve long, text string").repartition(2)
    x.model_points_to_curves(df).explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above = [a for a, b in zip(plan, plan[1:]) if re.search("Generate|Filter isnotnull", b) and depth(b) > depth(a)]
    assert above and not [a for a in above if "regexp_" in a or "RLIKE" in a]
