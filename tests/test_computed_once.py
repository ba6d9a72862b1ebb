"""Costly columns are computed once: in a fold, and for the rules of a quality score."""
from curvekit.operators import clean
from curvekit.plans import flows


def test_fold_and_score(spark, capsys):
    points = spark.createDataFrame([(1, float(i), 1 - i / 40) for i in range(30)], "curve_id long, t double, s double")
    clean.thin(points, tol_t=0.5, tol_s=0.0123).explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("> 0.0123)") == 1
    flows.scored_curves(points, dedup="min", trim=False).explain()
    assert "aggregate(" not in capsys.readouterr().out  # the curves are folded before
