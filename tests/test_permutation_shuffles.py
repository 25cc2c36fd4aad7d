"""Exchanging parts within dates moves its rows once."""

from pyspark.sql import functions as F

from corvane.operators import ml


def test_rows_of_groups_and_repeats_move_once(spark):
    rows = [(f"2020-01-{d:02d}", f"t{i}", float(i * d % 7), float(i * d % 5), float(i)) for d in range(1, 5) for i in range(9)]
    df = spark.createDataFrame(rows, "as_of string, ticker string, a double, b double, fwd_excess double").withColumns({"as_of": F.to_date("as_of"), "fwd_return": F.col("fwd_excess"), "outperform": F.lit(0)})
    folds = spark.sql("select 0 as fold, date'2020-01-01' as first, date'2020-02-01' as last, 0.5D as intercept, array(0.3D, 0.2D) as coef, array(0D, 0D) as mean, array(1D, 1D) as sd")
    out = ml.permutation_importance(df, folds, ["a", "b"], {"a": ["a"], "all": ["a", "b"]}, repeats=2)
    moves = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line and "as_of" in line and "feature_group" in line]
    assert len(moves) == 1
    assert {r.repeats for r in out.collect()} == {2}
