"""Variable review: collinearity, lasso and Shapley importance side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variable_review(vif: DataFrame, lasso: DataFrame, importance: DataFrame) -> DataFrame:
    """One row per variable with advice codes.

    ``vif`` has ``variable, vif, band``; ``lasso`` ``variable, coef, kept, important``;
    ``importance`` ``variable, importance``. ``common_core`` is set on the
    variables both lasso and importance hold, when there are at least two.
    """
    joined = (
        vif.select("variable", "vif", "band")
        .join(lasso.select("variable", "coef", "kept", "important"), "variable", "full")
        .join(importance.select("variable", "importance"), "variable", "full")
    )
    # One row per variable: the window sees as many rows as there are columns.
    every = Window.partitionBy(F.lit(0))
    both = F.coalesce(F.col("kept"), F.lit(False)) & F.col("importance").isNotNull()
    by_importance = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("importance"), "variable")
    table = joined.select(
        "*",
        (F.col("importance").isNotNull() & (F.row_number().over(by_importance) <= 3)).alias("top_three"),
        (both & (F.count_if(both).over(every) >= 2)).alias("common_core"),
    )
    codes = F.array(
        F.when(F.col("band") == "severe", "remove_collinear"),
        F.when(F.col("band") == "caution", "watch_collinear"),
        F.when(F.col("important"), "lasso_important"),
        F.when(F.col("top_three"), "top_contribution"),
        F.when(F.col("common_core"), "build_around"),
    )
    return table.withColumn("advice", F.array_compact(codes))
