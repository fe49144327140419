"""Row-local operators on streaming tables.

Cleaning, scoring and coverage are column expressions without state, so the same
functions serve batch and stream. Fitted summaries (means, coefficients,
coverage) come from a batch fit and travel as constants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.functions import tokens
from plantscope.operators.cases import Coverage, with_coverage, with_extreme_variables
from plantscope.operators.linear import LinearModel
from plantscope.sources.tables import apply_null_tokens


def clean_numbers(stream: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Null words out of every text column, the named ones read as numbers."""
    clean = apply_null_tokens(stream)
    return clean.select(*[tokens.to_number(F.col(f"`{c}`")).alias(c) if c in numeric else F.col(f"`{c}`") for c in clean.columns])


def score_rows(stream: DataFrame, model: LinearModel, coverage: Coverage | None = None) -> DataFrame:
    """Adds ``predicted`` and, with a coverage fit, how familiar the inputs are."""
    out = stream.withColumn("predicted", model.predict())
    return with_extreme_variables(with_coverage(out, coverage), coverage) if coverage else out


def stream_consensus(predictions: DataFrame, weights_path: str, out_path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that adds every micro-batch's weighted predictions to ``out_path``: ``scenario_id, batch_id, part, rows``.

    ``predictions`` is a stream of ``scenario_id, model, predicted``. At every micro-batch the weights
    (``model, weight, mean_prediction``) are read again from the table at ``weights_path``, so a new fit takes effect at the
    next batch and rows keep the weights of the batch they came in. A prediction that is not a number counts as the model's mean
    prediction, as in batch; rows of a model without a weight are left out. The consensus of a scenario is the sum of its
    parts (``consensus_of``). The weights table holds one row a model: it is broadcast only below ``MOST_MODELS`` rows.
    Parts are written with the batch id, so a batch repeated after a failure can be told apart and is written as one.
    """
    from plantscope.functions.numeric import clean

    spark = predictions.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        weights = spark.read.parquet(weights_path).select("model", "weight", "mean_prediction")
        if weights.count() <= MOST_MODELS:
            weights = F.broadcast(weights)
        usable = F.coalesce(clean(F.col("predicted")), F.col("mean_prediction"))
        part = batch.join(weights, "model").groupBy("scenario_id").agg(
            F.sum(F.col("weight") * usable).alias("part"), F.count(F.lit(1)).alias("rows"))
        (part.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .parquet(f"{out_path}/batch_id={batch_id}"))

    writer = predictions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def consensus_of(spark, out_path: str) -> DataFrame:
    """``scenario_id, consensus``: the parts of all batches written so far, added up."""
    return spark.read.parquet(out_path).groupBy("scenario_id").agg(F.sum("part").alias("consensus"))


#: Models of a weights table that may be broadcast to every task.
MOST_MODELS = 100_000


def windowed_missing_rate(stream: DataFrame, time_col: str, cols: Sequence[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per event-time window of ``size``: ``start, end, rows`` and, per column c, ``c_missing`` (count) and ``c_rate`` (share).

    Works on a stream or a table alike. On a stream, rows may arrive up to ``late`` behind the latest event time seen; a window
    is written once (append mode) when the watermark passes its end, and rows later than that are left out, as Spark's
    watermark defines. Rows with a NULL time belong to no window; a time without zone is taken in the session's zone. A cell counts as missing when it is NULL or, for numbers, NaN.
    """
    missing = [F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("double").isNotNull() & F.isnan(F.col(f"`{c}`").cast("double")))
               if dict(stream.dtypes)[c] in ("double", "float") else F.col(f"`{c}`").isNull() for c in cols]
    # a time without zone is read in the session's zone: watermarks need one
    timed = stream.where(F.col(time_col).isNotNull()).withColumn("_time", F.col(time_col).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_time", late)
    counts = timed.groupBy(F.window("_time", size).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(m).alias(f"{c}_missing") for c, m in zip(cols, missing)])
    return counts.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows",
        *[c for name in cols for c in (F.col(f"{name}_missing"), (F.col(f"{name}_missing") / F.col("rows")).alias(f"{name}_rate"))])
