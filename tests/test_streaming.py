from pyspark.sql import functions as F

from plantscope.operators import cases, linear
from plantscope.plans import views
from plantscope.session import scratch_path
from plantscope.streaming import rowwise


def drain(spark, stream):
    out = scratch_path(spark, "stream-out")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def test_cleaning_a_stream_equals_batch(spark, sf_dir):
    path = scratch_path(spark, "dirty")
    views.dirty(spark, sf_dir).write.parquet(path)
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    got = drain(spark, rowwise.clean_numbers(stream, views.DIRTY))
    want = rowwise.clean_numbers(batch, views.DIRTY)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_scoring_a_stream_equals_batch(spark, sf_dir):
    df = views.process(spark, sf_dir)
    parts = linear.split_grams(linear.with_holdout(df, "l_orderkey"), views.Y, views.X)
    model, coverage = linear.solve_least_squares(parts.train, views.Y), cases.coverage_fit(df, views.X)
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    cols = ["l_orderkey", "l_linenumber", F.round("predicted", 4).alias("p"), "coverage", F.array_join("extreme_variables", ",").alias("e")]
    got = drain(spark, rowwise.score_rows(stream, model, coverage).select(*cols))
    want = rowwise.score_rows(spark.read.parquet(path), model, coverage).select(*cols)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_consensus_on_a_stream_reads_new_weights_at_the_next_batch(spark):
    weights = scratch_path(spark, "weights")
    source = scratch_path(spark, "predictions")
    out, state = scratch_path(spark, "consensus"), scratch_path(spark, "consensus-state")
    schema = "scenario_id long, model string, predicted double"
    spark.createDataFrame([("a", 0.5, 10.0), ("b", 0.5, 20.0)], "model string, weight double, mean_prediction double").write.parquet(weights)
    spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", None)], schema).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    rowwise.stream_consensus(stream, weights, out, state).awaitTermination()
    first = {r.scenario_id: r.consensus for r in rowwise.consensus_of(spark, out).collect()}
    assert first == {1: 3.0, 2: 5.0}
    # a new fit: the next batch takes the new weights, the rows already counted keep theirs
    spark.createDataFrame([("a", 1.0, 10.0), ("b", 0.0, 20.0)], "model string, weight double, mean_prediction double") \
        .write.mode("overwrite").parquet(weights)
    spark.createDataFrame([(2, "b", 8.0), (3, "a", 7.0), (3, "c", 1.0)], schema).write.mode("append").parquet(source)
    rowwise.stream_consensus(spark.readStream.schema(schema).parquet(source), weights, out, state).awaitTermination()
    second = {r.scenario_id: r.consensus for r in rowwise.consensus_of(spark, out).collect()}
    assert second == {1: 3.0, 2: 5.0, 3: 7.0}
    # an empty batch adds nothing
    rowwise.stream_consensus(spark.readStream.schema(schema).parquet(source), weights, out, state).awaitTermination()
    assert {r.scenario_id: r.consensus for r in rowwise.consensus_of(spark, out).collect()} == second


def test_windowed_missing_rate_on_a_stream_equals_batch(spark, sf_dir):
    import datetime

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")
    events = events.withColumn("value", F.when(F.col("user_id") % 3 == 0, None).otherwise(F.col("value")))
    source = scratch_path(spark, "events")
    hours = sorted({r.h for r in events.select(F.date_trunc("hour", "ts").alias("h")).distinct().collect()})
    schema = events.schema
    out, state = scratch_path(spark, "rates"), scratch_path(spark, "rates-state")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        query = (rowwise.windowed_missing_rate(stream, "ts", ["value", "event_type"], "1 hour", "0 seconds").writeStream
                 .format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out))
        query.awaitTermination()

    # four files in order of time, each its own batch; then an empty batch and a late row that must be left out
    cuts = [hours[len(hours) * k // 4] for k in range(4)] + [hours[-1] + datetime.timedelta(hours=1)]
    for a, b in zip(cuts, cuts[1:]):
        events.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).write.mode("append").parquet(source)
        run()
    run()
    late = spark.createDataFrame([(hours[0], 1, None, None)], schema)
    late.write.mode("append").parquet(source)
    run()
    # a row far ahead closes the last real window
    ahead = hours[-1] + datetime.timedelta(days=30)
    spark.createDataFrame([(ahead, 1, "x", 1.0)], schema).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(ahead + datetime.timedelta(days=1), 1, "x", 1.0)], schema).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out).where(F.col("start") < F.lit(ahead))
    want = rowwise.windowed_missing_rate(events, "ts", ["value", "event_type"], "1 hour")
    assert got.count() == want.count() > 1
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and want.select(*got.columns).exceptAll(got).isEmpty()
