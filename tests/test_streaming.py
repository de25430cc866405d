import pytest
from pyspark.sql import functions as F

from attrispark.functions.spec import BANZHAF, SHAPLEY
from attrispark.operators import estimators as est
from attrispark.operators import exact
from attrispark.sources import games
from attrispark.streaming import accumulate

from .conftest import SMALL


def test_running_values_equal_the_batch_estimate(spark, tmp_path):
    game = games.region_revenue(spark, SMALL)
    drawn = est.worth(game, est.sample(spark, est.Law(coin=0.5), 5, 200, 3)).select("mask", "u")
    drawn.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(drawn.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = accumulate.running_values(stream, 5).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["player"]: r["value"] for r in spark.table("running").collect()}
    want = {r["player"]: r["value"] for r in est.estimate("msr", game, BANZHAF, 200, 3).collect()}
    assert got == pytest.approx(want)


def test_windowed_terms_are_attributed_and_stored(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("player", F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(5)).cast("int"))
    late = events.agg(F.max("ts")).first()[0]
    end = events.limit(1).withColumn("ts", F.lit(late) + F.expr("interval 10 days")).withColumn("value", F.lit(0.0))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    terms = accumulate.windowed_terms(stream, "ts", ["user_id"], "player", "value", "1 day", "1 day")
    values = accumulate.attribute_terms(terms, SHAPLEY, 5, [])
    accumulate.store_values(values, str(tmp_path / "out"), str(tmp_path / "c"), []).awaitTermination()
    got = {r["player"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("player").agg(F.sum("value").alias("v")).collect()}
    batch = games.TermsGame(5, games.from_facts(events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "player", "value"))
    want = {r["player"]: r["value"] for r in exact.closed_form(batch, SHAPLEY).collect() if r["value"]}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["kernel_shap", "leverage"])
def test_a_gram_matrix_kept_over_batches_and_a_restart(spark, tmp_path, name):
    from attrispark.operators import regression

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        game = games.region_revenue(spark, SMALL)
        fit = regression.FITS[name](game, SHAPLEY, False)
        drawn = est.worth(game, est.sample(spark, fit.law, 5, 240, 3)).select("k", "mask", "s", "u").cache()
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        for lo in (0, 80, 160):  # the query ends after what is there and is started again for the rest
            drawn.where(f"k >= {lo} and k < {lo + 80}").repartition(2).write.mode("append").parquet(source)
            stream = spark.readStream.schema(drawn.schema).option("maxFilesPerTrigger", 1).parquet(source)
            accumulate.fitted_values(stream, fit, out, str(tmp_path / "c")).awaitTermination()
            last = max(spark.read.parquet(out).select("batch").distinct().collect())[0]
            got = {r["player"]: r["value"] for r in spark.read.parquet(out).where(f"batch = {last}").collect()}
            want = getattr(regression, name)(game, SHAPLEY, lo + 80, 3).collect()
            assert got == pytest.approx({r["player"]: r["value"] for r in want}, rel=1e-6)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError):
        accumulate.fitted_values(drawn, regression.FITS["regression_msr_unbiased"](game, SHAPLEY, False), out, "x")
