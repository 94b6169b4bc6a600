import random

from pyspark.sql import functions as F

from factorlab.operators.ranking import rank_within
from factorlab.staging import stage, staging_root


def test_sliced_ranking_equals_plain_window(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        vol = 0.0 if i % 2 == 0 else round(rng.random(), 2)  # heavy ties
        rows.append((group, vol, f"t{i}"))
    df = stage(spark.createDataFrame(rows, "g string, vol double, ticker string"), "rank-test")
    plain = rank_within(df, ["g"], ["vol", "ticker"])
    sliced = rank_within(df, ["g"], ["vol", "ticker"], single_task_rows=100)
    assert sliced.columns == plain.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.collect()))
    largest = sliced.groupBy("g").agg(F.max("rn").alias("m")).orderBy(F.desc("m")).first()
    assert largest["g"] == "hot" and largest["m"] == 1000


def test_ranking_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, vol double, ticker string")
    assert rank_within(empty, ["g"], ["vol"]).count() == 0


def test_staging_uses_the_folder_the_session_names(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/") in staging_root(spark)
    assert staging_root(spark) == staging_root(spark)
