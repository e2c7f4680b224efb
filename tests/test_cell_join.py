"""The join of units with few cells: same rows on every path, no exchange of the units, hot cells apart."""

import pytest
from pyspark.sql import functions as F

from halfseen.operators import cell_join as cj
from halfseen.operators import nuisance as nu
from halfseen.operators import ranking as rk
from halfseen.operators.joins import match


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def units(spark):
    """Half of the units share one score, some keys are null, some cells are missing."""
    score = F.when(F.col("id") % 2 == 0, 7.0).when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 40).cast("double"))
    return spark.range(4000).select("id", score.alias("s"), (F.col("id") % 3).cast("string").alias("g"))


def cells(units):
    return units.filter("s IS NULL OR s <> 5").groupBy("s", "g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))


def rows(df):
    return sorted(map(tuple, df.select("id", "s", "g", "n", "top").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most,block", [(None, None), ("0", None), ("0", "300")], ids=["broadcast", "shuffled", "hot-apart"])
def test_every_path_gives_the_same_rows(spark, units, how, most, block):
    want = rows(match(units, cells(units), ["s", "g"], how))
    for name, value in ((cj.BROADCAST_BYTES_CONF, most), ("spark.halfseen.blockRows", block)):
        if value is not None:
            spark.conf.set(name, value)
    try:
        got = rows(cj.match_cells(units, cells(units), ["s", "g"], how))
    finally:
        spark.conf.unset(cj.BROADCAST_BYTES_CONF)
        spark.conf.unset("spark.halfseen.blockRows")
    assert got == want and len(want) > (3900 if how == "inner" else 3999)


def test_units_of_few_cells_are_not_exchanged(spark, units):
    u = units.withColumns({"t": F.lit(1), "y": (F.col("id") % 5 == 0).cast("double"), "lo": F.lit(0.2), "hi": F.lit(0.6)}).filter("s IS NOT NULL")
    for df in (nu.with_nuisance(u, ["g"], "t", "y"), nu.with_nuisance(u, ["g"], "t", "y", fit=u.filter("id > 50")),
               rk.midrank(u, "s"), rk.least_favourable(u, "s")):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text, text


def test_hot_cell_leaves_the_shuffle(spark, units):
    """Beyond the bound the shuffled side holds no cell above the block, so no task gets more than that of one key."""
    spark.conf.set(cj.BROADCAST_BYTES_CONF, "0")
    spark.conf.set("spark.halfseen.blockRows", "300")
    try:
        df = cj.match_cells(units, cells(units), ["s", "g"], "left")
        text = plan(df)
        assert "LeftAnti" in text and "LeftSemi" in text and "Union" in text
        keys = units.groupBy("s", "g").count().filter("count > 300").count()
        assert keys == 3 and df.count() == 4000
    finally:
        spark.conf.unset(cj.BROADCAST_BYTES_CONF)
        spark.conf.unset("spark.halfseen.blockRows")


def test_measure_counts_contents(spark):
    few = spark.createDataFrame([("x" * 1000, 1), (None, 2)], "k string, v int")
    assert 1000 < cj.measured_bytes(few) < 1200
    assert cj.measured_bytes(few.limit(0)) == 0
    with pytest.raises(ValueError):
        cj.match_cells(few, few, ["k"], "full")
