"""Property: the ordered scan equals the naive window for random data."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators.sequencing import ordered_scan

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "hot", None]), st.integers(0, 50), st.integers(-9, 9)),
                min_size=1, max_size=120)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_ordered_scan_property(spark, data):
    df = spark.createDataFrame([(k, e, i, v) for i, (k, e, v) in enumerate(data)],
                               "k string, epoch long, tb long, v long")
    got = ordered_scan(df, ["k"], ["epoch", "tb"], sums=["v"], index="i")
    w = Window.partitionBy("k").orderBy("epoch", "tb")
    exp = df.withColumn("i", F.row_number().over(w) - 1).withColumn(
        "_run_v", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["k", "tb", "i", "_run_v"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, exp.select(cols).collect()))
