"""Tiled scans equal plain windows, also when one key holds most rows."""

from pyspark.sql import Window, functions as F

from quire.operators.scan import running, tile_of


def test_running_equals_window(spark):
    n = F.col("id")
    df = spark.range(3000).select(F.when(n % 3 == 0, n % 7).otherwise(99).alias("k"), n.cast("int").alias("i"), F.when(n % 5 == 0, n).alias("v"), (n % 4).alias("x"))
    for inclusive in (True, False):
        out = running(df, ["k"], ["i"], tile_of("i", 64), sums={"s": F.col("x")}, lasts={"l": F.col("v")}, inclusive=inclusive)
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.withColumns({"s": F.coalesce(F.sum("x").over(w), F.lit(0)), "l": F.last("v", ignorenulls=True).over(w)})
        cols = ["k", "i", "s", "l"]
        assert out.select(cols).exceptAll(want.select(cols)).count() == 0
        assert out.count() == want.count()
