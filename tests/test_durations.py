"""Readable spans against Python's own three significant digits."""

from pyspark.sql import functions as F

from strayline.functions.durations import to_text


def test_spans_are_rounded_as_the_number_is(spark):
    """1.295 is held as a little less, 1.285 as a little less, too, 1.125 exactly."""
    values = [1.295, 1.355, 1.045, 1.285, 1.125, 1.375, 9.995, 9.996, 12.25, 12.35, 59.95, 10.05, 1.0, 2.5, 31.0]
    values += [n / 1000 for n in range(1000, 60000, 5)]
    small = [v / 1000 for v in values] + [0.0995, 0.2505, 0.9995, 0.09995]
    df = spark.createDataFrame([(v,) for v in values + small], "v double")
    for v, text in df.select("v", to_text(F.col("v")).alias("t")).collect():
        if v >= 1:
            assert text == f"{v:.3g} s"
        else:
            assert text == f"{v * 1e3:.3g} ms"
