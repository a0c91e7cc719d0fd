"""Small frames for the tests of column rules."""

from pyspark.sql import types as T


def one_col(spark, values, dtype="string", name="x"):
    t = {"string": T.StringType(), "double": T.DoubleType()}[dtype]
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, t)]))
