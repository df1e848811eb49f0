"""Area-code normaliser truth table, borough lookup and null/NaN rules."""
from pyspark.sql import functions as F

from haulcube.functions.codes import borough_of, normalise_code
from haulcube.functions.nullsafe import neq_keep_null, positive

TRUTH = [("QS011", "QE011"), ("QN05", "QE05"), ("M1012", "MN012"), ("M", "MN"), ("MN05", "MN05"),
         ("BXE012", "BX012"), ("BX1", "BXBX1"), ("BKW011", "BKS011"), ("BKW01", "BKSW01"),
         ("BKE161", "BKN161"), ("BKE091", "BKN091"), ("BKE011", "BKS011"), ("BKN05", "BKN05"),
         ("QW02", "QW02"), ("QE01", "QE01"), ("SI01", "SI01"), ("  QS011 ", "QE011"), ("", ""), ("nan", "nan")]


def test_normaliser_truth_table(spark):
    df = spark.createDataFrame(TRUTH, "raw string, want string")
    got = df.select("want", normalise_code(F.col("raw")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_borough(spark):
    df = spark.createDataFrame([("BKN01",), ("QE07",), ("MN12",), ("BX03",), ("SI01",), ("nan",), ("XX",)], "c string")
    got = [r[0] for r in df.select(borough_of(F.col("c"))).collect()]
    assert got == ["Brooklyn", "Queens", "Manhattan", "Bronx", "Staten Island", "Unknown", "Unknown"]


def test_placeholder_keeps_null(spark):
    df = spark.createDataFrame([("9999999",), (None,), ("T1",)], "t string")
    assert df.filter(neq_keep_null(F.col("t"), "9999999")).count() == 2


def test_nan_is_not_positive(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-1.0,), (2.0,)], "x double")
    assert df.filter(positive(F.col("x"))).count() == 1
