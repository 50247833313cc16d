import math

import pytest
from pyspark.sql import functions as F

from gallerist.functions import boxes as B
from gallerist.functions import stats as S
from gallerist.functions import vectors as V
from gallerist.functions.names import normalized_name, valid_name
from gallerist.functions.text import folded, key_or_null


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("k, n, low, high", [(19, 24, 0.595, 0.908), (14, 24, 0.388, 0.755), (0, 16, 0.0, 0.194), (0, 13, 0.0, 0.228)])
def test_wilson_published(spark, k, n, low, high):
    assert one(spark, S.wilson_low(F.lit(k), F.lit(n))) == pytest.approx(low, abs=6e-4)
    assert one(spark, S.wilson_high(F.lit(k), F.lit(n))) == pytest.approx(high, abs=6e-4)


def test_wilson_empty(spark):
    assert one(spark, S.wilson_low(F.lit(0), F.lit(0))) is None


def test_support():
    assert S.support_needed(0.01) == 381 and S.support_needed(0.001) == 3838


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(-4.0), F.lit(3.0))
    assert one(spark, V.norm(a)) == 5.0
    assert one(spark, V.half_cosine(a, b)) == 0.5
    assert one(spark, V.half_cosine(a, a)) == 0.0
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, V.valid_vector(a, 2)) and not one(spark, V.valid_vector(a, 3))
    assert not one(spark, V.valid_vector(F.array(F.lit(1.0), F.lit(math.nan)), 2))
    assert not one(spark, V.valid_vector(F.array(F.lit(1.0), F.lit(None).cast("double")), 2))
    assert not one(spark, V.valid_vector(F.lit(None).cast("array<double>"), 2))
    assert one(spark, V.chi_square(a, a, 1)) == 0.0


def test_boxes(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, B.iou(box(0, 0, 2, 2), box(1, 0, 2, 2))) == pytest.approx(1 / 3)
    assert one(spark, B.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert one(spark, B.association_cost(box(0, 0, 2, 2), box(0, 0, 2, 2), F.lit(None).cast("double"))) == 0.0
    assert one(spark, B.association_cost(box(0, 0, 2, 2), box(90, 0, 2, 2), F.lit(0.1))) is None
    assert one(spark, B.association_cost(box(0, 0, 2, 2), box(0, 0, 2, 2), F.lit(0.3))) is None


def test_names(spark):
    rows = [("  Ana \t Bo ",), ("x" * 65,), ("",), (None,), ("A​B",)]
    got = spark.createDataFrame(rows, "n string").select(normalized_name(F.col("n")).alias("n"), valid_name(F.col("n")).alias("v")).collect()
    assert got[0]["n"] == "Ana Bo" and [r["v"] for r in got] == [True, False, False, None, False]


def test_folded(spark):
    rows = [("Ａｂ​ C ",), ("Straße",), ("STRASSE",), (" N/A",), (None,), ("",)]
    got = [r["k"] for r in spark.createDataFrame(rows, "n string").select(key_or_null("n").alias("k")).collect()]
    assert got == ["abc", "strasse", "strasse", None, None, None]
    assert one(spark, folded(F.lit("-"))) == "-"


def test_folding_with_and_without_python(spark):
    from gallerist.functions.text import _fold, folded

    texts = [None, "", " ", "A b-C", "Ünï \u200bCode", "ＡＮＮ", "straße", "tab\there", "x\ny", "~!@", "\x00a", "İ", "K"]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(folded("t").alias("f")).collect()]
    assert got == [None if t is None else _fold(t) for t in texts]
