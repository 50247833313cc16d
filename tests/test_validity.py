"""Validity of attempts and pairs, quality reasons, usability, focus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerist.functions import images as I
from gallerist.functions import quality as Q
from gallerist.operators import validity as V


def test_attempt_and_pair_faults(spark):
    rows = [
        ("recognized", [(0.1, "a"), (0.2, "b")]), ("no_face", []), ("no_face", None), ("no_face", [(0.1, "a")]), (None, [(0.1, "a")]), ("recognized", [(0.2, "a"), (0.1, "b")]),
        ("recognized", [(0.1, "a"), (0.1, "a")]), ("recognized", [(1.5, "a")]), ("recognized", [(None, "")]), ("recognized", [(float("nan"), "a")]),
    ]
    df = spark.createDataFrame(rows, "status string, candidates array<struct<score:double,name:string>>")
    got = [r["faults"] for r in V.attempt_faults(df).collect()]
    assert got == [[], [], [], ["unusable"], ["unusable"], ["order"], ["name"], ["score"], ["score", "name"], ["score"]]
    assert V.attempt_faults(df.limit(0)).count() == 0
    pairs = spark.createDataFrame([(0.0, True), (1.0, False), (0.5, None), (None, True), (float("nan"), True), (1.1, False), (-0.1, False)], "distance double, genuine boolean")
    assert [r["fault"] for r in V.pair_faults(pairs).collect()] == [None, None, "truth", "distance", "distance", "distance", "distance"]


def test_landmarks_blur_fallback_and_usability(spark):
    inside = [1.0, 1.0, 9.0, 1.0, 5.0, 5.0, 2.0, 9.0, 8.0, 9.0]
    rows = [(inside, 0.5, 1.0), (inside[:9], None, 99.0), (inside[:9] + [float("nan")], None, 1.0), (inside[:9] + [10.0], 0.1, 99.0), ([-1.0, *inside[1:]], None, None), (None, None, 54.0), ([], 0.4, 0.0)]
    df = spark.createDataFrame(rows, "l array<double>, f double, v double")
    why = Q.reasons(F.lit(100.0), F.lit(50.0), F.col("f"), F.lit(0.1), blur_variance=F.col("v"), landmarks=F.col("l"), width=F.lit(20), height=F.lit(10))
    assert [r["w"] for r in df.select(why.alias("w")).collect()] == [[], ["landmarks"], ["landmarks", "blur"], ["outside", "blur"], ["outside"], ["blur"], []]
    rows = [(0, True, True, True), (None, None, None, None), (2, True, True, True), (1, None, True, True), (1, True, False, True), (1, True, True, None), (1, True, True, True)]
    s = spark.createDataFrame(rows, "n int, a boolean, g boolean, e boolean").select(Q.usability(*map(F.col, "nage")).alias("s"))
    assert [r["s"] for r in s.collect()] == ["no_face", "no_face", "multiple_faces", "quality_rejected", "invalid_geometry", "extraction_failed", "recognized"]


@pytest.mark.parametrize("w", [0.3, 0.7, 1.2])
def test_focus_of_waves_is_known(w):
    """A wave's second derivative is 2 tan(w / 2) times its first, whatever the contrast."""
    x = np.arange(128)
    for gain in (40, 80):
        picture = 128 + gain / 2 * np.sin(w * x)[None, :] + gain / 2 * np.sin(w * x)[:, None]
        assert I.regional_focus(picture) == pytest.approx(4 * np.tan(w / 2) ** 2, rel=0.1)  # grey levels are rounded


def blurred(picture, steps):
    for _ in range(steps):
        p = np.pad(picture, 1, mode="edge")
        picture = (p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1] + 4 * picture) / 8
    return picture


def test_focus_rejects_blur_noise_and_flat_pictures():
    rng = np.random.default_rng(1)
    stripes = 30 * np.sign(np.sin(0.8 * np.arange(256)))
    sharp = 128 + stripes[None, :] + stripes[:, None]
    limit = Q.Gate().min_focus
    assert I.regional_focus(sharp) > limit > I.regional_focus(blurred(sharp, 120))
    ramp = np.tile(np.linspace(60, 190, 256), (256, 1))
    assert I.regional_focus(np.clip(ramp + rng.normal(0, 3, ramp.shape), 0, 255)) < limit  # noise is no detail
    assert I.regional_focus(np.full((128, 128), 128.0)) == 0 == I.regional_focus(np.full((9, 9), 7.0))
    one_band = blurred(sharp, 120)
    one_band[:100] = sharp[:100]
    assert I.regional_focus(one_band) < limit  # one sharp band is not enough
    along = np.apply_along_axis(lambda r: np.convolve(r, np.ones(31) / 31, mode="same"), 1, sharp)
    assert I.regional_focus(along) < limit  # motion blur in one direction
