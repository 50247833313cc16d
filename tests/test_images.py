import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerist.functions import images as I


def test_measures(spark):
    rng = np.random.default_rng(0)
    g = rng.integers(0, 256, (40, 30), dtype=np.uint8)
    flat = np.full((20, 20), 90, np.uint8)
    rows = [(40, 30, bytearray(g.tobytes())), (20, 20, bytearray(flat.tobytes())), (5, 5, bytearray(b"12")), (None, 3, None)]
    df = spark.createDataFrame(rows, "h int, w int, p binary").select(I.measures(F.col("h"), F.col("w"), F.col("p")).alias("m")).select("m.*")
    a, b, c, d = df.collect()
    assert a["brightness"] == pytest.approx(g.mean()) and a["contrast"] == pytest.approx(g.std()) and a["sharpness"] > 1000
    assert b["sharpness"] == 0 and b["focus"] == 0 and b["dhash64"] == 0
    assert c["brightness"] is None and d["dhash64"] is None
    brighter = np.clip(g.astype(int) // 2 + 20, 0, 255).astype(float)
    assert bin((I.difference_hash(g.astype(float)) ^ I.difference_hash(brighter)) & (2**64 - 1)).count("1") <= 4


def test_patterns_and_transform():
    assert sorted(np.bincount(I.uniform_patterns())[:58]) == [1] * 58 and len(np.bincount(I.uniform_patterns())) == 59
    h = I.pattern_histograms(np.random.default_rng(1).random((64, 64)))
    assert h.shape == (64 * 59,) and h.reshape(64, 59).sum(1) == pytest.approx(1)
    src = np.array([[0, 0], [2, 0], [0, 2], [1, 5.0]])
    m = np.array([[0.6, -0.8, 3], [0.8, 0.6, -1]]) * np.array([[1, 1, 1]])
    assert I.similarity_transform(src, src @ m[:, :2].T + m[:, 2]) == pytest.approx(m)
    with pytest.raises(ValueError):
        I.similarity_transform(np.zeros((3, 2)), np.ones((3, 2)))


def test_embedder(spark):
    class Mean:
        signature, dimension = "mean", 1

        def extract(self, picture):
            return np.array([picture.mean()])

    df = spark.createDataFrame([(3, 3, bytearray(range(9))), (2, 2, bytearray(b"1234"))], "h int, w int, p binary")
    got = [r["v"] for r in df.select(I.embedding_udf(Mean())("h", "w", "p").alias("v")).collect()]
    assert got == [[4.0], None]
