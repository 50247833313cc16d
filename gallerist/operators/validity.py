"""Checks of attempts and pairs before they are measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def attempt_faults(attempts: DataFrame) -> DataFrame:
    """``attempts`` with ``faults``, an array of the rules that a row breaks.

    A row has a ``status`` and ``candidates``, an ARRAY of (score, name) by
    rising score.  Only recognised attempts carry candidates ("unusable"), the
    scores are numbers from 0 to 1 ("score"), names are there and differ
    ("name"), and the order is that of the scores ("order").  A null array is
    an empty one.
    """
    scores = F.transform("candidates", lambda c: c["score"])
    names = F.transform("candidates", lambda c: c["name"].cast("string"))
    bad = F.exists(scores, lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s > 1))
    nameless = F.exists(names, lambda n: n.isNull() | (n == "")) | (F.size(F.array_distinct(names)) < F.size(names))
    falling = F.exists(F.sequence(F.lit(2), F.greatest(F.size(scores), F.lit(2))), lambda i: F.try_element_at(scores, i) < F.try_element_at(scores, i - 1))
    full = F.size("candidates") > 0
    checks = [("unusable", full & ~F.col("status").eqNullSafe("recognized")), ("score", full & bad), ("name", full & nameless), ("order", full & falling)]
    return attempts.withColumn("faults", F.filter(F.array(*[F.when(_any(c), F.lit(name)) for name, c in checks]), lambda x: x.isNotNull()))


def pair_faults(pairs: DataFrame) -> DataFrame:
    """``pairs(distance, genuine)`` with ``fault``: "truth" if it is not known
    whether they are genuine, "distance" if the distance is no number from 0
    to 1, else null.  Pairs with a fault can't be measured."""
    d = F.col("distance")
    fine = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d <= 1)
    return pairs.withColumn("fault", F.when(F.col("genuine").isNull(), "truth").when(~fine, "distance"))
