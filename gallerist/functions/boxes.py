"""Rectangle algebra on (x, y, width, height), right and bottom exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box_of(array: Column) -> Box:
    """Columns of an ARRAY of four numbers."""
    return tuple(F.element_at(array, i).cast("double") for i in (1, 2, 3, 4))


def area(b: Box) -> Column:
    return F.greatest(b[2], F.lit(0.0)) * F.greatest(b[3], F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; zero if the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre_offset(a: Box, b: Box) -> Column:
    """Distance of the centres relative to the longer diagonal (at least 1)."""
    dx = (a[0] + a[2] / 2) - (b[0] + b[2] / 2)
    dy = (a[1] + a[3] / 2) - (b[1] + b[3] / 2)
    longest = F.greatest(F.sqrt(a[2] * a[2] + a[3] * a[3]), F.sqrt(b[2] * b[2] + b[3] * b[3]), F.lit(1.0))
    return F.sqrt(dx * dx + dy * dy) / longest


#: Fixed values of association.
MAX_OFFSET, MAX_DISTANCE, MIN_IOU = 1.5, 0.25, 0.3


def association_cost(a: Box, b: Box, distance: Column) -> Column:
    """Cost of continuing a track with an observation; null if it can't be.

    With a feature distance: 3/4 of it plus 1/4 of half the missing overlap,
    up to ``MAX_DISTANCE``; without: half the missing overlap, from
    ``MIN_IOU``."""
    overlap = iou(a, b)
    missing = (1.0 - overlap) / 2.0
    by_feature = F.when(distance <= MAX_DISTANCE, 0.75 * distance + 0.25 * missing)
    cost = F.when(distance.isNotNull(), by_feature).when(overlap >= MIN_IOU, missing)
    return F.when(centre_offset(a, b) <= MAX_OFFSET, cost)
