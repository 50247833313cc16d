"""Quality gates over scalar quality measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gallerist.functions.vectors import clip01


@dataclass(frozen=True)
class Gate:
    """Limits of an acceptable picture (fixed default values)."""

    min_brightness: float = 45.0
    max_brightness: float = 220.0
    min_contrast: float = 22.0
    min_focus: float = 0.35
    min_face_ratio: float = 0.035
    min_blur_variance: float = 55.0


def landmark_reason(landmarks: Column, width: Column, height: Column) -> Column:
    """"landmarks" if an ARRAY of five points (x, y, x, y, ...) is not ten finite
    numbers, "outside" if a point lies outside of the frame, else null; no
    array is no reason."""
    finite = (F.size(landmarks) == 10) & F.forall(landmarks, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    inside = F.forall(F.transform(landmarks, lambda x, i: (x >= 0) & (x < F.when(i % 2 == 0, width).otherwise(height))), lambda ok: ok)
    return F.when(landmarks.isNull() | (F.size(landmarks) == 0), None).when(~F.coalesce(finite, F.lit(False)), F.lit("landmarks")).when(~F.coalesce(inside, F.lit(False)), F.lit("outside"))


def reasons(brightness: Column, contrast: Column, focus: Column, ratio: Column, gate: Gate = Gate(), blur_variance: Column | None = None, landmarks: Column | None = None, width: Column | None = None, height: Column | None = None) -> Column:
    """Why a picture is refused, in a fixed order; empty if it is accepted.

    An unknown measure refuses nothing.  Where the focus is unknown the
    variance of the Laplacian, if there is one, tells blur; landmarks are
    looked at with the size of the frame.
    """
    blurred = focus < gate.min_focus
    if blur_variance is not None:
        blurred = F.coalesce(blurred, blur_variance < gate.min_blur_variance)
    checks = [landmark_reason(landmarks, width, height)] if landmarks is not None else []
    checks += [
        F.when(brightness < gate.min_brightness, F.lit("dark")),
        F.when(brightness > gate.max_brightness, F.lit("bright")),
        F.when(contrast < gate.min_contrast, F.lit("contrast")),
        F.when(blurred, F.lit("blur")),
        F.when(ratio < gate.min_face_ratio, F.lit("small")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def usability(found: Column, accepted: Column, geometry: Column, extracted: Column) -> Column:
    """Status of a picture from its number of faces, the gate, the geometry of
    the face and whether its vector was extracted; the first fault counts."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(F.coalesce(found, F.lit(0)) <= 0, "no_face").when(found > 1, "multiple_faces").when(no(accepted), "quality_rejected")
        .when(no(geometry), "invalid_geometry").when(no(extracted), "extraction_failed").otherwise("recognized")
    )


#: Reasons that each policy looks at.
POLICIES = {"none": (), "brightness_only": ("dark", "bright"), "sharpness_only": ("blur",), "full": ("dark", "bright", "contrast", "blur", "small")}


def proxy(brightness: Column, contrast: Column, focus: Column, ratio: Column, gate: Gate = Gate()) -> Column:
    """Quality in [0, 1] of an accepted picture: 0.35 focus + 0.25 contrast +
    0.20 face size + 0.20 exposure, each relative to twice its minimum."""
    half = (gate.max_brightness - gate.min_brightness) / 2.0
    middle = (gate.max_brightness + gate.min_brightness) / 2.0
    exposure = 1.0 - 0.5 * F.least(F.lit(1.0), F.abs(brightness - middle) / half)
    up = lambda x, least: clip01(x / (2.0 * least))
    return 0.35 * up(focus, gate.min_focus) + 0.25 * up(contrast, gate.min_contrast) + 0.20 * up(ratio, gate.min_face_ratio) + 0.20 * exposure
