"""Face predicates and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsift import constants as K


def _open(score: Column) -> Column:
    # No iris data counts as open.
    return F.coalesce(score, F.lit(1.0))


def eyes_open(left: Column, right: Column) -> Column:
    return (_open(left) > K.BLINK_THRESHOLD) & (_open(right) > K.BLINK_THRESHOLD)


def blinks(left: Column, right: Column) -> Column:
    return (_open(left) <= K.BLINK_THRESHOLD) | (_open(right) <= K.BLINK_THRESHOLD)


def is_neutral(emotion: Column) -> Column:
    return F.coalesce(emotion == "neutral", F.lit(True))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalise_box(box: Column, width: Column, height: Column) -> Column:
    """Pixel box as fractions of the image; a missing box is the full frame, a missing side the whole side."""
    w = F.when(width > 0, width.cast("double")).otherwise(F.lit(1.0))
    h = F.when(height > 0, height.cast("double")).otherwise(F.lit(1.0))

    def side(name, scale, default):
        return F.when(box.isNull(), F.lit(default)).otherwise(
            _unit(F.coalesce(box[name] / scale, F.lit(default)))
        )

    return F.struct(
        side("x", w, 0.0).alias("x"),
        side("y", h, 0.0).alias("y"),
        side("width", w, 1.0).alias("width"),
        side("height", h, 1.0).alias("height"),
    )
