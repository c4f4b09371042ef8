"""Small numeric expressions: ratios, bins, labels, text sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio_or_zero(a, b) -> Column:
    """``a / b``, 0 when ``b`` is not positive."""
    return F.when(_col(b) > 0, _col(a).cast("double") / _col(b)).otherwise(F.lit(0.0))


def ratio_or_null(a, b) -> Column:
    """``a / b``, null when ``b`` is not positive."""
    return F.when(_col(b) > 0, _col(a).cast("double") / _col(b))


def equal_width_bin(x, low, high, bins: int = 10) -> Column:
    """0-based bin of equal width, closed on the right; the minimum is in bin 0.

    ``low`` and ``high`` are numbers, columns or null. A constant column falls
    into the middle bin (of an even number the lower one), an all-null one
    gives nulls.
    """
    low, high = (F.lit(v) if v is None or isinstance(v, (int, float)) else _col(v) for v in (low, high))
    x = _col(x)
    steps = F.ceil(F.try_divide((x - low) * bins, high - low)).cast("int") - 1
    inside = F.least(F.lit(bins - 1), F.greatest(F.lit(0), steps))
    return F.when(x.isNotNull(), F.when(high == low, F.lit((bins - 1) // 2)).when(steps.isNotNull(), inside))


def stage_one_label(label) -> Column:
    """Classes 0 and 1 become 0; 2 becomes 1; 3 becomes 2."""
    return F.when(_col(label) <= 1, F.lit(0)).otherwise(_col(label) - 1)


def argmax(values) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(_col(values), F.array_max(_col(values))) - 1).cast("int")


def two_stage_label(first, second) -> Column:
    """Stage-one argmax 0 defers to stage two; otherwise it is the label less one."""
    return F.when(argmax(first) == 0, argmax(second)).otherwise(argmax(first) + 1)


def rounded(value, digits: int) -> Column:
    """``F.round``, which goes through decimal numbers, with those only next to ties and for large values."""
    value = _col(value)
    scaled = value * 10.0 ** digits
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(10.0 ** digits)).otherwise(F.round(value, digits))
