"""Statistics as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import ratio


def z_score(control_hits: Column, control: Column, hits: Column, total: Column) -> Column:
    """Two-proportion pooled z; 0 on empty totals or no spread."""
    p1, p2 = control_hits / control, hits / total
    pooled = (control_hits + hits) / (control + total)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / control + 1 / total))
    return F.when((control == 0) | (total == 0) | (spread == 0), 0.0).otherwise((p2 - p1) / spread)


#: Coefficients of the polynomial for the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_tailed_p(z: Column) -> Column:
    """Two-tailed p of a normal z by the polynomial of Abramowitz and Stegun."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + F.lit(0.3275911) * x)
    total = F.lit(0.0)
    for c in reversed(ERF):
        total = (total + F.lit(c)) * t
    return total * F.exp(-x * x)


def wilson(hits: Column, total: Column, z: float = 1.96) -> Column:
    """struct<low, high>: Wilson interval; 0 and 0 on an empty total."""
    n, p, zz = total.cast("double"), ratio(hits, total), z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    margin = z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)
    return F.struct(
        F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin)).alias("low"),
        F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + margin)).alias("high"),
    )


def bucket(user: Column, experiment: str) -> Column:
    """A user's fixed place in [0, 1) for an experiment: the first 32 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", user.cast("string"), F.lit(experiment)).cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def trend(early: Column, late: Column, band: float = 0.02) -> Column:
    return F.when(late - early > band, "improving").when(late - early < -band, "declining").otherwise("stable")
