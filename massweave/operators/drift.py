"""Systematic drift of retention time between two tables, fitted on candidate pairs."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate pairs needed to try a correction, and anchors needed to fit one.
LEAST_PAIRS = 10
LEAST_ANCHORS = 20


@dataclass(frozen=True)
class Drift:
    """``rt_b - rt_a`` as a polynomial in ``rt_a``."""

    intercept: float
    slope: float
    curve: float = 0.0

    def corrected(self, rt: Column) -> Column:
        """A retention time of the first table on the scale of the second; NULL stays NULL."""
        return rt + (F.lit(self.intercept) + F.lit(self.slope) * rt + F.lit(self.curve) * rt * rt)


def fit_drift(pairs: DataFrame, model: str = "ridge2", least: int = LEAST_ANCHORS, penalty: float = 1.0) -> Drift | None:
    """Fit the drift on all candidate pairs, each as often as it occurs.

    ``ridge2``: a parabola whose two coefficients are shrunk by ``penalty``, its intercept
    free, from centred sums (two aggregates; five numbers come to the driver).  ``linear``: least
    squares.  Too few pairs give a warning and no fit.
    """
    x, y = F.col("rt_a"), F.col("rt_b") - F.col("rt_a")
    means = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(x * x).alias("xx"), F.avg(y).alias("y")).first()
    if means["n"] < least:
        warnings.warn(f"{means['n']} anchors are too few to correct the drift of RT ({least} are needed)", stacklevel=2)
        return None
    u, v, t = x - F.lit(means["x"]), x * x - F.lit(means["xx"]), y - F.lit(means["y"])
    if model == "linear":
        s = pairs.agg(F.sum(u * u).alias("uu"), F.sum(u * t).alias("ut")).first()
        slope = s["ut"] / s["uu"] if s["uu"] else 0.0
        return Drift(means["y"] - slope * means["x"], slope)
    if model != "ridge2":
        raise ValueError(f"unknown drift model {model!r}")
    s = pairs.agg(*[F.sum(e).alias(k) for k, e in (("uu", u * u), ("uv", u * v), ("vv", v * v), ("ut", u * t), ("vt", v * t))]).first()
    uu, vv = s["uu"] + penalty, s["vv"] + penalty
    det = uu * vv - s["uv"] ** 2
    slope = (s["ut"] * vv - s["vt"] * s["uv"]) / det
    curve = (s["vt"] * uu - s["ut"] * s["uv"]) / det
    return Drift(means["y"] - slope * means["x"] - curve * means["xx"], slope, curve)
