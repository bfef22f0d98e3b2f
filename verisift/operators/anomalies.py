"""Anomalies in the history of a metric.

A history holds one row per run and metric (``db_name, table_name, column_name, metric, value,
audit_create_date``), as ``metric_rows`` writes it.  A detector gives every point of a series
the interval its value should lie in, from earlier points only; windows are bounded by a number
of days or of runs, so a series of any length is one sorted pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.functions.constraints import ConstraintProblem, Named
from verisift.functions.expressions import flag, stamp

SERIES = ("db_name", "table_name", "column_name", "metric")
DAY = 86_400


@dataclass(frozen=True)
class Detector:
    """``bounds()`` gives the lowest and the highest expected value of a point."""

    bounds: Callable[[], tuple[Column, Column]]


def _instant() -> Column:
    return F.unix_seconds(F.col("audit_create_date").cast("timestamp"))


def _series() -> W:
    return W.partitionBy(*SERIES).orderBy(_instant())


def _days(days: float):
    """The points of the last so many days before a point."""
    return _series().rangeBetween(-int(days * DAY), -1)


def _middle(values: Column) -> Column:
    """The median of an array of numbers; null for an empty one."""
    ordered, n = F.array_sort(values), F.size(values)
    half = F.floor((n + 1) / 2).cast("int")
    other = F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(ordered, half) + F.try_element_at(ordered, other)) / 2)


def _limits(base: Column, lower: float | None, upper: float | None, of: Callable[[Column, float], Column]) -> tuple[Column, Column]:
    none = F.lit(None).cast("double")
    return (none if lower is None else of(base, lower)), (none if upper is None else of(base, upper))


def relative_change(max_increase: float | None = None, max_decrease: float | None = None, lag: int = 1) -> Detector:
    """The value ``lag`` runs before times ``max_decrease`` and ``max_increase``.  With a lag of
    a season (7 for daily runs) a point is compared with the same day of the week before."""
    if max_increase is None and max_decrease is None:
        raise ConstraintProblem("a change needs a bound")
    if lag < 1:
        raise ConstraintProblem("a lag is a number of runs")

    def bounds() -> tuple[Column, Column]:
        earlier = F.lag("value", lag).over(_series())
        low, high = _limits(earlier, max_decrease, max_increase, lambda v, f: v * float(f))
        turned = earlier < 0  # the larger factor gives the lower bound
        return F.when(turned, high).otherwise(low), F.when(turned, low).otherwise(high)
    return Detector(bounds)


def absolute_change(max_increase: float | None = None, max_decrease: float | None = None, lag: int = 1) -> Detector:
    """The value ``lag`` runs before, less ``max_decrease`` and plus ``max_increase``."""
    if max_increase is None and max_decrease is None:
        raise ConstraintProblem("a change needs a bound")
    down = None if max_decrease is None else -abs(max_decrease)
    return Detector(lambda: _limits(F.lag("value", lag).over(_series()), down, max_increase, lambda v, f: v + float(f)))


def median_deviation(days: float = 30, factor: float = 3.0, least: int = 3, floor: float = 0.0) -> Detector:
    """The median of the last ``days`` plus and minus ``factor`` times the median absolute
    deviation (at least ``floor``); needs ``least`` points."""
    def bounds() -> tuple[Column, Column]:
        values = F.collect_list("value").over(_days(days))
        centre = _middle(values)
        spread = F.greatest(_middle(F.transform(values, lambda v: F.abs(v - centre))), F.lit(float(floor))) * float(factor)
        enough = F.size(values) >= least
        return F.when(enough, centre - spread), F.when(enough, centre + spread)
    return Detector(bounds)


def normal_deviation(days: float = 30, factor: float = 3.0, least: int = 3) -> Detector:
    """The mean of the last ``days`` plus and minus ``factor`` standard deviations."""
    def bounds() -> tuple[Column, Column]:
        centre, spread = (f("value").over(_days(days)) for f in (F.avg, F.stddev_pop))
        enough = F.count("value").over(_days(days)) >= least
        return F.when(enough, centre - spread * float(factor)), F.when(enough, centre + spread * float(factor))
    return Detector(bounds)


def threshold(lower: float | None = None, upper: float | None = None) -> Detector:
    """Fixed bounds."""
    return Detector(lambda: _limits(F.lit(0.0), lower, upper, lambda v, f: v + float(f)))


# Names by which constraint strings call the detectors
DETECTORS: dict[str, Callable[..., Detector]] = {
    "RelativeRateOfChange": relative_change, "AbsoluteChange": absolute_change, "MedianDeviation": median_deviation,
    "NormalDeviation": normal_deviation, "SimpleThreshold": threshold,
}


def read_detector(named: Any) -> Detector:
    """The detector a constraint string names, such as ``MedianDeviation(days=7, factor=3)``."""
    if not isinstance(named, Named) or named.name not in DETECTORS:
        raise ConstraintProblem(f"a detector is one of {sorted(DETECTORS)}")
    try:
        return DETECTORS[named.name](*named.args, **dict(named.kwargs))
    except TypeError as problem:
        raise ConstraintProblem(f"{named.name}: {problem}") from problem


def with_bounds(history: DataFrame, detector: Detector) -> DataFrame:
    """The points with ``lower`` and ``upper``; null where there is no bound."""
    lower, upper = detector.bounds()
    return history.withColumn("lower", lower).withColumn("upper", upper)


def metric_anomalies(history: DataFrame, detector: Detector) -> DataFrame:
    """Every point of a history with its bounds and whether its value lies outside them.  A
    point without earlier points to compare with isn't an anomaly, nor is a missing value."""
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return with_bounds(history, detector).withColumn("is_anomaly", flag(outside))


@dataclass(frozen=True)
class History:
    """Stored metric values that a run's own values are compared with."""

    metrics: DataFrame
    db_name: str
    table_name: str
    as_of: datetime | str | None = None

    def next_bounds(self, metric: str, columns: tuple[str, ...], detector: Detector) -> Column:
        """The bounds of a value measured now, as a struct of ``lower`` and ``upper``."""
        names = {"db_name": self.db_name, "table_name": self.table_name, "column_name": ",".join(columns) or "*", "metric": metric}
        mine = self.metrics
        for name, value in names.items():
            folded = name in ("db_name", "table_name")
            mine = mine.filter((F.lower(name) if folded else F.col(name)) == (value.lower() if folded else value))
        point = [F.lit(v).alias(k) for k, v in names.items()]
        now = stamp(self.as_of)
        past = mine.filter(F.col("audit_create_date").cast("timestamp") < now).select(
            *point, F.col("value").cast("double").alias("value"), F.col("audit_create_date").cast("timestamp").alias("audit_create_date"),
            F.lit(False).alias("now"))
        own = mine.sparkSession.range(1).select(
            *point, F.lit(None).cast("double").alias("value"), now.alias("audit_create_date"), F.lit(True).alias("now"))
        found = with_bounds(past.unionByName(own), detector).filter("now")
        return found.agg(F.first(F.struct("lower", "upper"))).scalar()


@dataclass(frozen=True)
class WithinBounds:
    """Holds for values inside the bounds that the history gives; a missing bound is none."""

    history: History
    metric: str
    columns: tuple[str, ...]
    detector: Detector

    def __call__(self, value: Column) -> Column:
        bounds = self.history.next_bounds(self.metric, self.columns, self.detector)
        lower, upper = bounds["lower"], bounds["upper"]
        return value.isNotNull() & F.coalesce(value >= lower, F.lit(True)) & F.coalesce(value <= upper, F.lit(True))
