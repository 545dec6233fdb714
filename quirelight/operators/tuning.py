"""Parameter search over scored trials ``(trial_id, param, val, score, state, run_at)``.

A round is one aggregation over the trials; the loop on the driver holds a few numbers for each parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATIENCE, ACCURACY = 3, 0.01


def parameter_range(low: Column, high: Column, n: int = 3) -> Column:
    """n + 1 values from low to high in equal steps."""
    step = (high - low) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: low + k * step)


def fractal_range(value: Column, values: Column, n: int = 3, lense: float = 1.0) -> Column:
    """The values moved to ``value`` as their middle, narrower by ``2 lense / n``."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.transform(values, lambda s: value + lense * 2.0 / n * (s - mean))


def clean_trials(trials: DataFrame) -> DataFrame:
    """Trials that count: a value and a score that is a number; repeated rows once."""
    return trials.where("param is not null and val is not null and score is not null and not isnan(score)").dropDuplicates(["trial_id", "param", "val", "score"])


def empty_trials(trials: DataFrame) -> DataFrame:
    """No trial, with the same columns."""
    return trials.where(F.lit(False))


def best_trials(trials: DataFrame) -> DataFrame:
    """``(param, best_score, n_best, mean_val, std_val, first_val)``: of each parameter the best score, and the values that reached it.

    Trials are aggregated by parameter and score first, and of these few rows the best is taken: no join, and a frequent parameter is pre-aggregated.
    """
    tied = trials.groupBy("param", "score").agg(
        F.count("*").alias("n_best"), F.avg("val").alias("mean_val"), F.stddev_samp("val").alias("std_val"), F.min_by("val", "trial_id").alias("first_val"),
    )
    best = tied.groupBy("param").agg(F.max_by(F.struct(F.col("score").alias("best_score"), "n_best", "mean_val", "std_val", "first_val"), "score").alias("b"))
    return best.select("param", "b.*")


def scores_by_option(trials: DataFrame) -> DataFrame:
    """``(param, val, total)``: the scores of each option added up."""
    return trials.groupBy("param", "val").agg(F.sum("score").alias("total"))


def of_parameter(trials: DataFrame, param: str, part: bool = False) -> DataFrame:
    """The trials of a parameter; with ``part`` of all whose name has it as a part."""
    return trials.where(F.contains("param", F.lit(param)) if part else F.col("param") == param)


def options(ranges: DataFrame, settings: Column) -> DataFrame:
    """``(param, val, settings)``: for each value of each parameter the settings with that one changed. ``ranges``: ``(param, vals)``."""
    rows = ranges.select("param", F.explode("vals").alias("val"))
    return rows.select("param", "val", F.map_concat(F.map_filter(settings, lambda k, _: k != F.col("param")), F.create_map("param", "val")).alias("settings"))


@dataclass
class Search:
    """Coordinate search: the parameters' ranges, how often each was refined, and the best found."""

    ranges: dict[str, list[float]]
    n: int = 3
    patience: int = PATIENCE
    accuracy: float = ACCURACY
    sized: dict[str, int] = field(default_factory=dict)
    best: dict | None = None

    def __post_init__(self) -> None:
        self.ranges = {p: _range(v, self.n) for p, v in self.ranges.items()}

    def update(self, trials: DataFrame) -> dict | None:
        """One round over the scored trials: the parameter with the best score gets a new range around its best value.

        If its best score is tied and it was refined often enough or the tied values agree, the next best parameter has its turn;
        a tie otherwise gives a range twice as wide. Without trials nothing changes. Gives the best trial so far.
        """
        found = best_trials(clean_trials(trials).where(F.col("param").isin(*self.ranges))).orderBy(F.desc("best_score"), "param").collect()  # one row for each parameter
        for r in found:
            p, tied, sized = r["param"], r["n_best"] > 1, self.sized.get(r["param"], 0)
            if tied and (sized > self.patience or (r["std_val"] or 0.0) < self.accuracy):
                continue
            own = self.ranges[p]
            n = len(own) + 1 if tied else 3
            self.ranges[p] = _fractal(r["first_val"] if tied else r["mean_val"], _range(own, n), n, 2.0 if tied else 1.0)
            self.sized[p] = sized + (1 if tied else -1)
            if not tied:
                self.best = r.asDict()
            break
        return self.best


def _range(values: list[float], n: int) -> list[float]:
    low, high = values[0], values[-1]
    return [low + k * (high - low) / n for k in range(n + 1)]


def _fractal(value: float, values: list[float], n: int, lense: float) -> list[float]:
    mean = sum(values) / len(values)
    return [value + lense * 2 / n * (v - mean) for v in values]
