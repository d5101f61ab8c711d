"""Two-timescale control chart: a fast mean against a slow baseline that learns from normal values only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpuslens.session import ship_package

#: State of a unit: fast mean, baseline mean (NaN before the first value), baseline variance, alarms in a row.
FRESH = (math.nan, math.nan, 0.05, 0)


def step(state: tuple, x: float, k: float = 3.0, fast: float = 0.10, slow: float = 0.01, patience: int = 300) -> tuple[tuple, bool]:
    """The state after ``x`` and whether ``x`` raises an alarm; an alarm that lasts ``patience`` values is a new baseline."""
    f, mean, var, run = state
    f = x if math.isnan(f) else f + fast * (x - f)
    if math.isnan(mean):
        return (f, f, 0.05, 0), False
    if f > mean + k * math.sqrt(var):
        return ((f, f, 0.05, 0), False) if run + 1 >= patience else ((f, mean, var, run + 1), True)
    d = f - mean
    return (f, mean + slow * d, (1 - slow) * (var + slow * d * d), 0), False


def alarms(events: DataFrame, **settings) -> DataFrame:
    """unit, at, fast, alarm of every value of ``events`` (unit, at, value), in the order of ``at`` within a unit.

    Units are dealt to tasks and sorted there; a task reads its rows batch by batch and holds one unit's state, so
    that a unit of any length needs no more memory than a batch. Null values take no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, state = None, FRESH
        for b in batches:
            levels, flags = [], []
            for u, x in zip(b["unit"], b["value"]):
                if u != unit:
                    unit, state = u, FRESH
                state, flag = step(state, x, **settings)
                levels.append(state[0])
                flags.append(flag)
            yield pd.DataFrame({"unit": b["unit"], "at": b["at"], "fast": levels, "alarm": flags})

    ship_package(events.sparkSession)
    rows = events.select("unit", "at", "value").where("value is not null and unit is not null")
    kinds = dict(rows.dtypes)
    return rows.repartition("unit").sortWithinPartitions("unit", "at").mapInPandas(run, f"unit {kinds['unit']}, at {kinds['at']}, fast double, alarm boolean")
