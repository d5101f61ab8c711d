"""Streams with state: control charts of units, counts that only grow, clusters rebuilt as documents arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslens.functions.text import plain_tokens
from corpuslens.operators.adaptive import FRESH, step
from corpuslens.session import ship_package


def adaptive_alarms(events: DataFrame, **settings) -> DataFrame:
    """unit, at, fast, alarm of a stream of (unit long, at long, value double); a unit's state outlives batches and restarts.

    A micro-batch is sorted by ``at`` within each unit; bound it at the source (maxFilesPerTrigger).
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else FRESH
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        levels, flags = [], []
        for x in rows["value"]:
            now, flag = step(now, x, **settings)
            levels.append(now[0])
            flags.append(flag)
        state.update(now)
        yield pd.DataFrame({"unit": rows["unit"], "at": rows["at"], "fast": levels, "alarm": flags})

    ship_package(events.sparkSession)
    rows = events.select("unit", "at", "value").where("value is not null and unit is not null")
    return rows.groupBy("unit").applyInPandasWithState(run, "unit long, at long, fast double, alarm boolean", "fast double, mean double, var double, run int", "append", GroupStateTimeout.NoTimeout)


def growing_counts(documents: DataFrame) -> DataFrame:
    """token, n over all that has arrived: what is learned later never lowers an earlier count."""
    return documents.select(F.explode(plain_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def rebuild_every(documents: DataFrame, rebuild: Callable[[int], None], batches: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append ``documents`` to ``path`` and call ``rebuild(batch)`` after every ``batches`` micro-batches.

    A batch is written into a folder of its own number, so that one repeated after a failure replaces itself.
    """

    def take(part: DataFrame, n: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if (n + 1) % batches == 0:
            rebuild(n)

    return documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
