"""Work that follows an order: rows in ranges, and states carried over the blocks of a group of any length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import written

FAN = 1024  # blocks that one step of a scan folds


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in ascending order (nulls first) through all partitions; partition numbers follow the order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def exclusive_scan(blocks: DataFrame, compose: Callable[[np.ndarray, np.ndarray], np.ndarray],
                   act: Callable[[np.ndarray, np.ndarray], np.ndarray], start: Sequence[int], reverse: bool = False,
                   fan: int = FAN) -> DataFrame:
    """(group, idx, state): ``start`` after all earlier blocks of the group (later ones with ``reverse``) acted on it.

    ``blocks``: group long, idx long (0, 1, ... in each group), value array<long>. ``compose(done, value)`` is the
    value that acts like ``done`` and then ``value``; ``act(state, value)`` is the next state. ``fan`` blocks at a time
    become one block of the next level until a group has one; then the states go down again. So no task takes more
    than ``fan`` blocks of a group at once, however long it is. Only the largest idx reaches the driver.
    """
    part = F.floor(F.col("idx") / fan).cast("long").alias("part")
    columns = [F.col(c) for c in ("group", "idx", "value")]

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", ascending=not reverse)
        values = [np.asarray(v, np.int64) for v in rows["value"]]
        done = values[0]
        for v in values[1:]:
            done = compose(done, v)
        return pd.DataFrame({"group": rows["group"].iloc[:1], "idx": rows["part"].iloc[:1], "value": [done]})

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", ascending=not reverse)
        state, states = np.asarray(rows["state"].iloc[0], np.int64), []
        for v in rows["value"]:
            states.append(state)
            state = act(state, np.asarray(v, np.int64))
        return pd.DataFrame({"group": rows["group"], "idx": rows["idx"], "state": states})

    levels = [blocks.select(*columns)]
    while levels[-1].agg(F.max("idx")).first()[0]:
        level = levels[-1].select(*columns, part).groupBy("group", "part")
        levels.append(written(level.applyInPandas(up, "group long, idx long, value array<long>")))
    states = levels.pop().select("group", "idx", F.array(*[F.lit(x).cast("long") for x in start]).alias("state"))
    while levels:
        above = states.withColumnRenamed("idx", "part")
        rows = levels.pop().select(*columns, part).join(above, ["group", "part"])
        states = written(rows.groupBy("group", "part").applyInPandas(down, "group long, idx long, state array<long>"))
    return states
