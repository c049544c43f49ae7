"""Streams of diffs and of costs, with the same operators as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import authorship


def judged_diffs(diffs: DataFrame, message: str | None = None) -> DataFrame:
    """The verdict on each diff of a stream (file, diff): no state, so any output mode will do."""
    return authorship.analyze(diffs, "diff", message).drop("diff")


def spend_by_window(calls: DataFrame, at: str = "at", every: str = "1 hour", late: str = "10 minutes", by: list[str] = ("model",)) -> DataFrame:
    """Cost by window of time, final once so much later calls have come (watermark)."""
    return calls.withWatermark(at, late).groupBy(F.window(at, every), *by).agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls")).select(F.col("window.start").alias("start"), *by, "cost_usd", "calls")


def budget_gate(runs: DataFrame, by: str, cap: float, reserve: float = 0.30) -> DataFrame:
    """Runs of a stream (by, ord, estimate) with allowed: whether the budget of its key, less what its allowed runs took
    so far, leaves the reserve. The state of a key is one number."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        for b in batches:
            ok, b = [], b.sort_values("ord")
            for e in b.estimate:
                ok.append(cap - spent - e >= reserve)
                spent += e if ok[-1] else 0.0
            yield b[[by, "ord", "estimate"]].assign(allowed=ok)
        state.update((spent,))

    kind = runs.schema[by].dataType.simpleString()
    return runs.select(by, "ord", "estimate").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, ord long, estimate double, allowed boolean", "spent double", "append", GroupStateTimeout.NoTimeout)
