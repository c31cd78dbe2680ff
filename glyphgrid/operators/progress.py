"""Progress of long runs: counts and means that come out of the job itself, by observation, without a second one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Progress:
    """What a run has seen, once an action over its DataFrame has ended. `observed` waits for that."""

    observation: Observation

    def observed(self) -> dict:
        """rows, groups seen (an estimate where asked for), and the mean of what was watched (None without values)."""
        found = dict(self.observation.get)
        n, total = found.pop("_n"), found.pop("_sum")
        found["mean"] = total / n if n else None
        return found


def watched(df: DataFrame, value: Column, name: str = "progress", **more: Column) -> tuple[DataFrame, Progress]:
    """`df`, whose next action also counts its rows and takes the mean of `value`. more: further aggregates by name."""
    seen = Observation(name)
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(value).alias("_n"), F.sum(value).alias("_sum"), *(c.alias(k) for k, c in more.items()))
    return out, Progress(seen)


def watched_inference(tiles: DataFrame, predicted: DataFrame, p: Column) -> tuple[DataFrame, Progress]:
    """An inference's result with the counters of a run: rows, the running mean of the prediction and how many are ink; `tiles`
    isn't run for it."""
    return watched(predicted, p, "inference", ink=F.count_if(p > 0.5), segments=F.approx_count_distinct("seg_id"))
