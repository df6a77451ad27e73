"""As-of joins and instant vectors: the latest sample at a moment, unless it is older than the lookback.

Neither joins by a range. An instant vector takes one ordered pass that finds until when each sample is the latest: until the next one, or until it is stale.
The steps that lie in that reign are its rows, so each series and step has one sample at most, and a series that falls silent has none
beyond the lookback. The as-of join orders both sides' rows together and carries the last right row along. Both scan in segments (see
scan.py), so a series may be larger than a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import neighbour, running

LOOKBACK_S = 300
#: A segment's length, milliseconds.
SEGMENT_MS = 6 * 3600 * 1000


def instant_vector(samples: DataFrame, by: list[str], step_s: int, lookback_s: int = LOOKBACK_S, width: int = SEGMENT_MS) -> DataFrame:
    """samples: by, epoch_ms, line_no, value -> by, t_ms (the step), value, age_ms: the latest sample at each step, not older than the lookback (open at
    its start). Of samples at the same time the later line counts."""
    step, back = 1000 * step_s, 1000 * lookback_s
    p = neighbour(samples.select(*by, "epoch_ms", "line_no", "value"), by, ["epoch_ms", "line_no"], width, {"__until": "epoch_ms"}, ahead=True)
    first = F.ceil(F.col("epoch_ms") / step).cast("bigint") * step
    last = F.least(F.coalesce("__until", F.col("epoch_ms") + back), F.col("epoch_ms") + back) - 1
    reign = p.filter(first <= last).select(*by, "epoch_ms", "value", F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))).alias("t_ms"))
    return reign.select(*by, "t_ms", "value", (F.col("t_ms") - F.col("epoch_ms")).alias("age_ms"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], tolerance: int | None = None, width: int = SEGMENT_MS, strict: bool = False) -> DataFrame:
    """left with the values of right's latest row at or before each row's time (before it, if strict), null if there is none within the tolerance.

    The time is a whole number on both sides; of right rows at the same time the one with the greatest values counts. Left rows keep their columns,
    repeated ones included."""
    own = left.select(*by, F.col(time).alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(F.col(time).alias("at"), *values).alias("r")).schema["r"].dataType).alias("__r"))
    others = right.select(*by, F.col(time).alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), F.struct(F.col(time).alias("at"), *values).alias("__r"))
    seen = running(own.unionByName(others), by, ["__at", "__side"], width, greatest={"__last": F.col("__r")}).filter("__row IS NOT NULL")
    fresh = F.lit(True) if tolerance is None else F.col("__at") - F.col("__last.at") <= tolerance
    return seen.select("__row.*", *[F.when(fresh, F.col(f"__last.{v}")).alias(v) for v in values])
