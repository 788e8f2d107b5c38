"""Weighted signals to a smoothed score and a class for every grid window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import col

COMMERCIAL, PROGRAM = "Commercial", "Program"


def active_weights(present: DataFrame) -> DataFrame:
    """(rec_id, total): the weights of the signals that ran, found something or not; 1 where they add up to nothing.

    ``present`` is (rec_id, signal, weight): what ran is known from settings and suppression, never from hits.
    """
    s = F.sum("weight")
    return present.groupBy("rec_id").agg(F.when(s > 0, s).otherwise(1.0).alias("total"))


def score_map(segments: DataFrame) -> DataFrame:
    """(rec_id, i, signal_scores): the scores of a window by signal."""
    return segments.groupBy("rec_id", "i").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("signal", F.lit(1.0).alias("score"))))).alias("signal_scores"))


def reference_signal(entries: DataFrame) -> DataFrame:
    """(rec_id, signal): the signal with the most windows, of equals the first; ``entries`` are (rec_id, signal, ord, n).

    Grids all come from the duration here, so this only tells which one a reader of single signals would take.
    """
    return entries.groupBy("rec_id").agg(F.max_by("signal", F.struct("n", -F.col("ord"))).alias("signal"))


#: Window numbers times this, divided by the radius: two windows are within the radius exactly if these differ by no more than it.
_STEPS = 1 << 20


def smooth(windows: DataFrame, radius) -> DataFrame:
    """Centred moving average of the original scores over 2r+1 windows, fewer at the edges; none for a radius of 0 and below.

    The radius may be a column, one value a recording: one range frame then serves all of them.
    """
    by = W.partitionBy("rec_id")
    if isinstance(radius, int):
        return windows.withColumn("p", F.avg("p").over(by.orderBy("i").rowsBetween(-radius, radius))) if radius > 0 else windows
    scaled = F.floor(F.col("i") * _STEPS / F.greatest(col(radius), F.lit(1)))
    mean = F.avg("p").over(by.orderBy("_scaled").rangeBetween(-_STEPS, _STEPS))
    return windows.withColumn("_scaled", scaled).withColumn("p", F.when(col(radius) > 0, mean).otherwise(F.col("p"))).drop("_scaled")


def classify(windows: DataFrame, threshold) -> DataFrame:
    """Commercial at the threshold and above; scores are rounded to nine places first, so that sums in another order agree."""
    return windows.withColumn("classification", F.when(F.round("p", 9) >= col(threshold), COMMERCIAL).otherwise(PROGRAM))
