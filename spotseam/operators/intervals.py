"""Point events to clusters, clusters and intervals to grid windows, and the logo-corner filters.

Everything is keyed by ``rec_id`` (and ``signal``) and shuffles on that key; times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import col

KEYS = ("rec_id", "signal")


def cluster(events: DataFrame, gap_us, min_us, min_events, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of events no more than ``gap_us`` apart, of enough events and length: (keys, start_us, end_us, n_events).

    An event exactly the gap away still belongs; a run ends at its last event.
    The limits may be columns of ``events``, so that each recording has its own.
    """
    w = W.partitionBy(*keys).orderBy("t_us")
    new = F.when(F.col("t_us") - F.lag("t_us").over(w) <= col(gap_us), 0).otherwise(1)
    runs = events.withColumns({"_new": new, "_min_us": col(min_us), "_min_n": col(min_events)}).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n_events"), F.max("_min_us").alias("_min_us"), F.max("_min_n").alias("_min_n"))
    return out.filter((F.col("n_events") >= F.col("_min_n")) & (F.col("end_us") - F.col("start_us") >= F.col("_min_us"))).select(*keys, "start_us", "end_us", "n_events")


def rescue(segments: DataFrame, gap_us, min_us, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Segments that stand alone: long enough, and both neighbours start more than the gap away."""
    w = W.partitionBy(*keys).orderBy("start_us", "end_us")
    far = F.lit(2**62)
    before = F.coalesce(F.col("start_us") - F.lag("start_us").over(w), far)
    after = F.coalesce(F.lead("start_us").over(w) - F.col("start_us"), far)
    marked = segments.withColumns({"_b": before, "_a": after})
    return marked.filter((F.col("end_us") - F.col("start_us") >= col(min_us)) & (F.col("_b") > col(gap_us)) & (F.col("_a") > col(gap_us))).drop("_b", "_a")


def long_enough(segments: DataFrame, min_count, fps) -> DataFrame:
    """Segments of at least so many frames; 30 frames a second where the rate isn't known."""
    rate = F.when(col(fps) > 0, col(fps)).otherwise(30.0)
    return segments.filter((F.col("end_us") - F.col("start_us")) / 1e6 >= col(min_count) / rate)


def overlap_windows(segments: DataFrame, window_us: Column | int, duration_us: Column | int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, i) of each grid window that a segment overlaps, once each.

    Half-open on both sides: a segment without length counts only strictly inside a
    window.  Segments are expanded to the windows they touch, so the cost is that of the result.
    """
    lo, hi = window_range(window_us, duration_us)
    return segments.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("i")).distinct()


def window_range(window_us: Column | int, duration_us: Column | int) -> tuple[Column, Column]:
    """The first and the last window that a segment overlaps; the last one lies before the first where there is none."""
    n = F.ceil(col(duration_us) / col(window_us))
    lo = F.floor(F.col("start_us") / col(window_us))
    hi = F.least(F.ceil(F.col("end_us") / col(window_us)) - 1, n - 1)
    return lo, F.when(F.col("start_us") < col(duration_us), hi).otherwise(-1).cast("bigint")


def grid(recordings: DataFrame, window_us: int) -> DataFrame:
    """(rec_id, i, start_us, end_us): windows of one size, the last one cut at the duration."""
    n = F.ceil(F.col("duration_us") / window_us)
    cells = recordings.filter("duration_us > 0").select("rec_id", "duration_us", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))
    return cells.select("rec_id", "i", (F.col("i") * window_us).alias("start_us"), F.least((F.col("i") + 1) * window_us, F.col("duration_us")).alias("end_us"))


def region_rates(regions: DataFrame, events: DataFrame, learn_s) -> DataFrame:
    """(rec_id, source, rate): events a second of each region in the learning window; 0 for silent ones."""
    n = events.groupBy("rec_id", "source").agg(F.count("*").alias("n"))
    rate = F.when(F.col("_learn") > 0, F.coalesce("n", F.lit(0)) / F.col("_learn")).otherwise(0.0)
    return regions.select("rec_id", "source", col(learn_s).cast("double").alias("_learn")).distinct().join(n, ["rec_id", "source"], "left").select("rec_id", "source", rate.alias("rate"))


#: The four corners, the two bands, and the rate above which a band tells of a crawl.
CORNERS = ("top-left", "top-right", "bottom-left", "bottom-right")
BANDS = ("top-band", "bottom-band")
BAND_LIMIT = 1.5


def band_warnings(rates: DataFrame) -> DataFrame:
    """Bands so busy that a news or weather crawl is likely."""
    return rates.filter(F.col("source").isin(*BANDS) & (F.col("rate") > BAND_LIMIT))


def without_tickers(rates: DataFrame, limit) -> DataFrame:
    return rates.filter(F.col("rate") <= col(limit))


def without_noise(rates: DataFrame, ratio) -> DataFrame:
    """Regions no busier than ``ratio`` times the calmest, where that drops some of several and not all."""
    w = W.partitionBy("rec_id")
    calm = F.col("rate") <= F.min("rate").over(w) * col(ratio)
    marked = rates.withColumn("_calm", calm).withColumns({"_n": F.count("*").over(w), "_k": F.count_if("_calm").over(w)})
    every = (F.col("_n") < 2) | (col(ratio) <= 0) | (F.col("_k") == 0)
    return marked.filter(every | F.col("_calm")).drop("_calm", "_n", "_k")


def consensus(events: DataFrame, active: DataFrame, duration_us, bucket_us: int = 5_000_000) -> DataFrame:
    """Events of active regions in buckets with two events or more, whichever regions they are from.

    With fewer than two active regions all of their events stay.
    """
    n = active.groupBy("rec_id").agg(F.count_distinct("source").alias("_active"))
    own = events.join(active.select("rec_id", "source").distinct(), ["rec_id", "source"]).join(n, "rec_id")
    own = own.withColumn("_bucket", F.floor(F.col("t_us") / bucket_us))
    votes = F.count("*").over(W.partitionBy("rec_id", "_bucket"))
    inside = F.col("_bucket") < F.ceil(col(duration_us) / bucket_us) + 1
    return own.withColumn("_votes", votes).filter((F.col("_active") < 2) | ((F.col("_votes") >= 2) & inside)).drop("_active", "_bucket", "_votes")


def absent_share(segments: DataFrame, recordings: DataFrame, limit: float = 0.85) -> DataFrame:
    """(rec_id, absent_s, share, suppressed): how much of a recording the segments cover, each counted in full."""
    total = segments.groupBy("rec_id").agg(F.sum((F.col("end_us") - F.col("start_us")) / 1e6).alias("absent_s"))
    s = F.coalesce("absent_s", F.lit(0.0))
    share = F.coalesce(F.try_divide(s, F.col("duration_us") / 1e6), F.lit(0.0))
    return recordings.join(total, "rec_id", "left").select("rec_id", s.alias("absent_s"), share.alias("share"), (share >= limit).alias("suppressed"))


def learn_window(recordings: DataFrame, learn_start_s, skip_start_s, learn_s, reference_s) -> DataFrame:
    """(rec_id, learn_start_s, learn_s, reference_s); negative settings mean the skip start and the middle of the learning window."""
    d = F.col("duration_us") / 1e6
    begin = F.least(F.when(col(learn_start_s) >= 0, col(learn_start_s)).otherwise(col(skip_start_s)).cast("double"), d / 2)
    span = F.least(col(learn_s).cast("double"), d - begin)
    ref = F.when(col(reference_s) >= 0, col(reference_s).cast("double")).otherwise(begin + span / 2)
    return recordings.select("rec_id", begin.alias("learn_start_s"), span.alias("learn_s"), ref.alias("reference_s"))


def corners(size: float, x_inset: float, y_inset: float) -> list[tuple[str, str]]:
    """Crop expressions of the four corners."""
    f = lambda v: f"{v:.4f}"
    left, top, right, bottom = f"iw*{f(x_inset)}", f"ih*{f(y_inset)}", f"iw*{f(1 - size - x_inset)}", f"ih*{f(1 - size - y_inset)}"
    wide = f"crop=iw*{f(size)}:ih*{f(size)}"
    return [(n, f"{wide}:{x}:{y}") for n, x, y in zip(CORNERS, (left, right, left, right), (top, top, bottom, bottom))]
