"""The detection plan: what each detector found, under each recording's own settings, to labelled segments.

``recordings`` become one wide row each: length, rate, every setting, skips.  Rows that
detectors found meet that row on ``rec_id``; whatever a setting decides is a column
expression from there on, so any number of profiles goes through one plan.  Each detector
joins these rows, so give ``settled`` as a written table (``tables.cut``): it is read several times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import intervals, score, segments
from ..sources import documents, settings
from ..tables import cut

#: The signals that detectors give, and the setting that weighs each; a signal's place here is its bit.
SIGNALS = {"BlackFrame": "bf_weight", "SceneChange": "sc_weight", "Silence": "silence_weight", "LogoAbsence": "logo_weight", "Letterbox": "letterbox_weight"}
#: Fixed value: from this share of absence on the logo says nothing.
ABSENT_LIMIT = 0.85


@dataclass(frozen=True)
class Found:
    """What the detectors found.

    spans (rec_id, signal, start_us, end_us): black, silent and letterboxed stretches;
    cuts (rec_id, t_us): scene changes; corners (rec_id, source, t_us): changes in the four corners
    and two bands; absences (rec_id, source, t_us): probes of corners unlike their reference;
    references (rec_id, source): corners that have one.
    """

    spans: DataFrame
    cuts: DataFrame
    corners: DataFrame
    absences: DataFrame
    references: DataFrame


def settled(recordings: DataFrame, params: DataFrame, boundaries: DataFrame | None = None, by: str = "profile", preset: str | None = None) -> DataFrame:
    """(rec_id, duration_us, frame_rate, every setting): the profile's settings and defaults, skips replaced by what boundaries tell."""
    own = recordings.select("rec_id", "duration_us", "frame_rate", by).join(params, by, "left").drop(by)
    r = settings.with_defaults(own, preset)
    if boundaries is None:
        return r
    skips = documents.effective_skips(r, boundaries, F.col("skip_start"), F.col("skip_end"), F.col("psip_enabled"), F.col("xds_enabled"))
    return r.drop("skip_start", "skip_end").join(skips.withColumnsRenamed({"skip_start_s": "skip_start", "skip_end_s": "skip_end"}), "rec_id")


def us(seconds: str) -> Column:
    """A setting in seconds as whole microseconds."""
    return F.round(F.col(seconds) * 1_000_000).cast("bigint")


def _with(rows: DataFrame, r: DataFrame, *names: str) -> DataFrame:
    return rows.join(r.select("rec_id", *names), "rec_id")


def black_segments(spans: DataFrame, r: DataFrame) -> DataFrame:
    """Black stretches as they are, or their clusters and, where one event is enough, those that stand alone."""
    own = _with(spans.filter("signal = 'BlackFrame'"), r, "frame_rate", "bf_min_count", "bf_use_clustering", "bf_cluster_max_gap", "bf_cluster_min_duration", "bf_cluster_min_events")
    dense = intervals.long_enough(own.filter("bf_use_clustering"), F.col("bf_min_count"), F.col("frame_rate"))
    gap, least = us("bf_cluster_max_gap"), us("bf_cluster_min_duration")
    clusters = intervals.cluster(dense.withColumn("t_us", F.col("start_us")), gap, least, F.col("bf_cluster_min_events"))
    alone = intervals.rescue(dense.filter("bf_cluster_min_events <= 1"), gap, least)
    cols = ["rec_id", "signal", "start_us", "end_us"]
    return own.filter(~F.col("bf_use_clustering")).select(cols).unionByName(clusters.select(cols)).unionByName(alone.select(cols))


def scene_segments(cuts: DataFrame, r: DataFrame) -> DataFrame:
    """Clusters of scene changes; they share the logo's cluster settings."""
    return _logo_clusters(_with(cuts.withColumn("signal", F.lit("SceneChange")), r, *_LOGO))


_LOGO = ("logo_cluster_max_gap", "logo_cluster_min_duration", "logo_cluster_min_events")


def _logo_clusters(events: DataFrame) -> DataFrame:
    return intervals.cluster(events, us(_LOGO[0]), us(_LOGO[1]), F.col(_LOGO[2])).select("rec_id", "signal", "start_us", "end_us")


def learning(r: DataFrame) -> DataFrame:
    """(rec_id, learn_start_s, learn_s, reference_s) of recordings whose logo counts."""
    on = r.filter("logo_enabled and logo_weight > 0")
    return intervals.learn_window(on, F.col("logo_learn_start"), F.col("skip_start"), F.col("logo_learn_duration"), F.col("logo_reference_seconds"))


def activity(corners: DataFrame, r: DataFrame) -> DataFrame:
    """(rec_id, source, rate): changes a second of each corner and band in the learning window."""
    window = learning(r).select("rec_id", "learn_start_s", "learn_s")
    seen = corners.join(window, "rec_id").filter((F.col("t_us") >= F.col("learn_start_s") * 1e6) & (F.col("t_us") < (F.col("learn_start_s") + F.col("learn_s")) * 1e6))
    regions = window.select("rec_id", "learn_s", F.explode(F.array(*map(F.lit, (*intervals.CORNERS, *intervals.BANDS)))).alias("source"))
    return intervals.region_rates(regions, seen, F.col("learn_s"))


def active_corners(rates: DataFrame, r: DataFrame) -> DataFrame:
    """(rec_id, source): corners that neither a ticker nor noise rules out."""
    own = _with(rates.filter(F.col("source").isin(*intervals.CORNERS)), r, "logo_ticker_threshold", "logo_corner_filter_ratio")
    return intervals.without_noise(intervals.without_tickers(own, F.col("logo_ticker_threshold")), F.col("logo_corner_filter_ratio")).select("rec_id", "source")


def logo_events(found: Found, active: DataFrame, r: DataFrame) -> DataFrame:
    """Events of active corners that others confirm: probes where a corner has a reference, else changes."""
    probed = found.absences.select("rec_id", "source", "t_us").join(found.references, ["rec_id", "source"], "left_semi")
    changed = found.corners.select("rec_id", "source", "t_us").join(found.references, ["rec_id", "source"], "left_anti")
    return intervals.consensus(_with(probed.unionByName(changed), r, "duration_us", *_LOGO), active, F.col("duration_us"))


def found_segments(found: Found, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All signals' segments (rec_id, signal, start_us, end_us), and the active corners."""
    active = cut(active_corners(activity(found.corners, r), r), "active-corners")  # read twice more
    logo = _logo_clusters(logo_events(found, active, r).withColumn("signal", F.lit("LogoAbsence")))
    silence = found.spans.filter("signal = 'Silence'").select("rec_id", "signal", "start_us", "end_us")
    bars = _with(found.spans.filter("signal = 'Letterbox'"), r, "letterbox_enabled", "letterbox_min_duration").filter((F.col("end_us") - F.col("start_us") >= us("letterbox_min_duration")) & F.col("letterbox_enabled"))
    every: Sequence[DataFrame] = (black_segments(found.spans, r), scene_segments(found.cuts, r), silence, logo, bars.select(silence.columns))
    out = every[0]
    for s in every[1:]:
        out = out.unionByName(s)
    return out, active


def hit_windows(segs: DataFrame, r: DataFrame) -> DataFrame:
    """(rec_id, i, flags, absent_us): every window of every recording, with a bit for each signal that touches it.

    The grid and the segments go to their recording's partition as ranges of windows and are expanded
    there.  The length of logo absences, each counted in full, lies in the first window.
    """
    bit = F.lit(0)
    for n, name in enumerate(SIGNALS):
        bit = F.when(F.col("signal") == name, 1 << n).otherwise(bit)
    zero = F.lit(0).cast("bigint")
    part = lambda lo, hi, flag, away: F.struct(lo.alias("lo"), hi.alias("hi"), flag.alias("bit"), away.alias("away"))
    lo, hi = intervals.window_range(us("window_size"), F.col("duration_us"))
    length = F.when(F.col("signal") == "LogoAbsence", F.col("end_us") - F.col("start_us")).otherwise(zero)
    own = _with(segs, r, "duration_us", "window_size")
    hits = own.select("rec_id", F.inline(F.array(part(lo, hi, bit, zero), part(zero, F.when(length > 0, zero).otherwise(-1), F.lit(0), length)))).filter("lo <= hi")
    last = F.ceil(F.col("duration_us") / us("window_size")) - 1
    grid = r.filter("duration_us > 0").select("rec_id", zero.alias("lo"), last.alias("hi"), F.lit(0).alias("bit"), zero.alias("away"))
    ranges = grid.unionByName(hits).repartition("rec_id")
    flat = ranges.select("rec_id", "bit", "away", F.explode(F.sequence("lo", "hi")).alias("i"))
    return flat.groupBy("rec_id", "i").agg(F.bit_or("bit").alias("flags"), F.sum("away").alias("absent_us"))


def with_corners(r: DataFrame, active: DataFrame) -> DataFrame:
    """``r`` with corners_left: whether the logo has any corner to go by."""
    left = active.select("rec_id").distinct().withColumn("corners_left", F.lit(True))
    return r.join(left, "rec_id", "left").withColumn("corners_left", F.coalesce("corners_left", F.lit(False)))


def counting_weights(absent: Column) -> dict[str, Column]:
    """The weight of each signal, 0 where its detector doesn't run: bars that are off, and a logo that is off, without weight or corners, or nearly always away."""
    out = {signal: F.col(w) for signal, w in SIGNALS.items()}
    logo = F.col("logo_enabled") & F.col("corners_left") & (F.col("logo_weight") > 0) & (absent < ABSENT_LIMIT)
    out["LogoAbsence"] = F.when(logo, F.col("logo_weight")).otherwise(0.0)
    out["Letterbox"] = F.when(F.col("letterbox_enabled"), F.col("letterbox_weight")).otherwise(0.0)
    return out


def present_signals(segs: DataFrame, r: DataFrame, active: DataFrame) -> DataFrame:
    """(rec_id, signal, weight) of the signals that count, found or not."""
    absent = intervals.absent_share(segs.filter("signal = 'LogoAbsence'"), r, ABSENT_LIMIT).select("rec_id", "share")
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), w.alias("weight")) for s, w in counting_weights(F.col("share")).items()])
    return with_corners(r, active).join(absent, "rec_id").select("rec_id", F.inline(rows)).filter("weight > 0")


def weighted(hits: DataFrame, r: DataFrame) -> DataFrame:
    """(rec_id, i, start_us, end_us, p, settings of later steps): each window's share of the weight of all signals that count."""
    named = ["duration_us", "frame_rate", "window_size", "threshold", "smoothing_radius", "sc_invert", "logo_enabled", "letterbox_enabled", "corners_left", *SIGNALS.values()]
    own = _with(hits, r, *named).withColumn("_absent", F.sum("absent_us").over(W.partitionBy("rec_id")) / F.col("duration_us"))
    total, got = F.lit(0.0), F.lit(0.0)
    for n, (signal, w) in enumerate(counting_weights(F.col("_absent")).items()):
        hit = F.col("flags").bitwiseAND(1 << n) != 0
        hit = hit != F.col("sc_invert") if signal == "SceneChange" else hit
        total, got = total + w, got + F.when(hit, w).otherwise(0.0)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), got / F.when(total > 0, total).otherwise(1.0)))
    start = F.col("i") * us("window_size")
    return own.select("rec_id", "i", start.alias("start_us"), F.least(start + us("window_size"), F.col("duration_us")).alias("end_us"), p.alias("p"), "threshold", "smoothing_radius", "frame_rate")


def scored_windows(found: Found, r: DataFrame) -> DataFrame:
    """Every grid window with its share of weights, before smoothing."""
    segs, active = found_segments(found, r)
    return weighted(hit_windows(segs, r), with_corners(r, active))


def classified(found: Found, r: DataFrame) -> DataFrame:
    return score.classify(score.smooth(scored_windows(found, r), F.col("smoothing_radius")), F.col("threshold"))


def raw_segments(found: Found, r: DataFrame) -> DataFrame:
    """Runs of one class, before any rewrite."""
    return segments.with_frames(segments.islands(classified(found, r), "frame_rate"), F.col("frame_rate")).drop("frame_rate")


def rewritten(raw: DataFrame, r: DataFrame) -> DataFrame:
    """Skips, bridged gaps, duration limits, the merge, and the last look at the skips, in this order."""
    s = _with(raw, r, "duration_us", "skip_start", "skip_end", "merge_gap", "min_commercial", "max_commercial")
    s = segments.strip_end(segments.strip_start(s, F.col("skip_start")), F.col("skip_end"), F.col("duration_us"))
    s = segments.bridge_gaps(s, F.col("merge_gap"), _KEPT)
    s = segments.merge_adjacent(segments.limit_duration(s, F.col("min_commercial"), F.col("max_commercial")), _KEPT)
    return segments.recheck_skips(s, F.col("skip_start"), F.col("skip_end"), F.col("duration_us")).drop(*_KEPT)


_KEPT = ("duration_us", "skip_start", "skip_end", "merge_gap", "min_commercial", "max_commercial")


def detect_breaks(found: Found, r: DataFrame) -> DataFrame:
    """Numbered segments of every recording of ``settled``."""
    return segments.numbered(rewritten(raw_segments(found, r), r))
