"""Classified windows to segments, and the rewrites of segments, in the order that matters.

Segments are (rec_id, start_us, end_us, type, confidence, start_frame, end_frame); all
windows here partition by ``rec_id`` alone, so one shuffle serves the whole chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..functions.scalars import col, frame
from .score import COMMERCIAL, PROGRAM


def _in_order() -> WindowSpec:
    return W.partitionBy("rec_id").orderBy("start_us")


def _so_far() -> WindowSpec:
    return _in_order().rowsBetween(W.unboundedPreceding, 0)


def folded(parts: Column) -> Column:
    """Confidences folded from the left, (a + b) / 2 at each step; not their mean."""
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), lambda a, x: (a + x) / 2)


def islands(windows: DataFrame, *kept: str) -> DataFrame:
    """One segment per run of one class, its confidence the mean score; ``kept`` columns have one value a recording."""
    w = W.partitionBy("rec_id").orderBy("i")
    new = F.when(F.col("classification") == F.lag("classification").over(w), 0).otherwise(1)
    runs = windows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("rec_id", "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max(F.col("classification") == COMMERCIAL).alias("_c"), F.avg("p").alias("confidence"), *[F.max(c).alias(c) for c in kept])
    return out.select("rec_id", "start_us", "end_us", F.when(F.col("_c"), COMMERCIAL).otherwise(PROGRAM).alias("type"), "confidence", *kept)


def with_frames(segments: DataFrame, fps) -> DataFrame:
    return segments.withColumns({"start_frame": frame(F.col("start_us"), col(fps)), "end_frame": frame(F.col("end_us"), col(fps))})


def strip_start(segments: DataFrame, skip_s) -> DataFrame:
    """Commercials that start before the skip become programme."""
    early = (F.col("type") == COMMERCIAL) & (col(skip_s) > 0) & (F.col("start_us") < col(skip_s) * 1_000_000)
    return segments.withColumn("type", F.when(early, PROGRAM).otherwise(F.col("type")))


def strip_end(segments: DataFrame, skip_s, duration_us) -> DataFrame:
    """Commercials that reach into the end skip are cut there, or become programme if they start in it.

    The end frame stays, and so does the next segment's start: the hole is part of the result.
    """
    limit = col(duration_us) - col(skip_s) * 1_000_000
    late = (F.col("type") == COMMERCIAL) & (col(skip_s) > 0) & (F.col("end_us") > limit)
    whole = late & (F.col("start_us") >= limit)
    return segments.withColumns({"end_us": F.when(late & ~whole, limit.cast("bigint")).otherwise(F.col("end_us")), "type": F.when(whole, PROGRAM).otherwise(F.col("type"))})


def _merge(marked: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """One segment per ``_run``; rows with ``_skip`` give their end, not their confidence; ``kept`` columns have one value a recording."""
    own = F.sort_array(F.collect_list(F.when(~F.col("_skip"), F.struct("start_us", "confidence"))))
    out = marked.groupBy("rec_id", "_run").agg(F.min("start_us").alias("s"), F.max_by("end_us", "start_us").alias("e"), F.min_by("type", "start_us").alias("type"), own.alias("c"), F.min_by("start_frame", "start_us").alias("sf"), F.max_by("end_frame", "start_us").alias("ef"), *[F.max(c).alias(c) for c in kept])
    return out.select("rec_id", F.col("s").alias("start_us"), F.col("e").alias("end_us"), "type", folded(F.transform("c", lambda x: x["confidence"])).alias("confidence"), F.col("sf").alias("start_frame"), F.col("ef").alias("end_frame"), *kept)


def bridge_gaps(segments: DataFrame, gap_s, kept: Sequence[str] = ()) -> DataFrame:
    """Commercials with no more than ``gap_s`` of programme between them become one; 0 turns it off.

    Whether a gap closes depends on its own length and its two neighbours only, so one
    pass does what repeated merging would.  The gap's own confidence doesn't count.
    """
    between = (F.col("type") == PROGRAM) & (F.lag("type").over(_in_order()) == COMMERCIAL) & (F.lead("type").over(_in_order()) == COMMERCIAL)
    closed = F.coalesce(between & (col(gap_s) > 0) & (F.col("end_us") - F.col("start_us") <= col(gap_s) * 1_000_000), F.lit(False))
    marked = segments.withColumn("_skip", closed)
    new = F.when(F.col("_skip") | F.coalesce(F.lag("_skip").over(_in_order()), F.lit(False)), 0).otherwise(1)
    return _merge(marked.withColumn("_new", new).withColumn("_run", F.sum("_new").over(_so_far())), kept)


def limit_duration(segments: DataFrame, min_s, max_s) -> DataFrame:
    """Commercials shorter or longer than allowed become programme; both bounds are allowed."""
    s = (F.col("end_us") - F.col("start_us")) / 1e6
    out = (F.col("type") == COMMERCIAL) & ((s < col(min_s)) | (s > col(max_s)))
    return segments.withColumn("type", F.when(out, PROGRAM).otherwise(F.col("type")))


def merge_adjacent(segments: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Neighbours of one type become one segment."""
    new = F.when(F.col("type") == F.lag("type").over(_in_order()), 0).otherwise(1)
    return _merge(segments.withColumns({"_skip": F.lit(False), "_new": new}).withColumn("_run", F.sum("_new").over(_so_far())), kept)


def recheck_skips(segments: DataFrame, skip_start_s, skip_end_s, duration_us) -> DataFrame:
    """The last look at both skips, without trimming; after the rewrites above it changes nothing."""
    limit = col(duration_us) - col(skip_end_s) * 1_000_000
    late = (F.col("type") == COMMERCIAL) & (col(skip_end_s) > 0) & (F.col("end_us") > limit)
    return strip_start(segments, skip_start_s).withColumn("type", F.when(late, PROGRAM).otherwise(F.col("type")))


def numbered(segments: DataFrame) -> DataFrame:
    """With seg_no from 0 in time order, and no of the segment among its type from 1."""
    return segments.withColumns({"seg_no": (F.row_number().over(_in_order()) - 1).cast("bigint"), "type_no": F.row_number().over(W.partitionBy("rec_id", "type").orderBy("start_us")).cast("bigint")})


def totals(segments: DataFrame) -> DataFrame:
    """(rec_id, n_breaks, break_s): commercials of each recording; recordings without any have 0."""
    c = F.col("type") == COMMERCIAL
    return segments.groupBy("rec_id").agg(F.count_if(c).alias("n_breaks"), F.coalesce(F.sum(F.when(c, (F.col("end_us") - F.col("start_us")) / 1e6)), F.lit(0.0)).alias("break_s"))
