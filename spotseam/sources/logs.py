"""Detector logs as text columns to events and segments; one row a recording in, exploded rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import number

#: What the detectors print.
BLACK = r"black_start[:=]\s*(\d+\.?\d*)\s+black_end[:=]\s*(\d+\.?\d*)"
SILENCE_START, SILENCE_END = r"silence_start:\s*(\d+\.?\d*)", r"silence_end:\s*(\d+\.?\d*)"
FRAME = r"pts_time:\s*(\d+\.?\d*)"
SSIM = r"n:(\d+)\s.*?All:(\d+\.?\d*)"
#: Microseconds between sampled frames of SSIM statistics.
SSIM_STEP_US = 5_000_000


def _us(seconds: Column) -> Column:
    return F.round(number(seconds) * 1_000_000).cast("bigint")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def black_segments(logs: DataFrame, log_col: str = "log") -> DataFrame:
    """(…, start_us, end_us) of each black or letterboxed stretch."""
    pairs = F.arrays_zip(_all(F.col(log_col), BLACK, 1).alias("a"), _all(F.col(log_col), BLACK, 2).alias("b"))
    return logs.select(*[c for c in logs.columns if c != log_col], F.explode(pairs).alias("_x")).select("*", _us(F.col("_x.a")).alias("start_us"), _us(F.col("_x.b")).alias("end_us")).drop("_x")


def silence_segments(logs: DataFrame, log_col: str = "log", duration_col: str = "duration_us") -> DataFrame:
    """Starts and ends paired in order of occurrence; one start too many lasts to the end of the recording."""
    a, b = _all(F.col(log_col), SILENCE_START, 1), _all(F.col(log_col), SILENCE_END, 1)
    n = F.least(F.size(a), F.size(b))
    to_us = lambda xs: F.transform(xs, _us)
    ends = F.when(F.size(a) > F.size(b), F.concat(F.slice(to_us(b), 1, n), F.array(F.col(duration_col).cast("bigint")))).otherwise(F.slice(to_us(b), 1, n))
    pairs = F.arrays_zip(F.slice(to_us(a), 1, F.size(ends)).alias("a"), ends.alias("b"))
    keep = [c for c in logs.columns if c not in (log_col, duration_col)]
    return logs.select(*keep, F.explode(pairs).alias("_x")).select(*keep, F.col("_x.a").alias("start_us"), F.col("_x.b").alias("end_us"))


def frame_events(logs: DataFrame, log_col: str = "log") -> DataFrame:
    """(…, t_us) of each frame that the log names: scene cuts, or changes in a corner or band."""
    keep = [c for c in logs.columns if c != log_col]
    return logs.select(*keep, F.explode(_all(F.col(log_col), FRAME, 1)).alias("_x")).select(*keep, _us(F.col("_x")).alias("t_us"))


def ssim_events(logs: DataFrame, threshold, log_col: str = "log") -> DataFrame:
    """(…, t_us) of sampled frames less similar to the reference than the threshold."""
    keep = [c for c in logs.columns if c != log_col]
    pairs = F.arrays_zip(_all(F.col(log_col), SSIM, 1).alias("n"), _all(F.col(log_col), SSIM, 2).alias("x"))
    rows = logs.select(*keep, F.explode(pairs).alias("_x"))
    return rows.filter(number(F.col("_x.x")) < threshold).select(*keep, ((F.col("_x.n").cast("bigint") - 1) * SSIM_STEP_US).alias("t_us"))


def read_logs(spark, path: str) -> DataFrame:
    """(path, log): one row a log file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("log"))
