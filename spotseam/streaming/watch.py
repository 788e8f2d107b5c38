"""New recordings as a stream: file events in, files that have come to rest out.

State is keyed by path and kept by Spark's checkpoint, so a restart loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from ..operators.intervals import KEYS
from ..sources.files import WATCHED, candidates, excluded, is_media, unprocessed

EVENTS = "path string, event string, old_path string, observed_at timestamp, size long"
#: Rest, size and extensions by default and for a server.
DEFAULT = {"delay_s": 30, "min_bytes": 10 << 20, "extensions": WATCHED}
SERVER = {"delay_s": 60, "min_bytes": 50 << 20, "extensions": (".ts", ".mpg", ".mpeg", ".mp4", ".mkv", ".wtv", ".m4v")}
#: Seconds that a file which has come out is remembered, so that a later change of it doesn't bring it out again.
REMEMBERED_S = 7 * 86_400


def clamped(delay_s: int, jobs: int) -> tuple[int, int]:
    """At least five seconds of rest and one job."""
    return max(5, delay_s), max(1, jobs)


def changes(events: DataFrame, patterns: list[str] = (), extensions=WATCHED) -> DataFrame:
    """(path, observed_at, size, gone): a rename takes the old path away and brings the new one."""
    moved = F.col("event") == "renamed"
    now = F.struct("path", "observed_at", "size", F.lit(False).alias("gone"))
    old = F.struct(F.col("old_path").alias("path"), "observed_at", F.lit(None).cast("long").alias("size"), F.lit(True).alias("gone"))
    rows = events.select("observed_at", F.explode(F.when(moved & F.col("old_path").isNotNull(), F.array(old, now)).otherwise(F.array(now))).alias("x"))
    rows = rows.select("x.path", "observed_at", "x.size", "x.gone")
    return rows.filter(is_media(F.col("path"), extensions) & ~excluded(F.col("path"), list(patterns)))


def stable_files(events: DataFrame, delay_s: int = 30, min_bytes: int = 0, patterns: list[str] = (), extensions=WATCHED) -> DataFrame:
    """(path, ready_at, size) once for each file that has seen no event for the delay and is large enough.

    Runs on event time: the stream's watermark is the clock, so results don't depend on how batches fall.
    A file that has come out is forgotten when it has seen no event for ``REMEMBERED_S``.
    """
    delay_s, forget_ms = clamped(delay_s, 1)[0], REMEMBERED_S * 1000
    timed = changes(events.withWatermark("observed_at", "0 seconds"), patterns, extensions)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"path": pd.Series(dtype="str"), "ready_at": pd.Series(dtype="datetime64[us]"), "size": pd.Series(dtype="int64")})
        if state.hasTimedOut:
            last, size, gone, done = state.get
            if gone or done:
                state.remove()
                yield none
                return
            state.update((last, size, gone, True))
            state.setTimeoutTimestamp(max(last // 1000 + forget_ms, state.getCurrentWatermarkMs() + 1))
            yield none if size < min_bytes else pd.DataFrame({"path": [key[0]], "ready_at": [pd.Timestamp(last + delay_s * 1_000_000, unit="us")], "size": [size]})
            return
        last, size, gone, done = state.get if state.exists else (-1, 0, False, False)
        for b in batches:
            for t, n, g in zip(b["observed_at"], b["size"], b["gone"]):
                us = int(t.value // 1000)
                if us >= last:
                    last, gone = us, bool(g)
                    size = size if pd.isna(n) else int(n)
        state.update((last, size, gone, done))
        due = last // 1000 + (forget_ms if done and not gone else delay_s * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield none

    return timed.groupBy("path").applyInPandasWithState(step, "path string, ready_at timestamp, size long", "last long, size long, gone boolean, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stable_batch(events: DataFrame, delay_s: int, until: Column, min_bytes: int = 0, patterns: list[str] = (), extensions=WATCHED) -> DataFrame:
    """The same over a finished event log: the first rest of each path that is long enough by ``until``."""
    delay_us = clamped(delay_s, 1)[0] * 1_000_000
    w = W.partitionBy("path").orderBy("us")
    rows = changes(events, patterns, extensions).withColumn("us", F.unix_micros("observed_at"))
    rows = rows.withColumns({"rest": F.coalesce(F.lead("us").over(w), F.unix_micros(until)) - F.col("us"), "known": F.last("size", True).over(w)})
    calm = rows.filter((F.col("rest") >= delay_us) & ~F.col("gone") & (F.coalesce("known", F.lit(0)) >= min_bytes))
    return calm.groupBy("path").agg(F.timestamp_micros(F.min("us") + delay_us).alias("ready_at"), F.min_by("known", "us").alias("size"))


def stream_clusters(events: DataFrame, gap_s: int, min_us: int, min_events: int, late: str = "10 minutes") -> DataFrame:
    """Clusters of timed events as they close: session windows whose ends are the last events, not the gap behind them."""
    s = events.withWatermark("ts", late).groupBy(*KEYS, F.session_window("ts", f"{gap_s} seconds"))
    us = F.unix_micros("ts")
    out = s.agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n_events"))
    return out.filter((F.col("n_events") >= min_events) & (F.col("end_us") - F.col("start_us") >= min_us)).select(*KEYS, "start_us", "end_us", "n_events")


def backfill(files: DataFrame, outputs: DataFrame, formats: list[str] = ("Edl",), min_bytes: int = DEFAULT["min_bytes"], patterns: list[str] = (), extensions=WATCHED) -> DataFrame:
    """(path, ready_at, size) of files that lie there already and have no output yet, as ``stable_files`` would give them.

    ``files`` is a listing (path, length, modified); hand the result to ``process_batch`` before the stream starts.
    """
    wanted = unprocessed(candidates(files, patterns, min_bytes, extensions), outputs, formats)
    return wanted.select("path", F.col("modified").alias("ready_at"), F.col("length").alias("size"))


def process_batch(batch: DataFrame, process, ledger: str, jobs: int | None = None) -> None:
    """Hands files not in the ledger to ``process(batch) -> DataFrame (path, ok)`` and records the outcome.

    With ``jobs`` the files lie in so many partitions, and no more than that many are worked on at once.
    """
    spark = batch.sparkSession
    try:
        done = spark.read.parquet(ledger).select("path")
    except Exception as e:  # the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], "path string")
    new = batch.dropDuplicates(["path"]).join(done, "path", "left_anti")
    process(new if jobs is None else new.repartition(clamped(0, jobs)[1], "path")).select("path", "ok").write.mode("append").parquet(ledger)


def counters(ledger: DataFrame) -> DataFrame:
    """(processed, failed) of a ledger, which may be read as a stream."""
    return ledger.agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))


def process_new(stable: DataFrame, process, ledger: str, checkpoint: str, jobs: int | None = None):
    """Starts a query that processes each batch.

    A batch that runs again finds its own rows in the ledger, so a file counts once.
    """
    return stable.writeStream.foreachBatch(lambda batch, _: process_batch(batch, process, ledger, jobs)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
