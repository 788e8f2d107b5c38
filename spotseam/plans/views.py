"""The driver's tables seen as recordings, signal events and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources import settings
from ..tables import cut
from .detect import Found, settled

DURATION_US = 3_600_000_000
FPS = 30000 / 1001
#: Which signal an event type stands for.
SIGNALS = {"error": "BlackFrame", "view": "SceneChange", "click": "Silence", "purchase": "LogoAbsence", "signup": "Letterbox"}
START_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal_name(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in SIGNALS.items():
        out = F.when(event_type == k, v).otherwise(out)
    return out


def signal_events(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(rec_id, signal, source, event_id, t_us): thirty days of events squeezed into one hour a recording."""
    e = table(spark, sf_dir, "events")
    # Instants without a zone: the difference to the start, whatever the session's zone.
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 720")
    return e.select(F.col("user_id").alias("rec_id"), signal_name(F.col("event_type")).alias("signal"), (F.col("event_id") % 4).cast("string").alias("source"), "event_id", t.alias("t_us"), *more)


def signal_spans(spark: SparkSession, sf_dir: str, signal: str | None = None) -> DataFrame:
    """(rec_id, signal, event_id, start_us, end_us): intervals a tenth of a second a unit of value long."""
    rows = signal_events(spark, sf_dir, F.round(F.col("value") * 100).cast("bigint").alias("v"))
    rows = rows if signal is None else rows.filter(F.col("signal") == signal)
    return rows.select("rec_id", "signal", "event_id", F.col("t_us").alias("start_us"), (F.col("t_us") + F.col("v") * 1000).alias("end_us"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id")).distinct()
    path = F.concat(F.lit("/rec/show "), (F.col("rec_id") % 20).cast("string"), F.lit("/Show "), F.col("rec_id").cast("string"), F.lit(".ts"))
    return ids.select("rec_id", path.alias("path"), F.lit(DURATION_US).alias("duration_us"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(FPS).alias("frame_rate"))


#: Settings of four profiles, as files laid over a base.
BASE_INI = """[General]
window_size = 2
[Detection]
commercial_threshold = 0.38 ; shipped
min_commercial_seconds = 60
max_commercial_seconds = 600
commercial_merge_gap = 20
skip_start_seconds = 90
skip_end_seconds = 60
[BlackFrame]
weight = 0.60
use_clustering = yes
min_count = 15
cluster_max_gap = 220
cluster_min_duration = 60
cluster_min_events = 2
[SceneChange]
weight = 0.05
[Silence]
weight = 0.15
[Logo]
weight = 0.40
learn_duration = 900
cluster_max_gap = 420
cluster_min_events = 2
corner_ticker_threshold = 0.002
"""
PROFILES = {
    "network": "",
    "late show": "[Detection]\ncommercial_threshold=.45\nsmoothing_radius=0\ncommercial_merge_gap=215\n[BlackFrame]\nweight=.55\ncluster_max_gap=180\ncluster_min_duration=1\ncluster_min_events=1\n[SceneChange]\nweight=.15\n[Silence]\nweight=.20\n[Logo]\nenabled=off\nweight=0\n[Xds]\nenabled=no\n",
    "sketch show": "[General]\nwindow_size=3.5\n[Detection]\ncommercial_threshold=.55\n[BlackFrame]\nweight=.55\nuse_clustering=no\n[SceneChange]\nweight=.20\nscene_change_invert=true\n[Logo]\nenabled=false\ncluster_max_gap=300\ncluster_min_events=3\n",
    "pillarbox": "[Detection]\nsmoothing_radius=5\nskip_start_seconds=0\ncommercial_merge_gap=0\n[BlackFrame]\nweight=.25\ncluster_max_gap=350\n[Letterbox]\nenabled=yes\nweight=.55\nmin_duration=30\n[Logo]\nlearn_start=300\nlogo_corner_filter_ratio=0\n[Psip]\nenabled=off\n",
}


def profiles(spark: SparkSession) -> DataFrame:
    """One row a profile: its own settings over the base."""
    files = [(f"{name}|{i}", text) for name, own in PROFILES.items() for i, text in enumerate((BASE_INI, own))]
    read = settings.params_of(settings.parse_ini(spark.createDataFrame(files, "file string, text string")))
    layers = read.withColumns({"profile": F.split_part("file", F.lit("|"), F.lit(1)), "layer": F.split_part("file", F.lit("|"), F.lit(2)).cast("int")}).drop("file")
    return settings.overlay(layers)


def boundaries(recs: DataFrame) -> DataFrame:
    """(rec_id, source, skip_start_s, skip_end_s): what broadcast tables told of some recordings."""
    row = lambda df, source, a, b: df.select("rec_id", F.lit(source).alias("source"), F.lit(a).alias("skip_start_s"), F.lit(b).alias("skip_end_s"))
    return row(recs.filter("rec_id % 7 = 0"), "psip", 120.0, 180.0).unionByName(row(recs.filter("rec_id % 5 = 0"), "xds", 60.0, 0.0))


def settled_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings under four profiles in turn."""
    recs = recordings(spark, sf_dir).withColumn("profile", F.element_at(F.array(*map(F.lit, PROFILES)), (F.col("rec_id") % 4 + 1).cast("int")))
    return cut(settled(recs, profiles(spark), boundaries(recs)), "settled")


def found(spark: SparkSession, sf_dir: str) -> Found:
    """All events as what detectors found; corners of two recordings in three have a reference."""
    e = signal_events(spark, sf_dir, F.round(F.col("value") * 100).cast("bigint").alias("v"))
    named = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    spans = e.filter(F.col("signal").isin("BlackFrame", "Silence", "Letterbox")).select("rec_id", "signal", F.col("t_us").alias("start_us"), (F.col("t_us") + F.col("v") * 1000).alias("end_us"))
    away = e.filter("signal = 'LogoAbsence'")
    corners = away.select("rec_id", named((*intervals.CORNERS, *intervals.BANDS), 6).alias("source"), "t_us")
    absences = away.filter("v % 10 < 7").select("rec_id", named(intervals.CORNERS, 4).alias("source"), F.expr("t_us div 5000000 * 5000000").alias("t_us"))
    places = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("source")) for n, c in enumerate(intervals.CORNERS)])
    references = recordings(spark, sf_dir).select("rec_id", F.inline(places)).filter("(rec_id + n) % 3 <> 0").drop("n")
    return Found(spans, e.filter("signal = 'SceneChange'").select("rec_id", "t_us"), corners, absences, references)
