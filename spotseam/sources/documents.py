"""Probe results, programme guides and server settings: JSON and XML documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import basename, col, fraction, number

_STREAM = "codec_type STRING, codec_name STRING, width STRING, height STRING, avg_frame_rate STRING, r_frame_rate STRING, duration STRING, sample_rate STRING, channels STRING"
PROBE = f"streams ARRAY<STRUCT<{_STREAM.replace(' STRING', ': STRING')}>>, format STRUCT<duration: STRING>"
EPG = "Items ARRAY<STRUCT<Id: STRING, Path: STRING, StartDate: STRING, EndDate: STRING, PrePaddingSeconds: STRING, PostPaddingSeconds: STRING>>"
#: Elements of the server's settings that name recording folders.
PATH_TAGS = ("RecordingPath", "MovieRecordingPath", "SeriesRecordingPath", "DefaultRecordingPath")


def parse_probe(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Media figures from probe JSON: the first video and the first audio stream; 0 or "" where unknown.

    The container's duration goes before the stream's if above 0, the average frame rate before
    the nominal one unless it is empty or 0/0.
    """
    p = F.from_json(json_col, PROBE)
    of = lambda kind: F.get(F.filter(F.col("_p.streams"), lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = F.col("_s.v"), F.col("_s.a")
    whole = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    rate = F.when(F.coalesce(v["avg_frame_rate"], F.lit("")).isin("", "0/0"), v["r_frame_rate"]).otherwise(v["avg_frame_rate"])
    total = number(F.col("_p.format.duration"))
    seconds = F.when(total > 0, total).otherwise(number(v["duration"]))
    # Exploding one value keeps it from being computed again for every column that is read from it.
    rows = df.withColumn("_p", F.explode(F.array(p))).withColumn("_s", F.explode(F.array(F.struct(of("video").alias("v"), of("audio").alias("a")))))
    keep = [c for c in df.columns if c != json_col]
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(*keep, F.round(seconds * 1_000_000).cast("bigint").alias("duration_us"), whole(v["width"]).alias("width"), whole(v["height"]).alias("height"), fraction(text(rate)).alias("frame_rate"), text(v["codec_name"]).alias("video_codec"), text(a["codec_name"]).alias("audio_codec"), whole(a["sample_rate"]).alias("audio_sample_rate"), whole(a["channels"]).alias("audio_channels"))


def parse_epg(df: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per recording that a guide document lists, in its order."""
    x = df.select(F.posexplode(F.from_json(json_col, EPG)["Items"]).alias("ord", "x"))
    pad = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    return x.select("ord", F.col("x.Id").alias("id"), F.col("x.Path").alias("path"), F.col("x.StartDate").try_cast("timestamp").alias("start_date"), F.col("x.EndDate").try_cast("timestamp").alias("end_date"), pad("x.PrePaddingSeconds").alias("pre_padding"), pad("x.PostPaddingSeconds").alias("post_padding"))


def post_padding(declared: Column, modified: Column, ended: Column) -> Column:
    """The declared padding, or how much later the file was written, if that is above 0 and under half an hour."""
    late = (F.unix_micros(modified) - F.unix_micros(ended)) / 1e6
    return F.when(F.coalesce(declared, F.lit(0)) != 0, declared.cast("double")).when((late > 0) & (late < 1800), late).otherwise(0.0)


def match_epg(recordings: DataFrame, epg: DataFrame) -> DataFrame:
    """Each recording with the first guide entry of its file name, case aside; null where there is none."""
    w = W.partitionBy("_name").orderBy("ord")
    first = epg.withColumn("_name", F.lower(basename(F.col("path")))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "path")
    return recordings.withColumn("_name", F.lower(basename(F.col("path")))).join(first, "_name", "left").drop("_name")


def match_programme(recordings: DataFrame, listings: DataFrame, tolerance_us: int = 300_000_000) -> DataFrame:
    """The first listing, in its order, that runs at a recording's start, give or take five minutes.

    recordings (rec_id, rec_start_us, …), listings (rec_id, ord, prog_start_us, prog_len_us, …).
    """
    hit = (F.col("prog_start_us") <= F.col("rec_start_us") + tolerance_us) & (F.col("prog_start_us") + F.col("prog_len_us") > F.col("rec_start_us") - tolerance_us)
    found = recordings.select("rec_id", "rec_start_us").join(listings, "rec_id").filter(hit)
    best = found.groupBy("rec_id").agg(F.min_by(F.struct("prog_start_us", "prog_len_us", "ord"), "ord").alias("x"))
    return recordings.join(best, "rec_id", "left").select(*recordings.columns, "x.prog_start_us", "x.prog_len_us", F.col("x.ord").alias("listing"))


def programme_skips(rec_start_us: Column, prog_start_us: Column, prog_len_us: Column, duration_us: Column) -> tuple[Column, Column]:
    """Seconds before the programme starts and after it ends, never below 0."""
    return F.greatest(F.lit(0.0), (prog_start_us - rec_start_us) / 1e6), F.greatest(F.lit(0.0), (rec_start_us + duration_us - prog_start_us - prog_len_us) / 1e6)


def elapsed_skips(elapsed_us: Column, prog_len_us: Column, duration_us: Column) -> tuple[Column, Column]:
    """The same for captions that tell a programme's length and how long it has run: a start not yet begun counts as recorded so far."""
    start = F.greatest(F.lit(0.0), elapsed_us / 1e6)
    return start, F.greatest(F.lit(0.0), (duration_us - prog_len_us) / 1e6 - start)


def effective_skips(recordings: DataFrame, boundaries: DataFrame, skip_start=0, skip_end=0, psip=True, xds=True) -> DataFrame:
    """(rec_id, skip_start_s, skip_end_s) by source: settings raised by the guide's padding, then replaced by PSIP, else by XDS, if complete.

    The settings, and whether PSIP and XDS count at all, may be columns of ``recordings``.
    """
    by = boundaries.groupBy("rec_id").pivot("source", ["epg", "psip", "xds"]).agg(F.first(F.struct("skip_start_s", "skip_end_s")))
    by = by.withColumnsRenamed({s: f"_{s}" for s in ("epg", "psip", "xds")})
    own = lambda f, on: F.when(col(on), F.col(f))
    pick = lambda f, base: F.coalesce(own(f"_psip.{f}", psip), own(f"_xds.{f}", xds), F.greatest(col(base).cast("double"), F.coalesce(F.col(f"_epg.{f}"), F.lit(0.0))))
    return recordings.join(by, "rec_id", "left").select("rec_id", pick("skip_start_s", skip_start).alias("skip_start_s"), pick("skip_end_s", skip_end).alias("skip_end_s"))


def server_paths(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Recording folders named in settings XML, trimmed, empty ones and repeats (case aside) left out; the first spelling stays."""
    found = F.concat(*[F.transform(F.regexp_extract_all(xml_col, F.lit(rf"(?is)<{t}>(.*?)</{t}>"), F.lit(1)), lambda p: F.trim(p)) for t in PATH_TAGS])
    rows = df.select(F.posexplode(F.filter(found, lambda p: p != "")).alias("ord", "path"))
    return distinct_paths(rows, "ord")


def recording_dirs(configured: DataFrame, usual: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, ord): folders that settings name, then the usual ones that exist; repeats (case aside) left out.

    configured (ord, path) as ``server_paths`` gives it, usual (ord, path), existing (path).
    """
    found = usual.join(existing.select("path").distinct(), "path", "left_semi")
    rows = configured.select("path", F.struct(F.lit(0).alias("layer"), "ord").alias("ord")).unionByName(found.select("path", F.struct(F.lit(1).alias("layer"), "ord").alias("ord")))
    return distinct_paths(rows, "ord")


def distinct_paths(df: DataFrame, order: str, path_col: str = "path") -> DataFrame:
    """The first of the paths that differ in case only."""
    w = W.partitionBy(F.lower(path_col)).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
