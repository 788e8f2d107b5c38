"""Cut plans: the command lines that would chapter or cut a recording, as text columns. Nothing is run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import clock, col, extension, filled, folder, padded, seconds3, stem
from ..operators.score import PROGRAM


@dataclass(frozen=True)
class CutParams:
    mode: str = "Chapter"  # Skip, Chapter, Cut, Both
    method: str = "Concat"  # Concat, SmartReencode, Reencode
    container: str = "Original"  # Original, Mkv, Mp4, Ts
    video_codec: str = "copy"
    video_preset: str = ""
    crf: int = 0
    resolution: str = ""
    pixel_format: str = ""
    hw_accel: str = "None"  # None, Nvenc, Qsv, Vaapi, VideoToolbox, Amf
    audio_codec: str = "copy"
    audio_bitrate: str = ""
    audio_sample_rate: str = ""
    audio_channels: str = ""
    normalize: bool = False
    normalize_target: str = "-24"
    subtitles: str = "all"
    copy_metadata: bool = True
    processing_info: bool = False
    deinterlace: str = "None"  # None, Auto, Yadif, Bwdif
    extra_filters: str = ""
    extra_args: str = ""
    log_level: str = "warning"
    name_pattern: str = "{name}.{mode}.{ext}"
    chapter_tool: str = "auto"
    overwrite: bool = False
    processed_by: str = "spotseam"


#: Suffix of hardware codecs, extension of containers.
HARDWARE = {"Nvenc": "nvenc", "Qsv": "qsv", "Vaapi": "vaapi", "VideoToolbox": "videotoolbox", "Amf": "amf"}
CONTAINERS = {"Mkv": ".mkv", "Mp4": ".mp4", "Ts": ".ts"}


def _head(p: CutParams) -> list[str]:
    device = ["-vaapi_device /dev/dri/renderD128"] if p.hw_accel == "Vaapi" else []
    return ["-hide_banner", *device, f"-loglevel {p.log_level}", "-y"]


def video_args(p: CutParams) -> list[str]:
    codec = p.video_codec
    if p.hw_accel in HARDWARE:
        codec = f"{'hevc' if '265' in codec or 'hevc' in codec else 'h264'}_{HARDWARE[p.hw_accel]}"
    out = ["-vf 'format=nv12,hwupload'"] if p.hw_accel == "Vaapi" else []
    out.append(f"-c:v {codec}")
    if codec != "copy":
        presets = any(x in codec for x in ("264", "265", "libsvt"))
        quality = "-cq" if "nvenc" in codec else "-crf"
        optional = [(p.video_preset if presets else "", "-preset"), (str(p.crf) if p.crf > 0 else "", quality), (p.resolution, "-s"), (p.pixel_format, "-pix_fmt")]
        out += [f"{flag} {value}" for value, flag in optional if value]
    return out + ([p.extra_args] if p.extra_args else [])


def audio_args(p: CutParams) -> list[str]:
    out = [f"-c:a {p.audio_codec}"]
    if p.audio_codec != "copy":
        out += [f"{flag} {value}" for value, flag in ((p.audio_bitrate, "-b:a"), (p.audio_sample_rate, "-ar"), (p.audio_channels, "-ac")) if value]
        out += [f"-af loudnorm=I={p.normalize_target}:TP=-1.5:LRA=11"] if p.normalize else []
    return out


def subtitle_args(p: CutParams) -> list[str]:
    return {"all": ["-c:s copy"], "by_language": ["-c:s copy"], "none": ["-sn"], "first": ["-map 0:s:0?", "-c:s copy"]}.get(p.subtitles.lower(), [])


def metadata_args(p: CutParams, today) -> list[Column]:
    note = F.concat(F.lit(f'-metadata comment="Processed by {p.processed_by} on '), F.date_format(col(today), "yyyy-MM-dd"), F.lit('"'))
    return ([F.lit("-map_metadata 0")] if p.copy_metadata else []) + ([note] if p.processing_info else [])


def filter_chain(p: CutParams) -> str:
    first = {"Yadif": "yadif", "Bwdif": "bwdif", "Auto": "bwdif=mode=send_field:parity=auto:deint=interlaced"}.get(p.deinterlace, "")
    return ",".join(x for x in [first, *(f.strip() for f in p.extra_filters.split(","))] if x)


def _line(*parts) -> Column:
    flat = [q for part in parts for q in (part if isinstance(part, list) else [part])]
    return F.concat_ws(" ", *[col(x) for x in flat])


def _quoted(text) -> Column:
    return F.concat(F.lit('"'), col(text), F.lit('"'))


def _input(path) -> Column:
    return F.concat(F.lit("-i "), _quoted(path))


def output_extension(path: Column, p: CutParams) -> Column:
    return F.lit(CONTAINERS[p.container]) if p.container in CONTAINERS else extension(path)


def output_path(path: Column, p: CutParams, today) -> Column:
    """The name pattern filled in; ``.cut`` goes in where that would be the input itself, case aside."""
    ext = output_extension(path, p)
    where = F.when(F.contains(path, F.lit("/")), F.concat(folder(path), F.lit("/"))).otherwise("")
    made = F.concat(where, filled(p.name_pattern, name=stem(path), ext=F.ltrim(ext, F.lit(".")), mode=p.mode.lower(), date=F.date_format(col(today), "yyyy-MM-dd")))
    return F.when(F.lower(made) == F.lower(path), F.concat(where, stem(path), F.lit(".cut"), ext)).otherwise(made)


def steps(recordings: DataFrame, p: CutParams) -> DataFrame:
    """(rec_id, step): what a mode consists of."""
    made = {"Skip": ["markers"], "Chapter": ["chapter"], "Cut": ["cut"], "Both": ["chapter", "cut"]}[p.mode]
    return recordings.select("rec_id", F.explode(F.array(*map(F.lit, made))).alias("step"))


def needs_encoding(p: CutParams) -> bool:
    return p.container != "Original" or p.video_codec != "copy" or p.audio_codec != "copy"


def segment_plan(segments: DataFrame, recordings: DataFrame, p: CutParams, temp: str = "/tmp") -> DataFrame:
    """(rec_id, seg, seg_path, args): extraction of each programme segment, numbered from 0."""
    w = W.partitionBy("rec_id").orderBy("start_us")
    rows = segments.filter(F.col("type") == PROGRAM).select("rec_id", "start_us", "end_us", (F.row_number().over(w) - 1).cast("bigint").alias("seg")).join(recordings.select("rec_id", "path"), "rec_id")
    path = F.col("path")
    ext = output_extension(path, p) if needs_encoding(p) else extension(path)
    rows = rows.withColumn("seg_path", F.concat(F.lit(f"{temp}/"), stem(path), F.lit("_seg"), padded(F.col("seg"), 3), ext))
    from_to = [F.concat(F.lit("-ss "), clock(F.col("start_us"))), _input(path), F.concat(F.lit("-t "), clock(F.col("end_us") - F.col("start_us")))]
    coding = ["-avoid_negative_ts make_zero", *video_args(p), *audio_args(p)] if needs_encoding(p) else ["-c copy", "-avoid_negative_ts make_zero"]
    head = _head(p) if needs_encoding(p) else _head(CutParams(log_level=p.log_level))
    return rows.select("rec_id", "seg", "seg_path", _line(head, from_to, coding, _quoted(F.col("seg_path"))).alias("args"))


def concat_args(list_path, out_path, p: CutParams) -> Column:
    return _line(_head(CutParams(log_level=p.log_level)), ["-f concat", "-safe 0"], _input(list_path), "-c copy", subtitle_args(p), _quoted(out_path))


def remux_args(path, out_path, p: CutParams, today) -> Column:
    return _line(_head(CutParams(log_level=p.log_level)), _input(path), ["-map 0", "-c copy"], metadata_args(p, today), subtitle_args(p), _quoted(out_path))


def chapter_args(path, metadata_path, out_path, p: CutParams) -> Column:
    return _line(_head(CutParams(log_level=p.log_level)), _input(path), _input(metadata_path), ["-map_metadata 1", "-map_chapters 1", "-c copy"], _quoted(out_path))


def chapter_tool(path: Column, p: CutParams, has_mkvmerge: bool) -> Column:
    """mkvmerge where it is asked for, or for Matroska output, and installed; else ffmpeg."""
    wanted = F.lit(p.chapter_tool.lower() == "mkvmerge") | (F.lit(p.chapter_tool.lower() == "auto") & (F.lower(output_extension(path, p)) == ".mkv"))
    return F.when(wanted & F.lit(has_mkvmerge), "mkvmerge").otherwise("ffmpeg")


def graph(parts: Column, chain: str = "") -> Column:
    """The filter graph over sorted (start_us, end_us): trims of video, then of audio, then one interleaved concat."""
    cut = lambda x: F.concat(F.lit("trim=start="), seconds3(x["start_us"]), F.lit(":end="), seconds3(x["end_us"]), F.lit(","))
    at = lambda i: i.cast("string")
    video = F.transform(parts, lambda x, i: F.concat(F.lit("[0:v]"), cut(x), F.lit("setpts=PTS-STARTPTS[v"), at(i), F.lit("]")))
    audio = F.transform(parts, lambda x, i: F.concat(F.lit("[0:a]a"), cut(x), F.lit("asetpts=PTS-STARTPTS[a"), at(i), F.lit("]")))
    ends = F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("[v"), at(i), F.lit("][a"), at(i), F.lit("]"))), "")
    join = F.concat(ends, F.lit("concat=n="), F.size(parts).cast("string"), F.lit(":v=1:a=1[outv][outa]"))
    last = F.array(F.lit(f"[outv]{chain}[outv2]")) if chain else F.array().cast("array<string>")
    return F.array_join(F.concat(video, audio, F.array(join), last), ";")


def graph_plan(segments: DataFrame, recordings: DataFrame, p: CutParams, today) -> DataFrame:
    """(rec_id, out_path, args): one encoding of all programme segments; filters go in only when all is encoded anew."""
    chain = filter_chain(p) if p.method == "Reencode" else ""
    parts = segments.filter(F.col("type") == PROGRAM).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("start_us", "end_us"))).alias("parts"))
    rows = recordings.select("rec_id", "path").join(parts, "rec_id").withColumn("out_path", output_path(F.col("path"), p, today))
    filters = F.concat(F.lit('-filter_complex "'), graph(F.col("parts"), chain), F.lit('"'))
    maps = [f'-map "[outv{"2" if chain else ""}]"', '-map "[outa]"']
    return rows.select("rec_id", "out_path", _line(_head(p), _input(F.col("path")), filters, maps, video_args(p), audio_args(p), metadata_args(p, today), _quoted(F.col("out_path"))).alias("args"))


def saved_percent(old_bytes: Column, new_bytes: Column) -> Column:
    return (F.lit(1.0) - F.try_divide(new_bytes, old_bytes)) * 100


def not_yet(plan: DataFrame, existing: DataFrame, p: CutParams) -> DataFrame:
    """Without outputs that exist, unless these may be overwritten."""
    return plan if p.overwrite else plan.join(existing.select(F.col("path").alias("out_path")).distinct(), "out_path", "left_anti")
