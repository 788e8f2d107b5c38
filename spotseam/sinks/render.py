"""Segments to the text of edit lists, chapter files and JSON; one row a recording.

``segments`` are numbered ones (see ``operators.segments.numbered``); ``recordings`` have
rec_id, path, duration_us, frame_rate, width and height.  A recording without any segment still has its file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, filled, frame, mkv_time, seconds3, span_text, stem, with_extension
from ..operators.score import COMMERCIAL
from ..sources.files import FORMATS

PROGRAM_LABEL, COMMERCIAL_LABEL = "Part {number}", "Commercial Break {number}"


def gathered(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings with their segments in time order in ``segs``, none as an empty array: one exchange whatever is rendered from them."""
    one = F.struct("start_us", "end_us", "type", "type_no", "confidence")
    by = segments.groupBy("rec_id").agg(F.sort_array(F.collect_list(one)).alias("segs"))
    none = F.array().cast(by.schema["segs"].dataType)
    return recordings.join(by, "rec_id", "left").withColumn("segs", F.coalesce("segs", none))


def _lines(line: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    segs = F.col("segs") if keep is None else F.filter("segs", keep)
    return F.array_join(F.transform(segs, line), "")


def _is_break(s: Column) -> Column:
    return s["type"] == COMMERCIAL


def title(s: Column, program: str = PROGRAM_LABEL, commercial: str = COMMERCIAL_LABEL) -> Column:
    """A label with its number among the segments of its type."""
    return F.when(_is_break(s), filled(commercial, number=s["type_no"])).otherwise(filled(program, number=s["type_no"]))


def edl_text() -> Column:
    return _lines(lambda s: F.concat(seconds3(s["start_us"]), F.lit(" "), seconds3(s["end_us"]), F.lit(" 3\n")), _is_break)


def comskip_text() -> Column:
    """Frames at the recording's rate, 29.97 where it isn't known."""
    rate = F.when(F.col("frame_rate") > 0, F.col("frame_rate")).otherwise(29.97)
    number = lambda c: frame(c, rate).cast("string")
    rows = _lines(lambda s: F.concat(number(s["start_us"]), F.lit("\t"), number(s["end_us"]), F.lit("\n")), _is_break)
    return F.concat(F.lit("FILE PROCESSING COMPLETE  "), basename(F.col("path")), F.lit("\n"), rows)


def mkv_text(program: str = PROGRAM_LABEL, commercial: str = COMMERCIAL_LABEL, hide: bool = True, default_edition: bool = True) -> Column:
    tag = lambda indent, name, value: F.concat(F.lit(f"{' ' * indent}<{name}>"), value, F.lit(f"</{name}>\n"))
    atom = lambda s: F.concat(
        F.lit("    <ChapterAtom>\n"),
        tag(6, "ChapterTimeStart", mkv_time(s["start_us"])),
        tag(6, "ChapterTimeEnd", mkv_time(s["end_us"])),
        F.when(_is_break(s) & F.lit(hide), "      <ChapterFlagHidden>1</ChapterFlagHidden>\n").otherwise(""),
        F.lit("      <ChapterDisplay>\n"),
        tag(8, "ChapterString", title(s, program, commercial)),
        F.lit("        <ChapLanguageIETF>en</ChapLanguageIETF>\n      </ChapterDisplay>\n    </ChapterAtom>\n"),
    )
    edition = "    <EditionFlagDefault>1</EditionFlagDefault>\n" if default_edition else ""
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<Chapters>\n  <EditionEntry>\n{edition}'), _lines(atom), F.lit("  </EditionEntry>\n</Chapters>\n"))


def ffmetadata_text(program: str = PROGRAM_LABEL, commercial: str = COMMERCIAL_LABEL) -> Column:
    ms = lambda c: F.floor(c / 1000).cast("string")
    block = lambda s: F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), ms(s["start_us"]), F.lit("\nEND="), ms(s["end_us"]), F.lit("\ntitle="), title(s, program, commercial), F.lit("\n"))
    return F.concat(F.lit(";FFMETADATA1\n"), _lines(block))


def json_text(timed: bool = False, pretty: bool = True) -> Column:
    """A summary with all segments; confidences rounded half to even at four places; with ``timed`` also when the analysis ran and how long."""
    one = lambda s: F.struct((s["start_us"] / 1e6).alias("start"), (s["end_us"] / 1e6).alias("end"), ((s["end_us"] - s["start_us"]) / 1e6).alias("duration"), s["type"].alias("type"), F.bround(s["confidence"], 4).alias("confidence"))
    utc = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    took = F.unix_micros("completed_at") - F.unix_micros("started_at")
    times = [utc("started_at").alias("analysisStarted"), utc("completed_at").alias("analysisCompleted"), span_text(took).alias("analysisDuration")] if timed else []
    doc = F.struct(F.col("path").alias("sourceFile"), span_text(F.col("duration_us")).alias("totalDuration"), F.col("frame_rate").alias("frameRate"), F.concat_ws("x", "width", "height").alias("resolution"), *times, F.transform("segs", one).alias("segments"))
    return F.to_json(doc, {"pretty": str(pretty).lower()})


def _file(segments: DataFrame, recordings: DataFrame, text: Column) -> DataFrame:
    return gathered(segments, recordings).select("rec_id", text.alias("text"))


def edl(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    return _file(segments, recordings, edl_text())


def comskip(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    return _file(segments, recordings, comskip_text())


def mkv_chapters(segments: DataFrame, recordings: DataFrame, program: str = PROGRAM_LABEL, commercial: str = COMMERCIAL_LABEL, hide: bool = True, default_edition: bool = True) -> DataFrame:
    return _file(segments, recordings, mkv_text(program, commercial, hide, default_edition))


def ffmetadata(segments: DataFrame, recordings: DataFrame, program: str = PROGRAM_LABEL, commercial: str = COMMERCIAL_LABEL) -> DataFrame:
    return _file(segments, recordings, ffmetadata_text(program, commercial))


def _timed(recordings: DataFrame) -> bool:
    return {"started_at", "completed_at"} <= set(recordings.columns)


def json_result(segments: DataFrame, recordings: DataFrame, pretty: bool = True) -> DataFrame:
    return _file(segments, recordings, json_text(_timed(recordings), pretty))


def render(segments: DataFrame, recordings: DataFrame, formats: list[str] | Column) -> DataFrame:
    """(rec_id, format, path, text) of each requested format, beside the recording; ``formats`` may be a column, each recording's own."""
    texts = {"Edl": edl_text, "ComskipTxt": comskip_text, "MkvChapters": mkv_text, "Json": lambda: json_text(_timed(recordings)), "FFMetadata": ffmetadata_text}
    wanted = formats if isinstance(formats, Column) else F.array(*map(F.lit, formats))
    files = [F.struct(F.lit(f).alias("format"), with_extension(F.col("path"), FORMATS[f]).alias("path"), F.when(F.array_contains(wanted, f), text()).alias("text")) for f, text in texts.items()]
    return gathered(segments, recordings).select("rec_id", F.inline(F.array(*files))).filter("text is not null")


def archive_name(path: Column, at: Column) -> Column:
    """``stem_yyyyMMdd_HHmmss.edl``."""
    return F.concat(stem(path), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".edl"))


def write_rendered(rendered: DataFrame, folder: str) -> DataFrame:
    """Writes each text to its own file below a folder that all executors see, and returns (path, bytes) of what was written."""
    import pyarrow as pa
    import pyarrow.fs

    def write(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            sizes = []
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist()):
                raw = text.encode()
                fs.create_dir(root, recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as sink:  # the same bytes if a task runs again
                    sink.write(raw)
                sizes.append(len(raw))
            yield pa.record_batch([b.column("name"), pa.array(sizes, pa.int64())], ["name", "bytes"])

    named = rendered.select(F.concat(F.col("rec_id").cast("string"), F.lit("-"), basename(F.col("path"))).alias("name"), "text")
    return named.mapInArrow(write, "name string, bytes long")


def concat_list(paths: Column) -> Column:
    """The text that lists files to be joined, quotes escaped."""
    one = lambda p: F.concat(F.lit("file '"), F.replace(p, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.array_join(F.transform(paths, one), "\n")

