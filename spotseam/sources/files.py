"""File listings: which recordings to take up, which edit lists to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import basename, extension, glob_regex, stem, with_extension

#: Extensions of recordings, of those that are watched for, of those that a batch takes, and of each output format.
MEDIA = (".ts", ".mpg", ".mpeg", ".mp4", ".mkv", ".avi", ".wtv", ".m4v", ".mov")
WATCHED = (".ts", ".mpg", ".mpeg", ".mp4", ".mkv")
BATCH = (".ts", ".mpg", ".mpeg", ".mp4", ".mkv", ".avi", ".wtv", ".m4v")
FORMATS = {"Edl": ".edl", "ComskipTxt": ".txt", "MkvChapters": ".chapters.xml", "Json": ".breaks.json", "FFMetadata": ".ffmeta"}
DONE_MARK = "FILE PROCESSING COMPLETE"


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, modified) of all files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def batch_listing(spark: SparkSession, path: str) -> DataFrame:
    """The recordings that a batch takes from one folder, not from those below."""
    return candidates(listing(spark, path, recursive=False), extensions=BATCH)


def megabytes(length: Column) -> Column:
    return length / (1024.0 * 1024.0)


def is_media(path: Column, extensions=MEDIA) -> Column:
    return F.lower(extension(path)).isin(*extensions)


def excluded(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | basename(path).rlike(glob_regex(p))
    return out


def candidates(files: DataFrame, patterns: list[str] = (), min_bytes: int = 0, extensions=MEDIA) -> DataFrame:
    """Recordings by extension that no pattern excludes and that are large enough."""
    return files.filter(is_media(F.col("path"), extensions) & ~excluded(F.col("path"), list(patterns)) & (F.col("length") >= min_bytes))


def unprocessed(files: DataFrame, outputs: DataFrame, formats: list[str] = ("Edl",)) -> DataFrame:
    """Files without any output of the formats, an edit list, or a finished text mark beside them.

    ``outputs`` is (path) of what lies there; for ``.txt`` files also first_line, which must tell of the
    mark unless text is one of the formats.
    """
    finished = F.lit("ComskipTxt" in formats) | ~F.endswith(F.lower("path"), F.lit(".txt")) | F.contains(F.coalesce("first_line", F.lit("")), F.lit(DONE_MARK))
    made = outputs.filter(finished).select(F.col("path").alias("_out")).distinct()
    wanted = sorted({FORMATS[f] for f in formats} | {".edl", ".txt"})
    hoped = files.select("path", F.explode(F.array(*[with_extension(F.col("path"), e) for e in wanted])).alias("_out"))
    return files.join(hoped.join(made, "_out").select("path").distinct(), "path", "left_anti")


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, first_line) of text files that have any content; for those that merely lie there see ``listing``."""
    texts = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.rtrim(F.substring_index("value", "\n", 1), F.lit("\r")).alias("first_line"))


def stale(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files last written before so many days ago; a report, nothing is deleted."""
    return files.filter(F.col("modified") < now - F.make_interval(days=F.lit(days)))


def archive_entries(files: DataFrame) -> DataFrame:
    """(path, show, run_ts) of ``Show_YYYYMMDD_HHMMSS.edl``; names no longer than the stamp are left out."""
    name = stem(F.col("path"))
    lists = files.filter(F.lower(extension(F.col("path"))) == ".edl").withColumn("_name", name).filter(F.length("_name") > 16)
    return lists.select("path", F.expr("substring(_name, 1, length(_name) - 16)").alias("show"), F.expr("substring(_name, -15)").alias("run_ts"))


def alongside_entries(files: DataFrame) -> DataFrame:
    """(path, show, run_ts) of edit lists that lie beside their recordings: the show is the name, and there is no run."""
    lists = files.filter(F.endswith("path", F.lit(".edl")))
    return lists.select("path", stem(F.col("path")).alias("show"), F.lit(None).cast("string").alias("run_ts"))


def edl_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(…, start_s, end_s, action) of the lines that begin with a digit."""
    parts = F.split(F.trim(line_col), r"\s+")
    keep = [c for c in lines.columns if c != line_col]
    return lines.filter(F.col(line_col).rlike("^[0-9]")).select(*keep, parts[0].try_cast("double").alias("start_s"), F.get(parts, F.lit(1)).try_cast("double").alias("end_s"), F.get(parts, F.lit(2)).try_cast("int").alias("action"))


def first_existing(places: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, path): of each name's candidate places, in order of priority, the first that exists."""
    return places.join(existing.select("path").distinct(), "path").groupBy("name").agg(F.min_by("path", "priority").alias("path"))
