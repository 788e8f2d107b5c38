"""Reports over collections of edit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import basename, csv_quoted, folder, report_time
from ..sources.files import is_media

SHOWS_HEADER = "Show,Det_Breaks,Actual_Breaks,Notes"
BREAKS_HEADER = "Show,Break,Det_Start,Det_End,Actual_Start,Actual_End,Notes"


def latest_runs(entries: DataFrame) -> DataFrame:
    """(show, run_ts, path): the latest run of each show; the path that sorts first on ties, and for lists without a run."""
    runs = entries.groupBy("show", "run_ts").agg(F.min("path").alias("path"))
    return runs.groupBy("show").agg(F.max(F.struct("run_ts", "path")).alias("x")).select("show", "x.run_ts", "x.path")


def named(entries: DataFrame, text: str) -> DataFrame:
    """Shows whose name holds the text, case aside."""
    return entries.filter(F.contains(F.lower("show"), F.lit(text.lower())))


def episode_keys(name: Column) -> tuple[Column, Column, Column]:
    """Sort keys of a file name: what stands before season and episode, both as numbers; 9999 and the whole name without them."""
    pattern = r"^(.*?)[Ss](\d+)[Ee](\d+)"
    hit = name.rlike(pattern)
    part = lambda i: F.regexp_extract(name, pattern, i)
    n = lambda i: F.when(hit, part(i).try_cast("int")).otherwise(9999)
    return F.when(hit, part(1)).otherwise(name), n(2), n(3)


def by_episode(df: DataFrame, name: Column) -> DataFrame:
    a, b, c = episode_keys(name)
    return df.withColumns({"prefix": a, "season": b, "episode": c}).orderBy("prefix", "season", "episode")


def numbered(df: DataFrame, *keys: str, parts: int = 32) -> DataFrame:
    """``df`` with ``pos``, the place of each row in the order of ``keys`` from 1, nulls first.

    No task sorts more than a range of the rows: bounds from a sample of the keys, chosen by their hash, deal the rows, and the counts of
    the ranges before are added to a row's place in its own. Rows of equal keys take any order among themselves, and share a range.
    """
    known = df.filter(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys)
    sample = known.orderBy(F.xxhash64(*keys), *keys).limit(parts * 100).orderBy(*keys).collect()
    types = [df.schema[k].dataType for k in keys]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, r, types)]) for r in sample[100::100]]
    part = F.size(F.filter(F.array(*bounds), lambda x: x <= F.struct(*keys))) if bounds else F.lit(0)
    dealt, before, total = df.withColumn("_part", part), {}, 0
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        before[r["_part"]], total = total, total + r["count"]
    offset = F.lit(0).cast("bigint")
    for n, rows in before.items():
        offset = F.when(F.col("_part") == n, F.lit(rows).cast("bigint")).otherwise(offset)
    return dealt.withColumn("pos", F.row_number().over(W.partitionBy("_part").orderBy(*keys)) + offset).drop("_part")


def shows_report(shows: DataFrame, edl: DataFrame) -> DataFrame:
    """(show, det_breaks, line): breaks of each show, 0 for shows without any."""
    n = edl.groupBy("show").agg(F.count("*").alias("n"))
    rows = shows.select("show").distinct().join(n, "show", "left").select("show", F.coalesce("n", F.lit(0)).cast("bigint").alias("det_breaks"))
    return rows.withColumn("line", F.concat_ws(",", csv_quoted(F.col("show")), F.col("det_breaks").cast("string"), F.lit(""), F.lit("")))


def breaks_report(edl: DataFrame) -> DataFrame:
    """(show, break_no, det_start, det_end, line): breaks of each show in order, with as many fields as the header."""
    w = W.partitionBy("show").orderBy("start_s", "end_s")
    rows = edl.select("show", F.row_number().over(w).cast("bigint").alias("break_no"), report_time(F.col("start_s")).alias("det_start"), report_time(F.col("end_s")).alias("det_end"))
    return rows.withColumn("line", F.concat_ws(",", csv_quoted(F.col("show")), F.col("break_no").cast("string"), "det_start", "det_end", F.lit(""), F.lit(""), F.lit("")))


def outcomes(runs: DataFrame) -> DataFrame:
    """(passed, failed) over (ok) of many runs."""
    return runs.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def summary(totals: DataFrame, took: Column | None = None) -> DataFrame:
    """(rec_id, text): what a run tells at its end, from ``segments.totals``; ``took`` are its seconds."""
    one = lambda c: F.format_string("%.1f", c)
    text = F.concat(F.lit("Results: "), F.col("n_breaks").cast("string"), F.lit(" commercial break(s) detected\nTotal commercial time: "), one(F.col("break_s")), F.lit("s\n"))
    return totals.select("rec_id", (text if took is None else F.concat(text, F.lit("Analysis time: "), one(took), F.lit("s\n"))).alias("text"))


def progress_bar(percent: Column) -> Column:
    """Twenty cells, one for each five percent."""
    full = F.floor(percent / 5).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 20 - full), F.lit("] "), F.format_string("%.0f", percent.cast("double")), F.lit("%"))


#: How a log names its levels.
LEVELS = {"Trace": "trce", "Debug": "dbug", "Information": "info", "Warning": "warn", "Error": "fail", "Critical": "crit"}


def log_lines(rows: DataFrame) -> DataFrame:
    """Rows (level, category, event_id, message, exception) with ``text``, two lines each and a third for an exception; level None is left out."""
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in LEVELS.items() for v in kv]), F.col("level")), F.lit("????"))
    text = F.concat(level, F.lit(": "), "category", F.lit("["), F.col("event_id").cast("string"), F.lit("]\n      "), "message", F.lit("\n"), F.coalesce(F.concat(F.lit("      "), F.col("exception"), F.lit("\n")), F.lit("")))
    return rows.filter("level <> 'None'").withColumn("text", text)


def dry_run(files: DataFrame, mode: str = "episode") -> DataFrame:
    """(folder, text): the files of each folder in the order a batch takes them, by season and episode, then path; or by path alone."""
    name = basename(F.col("path"))
    _, season, episode = episode_keys(name)
    known = name.rlike("[Ss](\\d+)[Ee](\\d+)")
    key = F.when(known & F.lit(mode == "episode"), season * 10_000 + episode).otherwise(99_999_999)
    rows = files.select(folder(F.col("path")).alias("folder"), F.struct(key.alias("key"), F.col("path"), name.alias("name")).alias("x"))
    by = rows.groupBy("folder").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    head = F.concat(F.lit("Dry run — "), F.size("xs").cast("string"), F.lit(" file(s) in '"), "folder", F.lit(f"' (sort: {mode}):\n"))
    return by.select("folder", F.concat(head, F.array_join(F.transform("xs", lambda x: F.concat(F.lit("  "), x["name"], F.lit("\n"))), "")).alias("text"))


def media_per_folder(files: DataFrame) -> DataFrame:
    return files.groupBy(folder(F.col("path")).alias("folder")).agg(F.count_if(is_media(F.col("path"))).cast("bigint").alias("n_media"))
