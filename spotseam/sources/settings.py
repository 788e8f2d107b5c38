"""INI and JSON settings to parameter rows, layered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import items, switch

#: Parameter, section, key, kind and default of the detection settings.
KEYS = [
    ("window_size", "General", "window_size", "double", 1.0),
    ("frame_sample_rate", "General", "frame_sample_rate", "double", 2.0),
    ("threshold", "Detection", "commercial_threshold", "double", 0.5),
    ("smoothing_radius", "Detection", "smoothing_radius", "int", 3),
    ("min_commercial", "Detection", "min_commercial_seconds", "double", 30.0),
    ("max_commercial", "Detection", "max_commercial_seconds", "double", 600.0),
    ("merge_gap", "Detection", "commercial_merge_gap", "double", 0.0),
    ("skip_start", "Detection", "skip_start_seconds", "double", 0.0),
    ("skip_end", "Detection", "skip_end_seconds", "double", 0.0),
    ("bf_weight", "BlackFrame", "weight", "double", 0.25),
    ("bf_min_count", "BlackFrame", "min_count", "int", 1),
    ("bf_use_clustering", "BlackFrame", "use_clustering", "boolean", False),
    ("bf_cluster_max_gap", "BlackFrame", "cluster_max_gap", "double", 20.0),
    ("bf_cluster_min_duration", "BlackFrame", "cluster_min_duration", "double", 60.0),
    ("bf_cluster_min_events", "BlackFrame", "cluster_min_events", "int", 4),
    ("sc_weight", "SceneChange", "weight", "double", 0.35),
    ("sc_invert", "SceneChange", "scene_change_invert", "boolean", False),
    ("sc_threshold", "SceneChange", "threshold", "double", 0.35),
    ("silence_weight", "Silence", "weight", "double", 0.15),
    ("logo_enabled", "Logo", "enabled", "boolean", True),
    ("logo_weight", "Logo", "weight", "double", 0.25),
    ("logo_learn_duration", "Logo", "learn_duration", "double", 120.0),
    ("logo_learn_start", "Logo", "learn_start", "double", -1.0),
    ("logo_reference_seconds", "Logo", "reference_seconds", "double", -1.0),
    ("logo_scene_threshold", "Logo", "scene_threshold", "double", 0.20),
    ("logo_cluster_min_events", "Logo", "cluster_min_events", "int", 5),
    ("logo_cluster_max_gap", "Logo", "cluster_max_gap", "double", 35.0),
    ("logo_cluster_min_duration", "Logo", "cluster_min_duration", "double", 30.0),
    ("logo_ssim_threshold", "Logo", "logo_ssim_threshold", "double", 0.50),
    ("logo_corner_filter_ratio", "Logo", "logo_corner_filter_ratio", "double", 1.5),
    ("logo_ticker_threshold", "Logo", "corner_ticker_threshold", "double", 0.5),
    ("logo_crop_size", "Logo", "logo_crop_size", "double", 0.10),
    ("logo_x_inset", "Logo", "logo_x_inset", "double", 0.0),
    ("logo_y_inset", "Logo", "logo_y_inset", "double", 0.0),
    ("letterbox_enabled", "Letterbox", "enabled", "boolean", False),
    ("letterbox_weight", "Letterbox", "weight", "double", 0.50),
    ("letterbox_min_duration", "Letterbox", "min_duration", "double", 5.0),
    ("letterbox_pic_threshold", "Letterbox", "pic_threshold", "double", 0.85),
    ("aspect_enabled", "AspectRatio", "enabled", "boolean", True),
    ("aspect_weight", "AspectRatio", "weight", "double", 0.05),
    ("audio_enabled", "AudioFingerprint", "enabled", "boolean", False),
    ("audio_weight", "AudioFingerprint", "weight", "double", 0.05),
    ("psip_enabled", "Psip", "enabled", "boolean", True),
    ("xds_enabled", "Xds", "enabled", "boolean", True),
    ("output_formats", "Output", "formats", "formats", ["Edl"]),
]
#: The settings of the two presets that differ from the defaults.
PRESETS = {
    "fast": {"frame_sample_rate": 1.0, "logo_enabled": False, "aspect_enabled": False, "audio_enabled": False},
    "accurate": {"frame_sample_rate": 4.0, "logo_enabled": True, "aspect_enabled": True, "audio_enabled": True, "threshold": 0.45},
}
#: The output formats.
FORMATS = ("Edl", "ComskipTxt", "MkvChapters", "Json", "FFMetadata")


def _bare(value: Column) -> Column:
    """What lies between double quotes at the start; else without an inline comment: at the first ; else at the first #, if behind something."""
    v = F.trim(value)
    close = F.locate('"', v, 2)
    semi, mark = F.instr(v, ";"), F.instr(v, "#")
    cut = F.when(semi > 0, semi).otherwise(mark)
    plain = F.when(cut > 1, F.trim(F.substr(v, F.lit(1), cut - 1))).otherwise(v)
    return F.when(~F.startswith(v, F.lit('"')), plain).when(close > 0, F.substr(v, F.lit(2), close - 2)).otherwise(v)


def _remark(value: Column) -> Column:
    """The inline comment that ``_bare`` cuts off; null for none."""
    v = F.trim(value)
    semi, mark = F.instr(v, ";"), F.instr(v, "#")
    cut = F.when(semi > 0, semi).otherwise(mark)
    return F.when(~F.startswith(v, F.lit('"')) & (cut > 1), F.trim(F.substr(v, cut + 1)))


def parse_ini(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, line_no, section, key, value, remark): each key once, its last value and inline comment; names compare without case."""
    lines = texts.select(F.col(file_col).alias("file"), F.posexplode(F.split(text_col, "\r?\n")).alias("line_no", "raw"))
    lines = lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.trim("raw").alias("raw"))
    head = F.when(F.col("raw").rlike(r"^\[.*\]$"), F.trim(F.regexp_extract("raw", r"^\[(.*)\]$", 1)))
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("_head", head).withColumn("section", F.coalesce(F.last("_head", True).over(w), F.lit("General")))
    at = F.instr("raw", "=")
    pairs = placed.filter(F.col("_head").isNull() & (F.col("raw") != "") & ~F.col("raw").rlike("^[#;]") & (at > 1))
    pairs = pairs.select("file", "line_no", "section", F.trim(F.substr("raw", F.lit(1), at - 1)).alias("key"), _bare(F.substr(F.col("raw"), at + 1)).alias("value"), _remark(F.substr(F.col("raw"), at + 1)).alias("remark"))
    return pairs.groupBy("file", F.lower("section").alias("_s"), F.lower("key").alias("_k")).agg(F.max("line_no").alias("line_no"), F.max_by("section", "line_no").alias("section"), F.max_by("key", "line_no").alias("key"), F.max_by("value", "line_no").alias("value"), F.max_by("remark", F.when(F.col("remark").isNotNull(), F.col("line_no"))).alias("remark")).drop("_s", "_k")


def header_comments(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, line_no, comment): comment lines before the first key and any section."""
    lines = texts.select(F.col(file_col).alias("file"), F.posexplode(F.split(text_col, "\r?\n")).alias("line_no", "raw")).withColumn("raw", F.trim("raw"))
    other = ~F.col("raw").rlike("^[#;]") & (F.col("raw").rlike(r"^\[.*\]$") | (F.instr("raw", "=") > 1))
    before = F.max(F.when(other, 1).otherwise(0)).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)) == 0
    return lines.withColumn("_before", before).filter(F.col("_before") & F.col("raw").rlike("^[#;]")).select("file", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_replace("raw", "^[#; ]+", "").alias("comment"))


def render_ini(kv: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """(file, text): header comments, sections in order of first appearance, keys in order of lines with their inline comments (``remark``)."""
    if "remark" not in kv.columns:
        kv = kv.withColumn("remark", F.lit(None).cast("string"))
    first = F.min("line_no").over(W.partitionBy("file", F.lower("section")))
    rows = kv.withColumn("_first", first)
    lines = F.concat_ws("\n", F.concat(F.lit("["), F.min_by("section", "line_no"), F.lit("]")), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "key", "value", "remark"))), lambda x: F.concat(x["key"], F.lit("="), x["value"], F.coalesce(F.concat(F.lit("  ; "), x["remark"]), F.lit("")))), "\n"))
    sections = rows.groupBy("file", "_first").agg(lines.alias("t"))
    out = sections.groupBy("file").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_first", "t"))), lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("text"))
    if comments is None:
        return out
    head = comments.groupBy("file").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "comment"))), lambda x: F.concat(F.lit("# "), x["comment"])), "\n"), F.lit("\n\n")).alias("head"))
    return out.join(head, "file", "left").select("file", F.concat(F.coalesce("head", F.lit("")), F.col("text")).alias("text"))


def typed(value: Column, kind: str) -> Column:
    """The value, or null where it doesn't parse: a lower layer then counts."""
    if kind == "boolean":
        return switch(value, F.lit(None).cast("boolean"))
    if kind == "formats":
        known = F.create_map(*[F.lit(v) for f in FORMATS for v in (f.lower(), f)])
        found = F.filter(F.transform(items(value), lambda v: F.try_element_at(known, F.lower(F.replace(v, F.lit("_"), F.lit(""))))), lambda v: v.isNotNull())
        return F.when(F.size(found) > 0, found)
    return F.trim(value).try_cast(kind)


def params_of(kv: DataFrame) -> DataFrame:
    """One row a file, one typed column a parameter; null where the file doesn't set it."""
    name = F.concat(F.lower("section"), F.lit("."), F.lower("key"))
    by = kv.withColumn("_name", name).groupBy("file").agg(*[F.max(F.when(F.col("_name") == f"{s}.{k}".lower(), F.col("value"))).alias(p) for p, s, k, *_ in KEYS])
    return by.select("file", *[typed(F.col(p), t).alias(p) for p, _, _, t, _ in KEYS])


def with_defaults(params: DataFrame, preset: str | None = None) -> DataFrame:
    """Every setting as a column that is never null: the row's own value, else the preset's, else the default."""
    own = {p: d for p, _, _, _, d in KEYS} | PRESETS.get(preset, {})
    value = lambda p, k: F.array(*map(F.lit, own[p])) if k == "formats" else F.lit(own[p]).cast(k)
    return params.withColumns({p: F.coalesce(F.col(p), value(p, k)) if p in params.columns else value(p, k) for p, _, _, k, _ in KEYS})


def overlay(layers: DataFrame, order: str = "layer", by: str = "profile") -> DataFrame:
    """Rows of the same profile laid over one another: for each parameter the value of the highest layer that sets it."""
    return layers.groupBy(by).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in layers.columns if c not in (order, by)])


def params_json(df: DataFrame) -> DataFrame:
    """Parameters as indented JSON in camel case."""
    camel = lambda c: c.split("_")[0] + "".join(x.title() for x in c.split("_")[1:])
    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns]), {"pretty": "true"}).alias("json"))


def params_from_json(df: DataFrame, schema: str, json_col: str = "json") -> DataFrame:
    """JSON replaces all settings: what it leaves out is null here, a default to its reader. Names compare without case."""
    lower = F.from_json(json_col, "map<string,string>")
    fields = [f.strip().split(" ") for f in schema.split(",")]
    keyed = df.withColumn("_m", F.transform_keys(lower, lambda k, _: F.lower(k)))
    return keyed.select(*[F.try_element_at("_m", F.lit(n.replace("_", "").lower())).try_cast(t).alias(n) for n, t in fields])
