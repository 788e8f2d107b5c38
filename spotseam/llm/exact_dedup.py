"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each normalised text is cut where its own content says so; a chunk becomes a
64-bit identifier; two documents are equal when their ordered identifier lists
are.  The identifiers are verified: of all chunks of one identifier the least and the
greatest of two further hashes are gathered, and where these differ, each of the chunks
gets an ordinal of its own.  Neither documents nor chunks move: only hashes and
the identifier lists do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SALTS, cut, group_figures, need

#: A chunk ends behind one of these letter-space pairs after 256 characters, at 4096 at the latest.
CHUNK = r"(?s).{256,4096}?(?:(?<=[aeilnr] )|$)|.{1,4096}"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _marks(chunk: Column, mask: Column) -> Column:
    """A chunk's identifier and the two hashes that verify it."""
    return F.struct(F.xxhash64(chunk).bitwiseAND(mask).alias("h"), F.xxhash64(F.lit("v"), chunk).alias("v"), F.xxhash64(F.lit("w"), chunk).alias("w"))


def collisions(marks: DataFrame) -> DataFrame:
    """(h, v, w, ord) of the chunks whose identifier another chunk has too; as a rule none. One exchange of three numbers a chunk, combined before it."""
    differ = F.expr("lo_v <> hi_v or lo_w <> hi_w")
    many = marks.groupBy("h").agg(F.min("v").alias("lo_v"), F.max("v").alias("hi_v"), F.min("w").alias("lo_w"), F.max("w").alias("hi_w")).filter(differ).select("h")
    many = cut(many, "shared-identifiers")
    if many.isEmpty():
        return many.select("h", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("ord"))
    shared = marks.join(many, "h", "left_semi").distinct()
    return cut(shared.withColumn("ord", F.row_number().over(W.partitionBy("h").orderBy("v", "w"))), "chunk-collisions")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays.  Null and empty texts are equal to one
    another.  A null id sorts after all others; rows that repeat an id with an
    equal text are one group whose rows all carry ``kept``.  Other
    columns of ``docs`` are left out, so their names cannot clash; an empty table gives an empty one.
    ``hash_bits`` below 64 makes collisions for tests; results don't depend on it.
    """
    need(docs, id_col, text_col)
    mask = F.lit((1 << hash_bits) - 1 if hash_bits < 64 else -1).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    # Rows are numbered as they are written, so that a group can be salted whatever its ids are.
    numbered = base.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("t", 256).alias("text_sha256"), F.transform(chunks(F.col("t")), lambda c: _marks(c, mask)).alias("parts"))
    cut_up = cut(numbered, "chunk-lists")
    twice = collisions(cut_up.select(F.inline("parts")))
    recipe = F.transform("parts", lambda p: p["h"])
    narrow = cut_up.select("doc_id", "row", "text_sha256", recipe.alias("recipe"))
    if not twice.isEmpty():
        narrow = cut(_with_ordinals(cut_up, twice), "recipes")
    figures, salt = group_figures(
        narrow,
        ["recipe"],
        [F.min("doc_id").alias("m"), F.count("*").alias("n")],
        [F.min("m").alias("keep_id"), F.sum("n").alias("group_size")],
        F.col("row"),
    )
    salted = narrow.withColumn(salt, F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    out = salted.join(figures, ["recipe", salt])
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_ordinals(cut_up: DataFrame, twice: DataFrame) -> DataFrame:
    """Recipes with each chunk's ordinal behind its identifier, 0 for chunks that share theirs with no other."""
    hit = cut_up.select("row", F.posexplode("parts").alias("pos", "p")).select("row", "pos", "p.*").join(twice, ["h", "v", "w"], "left")
    ordered = hit.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("ord", F.lit(0)).alias("ord")))).alias("marked"))
    marked = ordered.select("row", F.flatten(F.transform("marked", lambda p: F.array(p["h"], p["ord"].cast("long")))).alias("recipe"))
    return cut_up.select("doc_id", "row", "text_sha256").join(marked, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<bigint>")))
