"""From raw documents to packed sequences, in five stages.

Each stage works on all that the one before it kept, written as Parquet and read
again; it returns the columns of ``documents``, the last one packed pieces.  In all stages other
columns pass as they are, ids may repeat or be null, a null text counts as an empty one, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotseam.llm import common, decontam, exact_dedup, near_dup, packing, quality
from spotseam.llm.queries import vocabulary

_KEY = "__spotseam_key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _only(docs: DataFrame, kept: DataFrame, key) -> DataFrame:
    """The rows of ``docs`` whose id and text key are among ``kept``; one row of each that repeats."""
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{_KEY}") == F.col(f"k.{_KEY}"))
    found = docs.withColumn(_KEY, key).alias("d").join(kept.alias("k"), same, "left_semi")
    if not kept.groupBy("doc_id", _KEY).count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", _KEY])
    return found.drop(_KEY)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 and more. Each row is judged by its own text, so rows that repeat stay or go together; empty texts are scored too."""
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, keep=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id, a null id last; of rows that repeat id and text one. Empty and null texts are equal."""
    kept = common.cut(exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias(_KEY)), "kept")
    return _only(docs, kept, F.sha2(exact_dedup.normalised(F.col("text")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, a null id last; of equal ids the smallest text hash; of rows that repeat both one. Texts without words are copies of one another."""
    kept = common.cut(near_dup.near_dedup(docs).filter("kept").select("doc_id", F.col("text_hash").alias(_KEY)), "kept")
    return _only(docs, kept, F.xxhash64("text"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Null and empty texts stay; rows that repeat stay or go together; an empty benchmark takes nothing."""
    return decontam.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; an empty text is its end id alone, and every row counts, repeated or not."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: No stage but exact dedup is SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else common.cut(out, f"stage-{i}")
    return docs
