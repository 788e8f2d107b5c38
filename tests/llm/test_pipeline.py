"""The stages one after another, each held against brute force on its own input."""

import pytest

import corpus_pipeline
from spotseam.llm import common, quality
from tests.llm.test_dedup import brute_classes, brute_overlaps, norm


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = common.cut(stage(spark, docs, sf), "test-stage")
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {d for d, _ in rows}
            break
        assert out.columns == columns
        kept = sorted(r["doc_id"] for r in out.collect())
        if name == "quality classifier":
            model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert kept == sorted(r["doc_id"] for r in quality.score_quality(docs, model).filter("predicted = 1").collect())
        elif name == "exact dedup":
            first = {}
            for d, t in sorted(rows):
                first.setdefault(norm(t), d)
            assert kept == sorted(first.values())
        elif name == "near dedup":
            assert kept == sorted({c for _, c, _ in brute_classes(rows)})
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept == sorted({d for d, _ in rows} - {d for d, _ in brute_overlaps(rows, items)})
        docs = out


def test_run_and_repeated_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "c"), (2, "a  b"), (3, None)], "doc_id long, text string").selectExpr("*", "'x' as node", "1 as kept")
    got = corpus_pipeline.exact(spark, twice, sf)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == [("1", "a b"), ("1", "c"), ("3", "None")]
    assert got.columns == twice.columns


def test_near_dedup_keeps_one_row_of_ids_that_repeat(spark, sf):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, words), (1, words + " x"), (2, words.upper()), (None, "a b"), (None, "A b"), (None, "A  b"), (3, "c d"), (3, "c d"), (3, "e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, df, sf).collect()]
    assert sorted(str(d) for d, _ in kept) == ["1", "3", "3", "None"] and set(kept) <= set(rows)
    assert {t for d, t in kept if d == 3} == {"c d", "e f"}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), sf)
    assert out.count() == 0 and (stage == 4 or out.columns == docs.columns)


@pytest.mark.parametrize("stage", [1, 2, 3])
def test_stages_on_repeated_and_null_ids(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "en", "a", 1), (1, long, "en", "b", 1), (None, long + " x", "en", "a", 1), (None, item, "en", "a", 1), (None, item, "en", "a", 1), (7, None, "en", "a", 0), (7, "", "en", "a", 0), (None, None, None, None, None)]
    out = corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame(rows, docs.schema), sf).collect()
    texts = sorted(str(r["text"])[:6] for r in out)
    if stage == 1:  # one of each text: long, long with x, the item, the empty ones
        assert len(out) == 4
    elif stage == 2:  # the two long ones are near copies
        assert len(out) == 3 and [r["doc_id"] for r in out if (r["text"] or "").startswith("w0")] == [1]
    else:
        assert len(out) == 6 and item[:6] not in texts
