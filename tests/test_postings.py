"""Stored postings give the scores of the scan, after any batches."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import search
from quillgraph.operators.postings import Postings

QUERIES = ["red fox", "jumping foxes", "the", "", "blue", "lazy dogs and cats", "nothing"]
WORDS = ["red", "fox", "foxes", "jumps", "jumped", "over", "the", "lazy", "dog", "dogs", "blue", "cat"]


def frame(spark, docs):
    return spark.createDataFrame([(k, t, b) for k, (t, b) in docs.items()], "id long, title string, body string")


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def test_batches_give_the_scan_s_scores(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randrange(n)))
    index, now = Postings(spark, str(tmp_path / "i"), ("title", "body")), {}
    assert index.search("fox").collect() == []
    for batch in range(4):
        new = {rng.randrange(20): (text(4), text(12)) for _ in range(8)}
        gone = [k for k in list(now) if k not in new and rng.random() < 0.2] + [99]
        index.add(frame(spark, new), spark.createDataFrame([(k,) for k in gone], "id long"))
        now = {k: v for k, v in (now | new).items() if k not in gone}
        if batch == 2:
            index.merge()
            assert index.at.names("docs") == ["4"]
        for q in QUERIES:
            assert scores(index.search(q, None)) == scores(search.bm25(frame(spark, now), "id", q, {"title": "title", "body": "body"}, None)), (batch, q)
    assert [r["id"] for r in index.search("red fox", 3).collect()] == [r["id"] for r in search.bm25(frame(spark, now), "id", "red fox", {"title": "title", "body": "body"}, 3).collect()]


def test_only_the_query_s_terms_are_read(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), ("body",))
    index.add(spark.range(2000).select("id", F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id"))).alias("body")))
    rows = index.rows(["w77"])
    assert rows.count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "spread" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,w77)" in plan
    files = rows.inputFiles()
    assert len({f.split("spread=")[1].split("/")[0] for f in files}) >= 1
    read = index.rows(["w77"]).select(F.input_file_name().alias("f")).distinct().count()
    assert read == 1 < len(files)


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), ("body",))
    index.add(spark.createDataFrame([(1, "fox")], "id long, body string"))
    spark.createDataFrame([("fox", "body", 2, 1, 1, 0)], "term string, field string, id long, tf int, len int, spread int").write.partitionBy("spread").parquet(f"{tmp_path}/i/postings/2")
    assert [r["id"] for r in index.search("fox").collect()] == [1]
    index.add(spark.createDataFrame([(3, "fox fox")], "id long, body string"))
    assert sorted(r["id"] for r in index.search("fox").collect()) == [1, 3]


@pytest.mark.parametrize("texts", [[], [(1, None)], [(1, "the of")]])
def test_nothing_to_index(spark, tmp_path, texts):
    index = Postings(spark, str(tmp_path / "i"), ("body",))
    index.add(spark.createDataFrame(texts, "id long, body string"))
    assert index.search("fox").collect() == []
