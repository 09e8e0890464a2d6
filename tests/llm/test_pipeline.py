import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    import corpus_pipeline as p
    from lociframe.llm.ngram_join import jaccard_components
    from lociframe.llm.shared import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
        docs = out
        counts.append(docs.count())
        if name == "near_duplicates":
            assert jaccard_components(docs).where("doc_id != component_id").isEmpty()
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[-1] and last.where("size(ids) != n_tokens").isEmpty()


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, repeated and very long texts, columns of clashing names, empty tables."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from lociframe.llm.shared import materialize

    plain = "the river runs by the old house and nobody walks there at night any more"
    rows = [(1, plain, "en"), (2, plain, None), (None, plain, "en"), (3, None, "en"), (4, "", None), (5, plain + " token = abcdefghijklmnop", "en"), (5, "another text of one id that has words enough for shingles", "en"), (6, "word%d " * 3 % (1, 2, 3) + " ".join(f"w{i}" for i in range(60_000)), "en"), (7, "q1 q2 q3 q4 q5 q6", "en")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for c in ("spans", "blob", "own", "row", "id", "tok", "label", "score", "ids"):
        docs = docs.withColumn(c, F.lit("x"))
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, folder)
        assert stage(spark, now.limit(0), folder).collect() == []
        if name != "tokens":
            assert after.columns == docs.columns
            assert all(r.score == "x" and r.spans == "x" for r in after.select("score", "spans").collect())
        now = materialize(after, name)
    got = now.collect()
    ids = sorted((r.doc_id for r in got), key=str)
    assert 7 not in ids and 2 not in ids  # holds a benchmark item; a copy
    assert {1, 3, 4, None} <= set(ids) and ids.count(5) <= 2


def test_each_stage_gives_back_the_heap(spark, monkeypatch):
    """What the work before has grown is given back before a stage begins, by a task and not by the driver."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    from lociframe.llm import shared

    heap = lambda: spark._jvm.java.lang.Runtime.getRuntime().totalMemory()
    spark.range(3_000_000).select(F.md5(F.col("id").cast("string")).alias("v")).groupBy("v").count().write.format("noop").mode("overwrite").save()
    before = heap()
    shared.give_back(spark)
    assert heap() < before
    calls = []
    monkeypatch.setattr(p, "give_back", lambda s: calls.append(1))
    docs = spark.createDataFrame([(1, "some text", "en", "web", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(p, "table", lambda s, d, name: s.createDataFrame([], "doc_id long, quality int, toxic int, item_id long, text string"))
    for i, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, "")
        assert len(calls) == i + 1, name
