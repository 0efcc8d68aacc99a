import pytest

import corpus_pipeline as P

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    passage = " ".join(f"shade{k}" for k in range(70))
    own = [" ".join(f"{c}{k}" for k in range(120)) for c in ("tree", "walk")]
    more = spark.createDataFrame([
        (9001, own[0] + " " + passage, "en", "src1", 9), (9002, own[1] + " " + passage + " and a different end", "en", "src1", 9),
        (9003, None, "en", None, None), (9003, None, "en", None, None), (None, "lonely words without an id", None, "src2", 3)], docs.schema)
    docs, counts = docs.unionByName(more), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, DIR)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts[name] = docs.count()
        if name == "near_duplicates":
            assert docs.filter("doc_id = 9003").count() <= 1
        if name == "passages":
            texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id in (9001, 9002)").collect()}
            assert texts[9001].endswith(passage) and texts[9002] == own[1] + " and a different end"
            assert docs.filter("doc_id is null").count() == 1
    assert counts["toxicity"] > 150 and counts["near_duplicates"] < counts["toxicity"] and counts["mixing"] > 0


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_empty_documents(spark, k):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    assert P.STAGES[k][1](spark, docs, DIR).count() == 0
