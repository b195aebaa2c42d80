import corpus_pipeline as C
from tessera.llm._tables import staged, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    first = docs.orderBy("doc_id").first()
    item = table(spark, SF, "benchmark").first()["text"]
    planted = spark.createDataFrame(
        [(10_001, first["text"], "en", "src1", 1), (10_002, f"so it goes {item} and so on", "en", "src1", 1), (None, "kept as it is, with a few plain words in it.", None, None, None), (10_003, None, "en", "src1", None)], docs.schema
    )
    docs = docs.unionByName(planted)
    kept = []
    for k, (name, stage) in enumerate(C.STAGES):
        docs = staged(stage(spark, docs, SF), "stage")
        if k < 4:
            assert docs.columns == C._COLUMNS, name
            kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] and None in kept[3]
    assert 10_001 not in kept[1] and 10_002 not in kept[3]
    assert {r["doc_id"] for r in docs.collect()} == kept[3]


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF), "stage")
    assert docs.count() == 0
