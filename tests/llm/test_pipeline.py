import corpus_pipeline as C
from pyspark.sql import functions as F

from tessella.llm import decontaminate, toxicity

from .brute import near_components

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench, labels = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash", "decontaminate", "pii", "pieces"]
    one = C.drop_toxic(spark, docs, SF)
    scored = toxicity.with_score(docs, toxicity.learn(docs, labels)).where("score < 0.5")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in scored.collect()}
    two = C.drop_near_duplicates(spark, docs, SF)
    want = near_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert two.columns == docs.columns and sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, _, c in want})
    three = C.drop_contaminated(spark, docs, SF)
    hit = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).where("n_hit > 0").collect()}
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in docs.collect()} - hit
    four = C.mask_personal_data(spark, docs, SF)
    assert four.schema == docs.schema and four.where(F.length("text") != F.col("n_chars")).count() == 0
    five = C.encode_pieces(spark, docs, SF)
    assert five.count() == docs.count() and five.where(~F.col("same")).count() == 0


def test_run(spark):
    out = C.run(spark, SF)
    assert 0 < out.count() < 200 and "doc_id" in out.columns


def test_odd_rows(spark, docs):
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 5
