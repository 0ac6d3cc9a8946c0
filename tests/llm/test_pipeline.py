from __future__ import annotations

from conftest import ODD

import corpus_pipeline
from quillet.runtime import materialize

SF = "/root/testdata/sf0.001"


def test_stages_and_run_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == names, name
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] >= n[4] > n[0] / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(packed)


def test_odd_documents(spark, tmp_path, docs, prose):
    texts = [*ODD, *prose(30, 60, seed=51), *["\n".join(prose(4, 40, seed=52))] * 3]
    table = docs([*texts, texts[-1]], ids=[*range(len(texts)), None])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 12)) for i in range(8, 30)] + [(None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        read = materialize(stage(spark, read, str(tmp_path)), "stage")
        assert read.columns == table.columns
    kept = {r.doc_id for r in read.collect()}
    assert len(kept & set(range(len(ODD), len(ODD) + 30))) >= 28 and len(kept & set(range(len(ODD) + 30, len(texts)))) == 1
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_no_documents(spark, tmp_path, docs):
    docs(["x"]).filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
