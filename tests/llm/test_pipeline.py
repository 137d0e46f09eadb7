"""The pipeline's stages on the smallest tables and on edge cases."""

import corpus_pipeline

from gridmat.llm import queries


def test_stages_feed_each_other(spark, edge_docs, tmp_path):
    docs, folder = edge_docs, "/root/testdata/sf0.001"
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == edge_docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert all(a >= b for a, b in zip(counts[:4], counts[1:5])) and counts[4] > 0
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14))
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
