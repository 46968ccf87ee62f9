"""The pipeline and its stages over odd rows that were ingested twice."""
import collections
import tempfile

import corpus_pipeline
from foliocheck.llm.common import read
from tests.llm import cases
from tests.llm.test_copies import brute, shingles


def test_run_drops_copies_and_encodes_the_rest(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cases.frame(spark, cases.odd_rows() * 2).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, counts = read(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        path = f"{folder}/{len(counts)}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(collections.Counter((r.doc_id, r.text or "") for r in docs.collect()))
    clean, exact, near, mixed = counts
    assert clean == collections.Counter((doc, text or "") for doc, text, *_ in cases.odd_rows() * 2)
    assert set(exact.values()) == {1} and len(exact) == len({text for _, text in clean})
    texts = [text for _, text in exact]
    assert set(near.values()) == {1} and len(near) == len(set(brute([shingles(t) for t in texts])))
    assert set(mixed) <= set(near)
    coded = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r.doc_id for r in coded) == collections.Counter(doc for doc, _ in mixed.elements())
    assert all(len(r.ids) == r.n_tokens for r in coded)
