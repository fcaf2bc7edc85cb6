"""The pipeline's stages against brute force on their own inputs."""

import collections

import corpus_pipeline
from test_operators_llm import DOCS, brute_components, brute_repeats, corpus

from textmill.llm.common import materialize


def test_stages(spark, tmp_path):
    rows = corpus(8)
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 9 == 0)) for r in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "packing"]

    kept = corpus_pipeline.toxicity_filter(spark, docs, d)
    assert kept.columns == docs.columns and kept.count() <= len(rows)

    near = materialize(corpus_pipeline.near_duplicate_filter(spark, docs, d))
    assert near.columns == docs.columns
    groups = brute_components([r[:2] for r in rows])
    want = {i for i, _, c in groups if i == c and i is not None}
    got = collections.Counter(r.doc_id for r in near.select("doc_id").collect())
    assert set(got) - {None} == want and all(n == 1 for i, n in got.items() if i is not None) and got[None] == 2

    cut = corpus_pipeline.substring_filter(spark, near, d).collect()
    before = [(r.doc_id, r.text) for r in near.select("doc_id", "text").collect()]
    left = {(i, n - m) for (i, n, m, _), k in brute_repeats(before, 50).items() if not (n > 0 and n == m)}
    assert {(r.doc_id, len((r.text or "").split())) for r in cut} == left
    assert all(r.n_chars in (0, len(r.text or "")) for r in cut)

    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
