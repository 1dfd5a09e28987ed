from collections import Counter

import corpus_pipeline
from mediadate.llm import decontamination, jaccard, quality, registry, token_files


def test_stages_keep_columns_and_clean_rows(spark, folder, docs, rows):
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "token output" and len(corpus_pipeline.STAGES) == 5
    now = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [now.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] > 0


def test_run_equals_its_operators(spark, folder):
    start = spark.read.parquet(f"{folder}/documents.parquet")
    kept = jaccard.keep_one_of_each_group(quality.keep_good(start))
    clean = decontamination.keep_clean(kept, spark.read.parquet(f"{folder}/benchmark.parquet"))
    clean = spark.createDataFrame(clean.collect(), clean.schema)
    mixed = corpus_pipeline.source_mix(spark, clean, folder)
    want = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in registry.encode_table(mixed).collect())
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and got


def test_empty(spark, folder, empty):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
    assert now.collect() == []
    assert token_files.bit_width(49_408) == 16
