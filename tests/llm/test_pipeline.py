"""The pipeline against the same decisions taken in plain Python."""

import re

import public_tokenizers as tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from grantseek.llm import bpe, mixing, toxicity
from tests.llm.test_dedup import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    scores = toxicity.scored(raw, toxicity.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert set(kept[0]) == {r.doc_id for r in scores if r.score < 0.5}
    least = {}
    for i, t in kept[0].items():
        body = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        least[body] = min(i, least.get(body, i))
    assert set(kept[1]) == set(least.values())
    near = brute_components(list(kept[1].items()), 80, 5)
    assert set(kept[2]) == {c for _, c in near.values()}
    clean = spark.read.parquet(str(tmp_path / corpus_pipeline.STAGES[2][0]))
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(clean).collect() if r.taken}
    got = {}
    for r in docs.withColumn("n", mixing.word_count(F.col("text"))).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
        assert r.n_chars == len(r.text)
    assert got == taken

    encoding = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in last) == sorted((r.doc_id, len(encoding.encode_ordinary(r.text))) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)
