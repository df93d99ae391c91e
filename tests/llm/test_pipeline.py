"""The pipeline: each stage's decision against the operators' own brute-force rules, on its own input."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from treeflow.llm import mixing, near_copies, quality, simhash
from treeflow.llm.common import scratch

from .test_near_copies import brute_groups
from .test_operators import WORD, brute_quality, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, SF), "stage")
        seen.append(docs)
        assert name
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen[:4]]
    assert all(d.columns == columns for d in seen[:-1])
    assert not any(brute_quality(r["text"])[-1] for r in rows[1].values())
    content = quality.assess(seen[0], quality.fit(seen[0])).where("kept").select("doc_id").collect()
    assert {r["doc_id"] for r in content} == set(rows[1])
    ids = sorted(rows[1])
    assert set(rows[2]) == {ids[g] for g in brute_groups([rows[1][i]["text"] for i in ids])}
    for i, r in rows[3].items():
        before = rows[2][i]["text"]
        assert (r["text"] == before) == (not brute_spans(before)) and not brute_spans(r["text"].replace("<", " ").replace(">", " "))
    mixed, taken = seen[4].collect(), {r["doc_id"]: r["taken"] for r in mixing.taken(seen[3]).collect() if r["taken"]}
    words = {}
    for r in mixed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert words == taken
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], len(x := [*sp.encode(r["text"]), 2]), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for r in mixed)
    assert sorted(tuple(r)[:3] for r in seen[5].collect()) == want
    assert simhash.one_of_each(seen[2], rule=near_copies.NEAR).count() == seen[2].count()


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
