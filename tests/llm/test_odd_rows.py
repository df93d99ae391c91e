"""The pipeline's stages over rows that are null, shared, equal, empty or beside columns with clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeflow.llm.common import scratch

from .test_operators import brute_quality

BODY = "It was a long walk along the river and nobody said a word until we reached the old bridge number {} near {} that day"


@pytest.fixture(scope="module")
def odd(docs_of):
    rows = [(i, BODY.format(f"nr{i}", f"place{i * 7}") + f" call us: +1 555 123 {4000 + i}", "ab"[i % 2]) for i in range(12)]
    rows += [(None, BODY.format("one", "here"), "a"), (None, BODY.format("two", "there"), None), (None, BODY.format("two", "there"), None)]
    rows += [(3, BODY.format("three", "elsewhere" * 40), "b"), (4, None, "a"), (None, None, None), (5, "", "a"), (6, " \n ", None), (7, "short", "b"), (7, "short", "b")]
    docs = docs_of(rows)
    clash = {x: F.lit(i) for i, x in enumerate(("__id", "__tx", "__row", "__key", "__k0", "__k1", "__spans", "__text", "__merged", "__SIZE", "spans", "block", "pass"))}
    return docs.withColumns(clash)


def test_stages_take_odd_rows(spark, odd):
    docs, seen = odd, []
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, ""), "stage")
        seen.append(docs)
    assert all(d.columns == odd.columns for d in seen[:-1])
    texts = lambda d: Counter(r["text"] for r in d.select("text").collect())
    before, kept, single, private, mixed = texts(odd), *map(texts, seen[:4])
    assert kept == Counter({t: n for t, n in before.items() if t and not brute_quality(t)[-1]}) and sum(kept.values()) == 16
    assert set(single) <= set(kept) and set(single.values()) == {1}
    assert sum(private.values()) == sum(single.values())
    assert all("+1 555" not in t for t in private)
    words = lambda c: sum(n * len(t.split()) for t, n in c.items())
    assert words(private) * 0.5 < words(mixed) <= 3 * words(private)
    assert seen[4].count() == sum(mixed.values())


def test_stages_take_empty_tables(spark, odd):
    docs = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
