"""SimHash near-duplicates where buckets are sparse."""

import numpy as np

from treeflow.llm import simhash

from .test_operators import brute_components


def linked(edges, members):
    """The smallest member that each member reaches over the edges."""
    at = {m: i for i, m in enumerate(members)}
    label = list(range(len(members)))
    edges = [(at[a], at[b]) for u, v in edges for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    for _ in members:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_relabelled_rows_keep_their_links():
    table = np.array([0x00 << 32 | 1, 0xE3 << 32 | 1, 0xF0 << 32 | 1], np.uint64)
    probe = np.array([0x30 << 32 | 3], np.uint64)
    assert linked(simhash.bucket_links(table, [probe]), [*table.tolist(), *probe.tolist()]) == [0, 0, 0, 0]


def test_sparse_buckets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        table = np.unique(rng.integers(0, 1 << 9, 12, dtype=np.uint64) << np.uint64(32) | np.uint64(1))
        probes = [np.unique(rng.integers(0, 1 << 9, 4, dtype=np.uint64) << np.uint64(32) | np.uint64(low)) for low in (3, 5, 9)]
        members = np.concatenate([table, *probes]).tolist()
        # probes only meet the table here: their own links are other tiles'
        label = linked([(np.array([a], np.uint64), np.array([b], np.uint64)) for a in table.tolist() for b in members if bin(a ^ b).count("1") <= 3], members)
        assert linked(simhash.bucket_links(table, probes), members) == label


def test_example_in_spark(spark):
    fps = [0x00 << 32 | 1, 0xE3 << 32 | 1, 0xF0 << 32 | 1, 0x30 << 32 | 3]
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components_of(rows).collect()}
    assert [got[f] for f in fps] == brute_components(fps, list(range(4)))
