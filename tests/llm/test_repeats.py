"""Suffix-array dedup and recompression against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from treeflow.llm import recompression, repeats, suffix_dedup, suffixes

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def strings_brute(rows):
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[p : p + 200] for _, b in raws for p in range(len(b) - 199))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def windows_brute(rows):
    split = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in split:
        for p in range(len(w) - 49):
            if i is not None:
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


@pytest.mark.parametrize("contexts", [8192, 2])
def test_repeated_strings(docs_of, corpus, key, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    got = [tuple(r) for r in suffix_dedup.digest(docs_of(corpus)).collect()]
    assert sorted(got, key=key) == sorted(strings_brute(corpus), key=key)
    assert sum(r[2] for r in got) > 5000


def test_repeated_windows(docs_of, corpus, key):
    got = [tuple(r) for r in recompression.digest(docs_of(corpus)).collect()]
    assert sorted(got, key=key) == sorted(windows_brute(corpus), key=key)
    assert sum(r[2] for r in got) > 500


def test_outputs_and_empty_tables(docs_of, corpus):
    kept = {r["doc_id"]: r for r in recompression.deduplicate(docs_of(corpus)).collect()}
    assert kept[5001]["text"] == "" and kept[5005]["n_removed"] == 0
    spans = {r["doc_id"]: r for r in suffix_dedup.deduplicate(docs_of(corpus[:20])).collect()}
    assert all(len(r["starts"]) == len(r["stops"]) for r in spans.values())
    for op in (recompression.digest, suffix_dedup.digest):
        assert op(docs_of([])).collect() == []


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(150):
        n, sigma = rng.randint(1, 60), rng.randint(1, 4)
        t = [rng.randint(1, sigma) for _ in range(n)]
        if rng.random() < 0.3:
            t = t[: max(1, n // 4)] * 4
        t.append(0)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffixes.suffix_array(np.array(t), 6).tolist() == want


def test_prefix_lengths():
    rng = random.Random(9)
    for _ in range(60):
        t = [rng.randint(1, 2) for _ in range(rng.randint(1, 40))] * rng.randint(1, 4) + [0]
        sa = sorted(range(len(t)), key=lambda i: t[i:])
        for most in (1, 6, 200):
            lengths, before = suffixes.permuted_prefixes(np.array(t), np.array(sa), most)
            assert before[sa[0]] == -1
            for a, b in zip(sa, sa[1:]):
                shared = next((k for k in range(len(t)) if t[a + k : a + k + 1] != t[b + k : b + k + 1]), len(t))
                assert (lengths[b], before[b]) == (min(most, shared), a)


@pytest.mark.parametrize("induce", [suffixes._induce_swept, suffixes._induce_each])
def test_both_ways_of_inducing(monkeypatch, induce):
    monkeypatch.setattr(suffixes, "_induce", induce)
    test_suffix_arrays()


def test_folded_rows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        m = int(rng.integers(1, 40))
        h, k, n = rng.integers(0, 3, m), rng.integers(0, 2, (m, 2)), rng.integers(1, 3, m)
        lo = np.sort(rng.choice(60, m, replace=False))
        rows = sorted(zip(h.tolist(), map(tuple, k.tolist()), lo.tolist(), n.tolist()))
        fh, fk, flo, fn, step, reps = repeats.folded(h, k, lo, n)
        back = [(a, tuple(b), x + s * i, y) for a, b, x, y, s, r in zip(fh.tolist(), fk.tolist(), flo.tolist(), fn.tolist(), step.tolist(), reps.tolist()) for i in range(r)]
        assert sorted(back) == rows


def test_a_repeated_word_takes_few_rows():
    for anchoring, raw in ((recompression.anchoring, b"word " * 5000), (suffix_dedup.anchoring, b"word " * 5000), (suffix_dedup.anchoring, b"z" * 30000)):
        assert sum(len(repeats.folded(*a)[0]) for a in anchoring(raw)) < 20


def test_stretches_change_nothing(docs_of, corpus, key, monkeypatch):
    """Short stretches in this process give the windows that whole texts give; texts of all sorts."""
    text = " ".join(t or "" for _, t, *_ in corpus).encode()
    for module, width in ((recompression, recompression.WINDOW), (suffix_dedup, suffix_dedup.WIDTH)):
        found = []
        for size in (1 << 30, 3000, 700):
            monkeypatch.setattr(module, "STRETCH", size)
            windows = {}
            for h, _, lo, n in module.anchoring(text):
                windows.update((int(w), int(a)) for a, x, m in zip(h, lo, n) for w in range(x, x + m))
            found.append(windows)
        assert found[0] == found[1] == found[2]
        assert len(found[0]) == (len(text.split()) if module is recompression else len(text)) - width + 1


def test_very_long_texts_take_bounded_memory():
    import tracemalloc

    raw = np.random.default_rng(2).integers(97, 105, 50_000_000, dtype=np.uint8)
    raw[::7] = 32
    raw = raw.tobytes()
    tracemalloc.start()
    for a in suffix_dedup.anchoring(raw[:20_000_000]):
        del a
    for a in recompression.anchoring(raw):
        del a
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 600_000_000


def test_many_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.range(10_000).selectExpr("cast(null as long) doc_id", f"'{text}' text").repartition(4).unionByName(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    got = suffix_dedup.digest(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    size = len(text)
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == [("1", size, size, 1, 1), ("2", size, size, 1, 1), ("None", size, size, 1, 10_000)]
    ids = {r["doc_id"]: (r["n_removed"], r["count"]) for r in recompression.digest(docs).groupBy("doc_id", "n_removed").count().collect()}
    assert ids == {None: (0, 10_000), 1: (0, 1), 2: (120, 1)}


def test_recompression_names_interiors_alike():
    rng = np.random.default_rng(5)
    inside = rng.integers(1, 1 << 60, 50, dtype=np.uint64)
    inside[20:24] = inside[20]
    found = []
    for _ in range(20):
        left, right = (rng.integers(1, 1 << 60, int(rng.integers(0, 30)), dtype=np.uint64) for _ in range(2))
        if len(left) and rng.random() < 0.5:
            left[-1] = inside[0]
        symbol, start = recompression.recompress(np.concatenate([left, inside, right]))
        at = start - len(left)
        stop = np.append(at[1:], len(inside) + len(right))
        ok = (at >= recompression.MARGIN) & (stop <= 50 - recompression.MARGIN)
        found.append([(int(a), int(s)) for a, s in zip(at[ok], symbol[ok], strict=True)])
    assert found[0] and all(x == found[0] for x in found)
