"""The mix as documents where rows share an id or have none."""

from collections import Counter

from treeflow.llm import mixing


def test_rows_without_ids_of_their_own(docs_of):
    sizes = [40, 700, 90, 333, 5, 1200, 64, 128, 17, 256, 1000, 3]
    rows = [(None if i % 3 else 7, " ".join([f"r{i}"] * n), "ab"[i % 2]) for i, n in enumerate(sizes)]
    docs = docs_of([*rows, (8, "r12 " * 50, "a"), (8, "r12 " * 50, "a"), (9, None, "a"), (None, "", None)])
    words, ids = Counter(), {}
    for r in mixing.mixed_documents(docs).collect():
        found = r["text"].split()
        assert len(set(found)) == 1 and r["n_chars"] == len(r["text"])
        words[found[0]] += len(found)
        ids.setdefault(found[0], set()).add((r["doc_id"], r["source"]))
    for i, r in enumerate(rows):
        assert ids.get(f"r{i}", {(r[0], r[2])}) == {(r[0], r[2])}
    taken = [r for r in mixing.taken(docs).collect() if r["taken"]]
    got = [(rows[i][0], n, words[f"r{i}"]) for i, n in enumerate(sizes) if words[f"r{i}"]]
    assert sorted(map(str, got)) == sorted(str((r["doc_id"], r["size"], r["taken"])) for r in taken if r["doc_id"] != 8)
    assert words["r12"] == sum(r["taken"] for r in taken if r["doc_id"] == 8)
