"""Near copies: the rule against brute force over all pairs, and how well it finds exact similarities of 0.8 or more."""

import random
import re

from treeflow.llm import near_copies, simhash

from .test_operators import WORD


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def linked(a, b):
    """The rule: some segment at most one bit apart, and the whole at most RADIUS."""
    differ = [x ^ y for x, y in zip(a, b, strict=True)]
    parts = [(d >> 20 * j) & 0xFFFFF for d in differ for j in range(3)]
    return min(p.bit_count() for p in parts) <= 1 and sum(p.bit_count() for p in parts) <= near_copies.RADIUS


def brute_groups(texts):
    """For each text the place of the first one reachable over the rule's links."""
    fps = [near_copies.sketch((t or "").encode()) for t in texts]
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if fps[i] == fps[j] or linked(fps[i], fps[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(fps))]


def edited(rnd, text, share):
    words = text.split(" ")
    for i in rnd.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def originals(rnd, n):
    vocabulary = [f"w{i}" for i in range(2000)]
    return [" ".join(rnd.choices(vocabulary, k=rnd.randint(40, 400))) for _ in range(n)]


def kept_by(docs, rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in simhash.one_of_each(docs(rows), rule=near_copies.NEAR).collect())


def test_matches_brute_force(docs_of, corpus):
    rows = [(i, t) for i, t, _ in corpus if i is not None]
    groups = brute_groups([t for _, t in rows])
    least = {}
    for g, (i, t) in zip(groups, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    assert [x[1] for x in kept_by(docs_of, rows)] == sorted(least.values())


def test_hot_buckets(docs_of, monkeypatch):
    rnd = random.Random(3)
    text = originals(rnd, 1)[0]
    rows = list(enumerate([text, *(edited(rnd, text, 0.01) for _ in range(150)), *originals(rnd, 20)]))
    want = brute_groups([t for _, t in rows])
    assert want[:151] == [0] * 151
    for chunk in (7, 1024):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        assert [x[1] for x in kept_by(docs_of, rows)] == sorted(set(want))


def test_recall_and_precision():
    rnd = random.Random(11)
    found = {"0.8": [], "0.85": [], "0.9": [], "below": []}
    for text in originals(rnd, 1200):
        other = edited(rnd, text, rnd.choice([0.002, 0.005, 0.01, 0.015, 0.02, 0.025, 0.08, 0.15]))
        j = jaccard(shingles(text), shingles(other))
        hit = linked(near_copies.sketch(text.encode()), near_copies.sketch(other.encode()))
        found["0.9" if j >= 0.9 else "0.85" if j >= 0.85 else "0.8" if j >= 0.8 else "below" if j < 0.6 else "0.7"].append(hit) if j >= 0.8 or j < 0.6 else None
    share = {k: sum(v) / len(v) for k, v in found.items()}
    print({k: (len(v), round(share[k], 3)) for k, v in found.items()})
    assert share["0.9"] > 0.97 and share["0.85"] > 0.9 and share["0.8"] > 0.7 and share["below"] < 0.02


def test_unrelated_texts_stay(docs_of):
    rows = list(enumerate(originals(random.Random(4), 300)))
    assert len(kept_by(docs_of, rows)) == 300


def test_odd_rows(docs_of):
    """Empty tables, null and wordless texts (one group), null ids (last), repeated rows and ids, one long text."""
    assert kept_by(docs_of, []) == []
    long = "word " * 400_000 + "end"
    rows = [(3, None), (2, ""), (None, " \n"), (7, "one two"), (7, "one two"), (8, "ONE two"), (9, long), (None, long), (5, "three four"), (5, "five six")]
    assert [(x[1], x[2][:9]) for x in kept_by(docs_of, rows)] == [(2, ""), (5, "five six"), (5, "three fou"), (7, "one two"), (9, "word word")]
