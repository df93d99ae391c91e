"""Mixing, language, SimHash, personal data and quality against brute force, round trips and held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeflow.llm import langid, mixing, pii, quality, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- mixing ---


def test_mix(docs_of, corpus):
    got = mixing.taken(docs_of(corpus)).collect()
    assert len(got) == len(corpus)
    sizes = {}
    for _, t, s in corpus:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), mixing.targets([sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))]), strict=True))
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sorted(by) == sorted((sizes[s], want[s]) for s in sizes)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 2 * mixing.BLOCK_WORDS
    again = sorted(map(tuple, mixing.taken(docs_of(corpus)).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)
    assert mixing.taken(docs_of([])).collect() == []


def test_mix_parts():
    assert mixing.targets([10, 10, 10]) == pytest.approx([5, 10, 15])
    assert mixing.targets([100, 1, 1]) == pytest.approx([96, 3, 3])
    assert mixing.targets([0, 0]) == [0, 0]
    for n in (1, 2, 7, 64, 1001):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    for group_slots, groups in ((1 << 28, 1), (500, 5)):
        plan = mixing.Shards((500, 1500, 77), 256, group_slots)
        sizes = plan.sizes()
        assert len(sizes) == groups
        each = [plan.counts(g, n, s) for g, n in enumerate(sizes) for s in range(n)]
        assert np.sum([x for x, _ in each], axis=0).tolist() == [500, 1500, 77]
        befores = np.array([x for _, x in each])
        assert (np.cumsum([x for x, _ in each], axis=0)[:-1] == befores[1:]).all() and not befores[0].any()
    # far more slots than one draw can hold
    huge = mixing.Shards((10**15, 3 * 10**14, 7))
    assert huge.counts(huge.groups - 1, 300_000, 5)[0].sum() == mixing.SHARD_BLOCKS


def test_taken_words_follow_the_slots(docs_of, corpus):
    """Each row's words again from the slots that were drawn and where its words lie in its source's stream."""
    docs = docs_of(corpus)
    parts, drawn, sources = mixing.mix(docs)
    times = {}
    for r in drawn.collect():
        times[r["rank"], r["block"]] = times.get((r["rank"], r["block"]), 0) + 1
    assert {s.rank: sum(n for (r, _), n in times.items() if r == s.rank) for s in sources} == {s.rank: s.slots for s in sources}
    rows = {(r["rank"], r["start"], r["size"], r["doc_id"]) for r in parts.collect() if r["size"]}
    for s in sources:  # the rows of a source lie end to end
        at = 0
        for _, start, size, _ in sorted(x for x in rows if x[0] == s.rank):
            assert start == at
            at += size
        assert at == s.size
    want = sorted((str(i), size, sum(times.get((rank, w // mixing.BLOCK_WORDS), 0) for w in range(start, start + size))) for rank, start, size, i in rows)
    assert want == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.taken(docs).collect() if r["size"])


def test_mixed_documents(docs_of, corpus):
    rows = [(i, t, s) for k, (i, t, s) in enumerate(corpus) if i is not None and i != 5003]
    docs = docs_of(rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect() if r["taken"]}


# --- language ---


def test_language(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got} == {True}
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = langid.predict(docs_of([(1, None), (2, ""), (3, "12 !?"), (4, "the of and"), (None, "the"), (4, "the of and")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert langid.fit(docs_of([])) is None
    assert langid.predict(docs_of([(1, "abc")]), None).first()["lang_pred"] == "und"


def brute_language(model, text):
    """Language and score from every subword of every word, one after another."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    total, n = [0.0] * len(model.langs), 0
    for word in text.lower().split():
        marked = "\x02" + word + "\x02"
        for size in range(1, 5):
            for i in range(len(marked) - size + 1):
                if marked[i : i + size].strip("\x02"):
                    h = 1469598103934665603
                    for c in marked[i : i + size]:
                        h = ((h ^ ord(c)) * 1099511628211) % 2**64
                        h ^= h >> 29
                    row = model.table[(h >> 17) % langid.BUCKETS]
                    total, n = [x + float(y) for x, y in zip(total, row, strict=True)], n + 1
    z = [(x / n + float(b)) / model.temperature for x, b in zip(total, model.bias, strict=True)]
    e = np.exp(np.array(z) - max(z))
    return model.langs[int(e.argmax())], float(e.max() / e.sum())


def test_language_against_brute_force(docs_of):
    rnd = np.random.default_rng(3)
    alphabets = {"xx": "abcde", "yy": "defgh", "zz": "жздéß"}
    said = lambda chars: " ".join("".join(rnd.choice(list(chars), rnd.integers(1, 8))) for _ in range(30))
    rows = [langid.subwords(langid.words_of(said(c))) + (lang,) for lang, c in alphabets.items() for _ in range(40)]
    model = langid.fit_rows([(b.tolist(), np.full(len(b), 1 / len(b)).tolist(), lang) for b, _, lang in rows])
    texts = [said(c) for c in alphabets.values() for _ in range(20)] + [None, "", "12 !", "a", "  De\tfG  ", said("abcdefghжß") + " 🙂 x\u00a0y", "ab " * 5000]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs_of(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        lang, score = brute_language(model, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-5)


def test_subwords_stay_in_words():
    both, owner = langid.subwords(["ab", "c"])
    one, two = langid.subwords(["ab"])[0], langid.subwords(["c"])[0]
    assert sorted(both[owner == 0].tolist()) == sorted(one.tolist()) and sorted(both[owner == 1].tolist()) == sorted(two.tolist())


# --- SimHash ---


def brute_fingerprint(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(fps, ids):
    n, parent = len(fps), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def test_near_duplicates(docs_of, corpus, key):
    fps = [brute_fingerprint(t) for _, t, *_ in corpus]
    comps = brute_components(fps, [r[0] for r in corpus])
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(corpus, fps, comps, strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(docs_of(corpus)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = simhash.one_of_each(docs_of(corpus))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(set(comps), key=str)
    assert kept.columns == docs_of(corpus).columns
    assert simhash.near_duplicates(docs_of([])).collect() == []


@pytest.mark.parametrize("chunk", [1024, 3])
def test_dense_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set()
    for c in centre.tolist():
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components_of(rows).collect()}
    assert [got[f] for f in signed] == brute_components(fps, list(range(len(fps))))


# --- personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum((v := int(c) * (1 + i % 2)) // 10 + v % 10 for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute_spans(t):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if holds(kind, m.group()))


def said(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_personal_data(docs_of):
    import random

    rnd = random.Random(4)
    parts = ["a", "b@", "@", ".", "1", "22", "+", "+1 ", "-", " ", "(", "255", "0", "4", "😀", "é", "\n", "x.y", "a@b.c", "1.2.3.4", "4111111111111111", "+1 555 123 4567"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(250)]
    rows += [(900, None), (901, ""), (902, "a" * 100000 + " x"), (903, "1" * 30000), (904, "1 " * 30000), (905, "+1" + "(" * 30000), (906, "a@b.c " * 1500), (None, "a@b.co"), (907, "1.1." * 5000)]
    got = {r["doc_id"]: r for r in pii.digest(docs_of(rows)).collect()}
    for i, t in rows:
        spans = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(said(spans).encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in spans) for j in range(4)]
        assert set(said(spans).split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert pii.digest(docs_of([])).collect() == []


def luhn(digits):
    return next(f"{digits}{c}" for c in range(10) if holds("card", f"{digits}{c}"))


def test_contexts_reveal_unseen_identifiers(docs_of):
    rows = [(i, f"some words please call us: +1 555 123 {4000 + i} now") for i in range(40)]
    rows += [(100, "some words please call us: 555 77 9999 now"), (101, "in the year of 555 77 9999 nothing"), (102, "plain text")]
    rows += [(103, "Mail a@b.co\ncall us: 555 88 0000")]  # the words before are found over an earlier match
    got = {r["doc_id"]: r["spans"] for r in pii.digest(docs_of(rows)).collect()}
    assert (got[100], got[101], got[102], got[103]) == ("phone:27:38", "", "", "email:5:11,phone:21:32")
    out = {r["doc_id"]: r for r in pii.redact(docs_of(rows)).collect()}
    assert out[100]["text"] == "some words please call us: <PHONE> now" and out[100]["n_chars"] == len(out[100]["text"])
    assert out[102]["text"] == "plain text"


def test_hidden_seeds_are_recovered(docs_of):
    """A quarter of cards get a wrong last digit, a quarter of phone numbers lose their country: forms bring them back."""
    import random

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, hidden, others = [], set(), set()
    for i in range(240):
        card = luhn(f"{rnd.randrange(10**15):015d}")
        phone = f"({rnd.randrange(1000):03d}) 555-{rnd.randrange(10000):04d}"
        part = [word(), card, word(), "+1 " + phone, word()]
        if i % 4 == 0:
            part[1] = card[:-1] + str((int(card[-1]) + 3) % 10)
        if i % 4 == 1:
            part[3] = phone
        part += [word(), f"{rnd.randrange(10**9):09d}", word(), f"20{i % 30:02d}-0{1 + i % 9}-1{i % 10}", word()]
        text = " ".join(part)
        if i % 4 < 2:
            at = text.index(part[1] if i % 4 == 0 else phone)
            hidden.add((i, f"card:{at}:{at + 16}" if i % 4 == 0 else f"phone:{at}:{at + len(phone)}"))
        rows.append((i, text))
    added = set()
    for r in pii.find(docs_of(rows)).collect():
        added |= {(r["doc_id"], f"{pii.KINDS[x['place']]}:{x['start']}:{x['stop']}") for x in r["added"]}
    assert len(added & hidden) / len(hidden) > 0.95
    assert len(added & hidden) / len(added) > 0.95


def test_chance_does_not_make_patterns(docs_of):
    """Of random numbers a tenth pass Luhn's check; that is too few for their form to be trusted."""
    import random

    rnd = random.Random(5)
    rows = [(i, f"order {rnd.randrange(10**16):016d} of {rnd.choice('abcdefgh')}") for i in range(600)]
    got = pii.find(docs_of(rows)).collect()
    assert sum(len(r["base"]) for r in got) > 30 and not any(r["added"] for r in got)


# --- quality ---


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    at = {}
    for p in range(len(w) - 7):
        at.setdefault(tuple(w[p : p + 8]), []).append(p)
    rep = {q for x in at.values() if len(x) > 1 for p in x for q in range(p, p + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_quality(spark, docs_of, corpus, key):
    docs = docs_of(corpus)
    model = quality.fit(docs)
    got = quality.assess(docs, model).collect()
    want = sorted(((i, *brute_quality(t)) for i, t, _ in corpus), key=key)
    assert sorted((tuple(r)[:7] for r in got), key=key) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.keep(docs, model).count() == sum(r["kept"] for r in got)
    assert quality.assess(docs_of([]), quality.fit(docs_of([]))).collect() == []


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.assess(docs, quality.fit(docs)).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in got if r["quality"] == 1)
    assert sum(r["kept"] for r in got if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in got)


def test_neighbours_decide_doubtful_lines(docs_of):
    """A line that no threshold calls boilerplate is boilerplate among boilerplate, and content among content."""
    model = quality.fit(docs_of([]))
    junk, prose = b"### menu ### home ### about ###", b"It was a long walk along the river, and nobody said a word."
    for doubtful in (b"Home About", b"Read more", b"MORE about US", b"about 2024", b"page 12 of 40", b"LOGIN here"):
        among = [model.viterbi(quality.line_features([x, x, x, doubtful, x, x, x]))[3] for x in (junk, prose)]
        if among == [0, 1]:
            assert quality.seed_labels(quality.line_features([junk, doubtful]))[1] == 1
            break
    else:
        raise AssertionError("neighbours never decide")


def test_training_lines_come_from_anywhere():
    f = np.arange(1000 * quality.N_FEATURES, dtype=float).reshape(1000, -1)
    starts = {int(quality._stretch(f, h)[0, 0]) // quality.N_FEATURES for h in range(0, 1 << 30, 7919 * 1001)}
    assert min(starts) < 100 and max(starts) > 700 and len(quality._stretch(f, 5)) == quality.SAMPLE_LINES
    assert len(quality._stretch(f[:50], 77)) == 50


def test_repeated_words_of_very_repetitive_texts():
    words = [b"a", b"b"] * 300_000 + [b"c"]
    assert quality.repeated_words(words) == 600_000


def test_viterbi_and_gradient():
    rng = np.random.default_rng(3)
    model = quality.LineModel(rng.normal(size=(2, quality.N_FEATURES)), rng.normal(size=(2, 2)))
    f = rng.normal(size=(7, quality.N_FEATURES))

    def score(y):
        s = f @ model.emit.T
        return sum(s[i, v] for i, v in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:]))

    paths = [[(k >> i) & 1 for i in range(7)] for k in range(128)]
    assert model.viterbi(f).tolist() == max(paths, key=score)
    y = np.array(paths[37])
    emit, move, ll = model.gradient(f, y)
    assert ll == pytest.approx(score(paths[37]) - np.logaddexp.reduce([score(p) for p in paths]))
    model.emit[1, 2] += 1e-5
    assert (model.gradient(f, y)[2] - ll) / 1e-5 == pytest.approx(emit[1, 2], abs=1e-3)
