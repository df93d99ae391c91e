import random

import pytest

#: Columns whose names clash with those that the operators use inside.
EXTRA = {"h": 1, "fp": 2, "rank": 3, "doc": 4, "row": 5, "start": 6, "size": 7, "lang": None, "kept": True}


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text, source) rows, over several partitions, with clashing extra columns."""
    from pyspark.sql import functions as F

    def made(rows, lang=None):
        rows = [(*r, *[None] * (3 - len(r))) for r in rows]
        df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").repartition(3)
        df = df.withColumns({k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in EXTRA.items()})
        return df.withColumn("n_chars", F.length("text").cast("long"))

    return made


@pytest.fixture(scope="session")
def corpus():
    """A fixture of documents: copies, near copies, shared passages, runs, empty, null and odd texts, repeated rows."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(90) for _ in range(4)]
    rows = []
    for i in range(120):
        kind = i % 6
        body = text(rnd.randint(1, 160))
        if kind == 1:
            p = rnd.choice(passages).split()
            a = rnd.randint(0, 40)
            body = f"{body} {' '.join(p[a : a + rnd.randint(40, 60)])}\n{text(20)}"
        elif kind == 2 and rows:
            near = rows[rnd.randrange(len(rows))][1].split(" ")
            near[rnd.randrange(len(near))] = "changed"
            body = " ".join(near)
        elif kind == 3 and rows:
            body = rows[rnd.randrange(len(rows))][1]
        elif kind == 4:
            body = (rnd.choice("xy") + " ") * rnd.randint(20, 150) + "z" * rnd.randint(0, 450)
        rows.append((1000 - i * 3, body, rnd.choice(["a", "b", None, "ü"])))
    rows += [(5000, None, "a"), (5001, "", "a"), (5002, " \n\t ", None), (None, passages[0], "a"), (None, None, None), (5003, passages[1], "b"), (5003, passages[1], "b"), (5004, "w" * 3000, "a"), (5005, text(4000), "b"), (5006, "\x00odd\x1c \x85 　 text", "ü")]
    return rows


@pytest.fixture(scope="session")
def key():
    return lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
