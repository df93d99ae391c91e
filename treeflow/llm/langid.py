"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, columns, slices

#: Hash buckets, embedding size and subword lengths (in characters, word ends included).
BUCKETS, SIZE, LENGTHS = 1 << 15, 16, (1, 2, 3, 4)
#: Rows learned from, for each language, at most in expectation; in all, at most one and a half times as many.
ROWS_PER_LANGUAGE = 400
UNKNOWN = "und"
_KEEP = 150_000
_LETTER = re.compile("[A-Za-z]")
_FEATURES = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("bucket", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of each subword of each word; a word's first and last character touch a marker."""
    joined = "\x02" + "\x02".join(words) + "\x02" if words else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    marker = points == 2
    number = np.cumsum(marker) - 1  # a marker begins the word after it
    found, owner = [], []
    h = np.full(len(points), 1469598103934665603, np.uint64)
    inner = np.cumsum(marker)
    with np.errstate(over="ignore"):
        for n in range(1, max(LENGTHS) + 1):
            k = len(points) - n + 1
            if k <= 0:
                break
            h = (h[:k] ^ points[n - 1 :]) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
            if n not in LENGTHS:
                continue
            crossed = inner[n - 1 :][:k] - inner[:k] + marker[:k]  # markers in the subword
            at_ends = marker[:k].astype(np.int64) + marker[n - 1 :][:k] if n > 1 else marker[:k] * 2
            ok = (crossed == at_ends) & (crossed < n) & ~((n > 1) & (at_ends == 2) & (n == 2))
            found.append((h[ok] >> np.uint64(17)) % np.uint64(BUCKETS))
            owner.append(number[:k][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


@dataclass
class Model:
    """What ``fit`` learns: languages, the table of bucket scores (embeddings times weights), bias, temperature, threshold."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]], n: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5, 0.5, (BUCKETS, SIZE)) / SIZE
    out, bias = rng.normal(0, 0.3, (SIZE, n)), np.zeros(n)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            b, w, y = rows[i]
            rate = 1.0 * (1 - done / steps) + 0.01
            done += 1
            hidden = w @ emb[b]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * 0.2 * np.outer(hidden, p)
            bias -= rate * 0.02 * p
            emb[b] -= (rate * 20.0) * w[:, None] * back
    return emb @ out, bias


def fit_rows(rows: list[tuple[list, list, str]], *, epochs: int = 3, seed: int = 7) -> Model | None:
    """Fit on (buckets, weights, language) rows: four in five train, the rest set temperature and threshold."""
    langs = sorted({x[2] for x in rows})
    if not langs:
        return None
    data = [(np.asarray(b, np.int64), np.asarray(w, np.float64), langs.index(y)) for b, w, y in rows if len(b)]
    if not data:
        return None
    fit, tune = [x for i, x in enumerate(data) if i % 5], data[::5]
    table, bias = _train(fit or data, len(langs), epochs, seed)
    model = Model(langs, table.astype(np.float32), bias)
    sums = np.array([w @ table[b] for b, w, _ in tune])
    y = np.array([x[2] for x in tune])
    best = min((float(-np.log(np.maximum(_soft(sums + bias, t)[np.arange(len(y)), y], 1e-12)).mean()), t) for t in (0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0))
    model.temperature = best[1]
    p = _soft(sums + bias, model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.threshold = float(np.quantile(right, 0.01)) if len(right) else 1.0
    return model


def _soft(z: np.ndarray, t: float) -> np.ndarray:
    z = np.exp((z - z.max(axis=1, keepdims=True)) / t)
    return z / z.sum(axis=1, keepdims=True)


def _keyed(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    d = columns(docs, doc_id=id_col, text=text_col, **more)
    return d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def _bags(batches):
    for b in batches:
        rows = []
        for text in b.column(2).to_pylist():
            bucket, _ = subwords(words_of(text))
            u, c = np.unique(bucket, return_counts=True)
            rows.append((u.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
        yield batch(_FEATURES, b.column(0), b.column(1), [x[0] for x in rows], [x[1] for x in rows])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from a bounded sample of labelled rows, spread over the languages by a hash of the id.

    Only rows that are not held out, with text, id and language, count. Each row's whole text makes its subword bag on
    the executors; the driver gets at most 1.5 x rows_per_language bags for each language, of BUCKETS entries at most.
    None if there is nothing to learn from.
    """
    d = _keyed(docs, id_col, text_col, lang=lang_col).where("not held_out and doc_id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.15 * rows_per_language / n))).otherwise(share)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = d.withColumn("h", h).where(F.col("h") < share * float(1 << 30)).select("h", "lang", "text")
    bags = picked.mapInArrow(_bags, "h long, lang string, bucket array<int>, weight array<float>")
    rows = bags.orderBy("h", "lang", "bucket").limit(int(1.5 * rows_per_language * len(counts))).collect()
    return fit_rows([(r["bucket"], r["weight"], r["lang"]) for r in rows])


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (calibrated probability) and rejected (score below the threshold).

    Each text is scored whole: a word's subword scores are summed once for each distinct word and task. A text that is
    null or has no letter, and every text if there is no model, gets ``und`` and 0. Null ids are kept, not held out.
    """

    def run(batches):
        where: dict[str, int] = {}
        width = len(model.langs) + 1 if model else 1
        held = np.zeros((1024, width))
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in slices(len(texts), [len(t or "") for t in texts], 2_000_000):
                langs, scores, sure = [UNKNOWN] * (j - i), np.zeros(j - i), np.ones(j - i, bool)
                told = [k for k in range(j - i) if model and texts[i + k] is not None and has_letter(texts[i + k])]
                if told:
                    split = [words_of(texts[i + k]) for k in told]
                    if len(where) > _KEEP:
                        where.clear()
                    new = list(set().union(*split).difference(where))
                    if len(where) + len(new) > len(held):
                        held = np.concatenate([held, np.zeros((len(where) + len(new), width))])
                    if new:
                        at = len(where)
                        where.update(zip(new, range(at, at + len(new)), strict=True))
                        for p in range(0, len(new), 20_000):
                            part = new[p : p + 20_000]
                            bucket, owner = subwords(part)
                            for c in range(width - 1):
                                held[at + p : at + p + len(part), c] = np.bincount(owner, model.table[bucket, c], len(part))
                            held[at + p : at + p + len(part), -1] = np.bincount(owner, minlength=len(part))
                    sums = np.array([held[np.fromiter(map(where.__getitem__, w), np.int64, len(w))].sum(axis=0) for w in split])
                    probs = model.probabilities(sums[:, :-1], sums[:, -1])
                    for k, p in zip(told, probs, strict=True):
                        langs[k], scores[k] = model.langs[int(p.argmax())], float(p.max())
                        sure[k] = scores[k] < model.threshold
                yield batch(_OUT, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), langs, scores, sure)

    d = _keyed(docs, id_col, text_col).select("doc_id", "held_out", "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
