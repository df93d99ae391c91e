"""Repeated windows over a corpus: anchors chosen by content, contexts compared by digest, and the joins around them.

A window is ``width`` units (bytes or words) at one place of a text. Each window designates one anchor inside it, by
its content alone, so equal windows designate the same anchor at the same offset. The windows of one anchor are
consecutive; together they are its context. Rows are (doc, tx, h, k, k2, lo, n, step, reps): h names the units around
the anchor that all its windows hold, k and k2 are a 128-bit BLAKE2 digest of the units of the whole context, and its n
windows start at lo. A context that a text holds several times, step units apart, is one row with so many reps: runs of
a repeated unit or phrase take one row for each place in the phrase, however long they are. Equal windows have equal h.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, batch, columns, mix64

_A = pa.schema([(x, pa.int64()) for x in ("doc", "tx", "h", "k", "k2")] + [(x, pa.int32()) for x in ("lo", "n", "step", "reps")])
_W = pa.schema([("doc", pa.int64()), ("tx", pa.int64()), ("lo", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
ANCHORS = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in _A)
#: The columns that say where a row's windows are.
WHERE = ("doc", "tx", "lo", "n", "step", "reps")
#: Odd base of the polynomial names of runs of units.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        out = []
        with np.errstate(over="ignore"):
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
        have = (out[0], out[1])
        if size <= 1 << 21:
            _POWERS[base] = have
    return have


class Names:
    """64-bit names of any runs of a sequence of unit hashes, in constant time each."""

    def __init__(self, units: np.ndarray, base: int = BASE):
        self.up, self.down = _powers(base, len(units) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * self.up[: len(units)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[stop] - self.sums[start]) * self.down[start])

    def fixed(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by minima from both ends of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def grouped(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of windows with one anchor."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return first, np.diff(np.concatenate([first, [len(anchor)]]))


def digests(data: bytes, start: list[int], stop: list[int]) -> np.ndarray:
    """128-bit digests of stretches of bytes, two longs each."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(data[a:z], digest_size=16).digest() for a, z in zip(start, stop, strict=True)]), np.int64).reshape(-1, 2)


def folded(h: np.ndarray, k: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """h, k, lo, n, step and reps: rows of one name and context whose places are evenly spaced become one."""
    with np.errstate(over="ignore"):
        key = mix64(h.view(np.uint64) ^ mix64(k[:, 0].view(np.uint64)))
    order = np.argsort(key, kind="stable")
    h, k, lo, n = h[order], k[order], lo[order], n[order]
    joined = np.zeros(len(h), bool)  # a row and the one before it have one name and context
    joined[1:] = (h[1:] == h[:-1]) & (k[1:] == k[:-1]).all(axis=1) & (n[1:] == n[:-1])
    if not joined.any():
        return h, k, lo, n, np.zeros(len(h), np.int64), np.ones(len(h), np.int64)
    gap = np.zeros(len(h), np.int64)
    gap[1:] = np.diff(lo)
    # a row goes on with the run before it if its gap is that run's, or if the row before it opens a group
    opens = ~joined
    goes_on = joined.copy()
    goes_on[2:] &= opens[1:-1] | (gap[2:] == gap[1:-1])
    first = np.flatnonzero(~goes_on)
    reps = np.diff(np.concatenate([first, [len(h)]]))
    step = np.where(reps > 1, gap[np.minimum(first + 1, len(h) - 1)], 0)
    return h[first], k[first], lo[first], n[first], step, reps


#: From a text's bytes, stretch by stretch: h, k (two columns), lo and n of its anchors.
Anchoring = Callable[[bytes], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tx, text): doc and tx tell rows apart even where ids are null or shared; equal rows share both.

    The lowest bit of tx says that the id is null, so ``doc_id`` gets it back and every join with texts reads the same
    three columns: within one plan they are shuffled once.
    """
    d = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    null = F.col("doc_id").isNull().cast("long")
    return d.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(null).alias("tx"), "text")


def doc_id() -> Column:
    return F.when(F.col("tx").bitwiseAND(F.lit(1)) == 0, F.col("doc")).alias("doc_id")


def anchors(rows: DataFrame, anchoring: Anchoring) -> DataFrame:
    """One row for each anchor of each text, folded; memory follows one stretch of a text, not the text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            doc, tx = b.column(0).to_numpy(), b.column(1).to_numpy()
            found, held = [], 0
            for i, raw in enumerate(as_bytes(b.column(2))):
                for a in anchoring(raw or b""):
                    found.append((i, folded(*a)))
                    held += len(found[-1][1][0])
                    if held > 200_000:
                        yield _rows(doc, tx, found)
                        found, held = [], 0
            if found:
                yield _rows(doc, tx, found)

    return rows.select("doc", "tx", "text").mapInArrow(run, ANCHORS)


def _rows(doc: np.ndarray, tx: np.ndarray, found: list) -> pa.RecordBatch:
    at = np.repeat([i for i, _ in found], [len(a[0]) for _, a in found])
    h, k, lo, n, step, reps = (np.concatenate([a[j] for _, a in found]) for j in range(6))
    return batch(_A, doc[at], tx[at], h.view(np.int64), k[:, 0], k[:, 1], *[x.astype(np.int32) for x in (lo, n, step, reps)])


def with_texts(rows: DataFrame, ranges: DataFrame, how: str, *more: str) -> DataFrame:
    """Texts joined with all their distinct ranges (lo, n, step, reps and more) as one array: equal rows share one."""
    lists = ranges.groupBy("doc", "tx").agg(F.collect_set(F.struct("lo", "n", "step", "reps", *more)).alias("ranges"))
    return rows.join(lists, ["doc", "tx"], how)


def ranges_of(column: pa.Array, i: int, *more: str) -> list[np.ndarray]:
    """lo, n and more of the i-th list of ranges, one entry for each repetition."""
    if not column.is_valid()[i].as_py():
        return [np.zeros(0, np.int64) for _ in range(2 + len(more))]
    x = column[i].values
    lo, n, step, reps, *rest = (x.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("lo", "n", "step", "reps", *more))
    if (reps == 1).all():
        return [lo, n, *rest]
    at = np.repeat(np.arange(len(lo)), reps)
    place = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
    return [lo[at] + step[at] * place, n[at], *[y[at] for y in rest]]


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All windows of the ranges."""
    start = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return start + np.arange(int(n.sum()))


def covered(size: int, lo: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which of ``size`` units lie in a window of the ranges."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def windows(rows: DataFrame, ranges: DataFrame, units: Callable[[bytes], tuple[bytes, np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """(doc, tx, lo, w1, w2) of each window in the ranges: its place and the 128-bit digest of its units.

    units gives a text's units as bytes, and where in them each begins and ends.
    """

    def run(batches):
        for b in batches:
            doc, tx = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, raw in enumerate(as_bytes(b.column(2))):
                at = np.unique(spread(*ranges_of(b.column(3), i)))
                data, begin, end = units(raw)
                for j in range(0, len(at), 100_000):
                    part = at[j : j + 100_000]
                    w = digests(data, begin[part].tolist(), end[part + width - 1].tolist())
                    yield batch(_W, np.full(len(part), doc[i]), np.full(len(part), tx[i]), part.astype(np.int32), w[:, 0], w[:, 1])

    joined = with_texts(rows.select("doc", "tx", "text"), ranges, "inner")
    return joined.select("doc", "tx", "text", "ranges").mapInArrow(run, "doc long, tx long, lo int, w1 long, w2 long")


def one_window(places: DataFrame) -> DataFrame:
    """Places (doc, tx, lo) of single windows as ranges."""
    return places.select("doc", "tx", "lo", *[F.lit(x).alias(name) for name, x in (("n", 1), ("step", 0), ("reps", 1))])


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
