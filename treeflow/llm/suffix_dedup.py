"""Suffix-array dedup: byte strings of a fixed width that start more than once in the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, batch, mix64, partitions, scratch
from .repeats import WHERE, Names, anchors, covered, digests, doc_id, grouped, keyed, one_window, ranges_of, sha, sliding_least, windows, with_texts
from .suffixes import repeated_prefixes, suffix_array

#: Bytes of a string, and of the gram that anchors it.
WIDTH, GRAM = 200, 64
#: Windows of a long text that are anchored at once.
STRETCH = 1 << 21
#: Bytes of contexts that one suffix array holds, about; an anchor with more contexts than CONTEXTS is settled by
#: named windows instead, spread over all tasks, which is exact as well.
SHARD_BYTES, CONTEXTS = 1_500_000, 8192
_UNITS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_C = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("tx", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("once", pa.bool_()), ("context", pa.binary())])
_R = pa.schema([("doc", pa.int64()), ("tx", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("step", pa.int32()), ("reps", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))])


def byte_units(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    at = np.arange(len(raw))
    return raw, at, at + 1


def anchoring(raw: bytes):
    for begin in range(0, len(raw) - WIDTH + 1, STRETCH):
        part = raw[begin : begin + STRETCH + WIDTH - 1]
        grams = Names(_UNITS[np.frombuffer(part, np.uint8)]).fixed(GRAM)
        # the least gram of a window anchors it, the first of equal ones: the place is in the low bits
        order = (mix64(grams) >> np.uint64(30) << np.uint64(30)) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_least(order, WIDTH - GRAM + 1) & np.uint64((1 << 30) - 1)).astype(np.int64)
        lo, n = grouped(at)
        yield grams[at[lo]].view(np.int64), digests(part, lo.tolist(), (lo + n - 1 + WIDTH).tolist()), lo + begin, n


def _contexts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            doc, tx = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, raw in enumerate(as_bytes(b.column(2))):
                lo, n, h, once = ranges_of(b.column(3), i, "h", "once")
                for j in range(0, len(lo), 4096):
                    s = slice(j, j + 4096)
                    held = [raw[x : x + m - 1 + WIDTH] for x, m in zip(lo[s].tolist(), n[s].tolist(), strict=True)]
                    yield batch(_C, h[s], np.full(len(held), doc[i]), np.full(len(held), tx[i]), lo[s].astype(np.int32), n[s].astype(np.int32), once[s].astype(bool), held)

    joined = with_texts(rows.select("doc", "tx", "text"), chosen, "inner", "h", "once")
    return joined.select("doc", "tx", "text", "ranges").mapInArrow(run, "h long, doc long, tx long, lo int, n int, once boolean, context binary")


def repeated_in(contexts: list[bytes], windows_of: list[int]) -> list[np.ndarray]:
    """For each context, which of its windows also start elsewhere in the contexts.

    Contexts are laid out with marks between them; the suffix array is induced, and common prefixes with neighbours
    tell the windows that meet again. No window reaches over a mark.
    """
    sizes = np.array([len(x) + 1 for x in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8).astype(np.int32) + 2
    text[starts + sizes - 1] = 1  # the marks
    text[-1] = 0
    found = repeated_prefixes(text, suffix_array(text, 258), WIDTH)
    return [found[s : s + n] for s, n in zip(starts.tolist(), windows_of, strict=True)]


def _shards(batches):
    """Rows sorted by h: whole names are gathered up to SHARD_BYTES, and each such shard gets one suffix array."""
    held, size, last = [], 0, None

    def settle():
        if len(held) < 2:
            return
        found = repeated_in([x[5] for x in held], [x[3] for x in held])
        out = []
        for (doc, tx, lo, _, once, _), twice in zip(held, found, strict=True):
            if once and twice.any():
                edge = np.diff(np.concatenate([[0], twice.view(np.int8), [0]]))
                for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    out.append((doc, tx, lo + a, z - a, 0, 1))
        if out:
            yield batch(_R, *[list(x) for x in zip(*out, strict=True)])

    for b in batches:
        for h, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if h != last and size > SHARD_BYTES:
                yield from settle()
                held, size = [], 0
            last = h
            held.append(row)
            size += len(row[5])
    yield from settle()


def repeated(rows: DataFrame) -> DataFrame:
    """(doc, tx, lo, n, step, reps): places whose string of WIDTH bytes also starts anywhere else.

    Anchors whose name has one context only are decided by its count: all windows repeat where it occurs twice. Where
    a name has several contexts, one copy of each goes to the shard of its name, and suffix arrays find the windows
    that different contexts share. Contexts are equal if the digests of their bytes are. Counts are partial sums, and
    no task gathers the occurrences of a name.
    """
    found = scratch(anchors(rows, anchoring), "anchors")
    ends = [f("k").alias(f"{f.__name__}_k") for f in (F.min, F.max)] + [f("k2").alias(f"{f.__name__}_k2") for f in (F.min, F.max)]
    shared = found.groupBy("h").agg(F.sum("reps").alias("times"), *ends).where("times > 1").select("h", F.expr("min_k = max_k and min_k2 = max_k2").alias("same"))
    again = scratch(found.join(shared, "h"), "shared")
    alike = again.where("same").select(*WHERE)
    several = again.where("not same").drop("same")
    contexts = several.groupBy("h", "k", "k2").agg(F.sum("reps").alias("times"), F.min(F.struct("doc", "tx", "lo", "n")).alias("first"))
    contexts = scratch(contexts.select("h", "k", "k2", "times", "first.*"), "contexts")
    copies = several.join(contexts.where("times > 1").select("h", "k", "k2"), ["h", "k", "k2"]).select(*WHERE)
    wide = contexts.groupBy("h").agg(F.count("*").alias("contexts"))
    placed = contexts.join(wide, "h").withColumns({"once": F.col("times") == 1, "step": F.lit(0), "reps": F.lit(1)})
    narrow = _contexts(rows, placed.where(F.col("contexts") <= CONTEXTS).select(*WHERE, "h", "once"))
    n = partitions(rows.sparkSession)
    edges = narrow.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_shards, "doc long, tx long, lo int, n int, step int, reps int")
    out = alike.unionByName(copies).unionByName(edges)
    hot = placed.where(F.col("contexts") > CONTEXTS)
    if hot.limit(1).count():
        # made twice from the one exchange of texts, so that wide names add no shuffle of texts
        each = windows(rows, hot.select(*WHERE), byte_units, WIDTH)
        twice = each.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
        out = out.unionByName(one_window(each.join(twice, ["w1", "w2"])))
    return out


def _each(b: pa.RecordBatch):
    for i, raw in enumerate(as_bytes(b.column(1))):
        raw = raw or b""
        ranges = ranges_of(b.column(2), i)
        if not len(ranges[0]):
            yield raw, raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        gone = covered(len(raw), *ranges, WIDTH)
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        yield raw, np.frombuffer(raw, np.uint8)[~gone].tobytes(), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without its repeated strings.

    A null text is empty; rows with null or equal ids are rows like any other, and equal rows repeat each other; an
    empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            out = [(len(raw), len(raw) - len(kept), len(starts), sha(kept)) for raw, kept, starts, _ in _each(b)]
            yield batch(_OUT, b.column(0), *[list(x) for x in zip(*out, strict=True)] if out else [[]] * 4)

    joined = with_texts(rows, repeated(rows), "left").select(doc_id(), "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, starts, stops): remaining bytes, and the removed spans as byte offsets; edge cases as in ``digest``."""
    rows = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            out = [(kept, starts, stops) for _, kept, starts, stops in _each(b)]
            yield batch(_KEPT, b.column(0), *[list(x) for x in zip(*out, strict=True)] if out else [[]] * 3)

    joined = with_texts(rows, repeated(rows), "left").select(doc_id(), "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, kept binary, starts array<long>, stops array<long>")
