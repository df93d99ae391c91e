"""Substring dedup by recompression: runs and pairs of words get global names, round by round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, as_bytes, batch, mix64, scratch
from .repeats import WHERE, Names, anchors, covered, digests, doc_id, grouped, keyed, one_window, ranges_of, sha, sliding_least, windows, with_texts

#: Words of a window, and rounds of naming.
WINDOW, ROUNDS = 50, 2
#: In a round a symbol's fate depends on two symbols to each side, and symbols at most double: so symbols at least
#: MARGIN words inside a window are the same in every text that holds the window.
MARGIN, LONGEST = 2 * (2**ROUNDS - 1), 2**ROUNDS
#: Symbols that may be a window's anchor start within this many places from MARGIN on.
PLACES = WINDOW - 2 * MARGIN - LONGEST + 1
#: Bytes of a long text whose windows are anchored at once.
STRETCH = 1 << 21
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_units(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, and where each begins and ends."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), ends


def stretches(raw: bytes):
    """(place of the first word, words) of consecutive stretches that overlap by all but one word of a window."""
    at = first = 0
    held: list[bytes] = []
    while at < len(raw):
        stop = min(at + STRETCH, len(raw))
        while stop < len(raw) and raw[stop] not in SPACES:
            stop += 1
        words = held + raw[at:stop].split()
        yield first, words
        held = words[max(0, len(words) - WINDOW + 1) :]
        first, at = first + len(words) - len(held), stop


def recompress(names: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, start) after the rounds. Names are made by hashing alone, so every task makes the same ones.

    A round replaces each run of exactly two equal symbols, then each pair of a left and a right symbol outside runs;
    which symbols are left and which right is drawn anew in each round, from their names.
    """
    symbol, start = names, np.arange(len(names))
    for r in range(rounds):
        n = len(symbol)
        if n < 2:
            break
        equal = np.zeros(n + 1, bool)  # equal[i]: symbol i equals the one before it
        equal[1:n] = symbol[1:] == symbol[:-1]
        before, after = equal[:n], equal[1:]
        in_run = before | after
        run_of_two = after[:-1] & ~before[:-1] & ~after[1:]
        salt = np.uint64(0xA0761D6478BD642F + 2 * r)
        left = (mix64(symbol ^ salt) >> np.uint64(63)).astype(bool)
        pair = left[:-1] & ~left[1:] & ~in_run[:-1] & ~in_run[1:]
        merge = np.zeros(n, bool)
        merge[:-1] = run_of_two | pair
        with np.errstate(over="ignore"):
            i = np.flatnonzero(merge)
            named = symbol.copy()
            named[i] = mix64(symbol[i] * np.uint64(0xE7037ED1A0B428DB) + mix64(symbol[i + 1] ^ salt))
        keep = np.ones(n, bool)
        keep[1:] = ~merge[:-1]
        symbol, start = named[keep], start[keep]
    return symbol, start


def anchoring(raw: bytes):
    if len(raw) < 2 * WINDOW - 1:
        return
    for first, words in stretches(raw):
        count = len(words) - WINDOW + 1
        if count < 1:
            continue
        names = word_names(words)
        symbol, start = recompress(names)
        order = np.full(len(names), np.iinfo(np.uint64).max, np.uint64)
        # among equal symbols the first counts: the place is in the low bits, and every window compares places alike
        order[start] = (mix64(symbol) >> np.uint64(30) << np.uint64(30)) | start.astype(np.uint64)
        least = sliding_least(order[MARGIN : len(names) - MARGIN - LONGEST + 1], PLACES)
        at = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
        lo, n = grouped(at)
        a = at[lo]
        whole = np.zeros(len(names), np.uint64)
        whole[start] = symbol
        h = mix64(Names(names)(a - MARGIN, a + MARGIN + LONGEST) ^ mix64(whole[a]))
        data, begin, end = word_units(words)
        yield h.view(np.int64), digests(data, begin[lo].tolist(), end[lo + n - 2 + WINDOW].tolist()), lo + first, n


def repeated(rows: DataFrame) -> DataFrame:
    """(doc, tx, lo, n, step, reps): windows that also start in a document with a smaller id.

    Anchors of one name and one context are decided by the context's least id. Where an anchor's name has several
    contexts, the least document of each has its windows compared one by one, so that the edges of shared passages are
    exact. Contexts and windows are equal if the digests of their words are. Minima are partial sums; nothing gathers
    the occurrences of a name.
    """
    found = scratch(anchors(rows.where(F.col("tx").bitwiseAND(F.lit(1)) == 0), anchoring), "anchors")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("doc", "k", "k2") for f in (F.min, F.max)]
    shared = found.groupBy("h").agg(*ends).where("min_doc < max_doc").select("h", F.col("min_doc").alias("least"), F.expr("min_k = max_k and min_k2 = max_k2").alias("same"))
    again = scratch(found.join(shared, "h"), "shared")
    alike = again.where("same and doc > least").select(*WHERE)
    several = again.where("not same").drop("least", "same")
    contexts = several.groupBy("h", "k", "k2").agg(F.min("doc").alias("least"))
    placed = several.join(contexts, ["h", "k", "k2"])
    later = placed.where("doc > least").select(*WHERE)
    first = placed.where("doc = least").select(*WHERE)
    each = scratch(windows(rows, first, lambda raw: word_units(raw.split()), WINDOW), "windows")
    least = each.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    edges = one_window(each.join(least, ["w1", "w2"]).where("doc > least"))
    return alike.unionByName(later).unionByName(edges)


def _kept(raw: bytes, ranges: list[np.ndarray]) -> tuple[list[bytes], int]:
    words = raw.split()
    if not len(ranges[0]):
        return words, len(words)
    gone = covered(len(words), *ranges, WINDOW)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def _each(b: pa.RecordBatch):
    for i, raw in enumerate(as_bytes(b.column(1))):
        yield _kept(raw or b"", ranges_of(b.column(2), i))


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what is left of each text when repeated windows go.

    A row with a null id keeps its text and counts for no other; rows that share an id do not count for each other; a
    null text has no words; an empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            out = [(total, total - len(kept), sha(b" ".join(kept))) for kept, total in _each(b)]
            yield batch(_OUT, b.column(0), *[list(x) for x in zip(*out, strict=True)] if out else [[]] * 3)

    joined = with_texts(rows, repeated(rows), "left").select(doc_id(), "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed): the kept words joined by spaces; edge cases as in ``digest``."""
    rows = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            out = [(b" ".join(kept).decode(), total, total - len(kept)) for kept, total in _each(b)]
            yield batch(_KEPT, b.column(0), *[list(x) for x in zip(*out, strict=True)] if out else [[]] * 3)

    joined = with_texts(rows, repeated(rows), "left").select(doc_id(), "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")
