"""SimHash near-duplicates by multi-index hashing over two 32-bit segments."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, batch, columns, lean, partitions, scratch, unused
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Members of one bucket that a task holds at once. Larger buckets are cut into chunks, and each pair of chunks is a tile.
CHUNK = 1024
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text's UTF-8 bytes, repeats included; of all words where they are fewer, none of none."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit by bit, whether it is set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprint(raw: bytes) -> int:
    """Of a text's UTF-8 bytes: bit by bit, whether it is set in over half of the shingles' hashes; 0 without words."""
    return majority(shingle_hashes(raw))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. A null text has no words, hence fingerprint zero."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x or b"") for x in as_bytes(b.column(1))], np.uint64)
            yield batch(_FP, b.column(0), fps.view(np.int64))

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(run), "doc_id long, fp long")


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))


def _settle(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest labels that linked rows and columns share; near says what is linked."""
    big = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(near, right[None, :], big).min(axis=1, initial=big))
        new_right = np.minimum(right, np.where(near, new_left[:, None], big).min(axis=0, initial=big))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _joined(names: np.ndarray, old: np.ndarray, new: np.ndarray):
    """Edges between the rows that labels named before and those they name now."""
    moved = new != old
    if moved.any():
        pairs = np.unique(np.stack([old[moved], new[moved]]), axis=1)
        yield names[pairs[0]], names[pairs[1]]


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of left and right, fingerprints of one or more 64-bit words, differ in at most radius bits."""
    differ = np.zeros((len(left), len(right)), np.uint16)
    for k in range(left.shape[1]):
        differ += np.bitwise_count(left[:, None, k] ^ right[None, :, k])
    return differ <= radius


def spanning(names: np.ndarray, table: np.ndarray, probes: list[tuple[np.ndarray, np.ndarray]], radius: int):
    """Edges that join the members of one tile as its pairs within the radius do: a spanning set, not all pairs.

    Edges always join a row to the row its label names: each change of a label gives an edge from the former to the
    new one, so rows that a probe does not touch stay joined to those it relabels.
    """
    own = np.arange(len(table))
    label = _settle(_near(table, table, radius), own, own)[0]
    yield from _joined(names, own, label)
    for called, p in probes:
        near = _near(p, table, radius)
        hit = near.any(axis=1)
        if hit.any():
            mine, new = _settle(near[hit], np.full(int(hit.sum()), len(table)), label)
            yield called[hit], names[mine]
            yield from _joined(names, label, new)
            label = new


def bucket_links(table: np.ndarray, probes: list[np.ndarray]):
    """Spanning edges of one tile of 64-bit fingerprints, which are their own names, at RADIUS."""
    return spanning(table, table[:, None], [(p, p[:, None]) for p in probes], RADIUS)


def _tiles(batches):
    """Rows sorted by (seg, key, a, b, role): runs of one tile, table rows (role 0) before probes."""
    key, table, probes = None, [], []

    def done():
        if table and sum(map(len, table)) + sum(map(len, probes)) > 1:
            for u, v in bucket_links(np.unique(np.concatenate(table)), probes):
                yield batch(_EDGE, u.view(np.int64), v.view(np.int64))

    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
        role, fp = b.column(4).to_numpy(), b.column(5).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        # runs of one row inside a batch have nothing to compare
        busy = (stops - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
        for s, e in zip(starts[busy].tolist(), stops[busy].tolist(), strict=True):
            here = tuple(k[s])
            if here != key:
                yield from done()
                key, table, probes = here, [], []
            split = s + int(np.searchsorted(role[s:e], 1))
            if split > s:
                table.append(fp[s:split])
            for i in range(split, e, 4096):
                probes.append(fp[i : min(i + 4096, e)])
            if sum(map(len, probes)) > 65536:  # a long run of probes is compared as it comes
                for u, v in bucket_links(np.unique(np.concatenate(table)), probes):
                    yield batch(_EDGE, u.view(np.int64), v.view(np.int64))
                probes = []
    yield from done()


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of fingerprints (column fp) at RADIUS bits or fewer.

    Two fingerprints that differ in at most three bits differ in at most one bit of one of their halves. Each half
    indexes a table. Halves that are equal meet in the table's own bucket; of two halves one bit apart, one has an even
    number of ones, and that one probes its ball of radius one (each of 32 flips). Complete distances are verified.
    """
    parts = []
    for i in range(2):
        half = distinct.select(F.lit(i).cast("byte").alias("seg"), _segment(i).alias("key"), "fp")
        parts.append(half)
    table = parts[0].unionByName(parts[1])
    flips = F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)))
    probes = table.where(F.bit_count("key") % 2 == 0).select("seg", "key", "fp", flips.alias("flip")).select("seg", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    counts = table.groupBy("seg", "key").agg(F.count("*").alias("n_table"))
    members = table.withColumn("role", F.lit(0).cast("byte")).unionByName(probes.withColumn("role", F.lit(1).cast("byte"))).join(counts, ["seg", "key"])
    chunks = F.ceil(F.col("n_table") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    members = members.select("seg", "key", "role", "fp", chunks.alias("chunks"), mine.alias("mine"))
    many = members.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    own = F.col("role") == 1
    tiles = many.select("seg", "key", F.when(own, F.col("other")).otherwise(F.least("mine", "other")).alias("a"), F.when(own, F.col("other")).otherwise(F.greatest("mine", "other")).alias("b"), "role", "fp")
    n = partitions(distinct.sparkSession)
    placed = tiles.repartition(n, "seg", "key", "a", "b").sortWithinPartitions("seg", "key", "a", "b", "role")
    return placed.mapInArrow(lean(_tiles), "u long, v long")


def components_of(fps: DataFrame) -> DataFrame:
    """(fp, component_id, root) of each fingerprint in (doc_id, fp)."""
    distinct = scratch(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(scratch(links(distinct.select("fp")), "links"))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of the input.

    component_id is the smallest id reachable over links; equal fingerprints are always together. Texts that are null
    or without words have fingerprint zero and link like any other. Null ids are no candidates for the smallest; a
    component with none but null ids has a null component_id. An empty table gives an empty one.
    """
    fps = scratch(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    return fps.join(components_of(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Rule(NamedTuple):
    """What makes texts near-duplicates: names of the fingerprint's columns, its words (signed) of a text's bytes, and
    a function from rows with those columns and doc_id to the columns with the root of their component."""

    names: list[str]
    words: Callable[[bytes], tuple]
    roots: Callable[[DataFrame], DataFrame]


def _signed(raw: bytes) -> tuple:
    value = fingerprint(raw)
    return (value - (1 << 64) if value >> 63 else value,)


#: Three-word shingles, 64 bits, at most three of which differ: copies and almost equal texts.
CLOSE = Rule(["fp"], _signed, lambda fps: components_of(fps).select("fp", "root"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CLOSE) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (null last).

    Of rows that share that id, those with the smallest hash of the text count, and of equal rows one stays. Null texts
    and texts without words have fingerprint zero and link like any other.
    """
    names, (key, tx) = docs.columns, unused(docs, "id", "tx")
    own_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    own = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(own_id, F.lit(0)).alias(key), F.xxhash64(text, own_id.isNull()).alias(tx))
    width = len(rule.names)

    def run(batches):
        for b in batches:
            fps = np.array([rule.words(x or b"") for x in as_bytes(b.column(3))], np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(fps[:, k]) for k in range(width)]], names=["doc_id", "id", "tx", *rule.names])

    schema = "doc_id long, id long, tx long, " + ", ".join(f"{c} long" for c in rule.names)
    fps = scratch(own.select(own_id.alias("doc_id"), key, tx, text.alias("text")).mapInArrow(lean(run), schema), "fingerprints")
    chosen = fps.join(rule.roots(fps), rule.names).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "id", "tx")).alias("first"))
    chosen = chosen.select(F.col("first.id").alias(key), F.col("first.tx").alias(tx))
    return own.join(chosen, [key, tx]).dropDuplicates([key, tx]).select(*[F.col(f"`{c}`") for c in names])
