"""Near copies by SimHash of five-word shingles: multi-index hashing over segments of a long fingerprint.

Two texts whose sets of shingles have a Jaccard similarity J differ in about acos(2J / (1 + J)) / pi of the bits of
their fingerprints: 15 % at J = 0.8. No 64-bit fingerprint can tell that from 19 % (J = 0.7), so this one has 240 bits,
in twelve segments of 20. Texts link if some segment differs in at most one bit and the whole in at most RADIUS. Both
are estimates of J >= 0.8, and ``test_near_copies`` states how well they find it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, lean, mix64, partitions, scratch
from .components import components
from .simhash import Rule, majority, shingle_hashes, spanning

SHINGLE = 5
#: A fingerprint is WORDS longs of three segments each. Random texts meet in about 1 of 2 ** BITS buckets, so a corpus
#: of billions of texts needs more bits for a segment, and more segments to find as much.
WORDS, EACH, BITS = 4, 3, 20
#: Bits of 240 in which near copies differ at most: 18 %, one standard deviation above what J = 0.8 gives.
RADIUS = 43
#: Table rows of one bucket that a task holds at once; larger buckets are cut into chunks, and pairs of chunks are tiles.
CHUNK = 1024
NAMES = [f"f{k}" for k in range(WORDS)]
_MASK = (1 << BITS * EACH) - 1
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def sketch(raw: bytes) -> tuple:
    """The fingerprint's words, of the set of a text's shingles; zeros of a text without words."""
    hashes = np.unique(shingle_hashes(raw, SHINGLE))
    with np.errstate(over="ignore"):
        return tuple(majority(mix64(hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))) & _MASK for k in range(WORDS))


def _busy(starts: np.ndarray, stops: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Which runs may hold a link: runs of few pairs are compared at once, larger ones count as busy."""
    n, before = stops - starts, np.concatenate([[0], np.cumsum(probe)])
    table = n - (before[stops] - before[starts])
    busy = table * n > 256
    few = np.flatnonzero((table > 0) & (n > 1) & ~busy)
    pairs = table[few] * n[few]
    run = np.repeat(np.arange(len(few)), pairs)
    at = np.arange(len(run)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    left, right = starts[few][run] + at // n[few][run], starts[few][run] + at % n[few][run]
    near = (np.bitwise_count(fp[left] ^ fp[right]).sum(axis=1, dtype=np.int64) <= RADIUS) & (left != right)
    busy[few[run[near]]] = True
    return busy


def _tiles(batches):
    """Rows (key, part, id, words) sorted by key and part; part is twice the tile, plus one for probes."""
    here, table, probes, waiting = None, [], [], 0

    def done():
        if table and sum(len(x[0]) for x in table) + waiting > 1:
            names, rows = (np.concatenate(x) for x in zip(*table, strict=True))
            for u, v in spanning(names, rows, probes, RADIUS):
                yield batch(_EDGE, u, v)

    for b in batches:
        if not b.num_rows:
            continue
        key, part, names = (b.column(i).to_numpy() for i in range(3))
        fp = np.stack([b.column(3 + k).to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
        tile, probe = part >> 1, part & 1
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        busy = _busy(starts, stops, probe, fp)
        busy[0] = busy[-1] = True  # these may go on in another batch
        for s, e in zip(starts[busy].tolist(), stops[busy].tolist(), strict=True):
            now = (int(key[s]), int(tile[s]))
            if now != here:
                yield from done()
                here, table, probes, waiting = now, [], [], 0
            split = s + int(np.searchsorted(probe[s:e], 1))
            if split > s:
                table.append((names[s:split], fp[s:split]))
            if table:  # probes come after the table, and without one there is nothing to find
                probes += [(names[i : min(i + 4096, e)], fp[i : min(i + 4096, e)]) for i in range(split, e, 4096)]
                waiting += e - split
            if waiting > 65536:  # a long run of probes is compared as it comes
                yield from done()
                probes, waiting = [], 0
    yield from done()


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between ids whose components are those of all links of the fingerprints (id, f0, f1, ...).

    Every segment indexes a table. Equal segments meet in the table's own bucket; of two segments one bit apart, one
    has an even number of ones, and that one probes its ball of radius one. Complete distances are verified. A bucket
    of more than CHUNK table rows is dealt over tiles; tasks give spanning edges, never all pairs.
    """
    segments = F.array(*[F.struct(F.lit(EACH * k + j).cast("long").alias("seg"), F.shiftright(f"f{k}", BITS * j).bitwiseAND(F.lit((1 << BITS) - 1)).alias("value")) for k in range(WORDS) for j in range(EACH)])
    key = lambda seg, value: F.call_function("shiftleft", seg, F.lit(BITS)).bitwiseOR(value)
    cut = distinct.select("id", *NAMES, F.explode(segments).alias("s")).select("id", *NAMES, "s.seg", "s.value")
    table = cut.select(key(F.col("seg"), F.col("value")).alias("key"))
    hot = table.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("long").alias("chunks"))
    # flip 0 is the value itself in the table, the others the ball of the probes
    flips = F.when(F.bit_count("value") % 2 == 0, F.array(*[F.lit(0 if j < 0 else 1 << j).cast("long") for j in range(-1, BITS)])).otherwise(F.array(F.lit(0).cast("long")))
    members = cut.select("id", *NAMES, "seg", "value", F.explode(flips).alias("flip"))
    members = members.select(key(F.col("seg"), F.col("value").bitwiseXOR(F.col("flip"))).alias("key"), (F.col("flip") != 0).cast("long").alias("role"), "id", *NAMES)
    # written first, so that its true size decides whether the members must be shuffled for it
    members = members.join(scratch(hot, "hot"), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    mine, other = F.pmod(F.xxhash64("id"), F.col("chunks")), F.col("other")
    dealt = members.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    first, last = F.when(F.col("role") == 1, other).otherwise(F.least("mine", other)), F.when(F.col("role") == 1, other).otherwise(F.greatest("mine", other))
    part = F.call_function("shiftleft", first, F.lit(31)) + F.call_function("shiftleft", last, F.lit(1)) + F.col("role")
    tiles = dealt.select("key", part.alias("part"), "id", *NAMES)
    placed = tiles.repartition(partitions(distinct.sparkSession), "key", F.shiftright("part", 1)).sortWithinPartitions("key", "part")
    return placed.mapInArrow(lean(_tiles), "u long, v long")


def roots(fps: DataFrame) -> DataFrame:
    """(f0, f1, ..., root) of each distinct fingerprint; equal fingerprints are one row before anything is compared.

    Ids are given once and written, so that they stay what they are whichever task is lost.
    """
    distinct = scratch(fps.select(*NAMES).distinct().withColumn("id", F.monotonically_increasing_id()), "distinct")
    found = components(scratch(links(distinct), "links"))
    return distinct.join(found.withColumnRenamed("node", "id"), "id", "left").select(*NAMES, F.coalesce("root", "id").alias("root"))


#: Five-word shingles and a similarity of 0.8 or more, for ``simhash.one_of_each``.
NEAR = Rule(NAMES, sketch, roots)
