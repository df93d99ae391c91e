"""Mixing sources to target weights: fixed-length blocks, multinomial shard counts, index permutations, one join."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, lean, mix64, partitions, scratch, trim, unused

#: Words in a block, blocks in an output shard, and slots that are drawn together, at most.
BLOCK_WORDS, SHARD_BLOCKS, GROUP_SLOTS = 64, 1024, 1 << 28
#: Weights by rank of the source, repeating; no source is taken more often than this.
WEIGHTS, MOST_REPEATS = (1, 2, 3), 3
SEED = 20240607
#: Rows that one window of running sums holds, about.
BUCKET_ROWS, GROUP_BUCKETS = 2000, 256
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Source:
    """One source of the mix; ``slots`` blocks of it are drawn from ``blocks``."""

    rank: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the whole size by repeating weights; what lies above ``most`` times a source's size is shared anew."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    free, out, left = [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes), float(sum(sizes))
    while free:
        unit = left / sum(w[i] for i in free)
        above = [i for i in free if unit * w[i] > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(above)]
    return out


def plan(sizes: list[tuple[str | None, int]], *, block_words: int = BLOCK_WORDS) -> list[Source]:
    """Sources by code point, null last, with their targets and how many blocks to draw.

    Whole passes over a source take each block once; of the last pass as many blocks as come nearest to the target.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    out = []
    for rank, ((name, size), target) in enumerate(zip(ordered, targets([s for _, s in ordered]), strict=True)):
        blocks = -(-size // block_words)
        passes = min(MOST_REPEATS, int(target // size)) if size else 0
        rest = target - passes * size if size else 0.0
        last = min(blocks, int(rest / size * blocks + 0.5)) if size and passes < MOST_REPEATS else 0
        out.append(Source(rank, name, size, target, blocks, passes * blocks + last))
    return out


# --- draws -----------------------------------------------------------------------------------------------------


def _generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([SEED, *key])))


@dataclass(frozen=True)
class Shards:
    """The output's shards, in groups that are drawn each on its own.

    Group g of n gets the slots from slots * g // n on of each source, so a group holds every source in its proportion
    and at most GROUP_SLOTS slots, whatever the size of the mix. Within a group, each shard's counts are multinomial
    draws, given that all its shards together take exactly the group's slots.
    """

    slots: tuple[int, ...]
    shard_blocks: int = SHARD_BLOCKS
    group_slots: int = GROUP_SLOTS

    @property
    def groups(self) -> int:
        return -(-sum(self.slots) // max(1, self.group_slots - len(self.slots)))

    def before(self, group: int) -> np.ndarray:
        """Slots of each source in the groups before this one."""
        return np.array([s * group // max(1, self.groups) for s in self.slots], np.int64)

    def sizes(self) -> list[int]:
        """Shards in each group."""
        return [-(-int((self.before(g + 1) - self.before(g)).sum()) // self.shard_blocks) for g in range(self.groups)]

    def counts(self, group: int, shards: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """How many blocks of each source a shard of a group gets, and how many all the shards before it got.

        The law of the counts is multivariate hypergeometric and splits in halves, so one shard's counts take a
        logarithmic number of draws, each with a key of its own: every shard can be made alone, and again.
        """
        before = self.before(group)
        here = self.before(group + 1) - before
        total, low, high = int(here.sum()), 0, shards
        while high - low > 1:
            mid = (low + high) // 2
            left = min(total, mid * self.shard_blocks) - min(total, low * self.shard_blocks)
            draw = _split(here, left, _generator(group, low, high))
            if shard < mid:
                here, high = draw, mid
            else:
                before, here, low = before + draw, here - draw, mid
        return here, before


def _split(have: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw, source by source."""
    out, rest, left = np.zeros(len(have), np.int64), int(have.sum()), int(take)
    for i, n in enumerate(have.tolist()):
        rest -= n
        if n and left:
            out[i] = int(rng.hypergeometric(n, rest, left)) if rest else left
            left -= int(out[i])
    return out


def permuted(index: np.ndarray, n: int, *key: int) -> np.ndarray:
    """Where a keyed pseudorandom permutation of range(n) takes each index: a Feistel network with cycle walking."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _generator(n, *key).integers(0, 1 << 63, 4, dtype=np.uint64)
    out = index.astype(np.uint64, copy=True)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def slots(spark, sources: list[Source], *, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, rank, block, pass): every output slot of every shard with the block it holds.

    A shard's slots are in a pseudorandom order of their own; pass counts the earlier passes over the source.
    """
    plan, blocks = Shards(tuple(s.slots for s in sources), shard_blocks), [s.blocks for s in sources]
    sizes = plan.sizes()
    stops = np.cumsum(sizes, dtype=np.int64)
    shards = int(stops[-1]) if sizes else 0

    def run(frames):
        for frame in frames:
            for shard in frame["id"].tolist():
                group = int(np.searchsorted(stops, shard, "right"))
                here, before = plan.counts(group, sizes[group], shard - int(stops[group]) + sizes[group])
                rank = np.repeat(np.arange(len(here)), here)
                place = np.empty(len(rank), np.int64)
                passes = np.empty(len(rank), np.int64)
                at = 0
                for r, (n, first) in enumerate(zip(here.tolist(), before.tolist(), strict=True)):
                    if n:
                        p, i = np.divmod(np.arange(first, first + n), blocks[r])
                        for q in np.unique(p).tolist():
                            place[at : at + n][p == q] = permuted(i[p == q], blocks[r], r, q)
                        passes[at : at + n] = p
                    at += n
                order = _generator(1 << 40, shard).permutation(len(rank))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(rank)), "rank": rank[order].astype(np.int32), "block": place[order], "pass": passes[order].astype(np.int32)})

    ids = spark.range(0, shards, 1, max(1, min(shards, partitions(spark))))
    return ids.mapInPandas(lean(run), "shard long, slot long, rank int, block long, pass int")


# --- blocks ----------------------------------------------------------------------------------------------------


def _running(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, *keys): size counts the words; a null text has none."""
    d = columns(docs, doc_id=id_col, text=text_col, source=source_col, **{k: k for k in keys})
    return d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keys)


def packed(sizes: DataFrame, sources: list[Source], rows: int) -> DataFrame:
    """Adds rank, row (a place among equal rows) and start, the row's first word in its source's stream of words.

    Rows of a source are strung together by hash buckets of their ids, so that sums run in windows of about
    BUCKET_ROWS rows, then over buckets in groups, then over groups: no window holds a source. Equal ids are
    interchangeable where only their sizes and places count; keys beside doc_id, source and size stay and break ties.
    """
    keys = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    n = 1
    while n * BUCKET_ROWS < rows:
        n *= 2
    ranks = _table(sizes, sources, "name string, rank int")
    d = sizes.join(ranks, sizes["source"].eqNullSafe(ranks["name"])).drop("source", "name")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS).cast("int"))
    d = d.withColumn("row", F.row_number().over(Window.partitionBy("rank", "group", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", *keys)))
    d = _running(d, ["rank", "group", "bucket"], [F.col("row")], "size", "in_bucket")
    per_bucket = sizes_by(d, ["rank", "group", "bucket"])
    per_group = _running(sizes_by(per_bucket, ["rank", "group"]), ["rank"], [F.col("group")], "size", "at_group").drop("size")
    offsets = _running(per_bucket, ["rank", "group"], [F.col("bucket")], "size", "at_bucket").drop("size").join(per_group, ["rank", "group"])
    return d.join(offsets, ["rank", "group", "bucket"]).select("doc_id", "size", "rank", "bucket", "row", *keys, (F.col("in_bucket") + F.col("at_bucket") + F.col("at_group")).alias("start"))


def sizes_by(d: DataFrame, keys: list[str]) -> DataFrame:
    return d.groupBy(*keys).agg(F.sum("size").alias("size"))


def pieces(rows: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each part of a row in a block: block, first (word of the row) and words; wordless rows have a null block."""
    stop = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block_words), F.floor((stop - 1) / block_words)
    out = rows.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"))
    low, high = F.greatest(F.col("block") * block_words, "start"), F.least((F.col("block") + 1) * block_words, stop)
    return out.select("*", (low - F.col("start")).alias("first"), F.coalesce(high - low, F.lit(0)).alias("words"))


def survey(sizes: DataFrame) -> tuple[list[tuple[str | None, int]], int]:
    """Each source's size, and the number of rows. The driver holds one entry for each source, never one for each row."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return [(r["source"], r["size"] or 0) for r in found], sum(r["n"] for r in found)


def mix(docs: DataFrame, **names) -> tuple[DataFrame, DataFrame, list[Source]]:
    """(pieces, slots, sources) of the mix over all rows: the pieces of (rank, block) fill each slot that draws it.

    Null sources form one source, ranked last; an empty table gives empty ones; equal rows are rows of their own.
    """
    sizes = scratch(measured(docs, **names), "sizes")
    found, rows = survey(sizes)
    sources = plan(found)
    return pieces(packed(sizes, sources, rows)), slots(docs.sparkSession, sources), sources


def _table(df: DataFrame, sources: list[Source], schema: str) -> DataFrame:
    """The sources' fields as a table: one row for each source, joined as its size allows."""
    fields = [x.split()[0] for x in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(getattr(s, f) for f in fields) for s in sources], schema)


def taken(docs: DataFrame, **names: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of each row, repeats counted.

    A null text has size 0 and gives nothing; null sources form one source, ranked last; rows with null or equal ids
    stay rows of their own; an empty table gives an empty one. The driver and each task hold one entry for each source.
    """
    parts, drawn, sources = mix(docs, **names)
    repeats = drawn.groupBy("rank", "block").agg(F.count("*").alias("n"))
    joined = parts.join(repeats.hint("merge"), ["rank", "block"], "left")  # a plan's guess at drawn rows is far too low
    rows = joined.groupBy("doc_id", "rank", "bucket", "row", "size").agg(F.sum(F.col("words") * F.coalesce("n", F.lit(0))).alias("taken"))
    totals = _table(docs, sources, "rank int, size long, target double").withColumnRenamed("size", "source_size")
    return rows.join(totals, "rank").select("doc_id", "size", "source_size", "target", "taken")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The stretches of text over the spans (first word, words), in order, joined by newlines; whole if they cover it."""
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
    merged: list[list[int]] = []
    for first, words in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], first + words)
        else:
            merged.append([first, first + words])
    if merged == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in merged if b > a)


def _cuts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, s in parts:
        yield pd.Series([cut(x, [(y["first"], y["words"]) for y in z]) for x, z in zip(t, s, strict=True)], dtype=object)
    trim()


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix as documents: one row for each row and pass that the mix takes from, with the text it takes in that pass.

    A pass that takes all blocks of a row gives its text unchanged; else the taken stretches are joined by newlines.
    Columns are those of the input; rows without words or of which nothing is taken go; ``chars_col`` is counted anew.
    Rows are told apart by all their columns, so null and shared ids do no harm; equal rows are rows of their own.
    """
    names, keys = docs.columns, tuple(unused(docs, "k0", "k1"))
    own = _keyed(docs, text_col, keys)
    parts, drawn, _ = mix(own, id_col=id_col, text_col=text_col, source_col=source_col, keys=keys)
    found = parts.join(drawn.select("rank", "block", "pass").hint("merge"), ["rank", "block"])
    spans = found.groupBy(*keys, "rank", "bucket", "row", "size", "pass").agg(F.collect_list(F.struct("first", "words")).alias("spans"))
    return _attach(own, spans, names, keys, text_col, chars_col)


def _keyed(docs: DataFrame, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """Adds the keys, 128 bits that only rows equal in all columns share."""
    text = F.col(f"`{text_col}`")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    return docs.select("*", *[F.xxhash64(F.lit(i), rest, text, text.isNull()).alias(k) for i, k in enumerate(keys)])


def _attach(own: DataFrame, spans: DataFrame, names: list[str], keys: tuple[str, ...], text_col: str, chars_col: str | None) -> DataFrame:
    """Rows of the input, equal ones once, with the stretches of each pass over each of them."""
    size, stretches, made = unused(own, "size", "spans", "text")
    passes = spans.select(*keys, F.col("size").alias(size), F.col("spans").alias(stretches))
    joined = own.dropDuplicates(list(keys)).join(passes, list(keys))
    text = F.pandas_udf(_cuts, "string")
    whole = F.aggregate(stretches, F.lit(0).cast("long"), lambda a, x: a + x["words"]) == F.col(size)
    # rows that a pass takes whole keep their text; only the others' goes to Python
    none = F.array().cast("array<struct<first:bigint,words:bigint>>")
    parted = text(F.when(~whole, F.col(f"`{text_col}`")).otherwise(F.lit("")), F.when(~whole, F.col(stretches)).otherwise(none))
    new = joined.withColumn(made, F.when(whole, F.col(f"`{text_col}`")).otherwise(parted))
    out = []
    for c in names:
        if c == text_col:
            out.append(F.col(made).alias(c))
        elif c == chars_col:
            out.append(F.length(made).cast(own.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return new.select(*out)
