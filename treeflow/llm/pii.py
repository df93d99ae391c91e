"""Personal data by bootstrapped contextual extraction, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, scratch, unused

#: Kinds in their fixed order.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Quantifiers that cannot give back are possessive, and a look behind keeps a run of letters or
#: digits from being tried at each of its characters, so that long runs take linear time; matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Strings that look like identifiers but that the base patterns may not accept.
LOOSE = r"(?<![0-9().-])\(?[0-9][0-9().\x20-]{5,}[0-9]|(?<![^\s@])[^\s@]++@[^\s@]++"
#: Rounds of scoring; a pattern must be met with so many different seeds, and reach this confidence, to discover.
ROUNDS, MIN_SEEDS, CONFIDENCE = 3, 5, 0.8
#: What an instance that is neither seed nor proven wrong counts against a pattern, beside 1 for a seed of another kind.
UNKNOWN = 0.1
#: Characters of context looked at on each side of an identifier.
CONTEXT = 48
#: A pattern may be met by a third of all instances: joins on patterns spread each over so many keys.
SALTS = 16
_BLOCK = 256


#: Running sums of the array column lengths, in blocks, so that long arrays take about linear time.
_ADD = "0L, (a, y) -> a + y"
_SUMS = f"transform(sequence(0, cast(ceil(size(lengths) / {_BLOCK}) as int) - 1), b -> aggregate(slice(lengths, b * {_BLOCK} + 1, {_BLOCK}), {_ADD}))"
_STARTS = f"transform(lengths, (x, i) -> aggregate(slice(block_sums, 1, cast(i div {_BLOCK} as int)), {_ADD}) + aggregate(slice(lengths, cast(i div {_BLOCK} as int) * {_BLOCK} + 1, i % {_BLOCK} + 1), {_ADD}))"


def _around(side: str, places: list[tuple[str, str]]) -> str:
    """Up to CONTEXT characters on one side of match i, over the two matches next to it, digits all written 9."""
    parts = ", ".join(f"{side}(coalesce(get({array}, {place}), ''), {CONTEXT})" for array, place in places)
    return f"regexp_replace(lower({side}(concat({parts}), {CONTEXT})), '[0-9]', '9')"


_LEFT = _around("right", [("found", "i - 2"), ("gaps", "i - 1"), ("found", "i - 1"), ("gaps", "i")])
_RIGHT = _around("left", [("gaps", "i + 1"), ("found", "i + 1"), ("gaps", "i + 2"), ("found", "i + 2")])


def _matches(d: DataFrame, name: str, pattern: str, wanted: Column) -> DataFrame:
    """Adds an array column: start, stop (code points), found, and the text to the left and right of each match."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    d = d.withColumn("found", F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    d = d.withColumn("gaps", F.when(F.size("found") > 0, F.split(text, pattern, -1)).otherwise(none))
    d = d.withColumn("lengths", F.expr("transform(found, (m, i) -> cast(length(gaps[i]) + if(i > 0, length(found[i - 1]), 0) as long))"))
    d = d.withColumn("block_sums", F.when(F.size("lengths") > 0, F.expr(_SUMS)).otherwise(F.array(F.lit(0).cast("long"))))
    d = d.withColumn("starts", F.expr(_STARTS))
    d = d.withColumn(name, F.expr(f"transform(found, (m, i) -> named_struct('start', starts[i], 'stop', starts[i] + length(m), 'found', m, 'left', {_LEFT}, 'right', {_RIGHT}))"))
    return d.drop("found", "gaps", "lengths", "block_sums", "starts")


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.found, '[^0-9]', '')"
    if kind == "ip":
        return f"x.found rlike '^{_BYTE}([.]{_BYTE}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    if kind == "card":
        digit = f"cast(substring(reverse({digits}), i, 1) as int) * if(i % 2 = 0, 2, 1)"
        return f"if(length({digits}) between 12 and 19, aggregate(sequence(1, length({digits})), 0L, (a, i) -> a + ({digit}) div 10 + ({digit}) % 10) % 10 = 0, false)"
    return "true"


def marked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, loose): base spans that hold, and loose candidates, of each whole text (null: empty)."""
    d = columns(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("digits", F.col("text").rlike("[0-9]"))
    for i, kind in enumerate(KINDS):
        wanted = F.col("text").contains(_NEEDS[kind]) if _NEEDS[kind] else F.lit(True)
        wanted = wanted if kind == "email" else F.col("digits") & wanted
        d = _matches(d, kind, BASE[kind], wanted)
        d = d.withColumn(kind, F.expr(f"transform(filter({kind}, x -> {_valid(kind)}), x -> named_struct('start', x.start, 'place', {i}, 'stop', x.stop, 'found', x.found, 'left', x.left, 'right', x.right))"))
    d = _matches(d, "loose", LOOSE, F.col("digits") | F.col("text").contains("@"))
    return d.select("row", "doc_id", F.array_sort(F.concat(*KINDS)).alias("base"), "loose")


def _candidates(spans: DataFrame) -> DataFrame:
    """Loose candidates that no base span overlaps, with the kind that their characters suggest."""
    busy = spans.where(F.size("loose") > 0)
    base = busy.select("row", F.explode("base").alias("s")).select("row", "s.start", "s.stop", F.lit(0).alias("role"), "s.found", "s.left", "s.right")
    loose = busy.select("row", F.explode("loose").alias("s")).select("row", "s.start", "s.stop", F.lit(1).alias("role"), "s.found", "s.left", "s.right")
    w = Window.partitionBy("row").orderBy("start", "role", "stop")
    is_base = F.col("role") == 0
    d = base.unionByName(loose)
    d = d.withColumn("before", F.max(F.when(is_base, F.col("stop"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("after", F.min(F.when(is_base, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    free = d.where("role = 1 and coalesce(before <= start, true) and coalesce(after >= stop, true)")
    n = F.length(F.regexp_replace("found", "[^0-9]", ""))
    place = F.when(F.col("found").contains("@"), 0).when(F.col("found").rlike(r"^[0-9]+([.][0-9]+){2,}$"), 1).when(n.between(12, 19), 2).when(n.between(7, 11), 3)
    return free.withColumn("place", place).where("place is not null").select("row", "start", "stop", "place", "found", "left", "right")


def _patterns(d: DataFrame) -> DataFrame:
    """Adds patterns, the lexical patterns that an instance meets.

    These are the two words before it; the word before and the one after; the word before and the identifier's form;
    and the form alone. A form writes digits as 9; in a phone number the country's prefix goes, and in an e-mail
    address each run between dots and the at sign is one letter.
    """
    word = lambda i: F.regexp_extract("left", r"(\S+)\s+(\S+)\s*$", i)
    last, after = F.regexp_extract("left", r"(\S+)\s*$", 1), F.regexp_extract("right", r"^\s*(\S+)", 1)
    nines = F.regexp_replace("found", "[0-9]", "9")
    form = F.when(F.col("place") == 0, F.regexp_replace("found", "[^@.]+", "a")).when(F.col("place") == 3, F.regexp_replace(nines, r"^\+9{1,3}[\x20.-]*", "")).otherwise(nines)
    d = d.select("*", word(1).alias("w1"), word(2).alias("w2"), last.alias("last"), after.alias("after"), form.alias("form"))
    made = F.array(
        F.when(F.col("w1") != "", F.concat(F.lit("before "), "w1", F.lit(" "), "w2")),
        F.when((F.col("last") != "") & (F.col("after") != ""), F.concat(F.lit("between "), "last", F.lit(" "), "after")),
        F.when(F.col("last") != "", F.concat(F.lit("before "), "last", F.lit(" form "), "form")),
        F.concat(F.lit("form "), "form"),
    )
    return d.select("*", F.array_compact(made).alias("patterns")).drop("w1", "w2", "last", "after", "form", "left", "right")


def _meet(many: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of ``many`` joined with their (pattern, place); a pattern that very many rows meet is spread over SALTS keys."""
    spread = patterns.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return many.withColumn("salt", F.pmod(F.xxhash64("found"), F.lit(SALTS)).cast("int")).join(spread, ["pattern", "place", "salt"]).drop("salt")


def _confidence(right: Column, unknown: Column) -> Column:
    return right / (right + UNKNOWN * unknown + F.col("against") + 1)


def trusted(seeds: DataFrame, instances: DataFrame) -> DataFrame:
    """(pattern, place, confidence) of the patterns that reach CONFIDENCE.

    seeds and instances are distinct (pattern, place, found). The confidence of a pattern for a kind is the sum of the
    scores of what it meets, seeds with 1, over that sum, what UNKNOWN leaves of the rest, the seeds of other kinds,
    and one. The score of an instance is the chance that at least one of its trusted patterns is right. What a pattern
    itself says of an instance does not count for the pattern, and doubtful patterns vouch for nothing, so that no
    pattern raises itself and chance is not amplified. Patterns with less than MIN_SEEDS seeds take no part.
    """
    counts = seeds.groupBy("pattern", "place").agg(F.count("*").alias("seeds"))
    every = counts.groupBy("pattern").agg(F.sum("seeds").alias("every"))
    known = counts.where(F.col("seeds") >= MIN_SEEDS).join(every, "pattern").select("pattern", "place", "seeds", (F.col("every") - F.col("seeds")).alias("against"))
    edges = scratch(_meet(instances, known), "edges")
    confidence = _confidence(F.col("seeds"), F.count("*"))
    patterns = edges.groupBy("pattern", "place", "seeds", "against").agg(confidence.alias("confidence"))
    for _ in range(ROUNDS):
        patterns = scratch(patterns, "patterns")
        joined = _meet(edges.select("pattern", "place", "found"), patterns).withColumn("miss", F.when(F.col("confidence") >= CONFIDENCE, F.log(1 - F.col("confidence"))).otherwise(0.0))
        total = joined.groupBy("place", "found").agg(F.sum("miss").alias("total"))
        scored = joined.join(total, ["place", "found"]).withColumn("score", 1 - F.exp(F.round(F.col("total") - F.col("miss"), 9)))
        scores = F.round(F.sum("score"), 6)
        patterns = scored.groupBy("pattern", "place", "seeds", "against").agg(_confidence(F.col("seeds") + scores, F.count("*") - scores).alias("confidence"))
    return patterns.where(F.col("confidence") >= CONFIDENCE).select("pattern", "place", "confidence")


def discovered(spans: DataFrame) -> DataFrame:
    """(row, start, place, stop) of identifiers that base patterns miss and trusted lexical patterns reveal.

    Seeds are the base spans. Seeds and candidates are made distinct before any join, so no pattern's occurrences are
    gathered, and confidences depend on the texts alone.
    """
    candidates = scratch(_patterns(_candidates(spans)), "candidates")
    seeds = _patterns(spans.select(F.explode("base").alias("s")).select("s.place", "s.found", "s.left", "s.right"))
    met = lambda d: d.select(F.explode("patterns").alias("pattern"), "place", "found").distinct()
    good = scratch(trusted(met(seeds), met(candidates)), "trusted")
    each = candidates.select("row", "start", "place", "stop", "found", F.explode("patterns").alias("pattern"))
    return _meet(each, good).select("row", "start", "place", "stop").distinct()


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, added): arrays of (start, place, stop, ...) spans, for each row of the input.

    Offsets count code points, stop is exclusive, place is the kind's index in KINDS. A null text is empty and has no
    spans; null ids and equal rows stay rows of their own; an empty table gives an empty one.
    """
    spans = scratch(marked(docs, id_col=id_col, text_col=text_col), "spans")
    new = discovered(spans).groupBy("row").agg(F.collect_list(F.struct("start", "place", "stop")).alias("added"))
    return spans.join(new, "row", "left").select("row", "doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:bigint,place:int,stop:bigint>>")).alias("added"))


def _said(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.place], ':', x.start, ':', x.stop)), ',')")


def digest(docs: DataFrame, **names: str) -> DataFrame:
    """Counts of base spans, the digest of their list, and all spans written out."""
    d = find(docs, **names)
    plain = F.expr("transform(base, x -> named_struct('start', x.start, 'place', x.place, 'stop', x.stop))")
    d = d.select("doc_id", plain.alias("base"), "added").withColumn("every", F.array_sort(F.concat("base", "added")))
    counts = [F.expr(f"cast(size(filter(base, x -> x.place = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(_said("base"), 256).alias("base_sha256"), _said("every").alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The input with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    Columns are those of the input, ``chars_col`` counted anew; all rows and null texts stay, whatever their ids; an
    empty table gives an empty one.
    """
    names = docs.columns
    row, spans, merged, new = unused(docs, "row", "spans", "merged", "text")
    held = scratch(docs.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias(row)), "private")
    found = find(held, id_col=row, text_col=text_col).select(F.col("doc_id").alias(row), F.array_sort(F.expr("concat(transform(base, x -> named_struct('start', x.start, 'place', x.place, 'stop', x.stop)), added)")).alias(spans)).where(F.size(spans) > 0)
    d = held.join(found, row, "left")
    merge = f"""aggregate({spans}, cast(array() as array<struct<start: bigint, place: int, stop: bigint>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).stop > x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'place', element_at(a, -1).place, 'stop', greatest(element_at(a, -1).stop, x.stop)))),
           concat(a, array(x))))"""
    d = d.withColumn(merged, F.when(F.col(spans).isNotNull(), F.expr(merge)))
    tags = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    text = f"`{text_col}`"
    part = f"concat(substring({text}, cast(if(i > 0, {merged}[i - 1].stop, 0) as int) + 1, cast(x.start - if(i > 0, {merged}[i - 1].stop, 0) as int)), {tags}[x.place])"
    whole = F.expr(f"concat(array_join(transform({merged}, (x, i) -> {part}), ''), substring({text}, cast(element_at({merged}, -1).stop as int) + 1))")
    d = d.withColumn(new, F.when(F.col(merged).isNotNull(), whole).otherwise(F.col(text)))
    out = []
    for c in names:
        if c == text_col:
            out.append(F.col(new).alias(c))
        elif c == chars_col:
            out.append(F.when(F.col(merged).isNotNull(), F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return d.select(*out)
