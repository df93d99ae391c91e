"""Compact encodings of variables: fixed point, dictionaries, joint dictionaries, categories."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from enum import IntEnum
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

META = "encoding"
#: Distinct values of a column whose counts may come to the driver.
MOST_VALUES = 1_000_000
_INTEGERS = {8: ("byte", 127), 16: ("short", 32767), 32: ("int", 2147483647)}


class ValueDecodeError(ValueError):
    """An encoding lacks what decoding needs."""


class ArrayIsNotCategoricalError(TypeError):
    """The column carries no categories."""


@dataclass(frozen=True)
class Encoding:
    """How a column was encoded: "fixed" (scale, offset), "dictionary" or "joint" (values); missing is what code -1 stands for."""

    kind: str
    scale: float | None = None
    offset: float | None = None
    missing: Any = None
    values: tuple | None = None
    joint: str | None = None

    def metadata(self) -> dict:
        return {META: json.dumps(asdict(self))}

    @classmethod
    def of(cls, df: DataFrame, name: str) -> Encoding | None:
        return cls.of_field(df.schema[name])

    @classmethod
    def of_field(cls, f: T.StructField) -> Encoding | None:
        text = (f.metadata or {}).get(META)
        if text is None:
            return None
        d = json.loads(text)
        return cls(**d | {"values": tuple(d["values"]) if d["values"] is not None else None})


def _marked(col: Column, name: str, e: Encoding) -> Column:
    return col.alias(name, metadata=e.metadata())


def info(df: DataFrame, name: str) -> dict | None:
    e = Encoding.of(df, name)
    return None if e is None else asdict(e)


def strip(df: DataFrame, *names: str) -> DataFrame:
    """Without encoding metadata; codes stay."""
    return df.select(*[F.col(c).alias(c, metadata={}) if c in names else F.col(c) for c in df.columns])


def fixed_point(df: DataFrame, name: str, *, bitwidth: int = 16, scale: float | None = None, offset: float | None = None, min_value: float | None = None, max_value: float | None = None, missing: Any = None, rounding: bool = False) -> DataFrame:
    """Integers (value - offset) / scale, cut off (or rounded); the missing value, null and NaN become -1.

    Without a scale, the range of values (asked from the data where it is not given) fills the type; the top code is
    held within it.
    """
    kind, top = _INTEGERS[bitwidth]
    x = F.col(name).cast("double")
    known = ~(x.isNull() | F.isnan(x)) & (F.lit(True) if missing is None else x != float(missing))
    if scale is None:
        if min_value is None or max_value is None:
            low, high = df.where(known).agg(F.min(x), F.max(x)).first()
            min_value, max_value = (low if min_value is None else min_value), (high if max_value is None else max_value)
        offset = float(min_value or 0.0) if offset is None else offset
        scale = ((max_value or 0.0) - offset) / top or 1.0
    offset = 0.0 if offset is None else offset
    code = (x - F.lit(offset)) / F.lit(scale)
    code = F.floor(code + 0.5) if rounding else F.when(code >= 0, F.floor(code)).otherwise(F.ceil(code))
    out = F.when(known, F.least(code, F.lit(top))).otherwise(F.lit(-1)).cast(kind)
    return df.withColumn(name, out).select(*[_marked(F.col(c), c, Encoding("fixed", float(scale), float(offset), missing)) if c == name else F.col(c) for c in df.columns])


def histogram(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


def smash_bins(counts: Sequence[tuple[Any, int]], bitwidth: int) -> list:
    """Values left when the rarest ones (never the least or the largest) join their nearest neighbour until they fit."""
    import bisect
    import heapq

    ordered = sorted(counts)
    most = 1 << bitwidth
    values, n = [v for v, _ in ordered], dict(ordered)
    heap = [(c, v) for v, c in ordered[1:-1]]
    heapq.heapify(heap)
    while len(values) > most and heap:
        c, v = heapq.heappop(heap)
        if n.get(v) != c:
            continue
        i = bisect.bisect_left(values, v)
        near = values[i - 1] if v - values[i - 1] <= values[i + 1] - v else values[i + 1]
        n[near] += n.pop(v)
        del values[i]
        if near not in (values[0], values[-1]):
            heapq.heappush(heap, (n[near], near))
    return values


def by_dictionary(df: DataFrame, name: str, *, bitwidth: int = 8, values: Sequence | None = None) -> DataFrame:
    """Codes into a dictionary of at most 2^bitwidth values: exact for text, the nearest value for numbers; null is -1.

    The dictionary comes to the driver: without ``values`` the counts of distinct values do, and the rarest merge. A
    column with more than MOST_VALUES distinct values is an error: round it first, or give the values.
    """
    text = isinstance(df.schema[name].dataType, T.StringType)
    if values is None:
        most = 1 << bitwidth if text else MOST_VALUES
        counts = [(r["value"], r["n"]) for r in histogram(df, name).limit(most + 1).collect()]
        if len(counts) > most:
            raise ValueError(f"{name} has more than {most} distinct values")
        values = sorted(v for v, _ in counts) if text else smash_bins(counts, bitwidth)
    if len(values) > 1 << bitwidth:
        raise ValueError(f"{len(values)} values do not fit {bitwidth} bits")
    values = sorted(values)
    if text:
        code = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)) - 1 if values else F.lit(-1)
    else:
        edges = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        code = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(name))) if edges else F.lit(0)
    out = F.when(F.col(name).isNull(), F.lit(-1)).otherwise(code).cast("short" if bitwidth <= 8 else "int")
    return df.withColumn(name, out).select(*[_marked(F.col(c), c, Encoding("dictionary", values=tuple(values))) if c == name else F.col(c) for c in df.columns])


def joint_dictionary(df: DataFrame, names: Sequence[str], encoding: str) -> tuple[DataFrame, DataFrame]:
    """(df with one column <encoding>_offsets instead of the names, the table of distinct combinations by offset)."""
    from ..plans.tree import positions

    offset = f"{encoding}_offsets"
    combos = df.select(*names).distinct()
    table = positions(combos, list(names), offset).withColumn(offset, F.col(offset).cast("int"))
    on = [df[n].eqNullSafe(table[n]) for n in names]
    coded = df.join(table, on).select(*[df[c] for c in df.columns if c not in names], table[offset].alias(offset, metadata=Encoding("joint", joint=encoding).metadata()))
    return coded, table


def decode(df: DataFrame, name: str, aux: DataFrame | None = None) -> DataFrame:
    """Values instead of codes; joint encodings need their table."""
    e = Encoding.of(df, name)
    if e is None:
        return df
    if e.kind == "joint":
        if aux is None:
            raise ValueDecodeError(f"{name} needs its table of combinations")
        return df.join(aux, name).drop(name)
    return df.withColumn(name, decoded(F.col(name), e))


def decoded(code: Column, e: Encoding) -> Column:
    missing = F.lit(e.missing) if e.missing is not None else F.lit(None)
    if e.kind == "fixed":
        return F.when(code >= 0, code * F.lit(e.scale) + F.lit(e.offset)).otherwise(missing.cast("double"))
    if e.kind == "dictionary":
        values = F.array(*[F.lit(v) for v in e.values or ()])
        return F.when(code >= 0, F.get(values, code.cast("int")))
    raise ValueDecodeError(f"{e.kind} encodings need a table")


# --- categories ------------------------------------------------------------------------------------------------


def with_categories(df: DataFrame, name: str, categories: Sequence[str], *, ordered: bool = True) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata={"categories": list(categories), "ordered": ordered}) if c == name else F.col(c) for c in df.columns])


def is_categorical(df: DataFrame, name: str) -> bool:
    return "categories" in df.schema[name].metadata


def categories(df: DataFrame, name: str) -> list[str]:
    if not is_categorical(df, name):
        raise ArrayIsNotCategoricalError(name)
    return list(df.schema[name].metadata["categories"])


def is_same_categories(a: DataFrame, x: str, b: DataFrame, y: str) -> bool:
    return categories(a, x) == categories(b, y)


def codes(df: DataFrame, name: str) -> Column:
    """Positions in the categories; -1 for null and for what is not among them."""
    at = F.array_position(F.array(*[F.lit(c) for c in categories(df, name)]), F.col(name))
    return F.coalesce(F.when(at > 0, at - 1), F.lit(-1)).cast("int")


def as_int_enum(df: DataFrame, name: str, enum: type[IntEnum], *, categorical: bool = True) -> DataFrame:
    """Names of an enumeration (joined by | for sums of flags) to its numbers; gaps in the categories are called _n."""
    members = {k: int(v) for k, v in enum.__members__.items()}
    table = F.create_map(*[F.lit(x) for kv in members.items() for x in kv])
    parts = F.transform(F.split(F.col(name), "\\|"), lambda p: F.try_element_at(table, F.trim(p)))
    number = F.aggregate(parts, F.lit(0), lambda a, x: a.bitwiseOR(x))
    by_value = {v: k for k, v in members.items()}
    meta = {"categories": [by_value.get(i, f"_{i}") for i in range(max(members.values()) + 1)]} if categorical else {}
    return df.select(*[number.cast("int").alias(c, metadata=meta) if c == name else F.col(c) for c in df.columns])


def named(mapping: Mapping[str, Any] | Iterable[tuple[str, Any]]) -> Column:
    return F.create_map(*[F.lit(x) for kv in dict(mapping).items() for x in kv])
