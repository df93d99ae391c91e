"""Wide tables and matrices as tensors in long form."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.tree import Node


def ignored(patterns: str | Iterable[str] | None, name: str) -> bool:
    """Whether a pattern matches the start of the name."""
    return any(re.match(p, name) for p in ([patterns] if isinstance(patterns, str) else patterns or ()))


def split_periods(columns: Iterable[str], sep: str = "__") -> tuple[list[str], dict[str, dict[str, str]]]:
    """Plain names, and for each stacked name its column by period."""
    plain: list[str] = []
    stacked: dict[str, dict[str, str]] = {}
    for c in columns:
        name, found, period = c.partition(sep)
        if found:
            stacked.setdefault(name, {})[period] = c
        else:
            plain.append(c)
    return plain, stacked


def from_parquet_3d(spark: SparkSession, paths: str | Sequence[str], index_names: Sequence[str], *, time_periods: Sequence[str] | None = None, time_period_sep: str = "__", max_float_precision: int = 32, ignore: str | Iterable[str] | None = None, name: str = "tensor", check: bool = False) -> Node:
    """Files with one row for each (origin, destination) and columns NAME or NAME__PERIOD, as a node of two frames.

    Rows may come in any order and pairs may lack. Later files must hold the same labels. Periods without a column are
    0. With check, each file's pairs are counted, and repeated ones are an error.
    """
    o, d, t = index_names
    frames = []
    for path in [paths] if isinstance(paths, str) else paths:
        df = spark.read.parquet(path)
        for c in (o, d):
            if c not in df.columns:
                raise KeyError(c)
        if check and (df.groupBy(o, d).count().where("count > 1").limit(1).count()):
            raise ValueError(f"{path} repeats pairs")
        frames.append(df.select(o, d, *[c for c in df.columns if c not in (o, d) and not ignored(ignore, c)]))
    wide = frames[0]
    for i, other in enumerate(frames[1:], 1):
        for dim in (o, d):
            a, b = wide.select(dim).distinct(), other.select(dim).distinct()
            if check and (a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count()):
                raise ValueError(f"the labels of {dim} in file {i} differ from the first file's")
        wide = wide.join(other, [o, d], "full")
    return _node(wide, o, d, t, time_periods, time_period_sep, max_float_precision, name)


def _node(wide: DataFrame, o: str, d: str, t: str, time_periods: Sequence[str] | None, sep: str, precision: int, name: str) -> Node:
    plain, stacked = split_periods([c for c in wide.columns if c not in (o, d)], sep)
    if stacked and time_periods is None:
        raise ValueError("stacked columns need time_periods")
    frames = []
    if plain:
        frames.append(((o, d), wide.select(o, d, *plain)))
    if stacked:
        for by in stacked.values():
            if unknown := set(by) - set(time_periods):
                raise KeyError(f"unknown periods {sorted(unknown)}")
        rows = F.array(*[F.struct(F.lit(p).alias(t), *[(F.col(f"`{by[p]}`") if p in by else F.lit(0)).cast("double").alias(v) for v, by in stacked.items()]) for p in time_periods])
        frames.append(((o, d, t), wide.select(o, d, F.explode(rows).alias("__r")).select(o, d, "__r.*")))
    node = Node.tensor(name, *frames, unique=True)
    return node.max_float_precision(precision)


def from_matrices(spark: SparkSession, matrices: Mapping[str, Sequence[Sequence[float]]], index_names: Sequence[str], *, labels: Sequence | None = None, indexes: str = "one-based", time_periods: Sequence[str] | None = None, time_period_sep: str = "__", ignore: str | Iterable[str] | None = None, name: str = "tensor", max_float_precision: int = 32) -> Node:
    """Square or oblong matrices by name, in memory, as a node; NAME__PERIOD pages are stacked, pages that lack are 0."""
    import numpy as np

    kept = {k: np.asarray(m, dtype=float) for k, m in matrices.items() if not ignored(ignore, k)}
    shapes = {m.shape for m in kept.values()}
    if len(shapes) != 1:
        raise ValueError(f"matrices of different shapes: {sorted(shapes)}")
    rows, cols = shapes.pop()
    if labels is not None and rows != cols:
        raise ValueError("one list of labels fits square matrices only")
    start = {"one-based": 1, "zero-based": 0}.get(indexes)
    if labels is None and start is None:
        raise KeyError(indexes)
    own = lambda i: labels[i] if labels is not None else start + i
    import pyarrow as pa

    o, d = index_names[:2]
    data = {o: [own(i) for i in range(rows) for _ in range(cols)], d: [own(j) for _ in range(rows) for j in range(cols)]}
    wide = spark.createDataFrame(pa.table(data | {k: m.reshape(-1) for k, m in kept.items()}))
    return _node(wide, o, d, index_names[2] if len(index_names) > 2 else "__t", time_periods, time_period_sep, max_float_precision, name)


def from_omx(spark: SparkSession, path: str, index_names: Sequence[str], **options) -> Node:
    """Matrices of an HDF5 matrix file; needs h5py on the driver."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading matrix files needs h5py") from e
    with h5py.File(path, "r") as f:
        matrices = {k: f["data"][k][:] for k in f["data"]}
        lookups = {k: f["lookup"][k][:].tolist() for k in f.get("lookup", {})}
    wanted = options.pop("indexes", None)
    if wanted in (None, "one-based", "zero-based"):
        labels = next(iter(lookups.values())) if wanted is None and len(lookups) == 1 else None
        return from_matrices(spark, matrices, index_names, labels=labels, indexes=wanted or "one-based", **options)
    if wanted not in lookups:
        raise KeyError(wanted)
    return from_matrices(spark, matrices, index_names, labels=lookups[wanted], **options)
