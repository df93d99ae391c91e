"""Point lookups in a node by labels or positions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import blend
from ..plans.tree import Node


def gather(node: Node, names: Iterable[str], points: DataFrame, *, positions: bool = False, on_missing: str = "error", prefix: str = "", **dims: str) -> DataFrame:
    """``points`` with the named variables: gather(skims, ["DIST"], df, otaz="origin", dtaz="destination").

    dims maps each dim (or the finer name of a redirected one) to a column of points that holds labels, or with
    ``positions`` places. A label without a match is an error, or with on_missing="null" gives null. Fine names read
    dense values by their coarse zones, and blend variables that have a sparse table.
    """
    out = points
    for k, name in enumerate(names):
        fine = {n: d for d, (n, _) in node.redirects.items()}
        frame = next((f for f in node.frames if name in f.variables), None)
        if frame is None and name not in node.blended:
            raise KeyError(name)
        given = {fine.get(d, d): (c, d in fine) for d, c in dims.items()}
        made: list[str] = []
        cond = []
        value = F.lit(0.0)
        if frame is not None:
            if missing := [d for d in frame.dims if d not in given]:
                raise KeyError(f"{name} needs {missing}")
            child = frame.df
            for d in frame.dims:
                if positions:
                    lab = node.labels(d).select(F.col(d), F.col("__pos").alias(f"__p{k}_{d}"))
                    child = child.join(lab, d) if not node.dense else child.withColumn(f"__p{k}_{d}", F.col(d))
            child = child.select(*[F.col(f"__p{k}_{d}" if positions else d).alias(f"__g{k}_{d}") for d in frame.dims], F.col(name).alias(f"__v{k}"), F.lit(True).alias(f"__h{k}"))
            for d in frame.dims:
                column, is_fine = given[d]
                key = F.col(column)
                if is_fine:
                    m = node.redirects[d][1].select(F.col("__fine").alias(f"__mf{k}_{d}"), F.col("__coarse").alias(f"__mc{k}_{d}"))
                    out = out.join(m, F.col(column) == F.col(f"__mf{k}_{d}"), "left")
                    key = F.col(f"__mc{k}_{d}")
                    made += [f"__mf{k}_{d}", f"__mc{k}_{d}"]
                cond.append(key == F.col(f"__g{k}_{d}"))
                made.append(f"__g{k}_{d}")
            out = out.join(child, cond, "left")
            value = F.col(f"__v{k}")
            if on_missing == "error":
                value = F.when(F.col(f"__h{k}").isNotNull(), value).otherwise(F.raise_error(F.lit(f"{name}: no such label")).cast(frame.df.schema[name].dataType))
            made += [f"__v{k}", f"__h{k}"]
        if name in node.blended and all(d in dims for d in node.blended[name].dims):
            b = node.blended[name]
            t = b.table.select(F.col("__i").alias(f"__bi{k}"), F.col("__j").alias(f"__bj{k}"), F.col("__v").alias(f"__bv{k}"))
            out = out.join(t, (F.col(dims[b.dims[0]]) == F.col(f"__bi{k}")) & (F.col(dims[b.dims[1]]) == F.col(f"__bj{k}")), "left")
            value = blend(F.col(f"__bv{k}"), value, b.limit)
            made += [f"__bi{k}", f"__bj{k}", f"__bv{k}"]
        out = out.withColumn(prefix + name, value).drop(*made)
    return out


def at(node: Node, names: str | Iterable[str], points: DataFrame, *, append: bool | str = True, **dims: str) -> DataFrame:
    """Labels to values; append=False leaves only the values, a text becomes their prefix."""
    names = [names] if isinstance(names, str) else list(names)
    prefix = append if isinstance(append, str) else ""
    out = gather(node, names, points, prefix=prefix, **dims)
    return out if append else out.select(*[F.col(prefix + n) for n in names])


def iat(node: Node, names: str | Iterable[str], points: DataFrame, *, append: bool | str = True, **dims: str) -> DataFrame:
    """Positions to values, as ``at``."""
    names = [names] if isinstance(names, str) else list(names)
    prefix = append if isinstance(append, str) else ""
    out = gather(node, names, points, positions=True, prefix=prefix, **dims)
    return out if append else out.select(*[F.col(prefix + n) for n in names])


class DatasetWrapper:
    """Lookups by the same origin, destination and time columns: wrapper.set_df(df); wrapper["DIST"]."""

    def __init__(self, node: Node, orig_key: str, dest_key: str, time_key: str | None = None, *, dims: Mapping[str, str] | None = None):
        names = node.frames[0].dims
        keys = [orig_key, dest_key, *([time_key] if time_key else [])]
        self.node, self.dims = node, dict(dims or dict(zip(names, keys, strict=False)))
        self.df: DataFrame | None = None

    def set_df(self, df: DataFrame) -> DatasetWrapper:
        self.df = df
        return self

    def lookup(self, name: str, reverse: bool = False) -> DataFrame:
        if self.df is None:
            raise ValueError("set_df comes first")
        frame = self.node.frame_of(name)
        dims = {d: self.dims[d] for d in frame.dims}
        if reverse:
            a, b = list(dims)[:2]
            dims[a], dims[b] = dims[b], dims[a]
        return gather(self.node, [name], self.df, **dims)

    def __getitem__(self, name: str) -> DataFrame:
        return self.lookup(name)
