"""Nodes and frames from what callers have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.tree import Node


def construct(spark: SparkSession, source: Any) -> DataFrame:
    """A DataFrame from a DataFrame, Arrow table, pandas frame, mapping of columns, or list of column names (empty)."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, pa.Table):
        if len(set(source.column_names)) < source.num_columns:
            raise ValueError("column names repeat")
        return spark.createDataFrame(source)
    if isinstance(source, Mapping):
        return spark.createDataFrame(pa.table(dict(source)))
    if isinstance(source, (list, tuple)) and all(isinstance(x, str) for x in source):
        return spark.createDataFrame([], ", ".join(f"`{c}` double" for c in source))
    return spark.createDataFrame(source)


def from_arrow(spark: SparkSession, table: pa.Table, *, index_name: str = "index", index: Sequence | None = None, name: str = "table") -> Node:
    """A one-dimensional node; the index is the given labels (unique, one for each row) or row numbers."""
    if index_name in table.column_names:
        raise ValueError(f"{index_name} is a column already")
    labels = list(range(table.num_rows)) if index is None else list(index)
    if len(labels) != table.num_rows:
        raise ValueError(f"{len(labels)} labels for {table.num_rows} rows")
    if len(set(labels)) < len(labels):
        raise ValueError("labels repeat")
    return Node.table(name, construct(spark, table.append_column(index_name, pa.array(labels))), index_name, unique=True, dense=index is None)


def from_labels(spark: SparkSession, name: str, **dims: Sequence) -> Node:
    """All combinations of labels, without variables."""
    return Node.product(name, *[(d, spark.createDataFrame(pa.table({d: list(x)}))) for d, x in dims.items()])


def from_multi_index(df: DataFrame, dims: Sequence[str], name: str = "tensor", *, dense: bool = False) -> Node:
    """Rows keyed by several columns; with dense every combination of labels is there, null where no row was."""
    if dense:
        grid = None
        for d in dims:
            side = df.select(d).distinct()
            grid = side if grid is None else grid.crossJoin(side)
        df = grid.join(df, list(dims), "left")
    return Node.tensor(name, (tuple(dims), df))


def one_based(spark: SparkSession, n: int, name: str = "label") -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias(name))


def zero_based(spark: SparkSession, n: int, name: str = "label") -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))
