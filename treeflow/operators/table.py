"""Tables with row numbers: columns appended, merged and evaluated."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.compiler import Compiler, Value, kind_of, literal
from ..plans.tree import positions

ROW = "__row"


class Table:
    """A DataFrame whose rows are numbered by the column ``__row``, so tables can be put side by side."""

    def __init__(self, df: DataFrame, *, by: str | None = None):
        self.df = df if ROW in df.columns else positions(df.withColumn("__by", F.monotonically_increasing_id()) if by is None else df.withColumn("__by", F.col(by)), "__by", ROW).drop("__by")

    @classmethod
    def from_pydict(cls, spark: SparkSession, data: Mapping[str, Sequence]) -> Table:
        return cls.from_arrow(spark, pa.table(dict(data)))

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table) -> Table:
        if len(set(table.column_names)) < table.num_columns:
            raise ValueError("column names repeat")
        return cls(spark.createDataFrame(table.append_column(ROW, pa.array(range(table.num_rows), pa.int64()))))

    @classmethod
    def of_length(cls, spark: SparkSession, n: int) -> Table:
        return cls(spark.range(n).select(F.col("id").alias(ROW)))

    @classmethod
    def from_feather(cls, spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> Table:
        import pyarrow.feather as feather

        return cls.from_arrow(spark, feather.read_table(source, columns=columns))

    def to_feather(self, dest: str) -> None:
        """Through the driver: for tables that fit it."""
        import pyarrow.feather as feather

        feather.write_feather(self.to_arrow(), dest)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.columns:
            raise KeyError(name)
        return self.df.select(ROW, name)

    def to_df(self) -> DataFrame:
        return self.df.drop(ROW)

    def to_arrow(self) -> pa.Table:
        return self.df.orderBy(ROW).drop(ROW).toArrow()

    def to_pandas(self):
        return self.df.orderBy(ROW).drop(ROW).toPandas()

    def append_column(self, name: str, value: Any, *, overwrite: bool = True) -> Table:
        """A column from an expression, a constant or a column."""
        if name in self.columns and not overwrite:
            raise ValueError(f"{name} is there already")
        return Table(self.df.withColumn(name, value if not isinstance(value, (int, float, str, bool)) else F.lit(value)))

    def __or__(self, other: Table) -> Table:
        """Side by side; where names are the same the right one counts."""
        mine = [c for c in self.columns if c not in other.columns]
        return Table(self.df.select(ROW, *mine).join(other.df, ROW))

    @classmethod
    def concat(cls, tables: Iterable[Table]) -> Table:
        """One below the other; all must have the same columns."""
        tables = list(tables)
        first = tables[0]
        for t in tables[1:]:
            if t.df.select(*first.columns).dtypes != first.df.select(*first.columns).dtypes or set(t.columns) != set(first.columns):
                raise ValueError("the tables' columns differ")
        out = None
        for i, t in enumerate(tables):
            part = t.df.withColumn("__part", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return cls(positions(out.withColumnRenamed(ROW, "__by"), ["__part", "__by"], ROW).drop("__by", "__part"))

    def eval(self, expression: Any, *, target: str | None = None, inplace: bool = False, local: Mapping[str, Any] | None = None, functions: Mapping[str, Any] | None = None) -> Table | DataFrame:
        """An expression over the columns; "a = expression" names its target. With inplace the table gets the column."""
        if isinstance(expression, str) and (m := re.match(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)$", expression, re.DOTALL)):
            target, expression = m[1], m[2]
        schema = self.df.schema

        def resolve(path: tuple[str, ...]) -> Value | None:
            if len(path) == 1 and path[0] in self.columns:
                return Value(F.col(f"`{path[0]}`"), kind_of(schema[path[0]].dataType))
            return literal(local[path[0]]) if len(path) == 1 and local and path[0] in local else None

        v = Compiler(resolve, functions=functions)(expression)
        name = target or "value"
        if inplace or target:
            return Table(self.df.withColumn(name, v.col))
        return self.df.select(ROW, v.col.alias(name))

    def __repr__(self) -> str:
        return f"<Table {', '.join(f'{n}: {t}' for n, t in self.df.dtypes if n != ROW)}>"


def concat_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by name; types and names must agree."""
    tables = list(tables)
    out = tables[0]
    for t in tables[1:]:
        if sorted(t.dtypes) != sorted(out.dtypes):
            raise ValueError("the tables' columns differ")
        out = out.unionByName(t)
    return out
