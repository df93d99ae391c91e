"""Flows: named expressions over a tree, compiled to one plan of built-in columns."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.compiler import Compiler, Value, literal
from .binder import Binder
from .tree import Tree

#: Compiled flows by identity, so that equal definitions over an equal tree are compiled once.
LIBRARY: dict[str, Flow] = {}

_TYPES = {"float32": "float", "float64": "double", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "bool": "boolean"}


class Flow:
    """Evaluates definitions for each row of the tree's root.

    dtype: the type of all outputs ("float32" by default; None keeps each expression's own). Earlier outputs may be used
    by name in later definitions, as the rounded values they are; a variable of the tree with the same name wins.
    dim_exclude leaves root dims out of the output.
    """

    def __init__(self, tree: Tree, definitions: Mapping[str, Any] | Iterable[str], *, name: str | None = None, dtype: str | None = "float32", with_root_node_name: str | None = None, dim_exclude: Iterable[str] = (), error_model: str = "numpy", strict: bool = False):
        self.tree, self.root = tree, with_root_node_name or tree.root
        if self.root is None:
            raise ValueError("a tree without a root needs with_root_node_name")
        self.definitions = dict(definitions) if isinstance(definitions, Mapping) else {d: d for d in definitions}
        self.names = list(self.definitions)
        self.dtype = _TYPES.get(dtype, dtype) if dtype else None
        self.error_model, self.strict = error_model, strict
        self.name = name or f"flow_{self.identity[:16]}"
        self.dims = [d for d in tree.nodes[self.root].frames[0].dims if d not in set(dim_exclude)]
        self.binder = Binder(tree, self.root)
        self.values: dict[str, Value] = {}
        self.stages: list[list[str]] = [[]]
        self._done: set[str] = set()
        self._compile()

    @property
    def identity(self) -> str:
        """A hash of definitions, types, constants and the tree's shape."""
        shape = [(n, [(f.dims, f.df.dtypes) for f in x.frames]) for n, x in self.tree.nodes.items()]
        parts = (self.definitions, self.dtype, self.error_model, self.root, self.tree.extra_vars, self.tree.aux_vars, self.tree.list_relationships(), shape)
        return hashlib.blake2b(repr(parts).encode(), digest_size=20).hexdigest()

    # --- compiling ---

    def _resolve(self, path: tuple[str, ...]) -> Value | None:
        tree = self.tree
        if len(path) == 2:
            if path[0] in tree.aux_vars and isinstance(tree.aux_vars[path[0]], Mapping) and path[1] in tree.aux_vars[path[0]]:
                return literal(tree.aux_vars[path[0]][path[1]])
            return self.binder.variable(*path)
        name = path[0]
        holders = [n for n in tree.nodes if tree.has(n, name) and self._reachable(n)]
        if holders:
            if len(holders) > 1 and self.strict:
                raise ValueError(f"{name} is in several nodes: {holders}")
            if name in self.values:
                warnings.warn(f"the output {name} is hidden by {holders[0]}.{name}", stacklevel=2)
            return self.binder.variable(holders[0], name)
        if name in self.values:
            self._uses.add(name)
            v = self.values[name]
            return Value(F.col(f"`__out_{name}`"), "float" if self.dtype in ("float", "double") else v.kind, v.nullable)
        for space in (tree.extra_vars, tree.aux_vars):
            if name in space:
                return literal(space[name])
        return None

    def _reachable(self, node: str) -> bool:
        return node == self.root or bool(self.tree.bindings(node))

    def _compile(self) -> None:
        compiler = Compiler(
            self._resolve,
            functions=self.tree.extra_funcs,
            lookup=lambda node, name, fixed, mode: self.binder.variable(node, name, reverse=mode == "reverse", fixed=fixed),
            is_node=lambda n: n in self.tree.nodes or n in self.tree.fallbacks,
            error_model=self.error_model,
        )
        for name, definition in self.definitions.items():
            self._uses: set[str] = set()
            try:
                v = compiler(definition)
            except KeyError as e:
                if e.args and e.args[0] == name:
                    raise ValueError(f"{name} is defined by itself") from e
                raise
            if self._uses & set(self.stages[-1]):
                self.stages.append([])
            self.stages[-1].append(name)
            self.values[name] = v

    def _typed(self, v: Value) -> Column:
        if self.dtype is None:
            return v.col
        if v.kind == "bool" and self.dtype != "boolean":
            return v.col.cast("int").cast(self.dtype)
        return v.col.cast(self.dtype)

    def evaluated(self, source: DataFrame | None = None, mask: str | Column | None = None, *, added: Mapping[str, Column] | None = None, by: str | None = None) -> DataFrame:
        """The joined root with a column __out_<name> for each definition; see ``Binder.joined`` for the rest."""
        frame = self.tree.nodes[self.root].frames[0]
        root = source if source is not None else frame.sides if by and frame.sides else frame.df
        df = self.binder.joined(root, added, by)
        if mask is not None:
            if self.dtype not in ("float", "double"):
                raise TypeError("a mask needs a floating dtype")
            df = df.withColumn("__mask", F.coalesce(F.col(f"`__root_{mask}`") if isinstance(mask, str) else mask, F.lit(False)).cast("boolean"))
        for stage in self.stages:
            out = {f"__out_{n}": self._typed(self.values[n]) for n in stage}
            if mask is not None:
                out = {k: F.when(F.col("__mask"), c).otherwise(F.lit(float("nan")).cast(self.dtype)) for k, c in out.items()}
            df = df.withColumns(out)
        return df

    # --- results ---

    def _keys(self) -> list[Column]:
        return [F.col(f"`__root_{d}`").alias(d) for d in self.dims]

    def load(self, source: DataFrame | None = None, *, mask: str | Column | None = None, use_array_maker: bool = False) -> DataFrame:
        """The root's dims and one column for each definition. Masked rows stay, with NaN. The source may be a stream."""
        return self.evaluated(source, mask).select(*self._keys(), *[F.col(f"`__out_{n}`").alias(n) for n in self.names])

    load_dataframe = load

    def apply(self, source: DataFrame, **options: Any) -> DataFrame:
        """The same flow over other root rows: prepared once, run again, on batches and streams."""
        return self.load(source, **options)

    def load_dataarray(self, source: DataFrame | None = None, **options: Any) -> DataFrame:
        """Long form: dims, expressions, value."""
        return self.load(source, **options).unpivot([F.col(f"`{d}`") for d in self.dims], [F.col(f"`{n}`") for n in self.names], "expressions", "value")

    def utilities(self, coefficients: Coefficients, *, flat: bool = False) -> dict[str, Column]:
        """By alternative, the sum of coefficients times outputs; zero coefficients cost nothing."""
        matrix = coefficient_matrix(coefficients, self.names)
        out = {}
        for alt, column in matrix.items():
            parts = [F.col(f"`__out_{n}`").cast("double") * F.lit(float(c)) for n, c in zip(self.names, column, strict=True) if c]
            total = parts[0] if parts else F.lit(0.0)
            for p in parts[1:]:
                total = total + p
            out[alt] = total
        return out

    def dot(self, coefficients: Coefficients, source: DataFrame | None = None, *, mask: str | Column | None = None, dtype: str = "double") -> DataFrame:
        """Dims and one column for each alternative ("dot" for a single vector)."""
        df = self.evaluated(source, mask)
        return df.select(*self._keys(), *[c.cast(dtype).alias(a) for a, c in self.utilities(coefficients).items()])

    def logit_draws(self, coefficients: Coefficients, draws: Any = 1, source: DataFrame | None = None, **options: Any) -> DataFrame:
        from ..operators.choice import logit_draws

        return logit_draws(self, coefficients, draws, source, **options)

    def init_streamer(self, source: DataFrame | None = None):
        """A function of the root's keys, one value for each dim, that evaluates that row alone.

        With fewer values than dims, all rows that have them: a chooser's alternatives, say.
        """
        frame = self.tree.nodes[self.root].frames[0]
        root = source if source is not None else frame.df

        def streamer(*keys: Any) -> DataFrame:
            if not 0 < len(keys) <= len(frame.dims):
                raise ValueError(f"{len(keys)} keys for the dims {frame.dims}")
            rows = root
            for dim, key in zip(frame.dims, keys, strict=False):
                rows = rows.where(F.col(f"`{dim}`") == F.lit(key))
            return self.load(rows)

        return streamer

    def explain(self, mode: str = "formatted") -> None:
        self.load().explain(mode)

    @property
    def function_names(self) -> list[str]:
        return list(self.names)

    def show_code(self) -> str:
        return "\n".join(f"{n} = {d}" for n, d in self.definitions.items())

    @classmethod
    def of(cls, tree: Tree, definitions: Mapping[str, Any] | Iterable[str], **options: Any) -> Flow:
        """A flow from the library of compiled ones, if its tree is the same."""
        made = cls(tree, definitions, **options)
        found = LIBRARY.setdefault(made.identity, made)
        return found if found.tree is tree else made


#: A vector by definition, or alternatives with vectors, or rows of numbers.
Coefficients = Mapping[str, Any] | Sequence[Any]


def coefficient_matrix(b: Coefficients, names: list[str]) -> dict[str, list[float]]:
    """alternative -> one coefficient for each definition; blank ones are 0."""
    if isinstance(b, Mapping):
        if all(isinstance(v, Mapping) for v in b.values()):
            return {str(alt): [float(col.get(n) or 0) for n in names] for alt, col in b.items()}
        if all(isinstance(v, (list, tuple)) for v in b.values()):
            return {str(alt): _checked([float(x or 0) for x in col], names) for alt, col in b.items()}
        return {"dot": [float(b.get(n) or 0) for n in names]}
    rows = list(b)
    if rows and isinstance(rows[0], (list, tuple)):
        if rows[0] and isinstance(rows[0][0], (list, tuple)):
            raise NotImplementedError("coefficients have one or two dims")
        _checked(rows, names)
        return {str(j): [float(r[j] or 0) for r in rows] for j in range(len(rows[0]))}
    return {"dot": _checked([float(x or 0) for x in rows], names)}


def _checked(values: list, names: list[str]) -> list:
    if len(values) != len(names):
        raise ValueError(f"{len(values)} coefficients for {len(names)} definitions")
    return values
