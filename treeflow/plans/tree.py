"""The catalog: nodes, many-to-one relationships between them, and the tree."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T


@dataclass
class Frame:
    """Variables that share dims: a long table keyed by one column for each dim. sides: the tables it is the product of."""

    dims: tuple[str, ...]
    df: DataFrame
    sides: tuple[DataFrame, ...] = ()

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.dims and not c.startswith("__")]


@dataclass(frozen=True)
class Blend:
    """A sparse table (__i, __j, __v), the fine dims that find its cells, and the value from which dense ones count."""

    table: DataFrame
    dims: tuple[str, str]
    limit: float | None = None


@dataclass
class Node:
    """A named dataset: frames by dims, and what is known of their keys.

    order: the column or columns that give rows their positions, by dim (default: the dim's own labels).
    unique: keys are known to be unique, so no deduplication is planned. dense: labels are 0, 1, 2, ..., so a position
    is its label. categories: for a text variable or dim, its full list of categories. redirects: for a dim,
    the name of a finer one and a table (fine, coarse) that maps it. blended: variables with a sparse table beside them.
    joint: tables of combinations by offset. Variables that carry an encoding in their metadata are decoded where used.
    """

    name: str
    frames: list[Frame]
    order: dict[str, str] = field(default_factory=dict)
    unique: bool = False
    dense: bool = False
    clean: frozenset[str] = frozenset()
    categories: dict[str, tuple] = field(default_factory=dict)
    redirects: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    blended: dict[str, Blend] = field(default_factory=dict)
    joint: dict[str, DataFrame] = field(default_factory=dict)

    def with_joint(self, encoding: str, table: DataFrame) -> Node:
        """The table of combinations that the column <encoding>_offsets refers to: its variables are the node's own."""
        return replace(self, joint={**self.joint, f"{encoding}_offsets": table})

    def joint_of(self, name: str) -> str | None:
        """The offsets column whose table holds a variable."""
        return next((o for o, t in self.joint.items() if name in t.columns and name != o), None)

    def redirected(self, mapping: DataFrame, fine: str, coarse: str, **dims: str) -> Node:
        """Finer names for dims: redirected(m, "MAZ", "TAZ", otaz="omaz", dtaz="dmaz")."""
        m = mapping.select(F.col(fine).alias("__fine"), F.col(coarse).alias("__coarse"))
        if unknown := set(dims) - set(self.dims):
            raise ValueError(f"no dims {sorted(unknown)}")
        return replace(self, redirects={**self.redirects, **{d: (name, m) for d, name in dims.items()}})

    def with_blend(self, name: str, sparse: DataFrame, i: str, j: str, value: str, dims: tuple[str, str], limit: float | None = None, known: DataFrame | None = None) -> Node:
        """A sparse table (i, j, value) over two fine dims, blended into the variable below ``limit``; equal cells add up.

        Cells whose labels are not in ``known`` (one column of fine labels) are left out. Without a dense variable of
        the name, missing cells are 0.
        """
        d = sparse.select(F.col(i).alias("__i"), F.col(j).alias("__j"), F.col(value).cast("double").alias("__v"))
        if known is not None:
            labels = known.select(F.col(known.columns[0]).alias("__l")).distinct()
            d = d.join(labels, d["__i"] == labels["__l"], "left_semi").join(labels, d["__j"] == labels["__l"], "left_semi")
        d = d.groupBy("__i", "__j").agg(F.sum("__v").alias("__v"))
        return replace(self, blended={**self.blended, name: Blend(d, dims, limit)})

    def is_blended(self, name: str) -> bool:
        return name in self.blended

    @classmethod
    def table(cls, name: str, df: DataFrame, index: str, **known: Any) -> Node:
        """A one-dimensional node: the index column is its dim."""
        return cls(name, [Frame((index,), df)], **known)

    @classmethod
    def tensor(cls, name: str, *frames: tuple[tuple[str, ...], DataFrame], **known: Any) -> Node:
        """A node of long tables, one for each set of dims, so a lookup of a 2-D variable never reads a 3-D one."""
        made = [Frame(tuple(d), df) for d, df in frames]
        for f in made:
            if missing := set(f.dims) - set(f.df.columns):
                raise ValueError(f"{name} lacks the dim columns {sorted(missing)}")
        return cls(name, made, **known)

    @classmethod
    def product(cls, name: str, *sides: tuple[str, DataFrame], **known: Any) -> Node:
        """All combinations of labels, without variables: choosers and alternatives. The later sides are alternatives."""
        if any(not dim for dim, _ in sides):
            raise ValueError("each side needs a name")
        df = sides[0][1]
        for _, other in sides[1:]:
            df = df.crossJoin(other)
        return cls(name, [Frame(tuple(d for d, _ in sides), df, tuple(s for _, s in sides))], **known)

    @property
    def dims(self) -> list[str]:
        return list(dict.fromkeys(d for f in self.frames for d in f.dims))

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for f in self.frames for v in f.variables))

    @property
    def single_dim(self) -> str:
        """The name of the only dim; an error if there are none or several."""
        if len(self.dims) != 1:
            raise ValueError(f"{self.name} has the dims {self.dims}, not one")
        return self.dims[0]

    def frame_of(self, name: str) -> Frame | None:
        """The frame that holds a variable or, with the fewest dims, a dim."""
        if name in self.blended and not any(name in f.variables for f in self.frames):
            return Frame((), self.blended[name].table)
        for f in self.frames:
            if name in f.variables:
                return f
        if (offsets := self.joint_of(name)) is not None:
            return next((f for f in self.frames if offsets in f.variables), None)
        held = [f for f in self.frames if name in f.dims]
        return min(held, key=lambda f: len(f.dims)) if held else None

    def labels(self, dim: str) -> DataFrame:
        """(label, __pos): the dim's labels in order of position."""
        f = min((f for f in self.frames if dim in f.dims), key=lambda f: len(f.dims))
        by = self.order.get(dim, dim)
        if self.dense:
            return f.df.select(F.col(dim), F.col(dim).cast("long").alias("__pos")).distinct()
        d = f.df.groupBy(dim).agg(F.min(by).alias("__by")) if by != dim else f.df.select(dim, F.col(dim).alias("__by")).distinct()
        return positions(d, "__by").select(dim, "__pos")

    def filtered(self, **fixed: Any) -> Node:
        """Labels fixed or selected: a scalar drops its dim, a list keeps it."""
        frames = []
        for f in self.frames:
            df, dims = f.df, f.dims
            for dim, want in fixed.items():
                if dim in dims and isinstance(want, (list, tuple)):
                    df = df.where(F.col(dim).isin(list(want)))
                elif dim in dims:
                    df, dims = df.where(F.col(dim) == F.lit(want)).drop(dim), tuple(d for d in dims if d != dim)
            frames.append(Frame(dims, df))
        return replace(self, frames=frames)

    def where(self, condition: Column | str) -> Node:
        return replace(self, frames=[Frame(f.dims, f.df.where(condition)) for f in self.frames])

    def keep_dims(self, *dims: str, errors: str = "raise") -> Node:
        if errors == "raise" and (unknown := set(dims) - set(self.dims)):
            raise ValueError(f"no dims {sorted(unknown)}")
        return replace(self, frames=[f for f in self.frames if set(f.dims) <= set(dims)])

    def renamed(self, names: Mapping[str, str], *, errors: str = "ignore") -> Node:
        if errors == "raise" and (unknown := set(names) - set(self.dims) - set(self.variables)):
            raise ValueError(f"no names {sorted(unknown)}")
        return replace(self, frames=[Frame(tuple(names.get(d, d) for d in f.dims), f.df.withColumnsRenamed(dict(names))) for f in self.frames], order={names.get(k, k): names.get(v, v) for k, v in self.order.items()})

    def interchanged(self, a: str, b: str) -> Node:
        """Two dims swap roles."""
        return self.renamed({a: "__swap"}).renamed({b: a}).renamed({"__swap": b})

    def selected(self, names: Mapping[str, str] | Iterable[str]) -> Node:
        names = dict(names) if isinstance(names, Mapping) else {n: n for n in names}
        frames = [Frame(f.dims, f.df.select(*f.dims, *[F.col(v).alias(names[v]) for v in f.variables if v in names])) for f in self.frames]
        return replace(self, frames=[f for f in frames if f.variables or len(frames) == 1])

    def at_positions(self, dim: str, start: int, stop: int) -> Node:
        """Rows whose position along a dim is in range(start, stop)."""
        place = self.labels(dim).where((F.col("__pos") >= start) & (F.col("__pos") < stop)).select(dim)
        return replace(self, frames=[Frame(f.dims, f.df.join(place, dim, "left_semi") if dim in f.dims else f.df) for f in self.frames])

    def max_float_precision(self, bits: int) -> Node:
        if bits not in (32, 64):
            raise ValueError("floats have 32 or 64 bits here")
        kind = "float" if bits == 32 else "double"
        return replace(self, frames=[Frame(f.dims, f.df.select(*[F.col(x.name).cast(kind) if isinstance(x.dataType, T.DoubleType) and x.name not in f.dims else F.col(x.name) for x in f.df.schema])) for f in self.frames])

    def ensure_integer(self, names: Iterable[str], bits: int = 32) -> Node:
        kind, names = {8: "byte", 16: "short", 32: "int", 64: "long"}[bits], set(names)
        cast = lambda x: F.col(x.name).cast(kind) if x.name in names and not isinstance(x.dataType, T.IntegralType) else F.col(x.name)
        return replace(self, frames=[Frame(f.dims, f.df.select(*[cast(x) for x in f.df.schema])) for f in self.frames])


#: Ranges in which rows are numbered: no window holds more than about this share of them.
RANGES = 256


def _range_key(t: T.DataType, c: Column) -> Column:
    """A number that orders as the column does, or as the first seven bytes of a text do."""
    if isinstance(t, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return c.cast("int") if isinstance(t, T.BooleanType) else c


def positions(df: DataFrame, by: str | Sequence[str], name: str = "__pos") -> DataFrame:
    """Numbers rows from 0 in the order of columns, nulls first; rows equal in these go by their other columns.

    Approximate quantiles of the first column cut the rows into ranges; each is numbered by a window of its own, after
    the rows of the ranges before it. All within one plan, at every size.
    """
    by = [by] if isinstance(by, str) else list(by)
    key = _range_key(df.schema[by[0]].dataType, F.col(by[0]))
    rest = [f.name for f in df.schema if f.name not in by and not isinstance(f.dataType, T.MapType)]
    cuts = df.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000).alias("__cuts"))
    ranged = df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < key)), F.lit(0))).drop("__cuts")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # one row for each range
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by, *rest))
    return ranged.withColumn("__place", place).join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__start") + F.col("__place") - 1).cast("long").alias(name))


@dataclass(frozen=True)
class Relationship:
    """parent_data.parent_name finds rows of child_data by child_name: by label ("@") or by position ("->")."""

    parent_data: str
    parent_name: str
    child_data: str
    child_name: str
    indexing: str = "label"
    analog: str | None = field(default=None, compare=False)

    def __post_init__(self):
        if not all(isinstance(x, str) for x in (self.parent_data, self.parent_name, self.child_data, self.child_name)):
            raise TypeError("names are text")
        if self.indexing not in ("label", "position"):
            raise ValueError("indexing is label or position")

    @classmethod
    def parse(cls, text: str) -> Relationship:
        m = re.fullmatch(r"\s*(\w+)\.(\w+)\s*(@|->)\s*(\w+)\.(\w+)\s*", text)
        if not m:
            raise ValueError(f"not a relationship: {text!r}")
        return cls(m[1], m[2], m[4], m[5], "label" if m[3] == "@" else "position")

    def __str__(self) -> str:
        return f"{self.parent_data}.{self.parent_name} {'@' if self.indexing == 'label' else '->'} {self.child_data}.{self.child_name}"

    def to_dict(self) -> dict[str, str]:
        return {"parent_data": self.parent_data, "parent_name": self.parent_name, "child_data": self.child_data, "child_name": self.child_name, "indexing": self.indexing}


@dataclass(frozen=True)
class Branch:
    """The variables of one node, each as the root's rows see it."""

    tree: Tree
    node: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.tree.get(f"{self.node}.{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or not self.tree.has(self.node, name):
            raise AttributeError(f"{name} is not in {self.node}")
        return self[name]


class Tree:
    """Nodes linked by relationships. Holds plans only, never data.

    on_missing says what a key without a match gives: "first" takes the row at position 0 (as offset lookups do),
    "null" gives null, "error" fails when the row is computed. complete=True promises that every key has a match, which
    saves the joins that would find out.
    """

    def __init__(self, root: str | None | bool = None, *, relationships: Iterable[str | Relationship] = (), extra_vars: Mapping[str, Any] | None = None, aux_vars: Mapping[str, Any] | None = None, extra_funcs: Mapping[str, Callable] | Iterable[Callable] = (), subspace_fallbacks: Mapping[str, Iterable[str]] | None = None, replacement_filters: Mapping[str, Callable[[Node], Node]] | None = None, on_missing: str = "first", complete: bool = False, **nodes: Node):
        if on_missing not in ("first", "null", "error"):
            raise ValueError("on_missing is first, null or error")
        self.nodes: dict[str, Node] = {}
        self.links: list[Relationship] = []
        self.extra_vars, self.aux_vars = dict(extra_vars or {}), dict(aux_vars or {})
        self.extra_funcs = dict(extra_funcs) if isinstance(extra_funcs, Mapping) else {f.__name__: f for f in extra_funcs}
        self.fallbacks = {k: list(v) for k, v in (subspace_fallbacks or {}).items()}
        self.filters = dict(replacement_filters or {})
        self.on_missing, self.complete = on_missing, complete
        for name, node in nodes.items():
            self.nodes[name] = replace(node, name=name)
        for r in relationships:
            self.add_relationship(r)
        self._root = root

    # --- building and asking ---

    def add_dataset(self, name: str, node: Node, relationships: Iterable[str | Relationship] | str = (), as_root: bool = False) -> None:
        self.nodes[name] = replace(node, name=name)
        for r in [relationships] if isinstance(relationships, (str, Relationship)) else relationships:
            self.add_relationship(r)
        if as_root:
            self._root = name

    def add_items(self, items: Mapping[str, Any]) -> None:
        for name, node in items.get("datasets", {}).items():
            self.add_dataset(name, node)
        for r in items.get("relationships", []):
            self.add_relationship(r)

    def add_relationship(self, r: str | Relationship) -> None:
        r = Relationship.parse(r) if isinstance(r, str) else r
        r = self._finditem(r)
        for name in (r.parent_data, r.child_data):
            if name not in self.nodes:
                raise KeyError(name)
        if r not in self.links:
            self.links.append(r)

    def _finditem(self, r: Relationship) -> Relationship:
        """A parent that lacks the variable gives way to the first ancestor or descendant that has it."""
        if r.parent_data not in self.nodes or self.has(r.parent_data, r.parent_name):
            return r
        seen, queue = {r.parent_data}, [r.parent_data]
        while queue:
            at = queue.pop(0)
            if self.has(at, r.parent_name):
                return replace(r, parent_data=at)
            for x in self.links:
                if x.parent_data == at and x.child_data not in seen:
                    seen.add(x.child_data)
                    queue.append(x.child_data)
        raise KeyError(f"{r.parent_data}.{r.parent_name}")

    def has(self, node: str, name: str) -> bool:
        return node in self.nodes and self.nodes[node].frame_of(name) is not None

    @property
    def root(self) -> str | None:
        if self._root is False:
            return None
        if self._root:
            return self._root
        children = {r.child_data for r in self.links}
        return next((n for n in self.nodes if n not in children), None)

    @property
    def root_node(self) -> Node:
        if self.root is None:
            raise ValueError("the tree has no root")
        return self.nodes[self.root]

    @root_node.setter
    def root_node(self, node: Node) -> None:
        name = self.root
        self.nodes[name] = self._filtered(name, replace(node, name=name))

    @property
    def root_dims(self) -> tuple[str, ...]:
        return self.root_node.frames[0].dims

    def bindings(self, child: str) -> dict[str, Relationship]:
        """By dim of the child, the relationship that binds it; the first given counts."""
        out: dict[str, Relationship] = {}
        for r in self.links:
            if r.child_data == child:
                out.setdefault(r.child_name, r)
        return out

    def list_relationships(self) -> list[str]:
        return [str(r) for r in self.links]

    def get_relationship(self, parent: str, child: str) -> Relationship | None:
        return next((r for r in self.links if (r.parent_data, r.child_data) == (parent, child)), None)

    def namespace_names(self) -> set[str]:
        return set(self.nodes)

    def all_var_names(self) -> set[str]:
        return {v for n in self.nodes.values() for v in n.variables}

    def subspaces(self) -> dict[str, Node]:
        return dict(self.nodes)

    def dims(self) -> list[str]:
        return list(dict.fromkeys(d for n in self.nodes.values() for d in n.dims))

    def copy(self) -> Tree:
        out = Tree(self._root, extra_vars=self.extra_vars, aux_vars=self.aux_vars, extra_funcs=self.extra_funcs, subspace_fallbacks=self.fallbacks, replacement_filters=self.filters, on_missing=self.on_missing, complete=self.complete)
        out.nodes, out.links = dict(self.nodes), list(self.links)
        return out

    def _filtered(self, name: str, node: Node) -> Node:
        return self.filters[name](node) if name in self.filters else node

    def replace_datasets(self, other: Mapping[str, Node] | None = None, *, validate: bool = True, **more: Node) -> Tree:
        """A new tree with other data in some nodes. A node that is found by position must keep its number of rows."""
        out = self.copy()
        for name, node in {**(other or {}), **more}.items():
            if name not in self.nodes:
                raise KeyError(name)
            node = self._filtered(name, replace(node, name=name))
            for r in self.links if validate else ():
                if r.child_data == name and r.indexing == "position":
                    if node.labels(r.child_name).count() != self.nodes[name].labels(r.child_name).count():
                        raise ValueError(f"{name} is found by position and changes its size")
            out.nodes[name] = node
        return out

    def drop_dims(self, dims: str | Iterable[str], *, ignore_missing: bool = False) -> Tree:
        """A tree whose root lacks the dims: its rows are made distinct over the rest, and nodes that hung on them go."""
        dims = [dims] if isinstance(dims, str) else list(dims)
        root = self.root_node.frames[0]
        if not ignore_missing and (unknown := set(dims) - set(root.dims)):
            raise ValueError(f"no dims {sorted(unknown)} at the root")
        rest = tuple(d for d in root.dims if d not in dims)
        out = self.copy()
        name = self.root
        lost = {name}
        out.nodes[name] = replace(self.root_node, frames=[Frame(rest, root.df.select(*rest).distinct())])
        held = {(name, d) for d in rest}
        out.links = []
        gone: set[str] = set()
        for r in self.links:
            bad = r.parent_data in gone or (r.parent_data == name and (name, r.parent_name) not in held)
            if bad:
                gone.add(r.child_data)
        changed = True
        while changed:
            more = {r.child_data for r in self.links if r.parent_data in gone} - gone
            gone |= more
            changed = bool(more)
        out.links = [r for r in self.links if not {r.parent_data, r.child_data} & gone]
        out.nodes = {k: v for k, v in out.nodes.items() if k not in gone or k in lost}
        return out

    def to_dot(self) -> str:
        edges = "".join(f'  "{r.parent_data}" -> "{r.child_data}" [label="{r.parent_name} {"@" if r.indexing == "label" else "->"} {r.child_name}"];\n' for r in self.links)
        return "digraph tree {\n" + "".join(f'  "{n}";\n' for n in self.nodes) + edges + "}\n"

    def __repr__(self) -> str:
        return f"<Tree root={self.root} nodes={list(self.nodes)} relationships={self.list_relationships()}>"

    def __iter__(self):
        return iter(self.nodes)

    # --- evaluating ---

    def setup_flow(self, definitions: Mapping[str, Any] | Iterable[str], **options: Any):
        from .flow import Flow

        return Flow(self, definitions, **options)

    def get(self, names: str | Iterable[str], default: Any = None) -> DataFrame:
        """Root keys and the named variables ("node.var" or "var"); a default stands in for unknown names."""
        names = [names] if isinstance(names, str) else list(names)
        definitions = {}
        for n in names:
            node, _, var = n.rpartition(".")
            known = self.has(node, var) if node else any(self.has(x, n) for x in self.nodes)
            if not known and default is None:
                raise KeyError(n)
            definitions[n.replace(".", "_")] = n if known else default
        return self.setup_flow(definitions, dtype=None).load()

    def __getitem__(self, name: str) -> Branch | DataFrame:
        """A node's branch, so that tree["node"].var is tree.get("node.var"); else the named variable."""
        return Branch(self, name) if name in self.nodes else self.get(name)

    def eval(self, expression: Any, *, name: str | None = None, dtype: str | None = None) -> DataFrame:
        return self.setup_flow({name or "value": expression}, dtype=dtype).load()

    def eval_many(self, expressions: Mapping[str, Any] | Iterable[str], *, dtype: str = "double", result_type: str = "dataset") -> DataFrame:
        """One column for each expression, or with result_type "dataarray" one row for each (expressions, value)."""
        flow = self.setup_flow(expressions, dtype=dtype)
        out = flow.load()
        if result_type == "dataset":
            return out
        return out.unpivot([F.col(f"`{d}`") for d in self.root_dims], [F.col(f"`{n}`") for n in flow.names], "expressions", "value")

    def merged_dataset(self, columns: Iterable[str] | None = None) -> DataFrame:
        """The root with all (or the named) variables of all nodes that it reaches; clashing names get their node's."""
        wanted: dict[str, str] = {}
        for node in self.nodes.values():
            for v in node.variables:
                if columns is not None and v not in set(columns):
                    continue
                wanted[v if v not in wanted else f"{node.name}_{v}"] = f"{node.name}.{v}"
        return self.setup_flow(wanted, dtype=None).load()
