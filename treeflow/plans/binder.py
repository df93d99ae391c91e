"""Which lookups a flow needs, and the joins that answer them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.compiler import Value, kind_of, literal
from ..functions.scalar import blend
from ..operators.encoding import Encoding, decoded
from .tree import Frame, Node, Relationship, Tree


@dataclass
class Lookup:
    """One join: rows of a frame found by a source for each of its dims. Each is planned once, with only the variables in use."""

    number: int
    node: Node
    frame: Frame
    sources: tuple[tuple[str, Column, str], ...]  # dim, key column, "label" or "position"
    fixed: tuple[tuple[str, Any], ...]
    used: dict[str, None] = field(default_factory=dict)

    def column(self, name: str) -> str:
        return f"__j{self.number}_{name}"


class Binder:
    """Resolves names over a tree to columns of the joined root, registering lookups as it goes."""

    def __init__(self, tree: Tree, root: str):
        self.tree, self.root = tree, root
        self.lookups: dict[tuple, Lookup] = {}
        self.maps: dict[tuple, tuple[int, Column, DataFrame]] = {}
        self.blends: dict[tuple, tuple[int, Column, Column, DataFrame]] = {}
        self.joints: dict[tuple, tuple] = {}
        self.steps: list[tuple[str, Any]] = []

    # --- names ---

    def variable(self, node: str, name: str, *, reverse: bool = False, fixed: tuple = ()) -> Value | None:
        """The column of a node's variable (or dim), or None if the node and its fallbacks lack it."""
        if node not in self.tree.nodes:
            for other in self.tree.fallbacks.get(node, ()):
                if (found := self.variable(other, name, reverse=reverse, fixed=fixed)) is not None:
                    return found
            return None
        n = self.tree.nodes[node]
        frame = n.frame_of(name)
        if frame is None:
            for other in self.tree.fallbacks.get(node, ()):
                if (found := self.variable(other, name, reverse=reverse, fixed=fixed)) is not None:
                    return found
            return None
        if name in n.blended:
            return self._blended(n, name, reverse)
        offsets = n.joint_of(name) if name not in frame.df.columns else None
        read = offsets or name
        if node == self.root:
            col, nullable = F.col(f"`__root_{read}`"), read not in n.clean
        else:
            col, nullable = self._dense(n, frame, read, reverse, fixed), True
        if offsets is not None:
            return self._joint(n, offsets, name, col)
        return self._value(col, frame.df.schema[name], nullable, n)

    def _joint(self, n: Node, offsets: str, name: str, code: Column) -> Value:
        """A variable of a joint encoding: its table is joined once for each column of offsets that is looked up."""
        table = n.joint[offsets]
        key = (n.name, offsets, str(code._jc) if hasattr(code, "_jc") else str(code))
        if key not in self.joints:
            self.joints[key] = (len(self.steps), code, offsets, table, {})
            self.steps.append(("joint", self.joints[key]))
        number, *_, used = self.joints[key]
        used[name] = None
        return self._value(F.col(f"`__e{number}_{name}`"), table.schema[name], True, n)

    def _join_joint(self, df: DataFrame, step: tuple) -> DataFrame:
        number, code, offsets, table, used = step
        t = table.select(F.col(offsets).alias(f"__eo{number}"), *[F.col(v).alias(f"__e{number}_{v}") for v in used])
        out = df.withColumn(f"__ec{number}", code)
        return out.join(t, F.col(f"__ec{number}") == F.col(f"__eo{number}"), "left").drop(f"__ec{number}", f"__eo{number}")

    def _value(self, col: Column, f: T.StructField, nullable: bool, node: Node) -> Value:
        """The value a column holds: codes of an encoding are decoded, by what the column's metadata say of it."""
        e = Encoding.of_field(f)
        if e is not None and e.kind in ("fixed", "dictionary"):
            kind = "float" if e.kind == "fixed" else "str" if any(isinstance(v, str) for v in e.values or ()) else kind_of(f.dataType) if all(isinstance(v, int) for v in e.values or ()) else "float"
            return Value(decoded(col, e), kind, True, categories=node.categories.get(f.name))
        return Value(col, kind_of(f.dataType), nullable, categories=node.categories.get(f.name))

    def _dense(self, n: Node, frame: Frame, name: str, reverse: bool, fixed: tuple) -> Column:
        sources, held, open_dims = [], [], []
        for dim in frame.dims:
            found = self._source(n, dim)
            if found is None:
                open_dims.append(dim)
            else:
                sources.append((dim, *found))
        if len(open_dims) > len(fixed) or len(open_dims) > 1:
            raise KeyError(f"{n.name}.{name}: at most one dim may lack a binding, and it needs a constant: {open_dims}")
        held = list(zip(open_dims, fixed, strict=False))
        if len(fixed) > len(open_dims):
            raise KeyError(f"{n.name}.{name}: all dims are bound")
        if reverse:
            if len(sources) < 2:
                raise KeyError(f"{n.name}.{name} has no two bound dims")
            (a, ca, ia), (b, cb, ib) = sources[:2]
            sources[:2] = [(a, cb, ib), (b, ca, ia)]
        key = (n.name, frame.dims, tuple((d, str(c._jc) if hasattr(c, "_jc") else str(c), i) for d, c, i in sources), tuple(held))
        if key not in self.lookups:
            self.lookups[key] = Lookup(len(self.steps), n, frame, tuple(sources), tuple(held))
            self.steps.append(("lookup", self.lookups[key]))
        look = self.lookups[key]
        look.used[name] = None
        return F.col(f"`{look.column(name)}`")

    def _bound(self, n: Node, dim: str) -> tuple[Column, str] | None:
        r: Relationship | None = self.tree.bindings(n.name).get(dim)
        if r is None:
            return None
        v = self.variable(r.parent_data, r.parent_name)
        if v is None:
            raise KeyError(f"{r.parent_data}.{r.parent_name}")
        child = n.frame_of(dim)
        if r.indexing == "label" and child is not None:
            to = kind_of(child.df.schema[dim].dataType) if dim in child.df.columns else v.kind
            if (v.kind == "str") != (to == "str"):
                raise ValueError(f"{r}: a {v.kind} key cannot find {to} labels")
            if v.categories is not None and dim in n.categories and set(v.categories) != set(n.categories[dim]):
                raise ValueError(f"{r}: categoricals have different categories")
        return v.col, r.indexing

    def _source(self, n: Node, dim: str) -> tuple[Column, str] | None:
        if (found := self._bound(n, dim)) is not None:
            return found
        if dim in n.redirects:
            fine, mapping = n.redirects[dim]
            if (found := self._bound(n, fine)) is None:
                return None
            key = (n.name, dim)
            if key not in self.maps:
                self.maps[key] = (len(self.steps), found[0], mapping)
                self.steps.append(("map", self.maps[key]))
            return F.col(f"`__m{self.maps[key][0]}`"), "label"
        return None

    def _blended(self, n: Node, name: str, reverse: bool) -> Value:
        b = n.blended[name]
        i, j = (self._bound(n, d) for d in b.dims)
        if i is None or j is None:
            raise KeyError(f"{n.name}.{name}: its fine dims {b.dims} are not bound")
        dense_frame = next((f for f in n.frames if name in f.variables), None)
        dense = self._value(self._dense(n, dense_frame, name, reverse, ()), dense_frame.df.schema[name], True, n).col if dense_frame else F.lit(0.0)
        a, z = (j[0], i[0]) if reverse else (i[0], j[0])
        key = (n.name, name, reverse)
        if key not in self.blends:
            self.blends[key] = (len(self.steps), a, z, b.table)
            self.steps.append(("blend", self.blends[key]))
        return Value(blend(F.col(f"`__b{self.blends[key][0]}`"), dense, b.limit), "float")

    # --- joins ---

    def joined(self, root: DataFrame | tuple[DataFrame, ...], added: Mapping[str, Column] | None = None, by: str | None = None) -> DataFrame:
        """The root, its columns prefixed, with all registered lookups joined; never more rows than the root.

        Of a product's sides, what needs the first alone is joined before they are crossed. added: columns to compute
        as well, there too if they can be. by: a column of the first side; its rows are dealt by it before they are
        crossed, so that nothing is shuffled by it afterwards.
        """
        first, *others = [df.select(*[F.col(f"`{c}`").alias(f"__root_{c}") for c in df.columns]) for df in (root if isinstance(root, tuple) else (root,))]
        df, later = first, []
        lacks = {c for other in others for c in other.columns}
        for number, (kind, step) in enumerate(self.steps):
            if not others or _resolves(df, self._keys(kind, step), lacks):
                df = getattr(self, f"_join_{kind}")(df, step)
            else:
                later.append((kind, step))
                lacks |= {f"__j{number}_{v}" for v in step.used} if kind == "lookup" else {f"__e{number}_{v}" for v in step[-1]} if kind == "joint" else {f"__m{number}", f"__b{number}"}
        early = {n: c for n, c in (added or {}).items() if not others or _resolves(df, [c], lacks)}
        df = df.withColumns(early) if early else df
        if others and by is not None:  # a number of partitions, or they are merged by their size before the product
            df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(f"`{by}`"))
        for other in others:
            df = df.crossJoin(other)
        for kind, step in later:
            df = getattr(self, f"_join_{kind}")(df, step)
        late = {n: c for n, c in (added or {}).items() if n not in early}
        return df.withColumns(late) if late else df

    def _keys(self, kind: str, step: Any) -> list[Column]:
        """What a join finds its rows by."""
        return [c for _, c, _ in step.sources] if kind == "lookup" else [c for c in step if isinstance(c, Column)]

    def _join_map(self, df: DataFrame, step: tuple) -> DataFrame:
        number, key, mapping = step
        m = mapping.groupBy("__fine").agg(F.max("__coarse").alias(f"__m{number}")).withColumnRenamed("__fine", f"__f{number}")
        out = df.withColumn(f"__mk{number}", key).join(m, F.col(f"__mk{number}") == F.col(f"__f{number}"), "left").drop(f"__f{number}")
        if self.tree.on_missing == "error":
            missed = F.raise_error(F.lit("a redirection has no such label"))
            out = out.withColumn(f"__m{number}", F.when(F.col(f"__m{number}").isNotNull(), F.col(f"__m{number}")).otherwise(missed.cast(mapping.schema["__coarse"].dataType)))
        return out

    def _join_blend(self, df: DataFrame, step: tuple) -> DataFrame:
        number, a, z, table = step
        t = table.select(F.col("__i").alias(f"__i{number}"), F.col("__j").alias(f"__jj{number}"), F.col("__v").alias(f"__b{number}"))
        out = df.withColumn(f"__ka{number}", a).withColumn(f"__kz{number}", z)
        return out.join(t, (F.col(f"__ka{number}") == F.col(f"__i{number}")) & (F.col(f"__kz{number}") == F.col(f"__jj{number}")), "left").drop(f"__i{number}", f"__jj{number}")

    def _child(self, look: Lookup) -> DataFrame:
        """The frame's rows, one for each key: of equal keys the last position counts."""
        df, n = look.frame.df, look.node
        for dim, value in look.fixed:
            df = df.where(F.col(dim) == literal(value).col)
        dims = [d for d, _, _ in look.sources]
        by = next((n.order[d] for d in dims if d in n.order and n.order[d] in df.columns), None)
        used = [v for v in look.used if v not in dims]
        if not n.unique:
            place = F.col(by) if by else F.monotonically_increasing_id()
            last = F.max_by(F.struct(*used, F.lit(1).alias("__hit")), "__place").alias("__last")
            df = df.select(*dims, *used, place.alias("__place")).groupBy(*dims).agg(last, F.max("__place").alias("__place")).select(*dims, "__place", "__last.*").drop("__hit")
            by = "__place"
        for d, _, how in look.sources:
            if how == "position" and not n.dense:
                df = df.join(n.labels(d).withColumnRenamed("__pos", f"__pos_{d}"), d)
        keep_place = [F.col(by).alias(f"__place{look.number}")] if by and by in df.columns else []
        keys = [F.col(f"__pos_{d}" if how == "position" and not n.dense else d).alias(f"__k{look.number}_{d}") for d, _, how in look.sources]
        return df.select(*keys, *[F.col(v).alias(look.column(v)) for v in look.used], *keep_place)

    def _join_lookup(self, df: DataFrame, look: Lookup) -> DataFrame:
        n, policy = look.node, self.tree.on_missing
        child = self._child(look)
        place = f"__place{look.number}"
        keys = [f"__k{look.number}_{d}" for d, _, _ in look.sources]
        first = policy == "first" and not self.tree.complete
        for d, source, how in look.sources:
            df = df.withColumn(f"__s{look.number}_{d}", source)
            if first and len(look.sources) > 1:
                # each key alone falls back to its dim's first label
                labels = n.labels(d)
                start = labels.orderBy("__pos").limit(1).select(F.col("__pos" if how == "position" else d).alias("__start"))  # one row
                lab = labels.select(F.col("__pos" if how == "position" else d).alias("__lab"))
                df = df.join(lab, F.col(f"__s{look.number}_{d}") == F.col("__lab"), "left")
                df = df.join(F.broadcast(start), F.lit(True), "left")
                df = df.withColumn(f"__s{look.number}_{d}", F.coalesce("__lab", "__start")).drop("__lab", "__start")
        marked = child.drop(place).withColumn(f"__hit{look.number}", F.lit(True))
        on = [F.col(f"__s{look.number}_{d}") == F.col(k) for (d, _, _), k in zip(look.sources, keys, strict=True)]
        out = df.join(marked, on, "left") if on else df.crossJoin(F.broadcast(marked.limit(1)))
        hit = F.col(f"__hit{look.number}").isNotNull()
        columns = [look.column(v) for v in look.used]
        if first and len(look.sources) == 1:
            order = place if place in child.columns else keys[0]
            start = child.orderBy(order).limit(1).select(*[F.col(c).alias(f"__first_{c}") for c in columns])  # one row
            out = out.join(F.broadcast(start), F.lit(True), "left")
            out = out.withColumns({c: F.when(hit, F.col(c)).otherwise(F.col(f"__first_{c}")) for c in columns}).drop(*[f"__first_{c}" for c in columns])
        elif policy == "error" and not self.tree.complete:
            what = F.lit(f"{n.name}: no such label")
            out = out.withColumns({c: F.when(hit, F.col(c)).otherwise(F.raise_error(what).cast(child.schema[c].dataType)) for c in columns})
        return out.drop(*keys, f"__hit{look.number}")


def _resolves(df: DataFrame, columns: Sequence[Column], lacks: set[str]) -> bool:
    """Whether a table has all that the columns are made of. Names it lacks are sought first: Spark logs what it cannot resolve."""
    names = set(re.findall(r"\w+", " ".join(str(c) for c in columns)))
    if any(names.issuperset(re.findall(r"\w+", x)) for x in lacks):
        return False
    try:
        return bool(columns) and bool(df.select(*columns).schema)
    except AnalysisException:
        return False
