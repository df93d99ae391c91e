"""Multinomial and nested logit: probabilities, logsums and reproducible choices, in built-in columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..plans.flow import Coefficients, Flow
from .nesting import NestingTree

#: A share below this is not chosen when rounding leaves a draw above the whole.
TRIVIAL = 1e-30
NEG_INF = float("-inf")


def _greatest(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _any(conditions: Sequence[Column]) -> Column:
    """Whether one holds; halved, so that many draws make no deep tree."""
    half = len(conditions) // 2
    return F.lit(False) if not conditions else conditions[0] if not half else _any(conditions[:half]) | _any(conditions[half:])


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def uniform(keys: Sequence[Column], draw: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of keys, draw and seed: the same on every run and under any partitioning."""
    return F.pmod(F.xxhash64(*keys, draw.cast("int"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _drawn(draws: Any, keys: Sequence[Column], seed: int) -> list[Column]:
    """Columns of draws: a number makes that many hashed ones; columns and their names are taken as they are."""
    if draws is None:
        draws = 1
    if isinstance(draws, int):
        return [uniform(keys, F.lit(i), seed) for i in range(draws)]
    return [F.col(d) if isinstance(d, str) else d for d in ([draws] if isinstance(draws, (str, Column)) else draws)]


def mnl(utilities: Mapping[str, Column]) -> tuple[dict[str, Column], Column]:
    """Probability by alternative, and the logsum; shifted by the largest utility, so that exponents stay small."""
    top = _greatest(list(utilities.values()))
    parts = {a: F.exp(u - top) for a, u in utilities.items()}
    total = _sum(list(parts.values()))
    return {a: p / total for a, p in parts.items()}, F.log(total) + top


def nested(utilities: Mapping[str, Column], tree: NestingTree, parameters: Mapping[str, float] | None = None) -> tuple[dict[str, Column], Column, list[tuple[str, Column]]]:
    """Probabilities, logsum and the steps (name, column) to add first, for a tree of nests.

    A nest's utility is mu times the logsum of its children's utilities over mu (the largest of them if mu is 0);
    children of utility minus infinity are left out. A child's share is exp((child - nest) / mu).
    """
    u: dict[int, Column] = {c: utilities[tree.names[c]] for c in tree.elementals}
    steps: list[tuple[str, Column]] = []
    for n in tree.bottom_up():
        mu, kids = tree.parameter(n, parameters), tree.children(n)
        top = _greatest([u[k] for k in kids])
        if mu == 0:
            value = top
        else:
            value = F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + mu * F.log(_sum([F.exp((u[k] - top) / mu) for k in kids])))
        steps.append((f"__nest_{n}", value))
        u[n] = F.col(f"__nest_{n}")
    share: dict[int, Column] = {tree.ROOT: F.lit(1.0)}
    for n in reversed(tree.bottom_up()):
        mu = tree.parameter(n, parameters)
        for k in tree.children(n):
            own = F.when(u[k] == u[n], 1.0).otherwise(0.0) if mu == 0 else F.when(u[k] == NEG_INF, 0.0).otherwise(F.exp((u[k] - u[n]) / mu))
            share[k] = share[n] * own
            if k in tree.nests:
                steps.append((f"__share_{k}", share[k]))
                share[k] = F.col(f"__share_{k}")
    return {tree.names[c]: share[c] for c in tree.elementals}, u[tree.ROOT], steps


def chosen(probabilities: Sequence[Column], r: Column) -> tuple[Column, Column]:
    """(position, probability) of the first alternative whose running share exceeds r; the last that is not trivial if none does."""
    place = share = running = None
    for i, p in enumerate(probabilities):
        running = p if running is None else running + p
        place = F.when(running > r, i) if place is None else place.when(running > r, i)
        share = F.when(running > r, p) if share is None else share.when(running > r, p)
    last, last_share = F.lit(-1), F.lit(0.0)
    for i, p in enumerate(probabilities):
        last, last_share = F.when(p >= TRIVIAL, i).otherwise(last), F.when(p >= TRIVIAL, p).otherwise(last_share)
    return place.otherwise(last).cast("int"), share.otherwise(last_share)


def logit_draws(flow: Flow, coefficients: Coefficients, draws: Any = 1, source: DataFrame | None = None, *, logsums: int = 0, pick_counted: bool = False, nesting: NestingTree | None = None, parameters: Mapping[str, float] | None = None, mask: str | Column | None = None, seed: int = 0, wide: bool = False, probabilities: bool = False) -> DataFrame:
    """Simulated choices over a flow.

    One-dimensional roots take coefficients by alternative; each row gets choice_i and prob_i for each draw (and
    logsum; with pick_counted one row for each alternative that was drawn). Two-dimensional roots with one vector of
    coefficients choose among the rows of a chooser, and give one row for each chooser and draw; with ``wide`` or
    several alternatives, each cell chooses as in one dimension. logsums: 1 gives the logsum alone, 2 both. Masked
    rows have choice -1, probability 0, logsum 0; so have choosers all of whose cells are masked (a null choice where
    alternatives have text labels), with a pick_count of 0.
    """
    two = len(flow.tree.nodes[flow.root].frames[0].dims) == 2
    single = _single(coefficients, flow)
    if two and single and not wide:
        if nesting is not None:
            raise NotImplementedError("nests need alternatives as columns")
        return _long(flow, coefficients, draws, source, logsums, pick_counted, mask, seed)
    if single:
        raise ValueError("a one-dimensional root needs coefficients for each of several alternatives")
    df = flow.evaluated(source)
    keys = flow._keys()
    u = flow.utilities(coefficients)
    names = {a: f"__u_{i}" for i, a in enumerate(u)}
    df = df.withColumns({names[a]: c for a, c in u.items()})
    columns = {a: F.col(n) for a, n in names.items()}
    if nesting is None:
        probs, logsum = mnl(columns)
    else:
        probs, logsum, steps = nested(columns, nesting, parameters)
        for name, c in steps:
            df = df.withColumn(name, c)
    on = F.lit(True) if mask is None else F.coalesce(F.col(f"`__root_{mask}`") if isinstance(mask, str) else mask, F.lit(False)).cast("boolean")
    ls = F.when(on, logsum).otherwise(0.0).alias("logsum")
    if logsums == 1:
        return df.select(*keys, ls)
    df = df.withColumns({f"__p_{i}": F.when(on, probs[a]).otherwise(0.0) for i, a in enumerate(u)})
    shares = [F.col(f"__p_{i}") for i in range(len(u))]
    out = [*keys]
    if probabilities:
        out += [s.alias(f"p_{a}") for a, s in zip(u, shares, strict=True)]
    picks = []
    for i, r in enumerate(_drawn(draws, [F.col(f"`__root_{d}`") for d in flow.dims], seed)):
        place, share = chosen(shares, r)
        picks.append((F.when(on, place).otherwise(-1).cast("int"), F.when(on, share).otherwise(0.0)))
        if not pick_counted:
            out += [picks[-1][0].alias(f"choice_{i}"), picks[-1][1].alias(f"prob_{i}")]
    if pick_counted:
        made = df.select(*out, *([ls] if logsums else []), F.explode(F.array(*[F.struct(c.alias("choice"), p.alias("prob")) for c, p in picks])).alias("pick"))
        by = [d for d in flow.dims] + (["logsum"] if logsums else [])
        return made.where("pick.choice >= 0").groupBy(*by, F.col("pick.choice").alias("choice"), F.col("pick.prob").alias("prob")).agg(F.count("*").cast("int").alias("pick_count"))
    return df.select(*out, *([ls] if logsums else []))


def _single(coefficients: Coefficients, flow: Flow) -> bool:
    from ..plans.flow import coefficient_matrix

    return len(coefficient_matrix(coefficients, flow.names)) == 1


def shares_by_row(df: DataFrame, chooser: str, alternative: str, utility: str) -> DataFrame:
    """Adds prob, logsum, upto and after (running shares before and with the row) over each chooser's alternatives.

    All windows share one partitioning and order, so there is one sort, and one shuffle unless rows are dealt by chooser already.
    """
    rows = Window.partitionBy(chooser).orderBy(alternative)
    all_, run = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn("__top", F.max(utility).over(all_))
    d = d.withColumn("__e", F.exp(F.col(utility) - F.col("__top")))
    d = d.withColumn("__total", F.sum("__e").over(all_))
    d = d.withColumn("prob", F.col("__e") / F.col("__total")).withColumn("logsum", F.log("__total") + F.col("__top"))
    solid = F.when(F.col("prob") >= TRIVIAL, F.col(alternative))
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"after": F.sum("prob").over(run), "upto": F.coalesce(F.sum("prob").over(before), F.lit(0.0)), "__last": F.max(solid).over(all_), "__end": F.sum("prob").over(all_)})
    return d.drop("__top", "__e", "__total")


def _long(flow: Flow, coefficients: Coefficients, draws: Any, source: DataFrame | None, logsums: int, pick_counted: bool, mask: str | Column | None, seed: int) -> DataFrame:
    chooser, alternative = flow.tree.nodes[flow.root].frames[0].dims
    rs = [] if logsums == 1 else _drawn(draws, [F.col(f"`__root_{chooser}`")], seed)
    df = flow.evaluated(source, added={f"__r{i}": c for i, c in enumerate(rs)}, by=f"__root_{chooser}")
    u = next(iter(flow.utilities(coefficients).values()))
    if mask is not None:  # masked cells have no utility and no share, but keep their chooser
        u = F.when(F.coalesce(F.col(f"`__root_{mask}`") if isinstance(mask, str) else mask, F.lit(False)), u)
    d = df.select(F.col(f"`__root_{chooser}`").alias(chooser), F.col(f"`__root_{alternative}`").alias(alternative), u.alias("__u"), *[f"__r{i}" for i in range(len(rs))])
    d = shares_by_row(d, chooser, alternative, "__u")
    if mask is not None:
        d = d.withColumn("logsum", F.coalesce("logsum", F.lit(0.0)))
    if logsums == 1:
        return d.groupBy(chooser).agg(F.max("logsum").alias("logsum"))
    rs = [F.col(f"__r{i}") for i in range(len(rs))]
    # a draw falls on the row whose running share first exceeds it, or on the last solid row past the end
    falls = [((r >= F.col("upto")) & (r < F.col("after"))) | ((r >= F.col("__end")) & (F.col(alternative) == F.col("__last"))) for r in rs]
    picked, share, times = F.col(alternative), F.col("prob"), _sum([F.lit(0), *[F.when(c, 1).otherwise(0) for c in falls]])
    if mask is not None:  # the first cell of a chooser without any stands for its draws
        first = F.row_number().over(Window.partitionBy(chooser).orderBy(alternative)) == 1
        d = d.withColumn("__none", F.col("__end").isNull() & first)
        falls = [F.col("__none") | c for c in falls]
        kind = d.schema[alternative].dataType
        picked = F.when(F.col("__none"), F.lit(None if isinstance(kind, T.StringType) else -1).cast(kind)).otherwise(picked)
        share, times = F.when(F.col("__none"), 0.0).otherwise(share), F.when(F.col("__none"), 0).otherwise(times)
    d = d.where(_any(falls))  # lists are made for rows that are hit, not for every cell
    keep = [chooser, picked.alias("choice"), share.alias("prob"), *(["logsum"] if logsums else [])]
    if pick_counted:
        return d.select(*keep, times.alias("pick_count"))
    return d.select(*keep, F.explode(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(falls)])).alias("draw")).where(F.col("draw").isNotNull())


def utility_to_probability(df: DataFrame, utilities: Sequence[str], tree: NestingTree | None = None, parameters: Mapping[str, float] | None = None) -> DataFrame:
    """The same transformation on a table of utilities: adds p_<alternative> and logsum."""
    u = {a: F.col(a) for a in utilities}
    if tree is None:
        probs, logsum = mnl(u)
        steps: list = []
    else:
        probs, logsum, steps = nested(u, tree, parameters)
    for name, c in steps:
        df = df.withColumn(name, c)
    return df.withColumns({f"p_{a}": p for a, p in probs.items()} | {"logsum": logsum}).drop(*[n for n, _ in steps])


def labelled(choice: Column, labels: Sequence[str]) -> Column:
    """The label of a choice's position; null for none."""
    return F.get(F.array(*[F.lit(x) for x in labels]), choice)
