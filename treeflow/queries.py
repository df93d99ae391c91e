"""One query for each operator over the driver's tables, with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from enum import IntEnum
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .operators import choice, encoding, lookup
from .operators.nesting import construct_nesting_tree
from .operators.table import Table, concat_tables
from .plans import Flow, Node, Tree
from .sources import from_parquet_3d, read_spec
from .sources.store import BlockTable, DataStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return registered


# --- trees -----------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(spark: SparkSession, sf_dir: str, name: str, key: str, **known: Any) -> Node:
    return Node.table(name, read(spark, sf_dir, name), key, **{"unique": True, "dense": True} | known)


#: Parent column and child node of the star schema, in both directions of use.
STAR = ["lineitem.l_orderkey @ orders.o_orderkey", "lineitem.l_partkey @ part.p_partkey", "lineitem.l_suppkey @ supplier.s_suppkey", "orders.o_custkey @ customer.c_custkey", "customer.c_nationkey @ nation.n_nationkey", "nation.n_regionkey @ region.r_regionkey", "supplier.s_nationkey @ s_nation.n_nationkey"]


def star(spark: SparkSession, sf_dir: str, root: str = "lineitem", *, links: tuple = (), nodes: Mapping[str, Node] | None = None, **options: Any) -> Tree:
    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "supplier": "s_suppkey"}
    made = {n: node(spark, sf_dir, n, k) for n, k in keys.items() if root == "lineitem" or n not in ("lineitem", "part", "supplier")}
    if root == "lineitem":
        made["s_nation"] = node(spark, sf_dir, "nation", "n_nationkey")
    if root == "customer":
        made.pop("orders")
    made = {root: made.pop(root), **made, **(nodes or {})}
    have = [r for r in STAR if all(x.split(".")[0].strip() in made for x in r.split(" @ "))]
    return Tree(root, relationships=[*have, *links], **{"complete": True} | options, **made)


def skims(spark: SparkSession, sf_dir: str, name: str = "skims") -> Node:
    """Nation by nation distances, and times by order priority as well: asymmetric, so directions show."""
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    a, b = n.select(F.col("n_nationkey").alias("o")), n.select(F.col("n_nationkey").alias("d"))
    two = a.crossJoin(b).withColumn("DIST", F.abs(F.col("o") - F.col("d")) * 0.5 + F.col("o") % 7 * 0.125)
    p = F.explode(F.array(*[F.struct(F.lit(x).alias("period"), F.lit(i + 1).alias("k")) for i, x in enumerate(PRIORITIES)]))
    three = two.select("o", "d", "DIST", p.alias("p")).select("o", "d", "p.period", (F.col("DIST") * (1 + F.col("p.k") * 0.25)).alias("TIME"))
    return Node.tensor(name, (("o", "d"), two), (("o", "d", "period"), three), unique=True)


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_DIST = "(abs(a.n_nationkey - b.n_nationkey) * 0.5 + a.n_nationkey % 7 * 0.125)"
SKIM_SQL = f"(select a.n_nationkey o, b.n_nationkey d, cast({_DIST} as double) DIST from nation a cross join nation b)"
TIME_SQL = f"(select s.o, s.d, p.period, s.DIST * (1 + p.k * 0.25) TIME_ from {SKIM_SQL} s cross join (values " + ", ".join(f"('{x}', {i + 1})" for i, x in enumerate(PRIORITIES)) + ") p(period, k))"
STAR_SQL = """lineitem l left join orders o on l_orderkey = o_orderkey left join customer c on o_custkey = c_custkey left join nation n on c_nationkey = n.n_nationkey
 left join region r on n.n_regionkey = r_regionkey left join supplier s on l_suppkey = s_suppkey left join nation sn on s_nationkey = sn.n_nationkey left join part p on l_partkey = p_partkey"""
ORDERS_SQL = "orders o left join customer c on o_custkey = c_custkey left join nation n on c_nationkey = n.n_nationkey left join region r on n.n_regionkey = r_regionkey"
SKIM_LINKS = ("customer.c_nationkey @ skims.o", "supplier.s_nationkey @ skims.d", "orders.o_orderpriority @ skims.period")


def rounded(df: DataFrame) -> DataFrame:
    """Floats to six places as ``r6`` has them, so that sums in another order compare equal; infinities and NaN stay."""
    six = lambda c: F.when(F.abs(c) < 1e12, F.floor(c * 1e6 + 0.5) / 1e6).otherwise((c * 1e6 + 0.5) / 1e6)  # noqa: E731  from 1e12 on, what floor gets is whole
    return df.select(*[six(F.col(x.name)).alias(x.name) if isinstance(x.dataType, (T.FloatType, T.DoubleType)) else F.col(x.name) for x in df.schema])


def r6(sql: str) -> str:
    return f"floor(({sql}) * 1e6 + 0.5) / 1e6"


# --- lookups ---------------------------------------------------------------------------------------------------


@query(f"""select l_orderkey, {r6("l_extendedprice * (1 - l_discount)")} net, case when o_totalprice > 100000 then 1.0 else 0.0 end big, {r6("greatest(least(c_acctbal, 5000), 0)")} bal from {STAR_SQL}""")
def flow_load_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star(spark, sf_dir)
    return rounded(t.setup_flow({"net": "l_extendedprice * (1 - l_discount)", "big": "np.where(o_totalprice > 100000, 1, 0)", "bal": "customer.c_acctbal.clip(0, 5000)"}, dtype="float64").load())


@query(f"select l_orderkey, {r6('l_extendedprice * (1 - l_discount)')} net, {r6('o_totalprice')} price, {r6('c_acctbal')} bal from {STAR_SQL}")
def flow_load_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups without any promise: labels are made unique, and keys without a match would take the first row."""
    bare = {n: Node.table(n, read(spark, sf_dir, n), k) for n, k in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("customer", "c_custkey"))}
    t = Tree("lineitem", relationships=["lineitem.l_orderkey @ orders.o_orderkey", "orders.o_custkey @ customer.c_custkey"], **bare)
    return rounded(t.setup_flow({"net": "l_extendedprice * (1 - l_discount)", "price": "orders.o_totalprice", "bal": "customer.c_acctbal"}, dtype="float64").load())


@query(f"select l_orderkey, n.n_name nation, r_name region, {r6('c_acctbal')} bal from {STAR_SQL}")
def flow_chain_snowflake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(star(spark, sf_dir).setup_flow({"nation": "nation.n_name", "region": "r_name", "bal": "c_acctbal"}, dtype=None).load())


@query(f"select l_orderkey, n.n_name cust, sn.n_name supp, n.n_nationkey = sn.n_nationkey same from {STAR_SQL}")
def flow_role_playing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).setup_flow({"cust": "nation.n_name", "supp": "s_nation.n_name", "same": "nation.n_nationkey == s_nation.n_nationkey"}, dtype=None).load()


@query(f"select o_orderkey, {r6('c_acctbal')} bal, c_mktsegment seg from {ORDERS_SQL}")
def flow_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = node(spark, sf_dir, "customer", "c_custkey", dense=False)
    t = Tree("orders", relationships=["orders.o_custkey -> customer.c_custkey"], complete=True, orders=node(spark, sf_dir, "orders", "o_orderkey"), customer=c)
    return rounded(t.setup_flow({"bal": "c_acctbal", "seg": "c_mktsegment"}, dtype=None).load())


_FEW = "(select * from customer where c_custkey % 3 <> 1)"


@query(f"select o_orderkey, {r6('coalesce(c.c_acctbal, f.c_acctbal)')} bal from orders left join {_FEW} c on o_custkey = c_custkey cross join (select c_acctbal from {_FEW} order by c_custkey limit 1) f")
def flow_miss_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_missing(spark, sf_dir, "first"))


@query(f"select o_orderkey, {r6('c_acctbal')} bal from orders left join {_FEW} c on o_custkey = c_custkey")
def flow_miss_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_missing(spark, sf_dir, "null"))


def _missing(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    c = node(spark, sf_dir, "customer", "c_custkey", dense=False).where("c_custkey % 3 <> 1")
    t = Tree("orders", relationships=["orders.o_custkey @ customer.c_custkey"], on_missing=policy, orders=node(spark, sf_dir, "orders", "o_orderkey"), customer=c)
    return t.setup_flow({"bal": "customer.c_acctbal"}, dtype=None).load()


@query(f"select o_orderkey, {r6('c_acctbal + case when c_custkey % 2 = 0 then 1 else 0 end')} bal from orders left join customer c on o_custkey = c_custkey")
def flow_dup_label_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("at"))
    later = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("at"))
    twice = Node.table("customer", c.unionByName(later), "c_custkey", order={"c_custkey": "at"})
    t = Tree("orders", relationships=["orders.o_custkey @ customer.c_custkey"], complete=True, orders=node(spark, sf_dir, "orders", "o_orderkey"), customer=twice)
    return rounded(t.setup_flow({"bal": "customer.c_acctbal"}, dtype=None).load())


def _skim_flow(spark: SparkSession, sf_dir: str, definitions: Mapping[str, str], links: tuple = SKIM_LINKS) -> DataFrame:
    return rounded(star(spark, sf_dir, links=links, nodes={"skims": skims(spark, sf_dir)}).setup_flow(definitions, dtype="float64").load())


@query(f"select l_orderkey, {r6('DIST')} dist, {r6('TIME_')} time from {STAR_SQL} left join {TIME_SQL} k on k.o = c_nationkey and k.d = s_nationkey and k.period = o_orderpriority left join {SKIM_SQL} x on x.o = c_nationkey and x.d = s_nationkey")
def skim_lookup_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skim_flow(spark, sf_dir, {"dist": "skims.DIST", "time": "skims.TIME"})


@query(f"select l_orderkey, {r6('TIME_')} time from {STAR_SQL} left join {TIME_SQL} k on k.o = c_nationkey and k.d = s_nationkey and k.period = '2-HIGH'")
def skim_const_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skim_flow(spark, sf_dir, {"time": "skims['TIME', '2-HIGH']"}, SKIM_LINKS[:2])


@query(f"select l_orderkey, {r6('DIST')} back from {STAR_SQL} left join {SKIM_SQL} x on x.o = s_nationkey and x.d = c_nationkey")
def skim_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skim_flow(spark, sf_dir, {"back": "skims.reverse('DIST')"})


@query(f"select l_orderkey, {r6('greatest(x.DIST, y.DIST)')} far from {STAR_SQL} left join {SKIM_SQL} x on x.o = c_nationkey and x.d = s_nationkey left join {SKIM_SQL} y on y.o = s_nationkey and y.d = c_nationkey")
def skim_bimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skim_flow(spark, sf_dir, {"far": "skims.max('DIST')"})


# --- expressions -----------------------------------------------------------------------------------------------


def expressions(name: str, cells: Mapping[str, tuple[str, str]], *, dtype: str | None = "float64", **options: Any) -> None:
    """Registers a query of expressions over orders and what hangs on them; each with its SQL."""
    kept = r6 if dtype == "float64" else str
    sql = f"select o_orderkey, {', '.join(f'{kept(s)} {c}' for c, (_, s) in cells.items())} from {ORDERS_SQL}"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(star(spark, sf_dir, "orders", **options).setup_flow({c: e for c, (e, _) in cells.items()}, dtype=dtype).load())

    f.__name__ = name
    query(sql)(f)


expressions("expr_div_zero", {"a": ("o_totalprice / (c_nationkey - 3)", "o_totalprice / (c_nationkey - 3)"), "b": ("-1 / (n_regionkey * 0)", "-1 / (n_regionkey * 0)"), "c": ("o_orderkey / 7", "o_orderkey / 7")})
expressions("expr_floor_mod", {"a": ("(o_orderkey - 500) // 7", "floor((o_orderkey - 500) / 7.0)"), "b": ("(o_orderkey - 500) % 7", "(o_orderkey - 500) - 7 * floor((o_orderkey - 500) / 7.0)"), "c": ("(o_orderkey - 500) % -7", "(o_orderkey - 500) + 7 * floor((o_orderkey - 500) / -7.0)")})
expressions("expr_pow", {"a": ("n_regionkey ** 2", "pow(n.n_regionkey, 2)"), "b": ("np.power(c_nationkey, 0.5)", "pow(c_nationkey, 0.5)")})
expressions("expr_compare_chain", {"a": ("0 <= c_acctbal < 5000", "case when c_acctbal >= 0 and c_acctbal < 5000 then 1.0 else 0.0 end"), "b": ("c_acctbal > 100 and not o_totalprice < 50000", "case when c_acctbal > 100 and not o_totalprice < 50000 then 1.0 else 0.0 end")})
expressions("expr_where_nested", {"a": ("np.where(c_acctbal > 5000, 2, np.where(c_acctbal > 0, 1, 0))", "case when c_acctbal > 5000 then 2 when c_acctbal > 0 then 1 else 0 end"), "b": ("c_acctbal if o_orderstatus == 'F' else -1", "case when o_orderstatus = 'F' then c_acctbal else -1 end")})
expressions("expr_clip_variants", {"a": ("c_acctbal.clip(100)", "greatest(c_acctbal, 100)"), "b": ("c_acctbal.clip(upper=5000)", "least(c_acctbal, 5000)"), "c": ("np.clip(c_acctbal, 100, 5000)", "greatest(least(c_acctbal, 5000), 100)"), "d": ("clip(c_acctbal, 900, 10)", "greatest(least(c_acctbal, 10), 900)")})
expressions("expr_piece", {"a": ("piece(c_acctbal, None, 1000)", "least(c_acctbal, 1000)"), "b": ("piece(c_acctbal, 1000, 3000)", "greatest(least(c_acctbal, 3000), 1000) - 1000"), "c": ("piece(c_acctbal, 3000, None)", "greatest(c_acctbal, 3000) - 3000")})
expressions("expr_hard_sigmoid", {"a": ("hard_sigmoid(c_acctbal, 0, 1000)", "greatest(least(c_acctbal / 1000, 1), 0)"), "b": ("hard_sigmoid(c_acctbal, 1000, 0)", "greatest(least((c_acctbal - 1000) / -1000, 1), 0)")})
expressions("expr_minmax", {"a": ("max(c_acctbal, 1000)", "greatest(c_acctbal, 1000)"), "b": ("min(c_acctbal, o_totalprice / 100)", "least(c_acctbal, o_totalprice / 100)")})
expressions("expr_isin", {"a": ("c_nationkey.isin([1, 2, 3])", "case when c_nationkey in (1, 2, 3) then 1.0 else 0.0 end"), "b": ("o_orderstatus.isin(('F', 'O'))", "case when o_orderstatus in ('F', 'O') then 1.0 else 0.0 end")})
expressions("expr_between", {"a": ("c_acctbal.between(0, 1000)", "case when c_acctbal between 0 and 1000 then 1.0 else 0.0 end")})
expressions("expr_isna", {"a": ("(c_acctbal / (c_nationkey - 3) * 0).isna()", "case when c_nationkey = 3 then 1.0 else 0.0 end"), "b": ("o_orderstatus.isna()", "0.0")})
expressions("expr_bitwise", {"a": ("o_orderkey & 12", "o_orderkey & 12"), "b": ("o_orderkey | 3", "o_orderkey | 3"), "c": ("o_orderkey ^ 5", "xor(o_orderkey, 5)"), "d": ("~o_orderkey", "~o_orderkey")}, dtype=None)
expressions("expr_bool_wrap", {"a": ("(c_acctbal > 0) & (c_nationkey > 5)", "case when c_acctbal > 0 and c_nationkey > 5 then 1.0 else 0.0 end"), "b": ("(c_acctbal > 0) ^ (c_nationkey > 5)", "case when (c_acctbal > 0) <> (c_nationkey > 5) then 1.0 else 0.0 end"), "c": ("(c_acctbal > 0) * 2 + (c_nationkey > 5)", "case when c_acctbal > 0 then 2.0 else 0.0 end + case when c_nationkey > 5 then 1 else 0 end")})
expressions("expr_log_family", {"a": ("log(o_totalprice)", "ln(o_totalprice)"), "b": ("np.exp(n_regionkey)", "exp(n.n_regionkey)"), "c": ("log(n_regionkey)", "case when n.n_regionkey = 0 then cast('-inf' as double) else ln(n.n_regionkey + case when n.n_regionkey = 0 then 1 else 0 end) end"), "d": ("np.sqrt(c_nationkey)", "sqrt(c_nationkey)")})
expressions("expr_astype", {"a": ("c_acctbal.astype(int)", "cast(trunc(c_acctbal) as bigint)"), "b": ("(-c_acctbal).astype('int32') * 1", "cast(trunc(-c_acctbal) as bigint)")})
expressions("expr_get_default", {"a": ("customer.get('c_acctbal')", "c_acctbal"), "b": ("customer.get('no_such', 7)", "7"), "c": ("orders.get('nothing', default=o_totalprice)", "o_totalprice")})
expressions("expr_fallback_space", {"a": ("payer.c_acctbal", "c_acctbal"), "b": ("payer.n_regionkey", "n.n_regionkey")}, subspace_fallbacks={"payer": ["customer", "nation"]})
expressions("expr_output_reuse", {"a": ("o_totalprice / 1000", "o_totalprice / 1000"), "b": ("a * 2 + 1", "o_totalprice / 1000 * 2 + 1"), "c": ("b - a", "o_totalprice / 1000 * 2 + 1 - o_totalprice / 1000")})
expressions("expr_override_marker", {"a": ("df.something_else  # flow: c_acctbal + 1", "c_acctbal + 1"), "b": ("c_acctbal + 2  # note: adds two", "c_acctbal + 2"), "c": ("where(c_mktsegment == '# flow: 1', 1, 2)", "2.0")})
expressions("expr_ufuncs", {"a": ("np.log10(c_acctbal + 1000)", "log10(c_acctbal + 1000)"), "b": ("np.log2(c_acctbal + 1000)", "log2(c_acctbal + 1000)"), "c": ("np.hypot(c_acctbal, n_regionkey)", "sqrt(c_acctbal * c_acctbal + n.n_regionkey * n.n_regionkey)"), "d": ("np.arctan2(c_acctbal, 3 + n_regionkey)", "atan2(c_acctbal, 3 + n.n_regionkey)"), "e": ("np.logaddexp(c_acctbal / 1000, 1)", "ln(exp(c_acctbal / 1000) + exp(1))"), "f": ("np.trunc(c_acctbal / 7)", "trunc(c_acctbal / 7)"), "g": ("np.floor_divide(c_nationkey, 3)", "cast(c_nationkey // 3 as double)"), "h": ("np.mod(c_nationkey, 3)", "cast(c_nationkey % 3 as double)")})
expressions("expr_extra_aux_vars", {"a": ("c_acctbal * rate + steps[2] + levels[1]", "c_acctbal * 0.5 + 30000 + 20"), "b": ("c_nationkey.isin(wanted)", "case when c_nationkey in (2, 4) then 1.0 else 0.0 end"), "c": ("steps[n_regionkey]", "case n.n_regionkey when 0 then 10000 when 1 then 20000 when 2 then 30000 end")}, extra_vars={"rate": 0.5, "wanted": [2, 4]}, aux_vars={"steps": {0: 10000, 1: 20000, 2: 30000}, "levels": [10, 20]})
expressions("expr_extra_func", {"a": ("double_it(c_acctbal) + 1", "c_acctbal * 2 + 1"), "b": ("c_acctbal.apply(plus, by=n_regionkey)", "c_acctbal + n.n_regionkey")}, extra_funcs={"double_it": lambda x: x * 2, "plus": lambda x, by: x + by})


@query("select o_orderkey, case when k = 'F' then 1.0 else 0.0 end eq, case when k is null or k <> 'F' then 1.0 else 0.0 end ne, 0.0 bad, 2.0 notbad, case when k is null then 1.0 else 0.0 end na from (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderstatus end k from orders)")
def cat_eq_ne_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("k"))
    t = Tree("orders", orders=Node.table("orders", o, "o_orderkey", categories={"k": ("F", "O", "P")}))
    return t.setup_flow({"eq": "k == 'F'", "ne": "k != 'F'", "bad": "k == 'BAD'", "notbad": "(k != 'BAD') * 2", "na": "k.isna()"}, dtype="float64").load()


class Status(IntEnum):
    F = 1
    O = 2  # noqa: E741
    P = 4


@query("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 when 'P' then 4 end status from orders")
def int_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.as_int_enum(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "status", Status)


@query(f"select o_orderkey, case when o_totalprice > 100000 then {r6('c_acctbal')} else cast('nan' as double) end bal from {ORDERS_SQL}")
def mask_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star(spark, sf_dir, "orders")
    return rounded(t.setup_flow({"bal": "c_acctbal"}, dtype="float64").load(mask=F.col("__root_o_totalprice") > 100000))


# --- utilities and choices -------------------------------------------------------------------------------------

MODES = {"CAR": {"price": -0.00001, "bal": 0.0001, "one": 0.5}, "BUS": {"bal": -0.0001, "seg": 0.3}, "WALK": {"price": -0.00002, "seg": -0.2, "one": 1.0}}
_DEFS = {"price": "o_totalprice", "bal": "c_acctbal", "seg": "c_mktsegment == 'BUILDING'", "one": "1"}
_SEG = "case when c_mktsegment = 'BUILDING' then 1 else 0 end"
_U = f"select o_orderkey, -0.00001 * o_totalprice + 0.0001 * c_acctbal + 0.5 u0, -0.0001 * c_acctbal + 0.3 * {_SEG} u1, -0.00002 * o_totalprice - 0.2 * {_SEG} + 1.0 u2 from {ORDERS_SQL}"
_E = f"select *, exp(u0 - m) e0, exp(u1 - m) e1, exp(u2 - m) e2 from (select *, greatest(u0, u1, u2) m from ({_U}))"
_P = f"select *, e0 / (e0 + e1 + e2) p0, e1 / (e0 + e1 + e2) p1, e2 / (e0 + e1 + e2) p2, ln(e0 + e1 + e2) + m ls from ({_E})"


def _draw(ix: int) -> str:
    """Draws by integer arithmetic: the same in both engines."""
    return f"((o_orderkey * 7919 + {ix} * 104729 + 12345) % 1000003) / 1000003.0"


def _orders_flow(spark: SparkSession, sf_dir: str) -> Flow:
    return star(spark, sf_dir, "orders").setup_flow(_DEFS, dtype="float64")


def _draws(n: int) -> list:
    return [F.expr(_draw(i).replace("o_orderkey", "`__root_o_orderkey`")).cast("double") for i in range(n)]


def _pick(r: str) -> str:
    return f"case when p0 > {r} then 0 when p0 + p1 > {r} then 1 else 2 end"


@query(f"select o_orderkey, {r6('u0')} CAR, {r6('u1')} BUS, {r6('u2')} WALK from ({_U})")
def flow_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_orders_flow(spark, sf_dir).dot(MODES))


@query(f"select o_orderkey, {r6('p0')} p_CAR, {r6('p1')} p_BUS, {r6('p2')} p_WALK, {r6('ls')} logsum from ({_P})")
def mnl_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_orders_flow(spark, sf_dir).logit_draws(MODES, _draws(1), probabilities=True, logsums=2).drop("choice_0", "prob_0"))


@query(f"select o_orderkey, {r6('ls')} logsum from ({_P})")
def mnl_logsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_orders_flow(spark, sf_dir).logit_draws(MODES, logsums=1))


@query(f"select o_orderkey, {_pick(_draw(0))} choice_0, {r6(f'case {_pick(_draw(0))} when 0 then p0 when 1 then p1 else p2 end')} prob_0 from ({_P})")
def mnl_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_orders_flow(spark, sf_dir).logit_draws(MODES, _draws(1)))


@query(f"select o_orderkey, {_pick(_draw(0))} choice_0, {_pick(_draw(1))} choice_1, {_pick(_draw(2))} choice_2 from ({_P})")
def mnl_multi_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_flow(spark, sf_dir).logit_draws(MODES, _draws(3)).select("o_orderkey", "choice_0", "choice_1", "choice_2")


@query(f"select o_orderkey, choice, cast(count(*) as integer) pick_count from (select o_orderkey, unnest([{', '.join(_pick(_draw(i)) for i in range(5))}]) choice from ({_P})) group by all")
def mnl_pick_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_flow(spark, sf_dir).logit_draws(MODES, _draws(5), pick_counted=True).drop("prob")


@query(f"select p.o_orderkey, case when o_totalprice > 100000 then {_pick(_draw(0)).replace('o_orderkey', 'p.o_orderkey')} else -1 end choice_0, case when o_totalprice > 100000 then {r6('ls')} else 0.0 end logsum from ({_P}) p join orders o on p.o_orderkey = o.o_orderkey")
def mnl_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_orders_flow(spark, sf_dir).logit_draws(MODES, _draws(1), logsums=2, mask=F.col("__root_o_totalprice") > 100000).drop("prob_0"))


NESTS = {"name": "root", "coefficient": 1.0, "alternatives": [{"name": "MOTOR", "coefficient": 0.5, "alternatives": ["CAR", "BUS"]}, "WALK"]}
_NM = f"select *, greatest(u0, u1) + 0.5 * ln(exp((u0 - greatest(u0, u1)) / 0.5) + exp((u1 - greatest(u0, u1)) / 0.5)) um from ({_U})"
_NR = f"select *, greatest(um, u2) + ln(exp(um - greatest(um, u2)) + exp(u2 - greatest(um, u2))) ls from ({_NM})"
_NP = f"select *, exp(um - ls) * exp((u0 - um) / 0.5) p0, exp(um - ls) * exp((u1 - um) / 0.5) p1, exp(u2 - ls) p2 from ({_NR})"


def _nested(spark: SparkSession, sf_dir: str, **options: Any) -> DataFrame:
    return rounded(_orders_flow(spark, sf_dir).logit_draws(MODES, _draws(1), nesting=construct_nesting_tree(list(MODES), NESTS), **options))


@query(f"select o_orderkey, {r6('p0')} p_CAR, {r6('p1')} p_BUS, {r6('p2')} p_WALK from ({_NP})")
def nl_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir, probabilities=True).drop("choice_0", "prob_0")


@query(f"select o_orderkey, {r6('ls')} logsum from ({_NP})")
def nl_logsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir, logsums=1)


@query(f"select o_orderkey, {_pick(_draw(0))} choice_0 from ({_NP})")
def nl_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).drop("prob_0")


# --- two-dimensional roots -------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> Tree:
    """Every customer by every nation."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("alt"))
    root = Node.product("cells", ("c_custkey", c), ("alt", n))
    links = ["cells.c_custkey @ customer.c_custkey", "cells.alt @ nation.n_nationkey", "customer.c_nationkey @ skims.o", "cells.alt @ skims.d"]
    return Tree("cells", relationships=links, complete=True, cells=root, customer=node(spark, sf_dir, "customer", "c_custkey"), nation=node(spark, sf_dir, "nation", "n_nationkey"), skims=skims(spark, sf_dir))


_CELL_DEFS = {"dist": "skims.DIST", "far": "skims.DIST > 5", "reg": "n_regionkey"}
_CELL_B = {"dist": -0.2, "far": -0.5, "reg": 0.1}
_CELL_SQL = f"select c_custkey, n_nationkey alt, -0.2 * DIST - 0.5 * case when DIST > 5 then 1 else 0 end + 0.1 * n_regionkey u from customer cross join nation join {SKIM_SQL} x on x.o = c_nationkey and x.d = n_nationkey"
_CELL_P = f"select *, exp(u - m) / sum(exp(u - m)) over (partition by c_custkey) p, ln(sum(exp(u - m)) over (partition by c_custkey)) + m ls from (select *, max(u) over (partition by c_custkey) m from ({_CELL_SQL}))"


@query(f"select c_custkey, alt, {r6('DIST')} dist, n_regionkey * 1.0 reg from customer cross join (select *, n_nationkey alt from nation) join {SKIM_SQL} x on x.o = c_nationkey and x.d = alt")
def flow_cross_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir).setup_flow({"dist": "skims.DIST", "reg": "n_regionkey"}, dtype="float64").load())


@query(f"select c_custkey, alt, {r6('u')} dot from ({_CELL_SQL})")
def flow_dot_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir).setup_flow(_CELL_DEFS, dtype="float64").dot(_CELL_B))


@query(f"select distinct c_custkey, {r6('ls')} logsum from ({_CELL_P})")
def mnl_idca_logsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir).setup_flow(_CELL_DEFS, dtype="float64").logit_draws(_CELL_B, logsums=1))


_CUM = f"select *, sum(p) over (partition by c_custkey order by alt rows unbounded preceding) cum from ({_CELL_P})"
_R = "((c_custkey * 7919 + i * 104729 + 12345) % 1000003) / 1000003.0"


@query(f"select c_custkey, cast(i as integer) draw, cast(min(alt) as integer) choice from ({_CUM}) cross join range(10) t(i) where cum > {_R} group by all")
def mnl_idca_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = [F.expr(_R.replace("c_custkey", "`__root_c_custkey`").replace(" i ", f" {i} ")).cast("double") for i in range(10)]
    return _cells(spark, sf_dir).setup_flow(_CELL_DEFS, dtype="float64").logit_draws(_CELL_B, draws).select("c_custkey", F.col("draw").cast("int").alias("draw"), "choice")


_MASKED = f"select *, exp(u) / sum(exp(u)) over (partition by c_custkey) p from ({_CELL_SQL}) where alt % 2 = 0 and c_custkey % 3 > 0"
_MASKED_CUM = f"select *, sum(p) over (partition by c_custkey order by alt rows unbounded preceding) cum from ({_MASKED})"


@query(f"select c_custkey, cast(i as integer) draw, cast(min(alt) as integer) choice from ({_MASKED_CUM}) cross join range(3) t(i) where cum > {_R} group by all union all select c_custkey, cast(i as integer), -1 from customer cross join range(3) t(i) where c_custkey % 3 = 0")
def mnl_idca_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the alternatives are masked, and of every third customer all."""
    draws = [F.expr(_R.replace("c_custkey", "`__root_c_custkey`").replace(" i ", f" {i} ")).cast("double") for i in range(3)]
    mask = (F.col("__root_alt") % 2 == 0) & (F.col("__root_c_custkey") % 3 > 0)
    return _cells(spark, sf_dir).setup_flow(_CELL_DEFS, dtype="float64").logit_draws(_CELL_B, draws, mask=mask).select("c_custkey", F.col("draw").cast("int").alias("draw"), F.col("choice").cast("int").alias("choice"))


@query(f"select c_custkey, alt, {r6('ln(exp(u) + exp(0.5 * u))')} logsum from ({_CELL_SQL})")
def mnl_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {"A": _CELL_B, "B": {k: v / 2 for k, v in _CELL_B.items()}}
    return rounded(_cells(spark, sf_dir).setup_flow(_CELL_DEFS, dtype="float64").logit_draws(both, logsums=1, wide=True))


# --- point lookups, blending, encodings ------------------------------------------------------------------------


@query(f"select c_custkey, o, d, {r6('DIST')} DIST from (select c_custkey, c_nationkey o, cast(c_custkey % 25 as integer) d from customer) c join {SKIM_SQL} x using (o, d)")
def lookup_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("o"), (F.col("c_custkey") % 25).cast("int").alias("d"))
    return rounded(lookup.at(skims(spark, sf_dir), "DIST", points, o="o", d="d"))


@query(f"select c_custkey, {r6('DIST')} x_DIST from (select c_custkey, c_nationkey o, cast(c_custkey % 25 as integer) d from customer) c join {SKIM_SQL} x using (o, d)")
def lookup_iat(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("o"), (F.col("c_custkey") % 25).cast("int").alias("d"))
    return rounded(lookup.iat(skims(spark, sf_dir), "DIST", points, append="x_", o="o", d="d").drop("o", "d"))


@query(f"select c_custkey, {r6('DIST')} DIST from (select c_custkey, c_nationkey d, cast(c_custkey % 25 as integer) o from customer) c join {SKIM_SQL} x using (o, d)")
def wrapper_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 25).cast("int").alias("to"))
    return rounded(lookup.DatasetWrapper(skims(spark, sf_dir), "c_nationkey", "to").set_df(points).lookup("DIST", reverse=True).select("c_custkey", "DIST"))


_SPARSE = "(select o_custkey i, cast(o_orderkey % 100 as bigint) j, cast(sum(0.001 * (o_orderkey % 997)) as double) v from orders where o_orderkey % 3 = 0 group by all)"


def _blended(spark: SparkSession, sf_dir: str, limit: float | None, definition: str) -> DataFrame:
    """Trips between customers (fine) and suppliers (fine), with nations as coarse zones."""
    o = read(spark, sf_dir, "orders")
    cells = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("i"), (F.col("o_orderkey") % 100).alias("j"), (0.001 * (F.col("o_orderkey") % 997)).alias("v"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fine"), F.col("c_nationkey").alias("coarse"))
    n = skims(spark, sf_dir).redirected(c, "fine", "coarse", o="oc", d="dc").with_blend("DIST", cells, "i", "j", "v", ("oc", "dc"), limit)
    trips = Node.table("trips", o.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("to")), "o_orderkey", unique=True)
    t = Tree("trips", relationships=["trips.o_custkey @ skims.oc", "trips.to @ skims.dc"], complete=True, trips=trips, skims=n)
    return rounded(t.setup_flow({"dist": definition}, dtype="float64").load())


_TRIPS = f"(select o_orderkey, o_custkey, o_orderkey % 100 t from orders) q join customer a on o_custkey = a.c_custkey join customer b on t = b.c_custkey left join {_SPARSE} s on s.i = o_custkey and s.j = t"


@query(f"select o_orderkey, {r6('case when s.v is null or s.v > 0.5 then DIST else s.v / 0.5 * DIST + (1 - s.v / 0.5) * s.v end')} dist from {_TRIPS} join {SKIM_SQL} x on x.o = a.c_nationkey and x.d = b.c_nationkey")
def sparse_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, 0.5, "skims.DIST")


@query(f"select o_orderkey, {r6('coalesce(s.v, DIST)')} dist from {_TRIPS} join {SKIM_SQL} x on x.o = a.c_nationkey and x.d = b.c_nationkey")
def sparse_blend_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, None, "skims.DIST")


@query(f"select o_orderkey, {r6('case when s.v is null or s.v > 0.5 then DIST else s.v / 0.5 * DIST + (1 - s.v / 0.5) * s.v end')} dist from {_TRIPS.replace('s.i = o_custkey and s.j = t', 's.i = t and s.j = o_custkey')} join {SKIM_SQL} x on x.o = b.c_nationkey and x.d = a.c_nationkey")
def sparse_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, 0.5, "skims.reverse('DIST')")


@query("select o_orderkey, cast(trunc((o_totalprice - 0) / 10.0) as integer) code, trunc(o_totalprice / 10.0) * 10.0 value from orders")
def enc_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("code"))
    coded = encoding.fixed_point(df, "code", bitwidth=32, scale=10.0, offset=0.0)
    e = encoding.Encoding.of(coded, "code")
    return coded.select("o_orderkey", "code", encoding.decoded(F.col("code"), e).alias("value"))


@query("select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as smallint) code, o_orderpriority value from orders")
def enc_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoding.by_dictionary(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("code")), "code")
    return coded.select("o_orderkey", "code", encoding.decoded(F.col("code"), encoding.Encoding.of(coded, "code")).alias("value"))


@query("select o_orderkey, cast(dense_rank() over (order by o_orderstatus, o_orderpriority) - 1 as integer) both_offsets, o_orderstatus, o_orderpriority from orders")
def enc_joint_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    coded, table = encoding.joint_dictionary(df, ["o_orderstatus", "o_orderpriority"], "both")
    return coded.join(table, "both_offsets").select("o_orderkey", "both_offsets", "o_orderstatus", "o_orderpriority")


@query()
def enc_smash_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.by_dictionary(read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("code")), "code", bitwidth=4)


@query("select p_partkey, cast(case when p_size < 10.5 then 0 when p_size < 25.5 then 1 when p_size < 40.5 then 2 else 3 end as smallint) code, case when p_size < 10.5 then 1 when p_size < 25.5 then 20 when p_size < 40.5 then 31 else 50 end as value from part")
def enc_dict_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of four given values."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("code"))
    coded = encoding.by_dictionary(df, "code", bitwidth=2, values=[1, 20, 31, 50])
    return coded.select("p_partkey", "code", encoding.decoded(F.col("code"), encoding.Encoding.of(coded, "code")).alias("value"))


def _encoded_orders(spark: SparkSession, sf_dir: str, coded: Node, definitions: Mapping[str, str]) -> DataFrame:
    t = Tree("lineitem", relationships=["lineitem.l_orderkey @ orders.o_orderkey"], complete=True, lineitem=node(spark, sf_dir, "lineitem", "l_orderkey"), orders=coded)
    return rounded(t.setup_flow(definitions, dtype="float64").load())


@query(f"select l_orderkey, {r6('2 * trunc(o_totalprice / 10.0) * 10.0')} twice, case when trunc(o_totalprice / 10.0) * 10.0 > 200000 then 1.0 else 0.0 end dear from lineitem join orders on l_orderkey = o_orderkey")
def flow_fixed_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point codes are decoded where a flow uses them."""
    coded = encoding.fixed_point(read(spark, sf_dir, "orders"), "o_totalprice", bitwidth=32, scale=10.0, offset=0.0)
    return _encoded_orders(spark, sf_dir, Node.table("orders", coded, "o_orderkey", unique=True, dense=True), {"twice": "orders.o_totalprice * 2", "dear": "orders.o_totalprice > 200000"})


@query("select l_orderkey, case when o_orderpriority = '2-HIGH' then 1.0 else 0.0 end high, case when o_orderstatus in ('F', 'P') then 1.0 else 0.0 end shut from lineitem join orders on l_orderkey = o_orderkey")
def flow_dict_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of dictionaries are decoded where a flow uses them."""
    coded = encoding.by_dictionary(encoding.by_dictionary(read(spark, sf_dir, "orders"), "o_orderpriority"), "o_orderstatus", bitwidth=2)
    return _encoded_orders(spark, sf_dir, Node.table("orders", coded, "o_orderkey", unique=True, dense=True), {"high": "orders.o_orderpriority == '2-HIGH'", "shut": "orders.o_orderstatus.isin(['F', 'P'])"})


@query("select l_orderkey, case when o_orderpriority = '2-HIGH' and o_orderstatus <> 'F' then 1.0 else 0.0 end openhigh, cast(o_orderkey % 7 as double) wk from lineitem join orders on l_orderkey = o_orderkey")
def flow_joint_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of a joint dictionary come from its table, joined once."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 7).alias("week"))
    coded, table = encoding.joint_dictionary(df, ["o_orderpriority", "o_orderstatus", "week"], "three")
    orders = Node.table("orders", coded, "o_orderkey", unique=True, dense=True).with_joint("three", table)
    return _encoded_orders(spark, sf_dir, orders, {"openhigh": "(orders.o_orderpriority == '2-HIGH') & (orders.o_orderstatus != 'F')", "wk": "orders.week"})


# --- tables, specs, files --------------------------------------------------------------------------------------


@query(f"select c_custkey o, n_nationkey d, period, {r6('c_custkey * 10 + n_nationkey + v')} TIME from customer cross join nation cross join (values ('AM', 0.0), ('PM', 0.5)) p(period, v)")
def parquet3d_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.scratch import scratch_path

    o = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o")).crossJoin(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d")))
    path = scratch_path(spark, "wide")
    o.select("o", "d", (F.col("o") * 10 + F.col("d")).cast("double").alias("TIME__AM"), (F.col("o") * 10 + F.col("d") + 0.5).alias("TIME__PM"), F.lit(1.0).alias("IGNORED")).write.parquet(path)
    n = from_parquet_3d(spark, path, ("o", "d", "period"), time_periods=("AM", "PM"), ignore="IGN", max_float_precision=64)
    return rounded(next(f.df for f in n.frames if "period" in f.dims))


@query("select n_nationkey k, n_name v from nation union all select r_regionkey, r_name from region")
def table_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_tables([read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))])


@query("select c_custkey, c_acctbal + 1 c_acctbal, c_mktsegment from customer")
def table_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    a = Table(c.select("c_custkey", "c_acctbal", "c_mktsegment"), by="c_custkey")
    b = Table(c.select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")), by="c_custkey")
    return (a | b).to_df().select("c_custkey", "c_acctbal", "c_mktsegment")


@query(f"select c_custkey, {r6('greatest(c_acctbal, 100) / 2')} half from customer")
def table_eval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), by="c_custkey")
    return rounded(t.eval("half = c_acctbal.clip(floor_) / 2", local={"floor_": 100}).to_df().select("c_custkey", "half"))


SPEC = """Label,Expression,CAR,WALK
price,o_totalprice / 1000,-0.02,coef_walk
rich,c_acctbal > 5000,0.5,
const,1,,1.5
"""


@query(f"select o_orderkey, {r6('-0.02 * (o_totalprice / 1000) + 0.5 * case when c_acctbal > 5000 then 1 else 0 end')} CAR, {r6('-0.03 * (o_totalprice / 1000) + 1.5')} WALK from {ORDERS_SQL}")
def spec_csv_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = read_spec(SPEC, values={"coef_walk": -0.03})
    return rounded(star(spark, sf_dir, "orders").setup_flow(spec.definitions, dtype="float64").dot(spec.coefficients))


@query(f"select o_orderkey, unnest(['a', 'b']) expressions, unnest([{r6('c_acctbal * 2')}, {r6('o_totalprice + n.n_regionkey')}]) as value from {ORDERS_SQL}")
def eval_many_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(star(spark, sf_dir, "orders").eval_many({"a": "c_acctbal * 2", "b": "o_totalprice + n_regionkey"}, result_type="dataarray"))


@query(f"select o_orderkey, {r6('c_acctbal')} customer_c_acctbal, 5 nothing from {ORDERS_SQL}")
def tree_get_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(star(spark, sf_dir, "orders").get(["customer.c_acctbal", "nothing"], default=5))


@query(f"select c_custkey, {r6('c_acctbal')} bal from customer")
def tree_drop_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir).drop_dims("alt").setup_flow({"bal": "customer.c_acctbal"}, dtype="float64").load())


@query(f"select o_orderkey, {r6('c_acctbal * 2')} bal from {ORDERS_SQL} where o_orderkey % 2 = 0")
def tree_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star(spark, sf_dir, "orders", replacement_filters={"orders": lambda n: n.where("o_orderkey % 2 = 0")})
    return rounded(t.replace_datasets(orders=node(spark, sf_dir, "orders", "o_orderkey")).setup_flow({"bal": "c_acctbal * 2"}, dtype="float64").load())


@query(f"select o_orderkey, o_custkey, {r6('c_acctbal')} c_acctbal, n_name from {ORDERS_SQL}")
def tree_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(star(spark, sf_dir, "orders").merged_dataset(["o_custkey", "c_acctbal", "n_name"]))


@query("select c_custkey, c_acctbal + 1 as bal, c_mktsegment seg from customer")
def store_checkpoint_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.scratch import scratch_path

    c = read(spark, sf_dir, "customer")
    store = DataStore(spark, scratch_path(spark, "store"))
    store.set_data("customer", c.select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), "c_custkey")
    store.make_checkpoint("one")
    store.update("customer", c.select("c_custkey", (F.col("c_acctbal") + 1).alias("bal")))
    store.make_checkpoint("two")
    fresh = DataStore(spark, store.directory, mode="r")
    fresh.restore_checkpoint("two")
    return fresh.get_dataframe("customer")


@query("select c_custkey __row, c_acctbal, c_mktsegment from customer")
def quilt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.scratch import scratch_path

    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__row"), "c_acctbal", "c_mktsegment")
    blocks = BlockTable(spark, scratch_path(spark, "blocks"))
    blocks.write(c.where("__row < 50").select("__row", "c_acctbal"))
    blocks.write(c.select("__row", "c_acctbal"))
    blocks.write(c)
    return blocks.read()


@query(f"select s.o, s.d, s.period, {r6('TIME_')} TIME_ from {TIME_SQL} s")
def tensor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.scratch import scratch_path
    from .sources.tensors import read_node, write_node

    path = scratch_path(spark, "tensor")
    write_node(skims(spark, sf_dir), path, partition_by="period")
    three = next(f.df for f in read_node(spark, path).frames if "period" in f.dims)
    return rounded(three.withColumnRenamed("TIME", "TIME_"))


@query(f"select event_id, {r6('value * 2 + c_acctbal')} v from events left join customer on user_id = c_custkey")
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow that a stream of events goes through, run over all events as a batch; the tests run the stream."""
    return rounded(events_flow(spark, sf_dir).load())


def events_flow(spark: SparkSession, sf_dir: str) -> Flow:
    t = Tree("events", relationships=["events.user_id @ customer.c_custkey"], on_missing="null", events=node(spark, sf_dir, "events", "event_id"), customer=node(spark, sf_dir, "customer", "c_custkey"))
    return t.setup_flow({"v": "events.value * 2 + customer.c_acctbal"}, dtype="float64")


@query(f"select o_orderkey, {r6('p0')} p_a, {r6('p1')} p_b, {r6('p2')} p_c, {r6('ls')} logsum from ({_P})")
def utility_table_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _orders_flow(spark, sf_dir).dot(MODES).withColumnsRenamed({"CAR": "a", "BUS": "b", "WALK": "c"})
    return rounded(choice.utility_to_probability(u, ["a", "b", "c"]).drop("a", "b", "c"))


@query(f"select o_orderkey, case {_pick(_draw(0))} when 0 then 'CAR' when 1 then 'BUS' else 'WALK' end mode from ({_P})")
def choice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_flow(spark, sf_dir).logit_draws(MODES, _draws(1)).select("o_orderkey", choice.labelled(F.col("choice_0"), list(MODES)).alias("mode"))
