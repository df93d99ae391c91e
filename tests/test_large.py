"""Values and sizes that the small tables lack."""

import duckdb
from pyspark.sql import functions as F

from treeflow import queries
from treeflow.plans import Node, Tree


def test_six_places_of_large_values(spark, tmp_path):
    """Quotients from 1e12 on are rounded as the SQL rounds them; infinities stay."""
    sf = "/root/testdata/sf0.001"
    queries.read(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey") + 10**13).write.parquet(f"{tmp_path}/orders.parquet")
    for t in ("customer", "nation", "region"):
        queries.read(spark, sf, t).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("expr_div_zero", "expr_log_family"):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        want = con.sql(queries.ORACLE_SQL[name]).fetchall()
        assert len(got) == 1500 and sorted(tuple(r) for r in got) == sorted(want)


def test_choosers_are_dealt_before_the_product(spark):
    """Cells are not shuffled, and draws are made for each chooser, not for each cell."""
    for name in ("mnl_idca_sample", "mnl_idca_mask", "mnl_idca_logsum"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above = plan.split("BroadcastNestedLoopJoin")[0]
        assert "Window" in above and "Exchange hashpartitioning" not in above and "1000003" not in above
        assert "Exchange hashpartitioning(__root_c_custkey" in plan


def test_draws_of_choosers_cells_and_lookups(spark):
    """Draws may be made of anything in a cell's row; lookups of either side or both, and equal choosers, give the same."""
    who = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, 1)], "who long, grp long")
    alt = spark.range(4).select(F.col("id").alias("alt"))
    groups = Node.table("groups", spark.createDataFrame([(0, 0.0), (1, 0.999999999999)], "g long, r double"), "g", unique=True)
    sizes = Node.table("sizes", spark.createDataFrame([(a, 0.5 * a) for a in range(4)], "s long, size double"), "s", unique=True)
    pairs = Node.tensor("pairs", (("g2", "s2"), spark.createDataFrame([(g, a, 0.5 * a * g) for g in range(2) for a in range(4)], "g2 long, s2 long, v double")), unique=True)
    links = ["cells.grp @ groups.g", "cells.alt @ sizes.s", "cells.grp @ pairs.g2", "cells.alt @ pairs.s2"]
    t = Tree("cells", relationships=links, complete=True, cells=Node.product("cells", ("who", who), ("alt", alt)), groups=groups, sizes=sizes, pairs=pairs)
    f = t.setup_flow({"u": "size + v", "r": "groups.r"}, dtype="float64")
    table = t.nodes["cells"].frames[0].df
    looked_up = next(c for c in f.evaluated().columns if c.startswith("__j") and c.endswith("_r"))
    draws = [F.col(looked_up), F.col("__root_alt") * 0 + F.col("__root_grp") * 0.999999999999, F.col("__root_grp") * 0.999999999999]
    want = {(0, 3), (1, 0), (2, 3)}
    for source in (None, table):  # a table that is given is no product
        out = f.logit_draws({"u": 1.0}, draws, source).collect()
        assert len(out) == 9 and {(r["who"], r["draw"], r["choice"]) for r in out} == {(w, d, c) for w, c in want for d in range(3)}
    assert f.logit_draws({"u": 1.0}, 0).count() == 0
    assert sorted(map(tuple, f.logit_draws({"u": 1.0}, 4, seed=1).collect())) == sorted(map(tuple, f.logit_draws({"u": 1.0}, 4, table, seed=1).collect()))
    assert sorted(map(tuple, f.logit_draws({"u": 1.0}, draws, pick_counted=True).select("who", "choice", "pick_count").collect())) == [(0, 3, 3), (1, 0, 3), (2, 3, 3)]
